"""Text functions. Patterns start with (?Ud): Unicode classes, and only \\n ends a line."""

from __future__ import annotations

import json
import re
import sys
import unicodedata
from collections.abc import Callable
from functools import lru_cache, reduce

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: What counts as a secret, in the order of redaction.
SECRET_PATTERNS = (
    r"-----BEGIN (?:RSA |EC |OPENSSH )?PRIVATE KEY-----",
    r"\b(?:sk|ghp|github_pat)_[A-Za-z0-9_-]{20,}\b",
    r"(?i)\b(?:password|passwd|secret|api[_-]?key)\s*[:=]\s*[\"']?[^\s\"']{8,}",
    r"(?im)^[^\r\n]*(?:パスワード|暗証番号|秘密鍵|認証キー)[^\r\n]*$",
    r"(?im)^\s*(?:ユーザー(?:名)?|ユーザ(?:名)?|アカウント(?:名)?|ログイン(?:名)?|接続先|ホスト(?:名)?|IP(?:アドレス)?|endpoint|host(?:name)?|user(?:name)?)\s*[:：=\t][^\r\n]*$",
    r"(?i)\b(?:https?|ssh|svn)://[^\s/:]+:[^\s/@]+@[^\s]+",
    r"(?i)(?<![A-Za-z0-9._/-])[A-Za-z][A-Za-z0-9._-]{2,31}/(?=[^\s/]{8,64}(?:\s|$))(?=[^\s/]*[A-Za-z])(?=[^\s/]*\d)(?=[^\s/]*[^A-Za-z0-9\s/])[^\s/]{8,64}",
)
#: What counts as an injected instruction.
INJECTION_PATTERNS = (r"(?i)ignore (?:all |the )?(?:previous|prior) instructions", r"(?i)system prompt", r"(?i)developer message")
REDACTED = "[REDACTED_SECRET]"
DIALECT = "(?Ud)"


def py_strip(c: Column) -> Column:
    """Strip every Unicode blank at both ends."""
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


#: A few ranges around all letters but ß whose folding is not their lower case: texts without them need no more.
FOLDS_OTHERWISE = r"[\x{b5}\x{149}\x{17f}\x{1f0}\x{345}-\x{590}\x{13a0}-\x{1ffc}\x{ab53}-\x{abbf}\x{fb00}-\x{fb17}]"


@lru_cache(maxsize=1)
def _folding() -> str:
    """What case folding does to lower-case letters, as a JSON object."""
    return json.dumps({c.lower(): c.casefold() for c in map(chr, range(sys.maxunicode + 1)) if len(c.lower()) == 1 and c.lower() != c.casefold()})


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body of a value that is computed once, however often body uses it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def fold(c: Column) -> Column:
    """Case folding: lower case, ß as ss, and for the few texts with other letters that fold otherwise (final sigma,
    ligatures, long s) one letter after the other."""
    table = F.from_json(F.lit(_folding()), "map<string,string>")
    letters = F.regexp_extract_all(F.lower(c), F.lit("(?s)(.)"), F.lit(1))
    full = F.array_join(F.transform(letters, lambda x: F.coalesce(F.try_element_at(table, x), x)), "")
    return F.when(F.lower(c).rlike(FOLDS_OTHERWISE), full).otherwise(F.replace(F.lower(c), F.lit("ß"), F.lit("ss")))


@F.pandas_udf(T.StringType())
def fold_unicode(texts: pd.Series) -> pd.Series:
    """Compatibility form, stripped, fully folded; no built-in function does this."""
    return texts.map(lambda t: None if t is None else unicodedata.normalize("NFKC", t).strip().casefold())


def search_projection(c: Column, limit: int = 4000) -> Column:
    """One blank between words, at most `limit` characters."""
    return F.substring(F.trim(F.regexp_replace(c, r"(?U)\s+", " ")), 1, limit)


def normalise_lines(c: Column) -> Column:
    """No NUL, one kind of line end, no blanks at the ends of lines or of the text."""
    lines = F.regexp_replace(F.replace(c, F.lit("\x00"), F.lit("")), "\r\n?", "\n")
    return py_strip(F.regexp_replace(lines, r"(?Umd)[\s&&[^\n]]+$", ""))


def token_estimate(c: Column) -> Column:
    return F.greatest(F.lit(1), F.floor(F.char_length(c) / 4)).cast("long")


def redact(c: Column, patterns: tuple[str, ...] = SECRET_PATTERNS, mark: str = REDACTED) -> Column:
    for p in patterns:
        c = F.regexp_replace(c, DIALECT + p, mark)
    return c


def matches_any(c: Column, patterns: tuple[str, ...]) -> Column:
    found = F.lit(False)
    for p in patterns:
        found = found | c.rlike(DIALECT + p)
    return found


def scan_text(c: Column) -> Column:
    """safe_text, and whether the text as given holds secrets or injected instructions."""
    return F.struct(redact(c).alias("safe_text"), matches_any(c, SECRET_PATTERNS).alias("secret_detected"), matches_any(c, INJECTION_PATTERNS).alias("prompt_injection_detected"))


def html_escape(c: Column) -> Column:
    for mark, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;")):
        c = F.replace(c, F.lit(mark), F.lit(entity))
    return c


def line_count(c: Column) -> Column:
    return (F.char_length(c) - F.char_length(F.replace(c, F.lit("\n"), F.lit(""))) + 1).cast("long")


# What a search term is.
CJK_RUN = r"([぀-ヿ㐀-鿿]+)"
TERM = r"([a-z_][a-z0-9_.:/-]*|[0-9]+|[぀-ヿ㐀-鿿]+)"


def search_terms(c: Column) -> Column:
    """Distinct words, numbers and CJK runs of two characters or more, and all pairs and triples within CJK runs."""
    folded = fold(c)
    words = F.filter(F.regexp_extract_all(folded, F.lit(TERM), F.lit(1)), lambda w: F.char_length(w) > 1)
    runs = F.regexp_extract_all(folded, F.lit(CJK_RUN), F.lit(1))

    def grams(width: int) -> Column:
        last = lambda run: F.char_length(run) - width + 1
        return F.flatten(F.transform(runs, lambda run: F.when(last(run) > 0, F.transform(F.sequence(F.lit(1), F.greatest(last(run), F.lit(1))), lambda i: F.substring(run, i, F.lit(width)))).otherwise(F.array().cast("array<string>"))))

    return F.array_distinct(F.concat(words, grams(2), grams(3)))


# Labels before identities in a query, and its tokens.
LABELLED = r"(?im)(?:organization\s*code|organization\s*name|code|正式名|略称)\s*[:：]\s*([^\r\n,{}\[\]\"]{2,128})"
LEXICAL = r"[A-Za-z][A-Za-z0-9_.:/-]{1,63}|\d{2,12}|[぀-ヿ㐀-鿿]{2,32}"


def query_terms(query: str, limit: int = 12) -> list[str]:
    """The terms that a constant query is searched by, most telling first: values behind a label, the query itself, its
    tokens as written, then words, numbers and CJK grams from short to long. Terms are folded, distinct, two characters
    or more, and at most `limit`."""
    folded = query.casefold()
    found = [m.group(1) for m in re.finditer(LABELLED, query)]
    if len(query.strip()) in range(2, 129):
        found.append(query)
    found += [m.group() for m in re.finditer(LEXICAL, query)]
    grams = {m.group() for m in re.finditer(TERM, folded)}
    for m in re.finditer(CJK_RUN, folded):
        grams.update("".join(g) for n in (2, 3) for g in zip(*(m.group()[k:] for k in range(n)), strict=False))
    found += sorted(filter(lambda g: len(g) > 1, grams), key=lambda g: (len(g), g))
    terms: dict[str, None] = {}
    for term in (t.strip().casefold() for t in found):
        if len(term) >= 2 and len(terms) < limit:
            terms.setdefault(term)
    return list(terms)


def term_hits(c: Column, terms: list[str]) -> Column:
    """How many of the terms occur."""
    return let(fold(c), lambda folded: reduce(lambda n, t: n + folded.contains(t).cast("int"), terms, F.lit(0)))


def error_fingerprint(project: Column, source: Column, kind: Column, message: Column) -> Column:
    """Numbers of four digits or more and identifiers are alike; blanks are one; 1,000 characters count."""
    plain = F.regexp_replace(F.lower(message), r"(?U)\b[0-9a-f]{8}-[0-9a-f-]{27,}\b|\b\d{4,}\b", "{id}")
    plain = F.substring(py_strip(F.regexp_replace(plain, r"(?U)\s+", " ")), 1, 1000)
    return F.sha2(F.concat_ws("|", project, source, F.coalesce(kind, F.lit("")), plain), 256)


def task_fingerprint(prompt: Column, words: int = 12) -> Column:
    """A digest of the first words of a prompt."""
    return F.sha2(F.array_join(F.slice(F.split(F.lower(py_strip(prompt)), r"(?U)\s+"), 1, words), " "), 256)


# Marks of an overflow, the message that stands for all of them, and the one of an error without any.
OVERFLOW_MARKS = ("NumericValueOutOfRange", "integer out of range")
OVERFLOW_MESSAGE = "文件元数据大小超出数据库字段范围，完整技术日志已保留。"
NO_MESSAGE = "知识学习失败"


def first_line(c: Column, limit: int = 300) -> Column:
    """What an error says: its first line that is not blank (lines end at \\n, \\r or both), cut to `limit`; one message
    for all overflows, and a default for none."""
    line = F.try_element_at(F.filter(F.transform(F.split(c, "[\\r\\n]"), py_strip), lambda x: x != ""), F.lit(1))
    overflow = reduce(lambda a, b: a | b, [c.contains(m) for m in OVERFLOW_MARKS])
    return F.when(overflow, OVERFLOW_MESSAGE).otherwise(F.coalesce(F.substring(line, 1, limit), F.lit(NO_MESSAGE)))


def symbol_score(name: Column, qualified: Column, path: Column, query: str, terms: list[str]) -> Column:
    """How well a symbol fits a query: 10 for the same name, else points for names and path inside it, and terms."""
    q = F.lit(query.casefold())
    inside = lambda c, points: F.when((c != "") & F.contains(q, c), float(points)).otherwise(0.0)

    def points(s: Column) -> Column:
        n, u, p = s["n"], s["u"], s["p"]
        hits = reduce(lambda h, t: h + (n.contains(t) | u.contains(t)).cast("double"), terms, F.lit(0.0))
        return F.when((n == q) | (u == q), 10.0).otherwise(inside(n, 6) + inside(u, 7) + inside(p, 5) + hits)

    return let(F.struct(fold(name).alias("n"), fold(qualified).alias("u"), fold(path).alias("p")), points)


def shortcut_text(path: Column, status: Column, target: Column, kind: Column) -> Column:
    """What a shortcut says; lines without a value are left out."""
    line = lambda key, value: F.concat(F.lit(f"{key}: "), F.nullif(value, F.lit("")))
    return F.concat_ws("\n", line("relative_path", path), F.lit("entry_type: windows_shortcut"), line("shortcut_target_status", status), line("shortcut_target_path", target), line("shortcut_target_kind", kind))


def grams(c: Column, width: int = 3) -> Column:
    """The distinct stretches of `width` characters of a text, found in one pass over it."""
    return F.array_distinct(F.regexp_extract_all(c, F.lit(f"(?s)(?=(.{{{width}}}))"), F.lit(1)))


def contains_cjk(c: Column) -> Column:
    return c.rlike(r"[㐀-䶿一-鿿]")


def plain_url(c: Column) -> Column:
    """Without the credentials."""
    return F.regexp_replace(c, r"://[^/@\s]+@", "://")
