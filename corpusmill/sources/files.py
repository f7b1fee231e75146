"""Files as tables: contents, kinds, encodings and text, and archives of rows as sinks."""

from __future__ import annotations

import email
import email.policy
import io
import re
import zipfile
from collections.abc import Iterator
from functools import lru_cache
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusmill.functions.paths import is_excluded
from corpusmill.sources.formats import printable_runs, rtf_text, workbook_text

# First bytes of formats, in the order of the probe.
MAGIC = (("25504446", "pdf"), ("504B0304", "zip"), ("D0CF11E0A1B11AE1", "ole"), ("89504E470D0A1A0A", "png"), ("FFD8FF", "jpeg"), ("47494638", "gif"), ("1F8B", "gzip"), ("7B5C727466", "rtf"))
OLE = bytes.fromhex("D0CF11E0A1B11AE1")
PROBE_BYTES, LEAST_TEXT = 65536, 0.85
MAX_MEMBERS, MAX_MEMBER_BYTES, MAX_RATIO = 1000, 64 << 20, 100
# Header lines that are their own text, an address and words with a blank between each.
PLAIN_ADDRESS = re.compile(r"[A-Za-z0-9!#$%&'*+/^_`{|}~-]+(\.[A-Za-z0-9!#$%&'*+/^_`{|}~-]+)*@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)*")
PLAIN_WORDS = re.compile(r"[!-~]+( [!-~]+)*")
#: Header lines that a worker remembers, and how long they may be.
HEADERS, HEADER_CHARS = 4096, 256


def scan(spark: SparkSession, folder: str) -> DataFrame:
    """path, modified, size, content of every file below folder, without excluded directories."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder)
    return found.where(~is_excluded(F.col("path"))).select("path", F.col("modificationTime").alias("modified"), F.col("length").alias("size"), "content", F.sha2("content", 256).alias("sha256"))


@F.pandas_udf(T.DoubleType())
def text_probability(content: pd.Series) -> pd.Series:
    """Share of printable characters and line breaks in the first bytes: 0 with a NUL, 1 with a byte order mark or if empty."""

    def one(data: bytes) -> float:
        data = bytes(data[:PROBE_BYTES])
        if not data or data.startswith((b"\xef\xbb\xbf", b"\xff\xfe", b"\xfe\xff")):
            return 1.0
        if b"\0" in data:
            return 0.0
        text = data.decode("utf-8", "replace")
        return round(sum((c.isprintable() and c != "�") or c in "\r\n\t" for c in text) / len(text), 4)

    return content.map(lambda d: None if d is None else one(d))


def magic(content: Column) -> Column:
    head, out = F.hex(F.substring(content, 1, 16)), None
    for code, kind in MAGIC:
        out = F.when(head.startswith(code), kind) if out is None else out.when(head.startswith(code), kind)
    return out


def probe(files: DataFrame) -> DataFrame:
    """Adds kind: a format by its first bytes, else text or binary by what the content looks like."""
    return files.withColumn("kind", F.coalesce(magic(F.col("content")), F.when(text_probability("content") >= LEAST_TEXT, "text").otherwise("binary")))


def decode_text(data: bytes) -> tuple[str | None, str | None]:
    """(text, encoding) by mark, then UTF-8, then the Japanese code pages; nothing if none fits."""
    if data.startswith(b"\xef\xbb\xbf"):
        return data.decode("utf-8-sig", "replace"), "utf-8-sig"
    if data.startswith((b"\xff\xfe", b"\xfe\xff")):
        return data.decode("utf-16", "replace"), "utf-16"
    for encoding in ("utf-8", "cp932", "shift_jis"):
        try:
            return data.decode(encoding), encoding
        except UnicodeDecodeError:
            continue
    return None, None


def _office(data: bytes) -> str:
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        parts = sorted(n for n in z.namelist() if n.endswith(".xml") and n.startswith(("word/document", "ppt/slides/slide", "content")))
        return "\n".join(" ".join(ElementTree.fromstring(z.read(n)).itertext()) for n in parts)


@lru_cache(HEADERS)
def _header(name: str, value: str) -> str:
    return email.policy.default.header_fetch_parse(name, value)


class _Headers(email.policy.EmailPolicy):
    """As the default policy, which parses a header by its grammar whenever it is asked for: here lines that mails have in
    common are parsed once, and those that are their own text not at all."""

    def header_fetch_parse(self, name: str, value: str) -> str:
        kind = name.lower()
        if (kind in ("from", "to") and PLAIN_ADDRESS.fullmatch(value)) or (kind == "subject" and "=?" not in value and PLAIN_WORDS.fullmatch(value)):
            return value
        return _header(name, value) if len(value) <= HEADER_CHARS else super().header_fetch_parse(name, value)


_POLICY = _Headers()


def _mail(data: bytes) -> str:
    m = email.message_from_bytes(data, policy=_POLICY)
    lines = [f"{h}: {v}" for h in ("From", "To", "Subject", "Date") if (v := m[h])]
    for part in m.walk():
        if part.get_filename():
            lines.append(f"[attachment] {part.get_filename()}")
        elif part.get_content_type() == "text/plain":
            lines.append(part.get_content())
    return "\n".join(lines)


def _compound(data: bytes) -> str:
    """Printable stretches of a compound file, in either of the encodings that such files use. The file is looked through
    as it lies there, not stream by stream."""
    runs = [run for encoding in ("utf-16-le", "cp932") for run in printable_runs(data.decode(encoding, "ignore"))]
    if not runs:
        raise ValueError("ole_text_not_found")
    return "\n".join(runs)


def _archive(data: bytes) -> str:
    """Text members; members that climb out, link, swell or are too many are named and left out."""
    out = []
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        for k, m in enumerate(z.infolist()):
            bad = m.filename.startswith("/") or ".." in m.filename.split("/") or (m.external_attr >> 16) & 0o170000 == 0o120000
            if k >= MAX_MEMBERS or bad or m.file_size > MAX_MEMBER_BYTES or m.file_size > MAX_RATIO * max(1, m.compress_size):
                out.append(f"[left out] {m.filename}")
            elif not m.is_dir() and (text := decode_text(z.read(m))[0]) is not None:
                out.append(f"[member] {m.filename}\n{text}")
    return "\n".join(out)


def _extract(path: str, data: bytes) -> tuple[str | None, str | None, str | None]:
    ext = "." + path.rsplit(".", 1)[-1].lower() if "." in path.rsplit("/", 1)[-1] else ""
    try:
        if ext in (".xlsx", ".xlsm"):
            return workbook_text(data, path.rsplit("/", 1)[-1]), "workbook", None
        if ext in (".docx", ".pptx", ".odt"):
            return _office(data), "office", None
        if ext == ".rtf":
            return rtf_text(data), "rtf", None
        if ext == ".eml":
            return _mail(data), "mail", None
        if ext == ".zip":
            return _archive(data), "archive", None
        if data.startswith(OLE):
            return _compound(data), "ole-runs", None
        text, encoding = decode_text(data)
        return text, encoding, None if text is not None else "unknown_encoding"
    except (ValueError, KeyError, zipfile.BadZipFile, ElementTree.ParseError, LookupError) as e:
        return None, None, type(e).__name__


def extract(files: DataFrame) -> DataFrame:
    """path, text, extractor, error. Formats are read inside tasks, a batch at a time."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = [(p, *_extract(p, bytes(c))) for p, c in zip(b["path"], b["content"], strict=True)]
            yield pd.DataFrame(rows, columns=["path", "text", "extractor", "error"])

    return files.select("path", "content").mapInPandas(run, "path string, text string, extractor string, error string")


def event_lines(kind: Column, number: Column, data: Column) -> Column:
    """One message of an event stream."""
    return F.format_string("id: %s\nevent: %s\ndata: %s\n\n", number.cast("string"), kind, data)


def receipt_json(fields: list[str]) -> Column:
    """A receipt as a line of JSON."""
    return F.to_json(F.struct(*fields), {"ignoreNullFields": "false"})


def receipt_markdown(title: str, fields: list[str]) -> Column:
    """A receipt as Markdown: a title and a list."""
    lines = [F.concat(F.lit(f"- {f}: "), F.coalesce(F.col(f).cast("string"), F.lit("-")), F.lit("\n")) for f in fields]
    return F.concat(F.lit("# "), F.col(title), F.lit("\n\n"), *lines)
