"""Decision tables and small arithmetic."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Commands that are refused, and commands that need no approval.
FORBIDDEN = (r"(?i)(^|\s)(rm|rmdir)\s+(-[^\s]*r|/s)\b", r"(?i)\bgit\s+(reset\s+--hard|clean\s+-[^\s]*f)", r"(?i)\b(format|diskpart|cipher\s+/w)\b", r"(?i)\b(remove-item)\b.*\b-recurse\b.*\b-force\b")
SAFE = (
    r"(?i)^\s*(rg|git\s+(status|diff|log|show)|pytest|python\s+-m\s+pytest)\b", r"(?i)^\s*git\s+(clone|ls-remote|rev-parse)\b", r"(?i)^\s*svn\s+(info|export)\b",
    r"(?i)^\s*(npm|pnpm)\s+(test|run\s+(test|build|lint))\b", r"(?i)^\s*(get-childitem|get-content|select-string)\b", r"(?i)^\s*tesseract\s+ocr\b",
)
# Words that place a failure on a side, in order, with the confidence.
BOUNDARIES = (
    ("credential", 0.96, ("authentication", "credential", "unauthorized", "permission denied", "access denied", "errno 86", "认证", "凭据", "授权")),
    ("external", 0.88, ("network", "connection refused", "timeout", "redis", "postgres", "ollama", "unavailable", "网络", "连接")),
    ("scope", 0.95, ("out_of_scope", "policy_scope", "legal_boundary")),
)
INTERNAL = ("internal", 0.84)
PRIORITIES = {"critical": 300, "high": 200, "medium": 100, "low": 50}


def any_of(c: Column, patterns: tuple[str, ...]) -> Column:
    found = F.lit(False)
    for p in patterns:
        found = found | c.rlike(p)
    return found


def command_policy(subject: Column, kind: Column) -> Column:
    from corpusmill.functions.text import py_strip

    s = py_strip(subject)
    return F.when(kind == "file_change", "allow").when(any_of(s, FORBIDDEN), "deny").when(any_of(s, SAFE), "allow").otherwise("approval_required")


def boundary(text: Column) -> Column:
    """(boundary, confidence) by the first list with a word in text."""
    low, out = F.lower(text), None
    for name, confidence, words in BOUNDARIES:
        found = F.lit(False)
        for w in words:
            found = found | low.contains(w)
        value = F.struct(F.lit(name).alias("boundary"), F.lit(confidence).alias("confidence"))
        out = F.when(found, value) if out is None else out.when(found, value)
    return out.otherwise(F.struct(F.lit(INTERNAL[0]).alias("boundary"), F.lit(INTERNAL[1]).alias("confidence")))


def severity_priority(severity: Column) -> Column:
    table = F.create_map(*[F.lit(x) for kv in PRIORITIES.items() for x in kv])
    return F.coalesce(F.try_element_at(table, severity), F.lit(100))


def retry_seconds(attempt: Column) -> Column:
    return F.least(F.lit(60.0), F.pow(F.lit(2.0), attempt - 1)).cast("long")


def retry_minutes(failures: Column, interval: Column) -> Column:
    return F.least(interval, F.lit(5) * F.pow(F.lit(2.0), F.least(failures - 1, F.lit(6)))).cast("long")


def clamp(c: Column, low: float = 0.0, high: float = 1.0) -> Column:
    return F.greatest(F.lit(low), F.least(c, F.lit(high)))


def applicable(start: Column, end: Column, at: Column) -> Column:
    """at lies in [start, end); a null bound is open."""
    return (start.isNull() | (start <= at)) & (end.isNull() | (at < end))


def resolution_mode(side: Column, proposed: Column) -> Column:
    """What a proposed way to resolve an issue becomes on the side that it lies on."""
    return (
        F.when(side == "scope", "out_of_scope")
        .when(side.isin("external", "credential"), F.when(proposed == "mixed", "mixed").otherwise("external"))
        .when((side == "internal") & proposed.isin("agent", "human_code", "mixed", "undetermined"), proposed)
        .otherwise("undetermined")
    )


# Errors that are input errors or failures of a tool, by the names of their classes.
READ_ERRORS = ("OSError", "BlockingIOError", "ConnectionError", "FileNotFoundError", "InterruptedError", "IsADirectoryError", "NotADirectoryError", "TimeoutError")
RUN_ERRORS = ("RuntimeError", "NotImplementedError", "RecursionError")


def rejection_reason(error: Column, path: Column, own: Column | None = None) -> Column:
    """Why a file was rejected: the reason that the error brings itself, else one by its class, and for PDF by the file."""
    from corpusmill.functions.paths import suffix

    by_class = (
        F.when(error == "UnicodeDecodeError", "encoding_unsupported").when(error == "BadZipFile", "office_archive_invalid").when(error == "PermissionError", "file_permission_denied")
        .when(error.isin(*READ_ERRORS), "file_read_error").when(suffix(path) == ".pdf", "pdf_unreadable").when(error.isin(*RUN_ERRORS), "extractor_unavailable").otherwise("extractor_rejected")
    )
    return by_class if own is None else F.coalesce(own, by_class)


# Kinds of repositories that a field may name.
REPOSITORY_TYPES = ("svn", "subversion", "git", "gitlab", "github", "tfs")


def extraction_reasons(contracts: dict[str, tuple[str, tuple[str, ...]]], allowed: list[int], cited: Column) -> Column:
    """Every reason to refuse an extracted field (columns field_code, value, option_id, confidence, evidence), in order.

    contracts: field -> its type and options; allowed: the pieces of evidence that were shown; cited: their text."""
    code, value, option, confidence, evidence = (F.col(c) for c in ("field_code", "value", "option_id", "confidence", "evidence"))
    of_type = lambda *types: code.isin(*[c for c, (t, _) in contracts.items() if t in types])
    choices = [(c, o) for c, (t, o) in contracts.items() if t in ("enum", "master_reference")]
    allows = F.lit(False)
    for c, options in choices:
        allows = allows | ((code == c) & F.coalesce(option.isin(*options), F.lit(False)))
    choosing = of_type("enum", "master_reference")
    objects = F.from_json(value, "array<struct<repository_type:string>>")
    named = F.transform(objects, lambda o: F.lower(F.trim(o["repository_type"])))
    fits = F.coalesce(F.forall(named, lambda t: t.isNotNull()), F.lit(False))
    uncited = F.exists(named, lambda t: ~F.coalesce(t.isin(*REPOSITORY_TYPES) & F.contains(F.lower(cited), t), F.lit(False)))
    shown = F.coalesce((F.size(evidence) > 0) & F.forall(evidence, lambda x: x.isin(*allowed)), F.lit(False))
    reasons = (
        (~code.isin(*contracts), "field_not_requested"), (~shown, "evidence_not_authoritative"), (~F.coalesce(confidence.between(0, 1), F.lit(False)), "confidence_invalid"),
        (choosing & ~allows, "option_not_allowed"), (~choosing & option.isNotNull(), "option_not_applicable"), (of_type("object_list") & ~fits, "object_schema_invalid"),
        (F.coalesce(value, F.lit("")) == "", "value_empty"), ((code == "repositories") & F.coalesce(uncited, F.lit(False)), "repository_type_not_cited"),
    )
    return F.array_compact(F.array(*[F.when(hit, reason) for hit, reason in reasons]))
