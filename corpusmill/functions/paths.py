"""Functions of file paths: parts, history, routing, capabilities and conversion decisions."""

from __future__ import annotations

import sys
import unicodedata
from functools import lru_cache

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Extensions by how their files are treated.
METADATA_ONLY = (".7z", ".bak", ".backup", ".bin", ".bkp", ".bz2", ".dmp", ".dump", ".ear", ".gz", ".img", ".iso", ".jar", ".rar", ".tar", ".tgz", ".vhd", ".vhdx", ".war", ".xz")
CODE = (".c", ".cpp", ".cs", ".go", ".h", ".java", ".js", ".jsx", ".kt", ".php", ".ps1", ".py", ".rb", ".rs", ".sh", ".sql", ".ts", ".tsx")
TEXT = (".c", ".cfg", ".conf", ".cpp", ".cs", ".css", ".csv", ".go", ".h", ".html", ".ini", ".java", ".js", ".json", ".jsx", ".kt", ".log", ".md", ".php", ".properties", ".ps1", ".py", ".rb", ".rs", ".rst", ".sh", ".sql", ".toml", ".ts", ".tsx", ".txt", ".xml", ".yaml", ".yml")
OFFICE = (".docx", ".pptx", ".xlsx", ".xlsm", ".odt")
SUPPORTED = (*TEXT, *OFFICE, ".pdf")
OTHER_DOCUMENT = (".bmp", ".doc", ".eml", ".gif", ".jpeg", ".jpg", ".msg", ".png", ".ppt", ".rtf", ".tif", ".tiff", ".xls", ".zip")
TEMPORARY_OFFICE = (".docx", ".pptx", ".xlsx", ".xlsm")
PLANNED_OCR = (".bmp", ".gif", ".jpeg", ".jpg", ".png", ".tif", ".tiff")
PLANNED_TEXT = ("", ".0", ".bat", ".chm", ".cnf", ".config", ".csproj", ".ctl", ".def", ".doc", ".eml", ".en", ".euc-kr", ".hlp", ".htm", ".ja", ".jrxml", ".jsp", ".licenses", ".msg", ".org", ".ovpn", ".oxps", ".policy", ".ppt", ".rdp", ".resx", ".rpt", ".rtf", ".settings", ".utf8", ".var", ".vbs", ".xls", ".zh", ".zh-cn", ".zh_tw")
NEVER_EXTRACT = (".app", ".class", ".cpl", ".dll", ".dylib", ".exe", ".ko", ".lib", ".msi", ".ocx", ".pdb", ".so")
SENSITIVE = (".cer", ".crt", ".key", ".p12", ".pem", ".pfx", ".ppk")
DUMP_NAME = r"(?i)(^|[._-])(backup|database[-_]?dump|db[-_]?dump|dump|export)([._-]|$)"
# Directories that hold old copies.
HISTORY_NAMES = ("old", "旧", "back", "backup", "bak", "バックアップ")
HISTORY_PREFIXES = ("旧_", "旧-")
# Parts of paths that a scan leaves out.
EXCLUDED_PARTS = (".git", ".idea", ".pytest_cache", ".svn", ".venv", "build", "coverage", "dist", "node_modules", "target", "vendor")


def name(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def suffix(path: Column) -> Column:
    """The last extension with its dot, in lower case; none for names that only start or end with a dot."""
    return F.lower(F.regexp_extract(name(path), r"^.+(\.[^.]+)$", 1))


def stem(path: Column) -> Column:
    return F.regexp_replace(name(path), r"(?<=.)\.[^.]+$", "")


def parents(path: Column) -> Column:
    parts = F.split(path, "/")
    return F.filter(F.slice(parts, 1, F.size(parts) - 1), lambda p: ~p.isin("", "."))


def root_segment(path: Column) -> Column:
    return F.split_part(F.translate(path, "\\", "/"), F.lit("/"), F.lit(1))


def under(path: Column, prefix: Column | str) -> Column:
    """path is prefix or lies below it."""
    p = prefix if isinstance(prefix, Column) else F.lit(prefix)
    return (path == p) | path.startswith(F.concat(p, F.lit("/")))


@lru_cache(maxsize=1)
def _compatible() -> tuple[dict[str, str], dict[str, str]]:
    """Characters, and pairs of a letter and a mark, that are a character of the history names in compatibility form."""
    needed = set("".join((*HISTORY_NAMES, *HISTORY_PREFIXES))) | set("#history/")
    form = lambda t: unicodedata.normalize("NFKC", t).casefold()
    like: dict[str, list[str]] = {}
    for c in map(chr, range(128, sys.maxunicode + 1)):
        like.setdefault(unicodedata.normalize("NFKD", c), []).append(c)
        like.setdefault(form(c), []).append(c)
    one = {c: n for n in sorted(needed) for c in like.get(n, []) if c != n and form(c) == n}
    marked = [(n, unicodedata.normalize("NFKD", n)) for n in sorted(needed) if len(unicodedata.normalize("NFKD", n)) == 2]
    pairs = {b + m: n for n, (base, mark) in marked for b in {base, *like.get(base, [])} for m in {mark, *like.get(mark, [])} if form(b + m) == n}
    return one, pairs


def compatible(path: Column) -> Column:
    """path with every character that the names of old copies are made of in compatibility form; others stay."""
    one, pairs = _compatible()
    out = path
    for pair, n in pairs.items():
        out = F.replace(out, F.lit(pair), F.lit(n))
    out = F.translate(out, "".join(one), "".join(one.values()))
    return F.when(path.rlike(r"[^\x00-\x7f]"), out).otherwise(path)


def is_historical(path: Column) -> Column:
    """A path into a history, or below a directory of old copies, in whatever width its letters are written."""
    path = compatible(path)
    parts = F.split(F.translate(path, "\\", "/"), "/")
    folded = F.transform(F.slice(parts, 1, F.size(parts) - 1), lambda s: F.regexp_replace(F.lower(s), r"(?U)\s+", ""))
    old = lambda s: s.isin(*HISTORY_NAMES) | s.startswith(HISTORY_PREFIXES[0]) | s.startswith(HISTORY_PREFIXES[1])
    return F.lower(path).contains("#history/") | F.exists(folded, old)


def contained(path: Column, root: Column) -> Column:
    """Whether a path lies in a root or is it, part by part, once its own steps up are taken; one that climbs out does not."""
    parts = lambda c: F.filter(F.split(F.translate(c, "\\", "/"), "/"), lambda p: ~p.isin("", "."))
    # a step up takes the part before it; where there is none it stays, and so matches no root
    taken = F.aggregate(parts(path), F.array().cast("array<string>"), lambda done, p: F.when((p == "..") & (F.size(done) > 0) & (F.try_element_at(done, F.lit(-1)) != ".."), F.slice(done, 1, F.greatest(F.size(done) - 1, F.lit(0)))).otherwise(F.array_append(done, p)))
    own = parts(root)
    return F.slice(taken, 1, F.size(own)) == own


def scanned(files: DataFrame) -> DataFrame:
    """files (path) -> path, kind, depth, folded: all files and the directories above them, in what order a scan by levels
    meets them: sort by depth, then folded, then path. A directory that is left out is met, but nothing below it."""
    parts = F.split("path", "/")
    depths = F.sequence(F.lit(1), F.size(parts))
    levels = files.where("path <> ''").distinct().select(F.size(parts).alias("n"), parts.alias("parts"), F.explode(depths).alias("depth"))
    met = levels.select(F.slice("parts", 1, F.col("depth")).alias("parts"), "depth", F.when(F.col("depth") < F.col("n"), "directory").otherwise("file").alias("kind")).distinct()
    above = F.slice("parts", 1, F.col("depth") - 1)
    seen = met.where(~F.arrays_overlap(above, F.array(*map(F.lit, EXCLUDED_PARTS))))
    return seen.select(F.array_join("parts", "/").alias("path"), "kind", "depth", F.transform("parts", lambda p: F.lower(p)).alias("folded"))


def is_excluded(path: Column) -> Column:
    return F.arrays_overlap(F.split(path, "/"), F.array(*map(F.lit, EXCLUDED_PARTS)))


def route(path: Column, size: Column, most: Column | int) -> Column:
    """(mode, reason); the first rule that fits decides."""
    ext, base = suffix(path), name(path)
    to = lambda mode, reason: F.struct(F.lit(mode).alias("mode"), F.lit(reason).cast("string").alias("reason"))
    return (
        F.when(base.startswith("~$") & ext.isin(*TEMPORARY_OFFICE), to("metadata_only", "temporary_office_file"))
        .when(ext == ".lnk", to("path_only", "windows_shortcut"))
        .when(ext.isin(*METADATA_ONLY), to("metadata_only", "metadata_only_policy"))
        .when(size > most, to("metadata_only", "file_too_large"))
        .when((ext == ".sql") & base.rlike(DUMP_NAME), to("metadata_only", "database_dump_policy"))
        .when(size == 0, to("path_only", "empty_file_path_only"))
        .when(ext.isin(*CODE), to("code", None))
        .when(ext.isin(*SUPPORTED, *OTHER_DOCUMENT), to("document", None))
        .otherwise(to("document", "content_probe_required"))
    )


def semantic_text(path: Column, reason: Column) -> Column:
    """Six lines that say what a path says."""
    line = lambda key, value: F.concat(F.lit(f"{key}: "), value)
    return F.concat_ws(
        "\n", line("relative_path", path), line("file_name", name(path)), line("file_stem", stem(path)), line("extension", suffix(path)),
        line("directories", F.array_join(parents(path), " / ")), line("entry_state", reason),
    )


def capability(ext: Column, mode: Column) -> Column:
    e = F.lower(ext)
    return (
        F.when((mode == "path_only") | (e == ".lnk"), "path_knowledge")
        .when(e.isin(*SUPPORTED), "supported_text")
        .when(e.isin(*PLANNED_OCR), "planned_ocr")
        .when(e.isin(*PLANNED_TEXT), "planned_text")
        .when(e.isin(*METADATA_ONLY), "safe_unpack_candidate")
        .when(e.isin(*NEVER_EXTRACT), "binary_metadata")
        .when(e.isin(*SENSITIVE), "sensitive_metadata")
        .otherwise("content_probe_required")
    )


def lifecycle(present: Column, status: Column, mode: Column, has_document: Column, active: Column) -> Column:
    """active: the entry was last seen by the run that is under way."""
    return (
        F.when(~present | (status == "removed"), "removed")
        .when((status == "indexed") & has_document, "indexed")
        .when(status.isin("rejected", "failed", "extraction_failed"), "rejected")
        .when(active, "processing")
        .when((mode == "metadata_only") | (status == "metadata_only"), "metadata_only")
        .when((mode == "path_only") & has_document, "indexed")
        .otherwise("discovered")
    )


def conversion(life: Column, mode: Column, reason: Column, has_document: Column, able: Column) -> Column:
    """(action, reason)."""
    to = lambda action, why: F.struct(F.lit(action).alias("action"), why.alias("reason"))
    say = F.lit
    return (
        F.when(life == "removed", to("metadata_only", say("historical_removed")))
        .when(mode == "path_only", to("path_only", F.coalesce(reason, say("path_semantic"))))
        .when((life == "indexed") & has_document, to("backfill_object", say("indexed_without_artifact")))
        .when(able == "safe_unpack_candidate", to("safe_unpack", say("container_requires_sandbox")))
        .when(able.isin("binary_metadata", "sensitive_metadata"), to("metadata_only", able))
        .when(able.isin("planned_text", "planned_ocr", "content_probe_required"), to("reclean", able))
        .when(life == "rejected", to("reclean", F.coalesce(reason, say("prior_rejection"))))
        .when(life.isin("processing", "discovered"), to("reclean", say("content_not_indexed")))
        .otherwise(to("metadata_only", F.coalesce(reason, say("policy_metadata"))))
    )


def source_key(kind: Column, location: Column, reference: Column, subpath: Column, scope: Column) -> Column:
    """The identity of a source; file locations ignore case, and slashes at their ends."""
    from corpusmill.functions.text import fold, py_strip

    place = F.regexp_replace(py_strip(location), r"[/\\]+$", "")
    place = F.when(kind.isin("local_directory", "network_share"), fold(place)).otherwise(place)
    below = F.regexp_replace(F.translate(F.coalesce(subpath, F.lit("")), "\\", "/"), "^/+|/+$", "")
    return F.sha2(F.concat_ws("\n", kind, place, py_strip(F.coalesce(reference, F.lit(""))), below, scope), 256)


def object_key(digest: Column) -> Column:
    """Where content with this SHA-256 lies in an object store; null for anything else."""
    return F.when(digest.rlike("^[0-9a-f]{64}$"), F.concat_ws("/", F.lit("sha256"), F.substring(digest, 1, 2), F.substring(digest, 3, 2), digest))
