"""Sources, files, manifests, snapshots and versions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corpusmill.functions import paths as P
from corpusmill.functions import rules as R
from corpusmill.operators import merge as M
from corpusmill.sources.tables import EXTENSIONS, entries, read

_EXT = f"list_extract([{', '.join(repr(e) for e in EXTENSIONS)}], CAST(doc_id % {len(EXTENSIONS)} + 1 AS INT))"
_ENTRIES = f"""e AS (SELECT doc_id, source, lang, n_chars, source || '/' || lang || '/doc_' || doc_id || {_EXT} AS path, {_EXT} AS ext, doc_id % 17 <> 0 AS present,
  CASE doc_id % 5 WHEN 0 THEN 'indexed' WHEN 1 THEN 'rejected' WHEN 2 THEN 'metadata_only' ELSE 'observed' END AS status, doc_id % 3 <> 0 AS has_document, doc_id % 7 = 0 AS active FROM documents)"""
MOST = 20_000


_ROUTE = f"""CASE WHEN ext = '.lnk' THEN 'path_only|windows_shortcut' WHEN ext IN ('.gz') THEN 'metadata_only|metadata_only_policy' WHEN n_chars > {MOST} THEN 'metadata_only|file_too_large'
  WHEN n_chars = 0 THEN 'path_only|empty_file_path_only' WHEN ext IN ('.py', '.sql') THEN 'code|' WHEN ext IN ('.txt', '.md', '.doc', '.zip', '.png') THEN 'document|' ELSE 'document|content_probe_required' END"""
_ROUTED = f"{_ENTRIES}, r AS (SELECT *, split_part({_ROUTE}, '|', 1) AS mode, nullif(split_part({_ROUTE}, '|', 2), '') AS reason FROM e)"
_MANIFEST = f"""{_ROUTED}, c AS (SELECT *, CASE WHEN mode = 'path_only' OR ext = '.lnk' THEN 'path_knowledge' WHEN ext IN ('.txt', '.py', '.sql', '.md') THEN 'supported_text' WHEN ext IN ('.png') THEN 'planned_ocr'
    WHEN ext IN ('.doc') THEN 'planned_text' WHEN ext IN ('.gz') THEN 'safe_unpack_candidate' WHEN ext IN ('.exe') THEN 'binary_metadata' WHEN ext IN ('.pem') THEN 'sensitive_metadata' ELSE 'content_probe_required' END AS capability,
    CASE WHEN NOT present OR status = 'removed' THEN 'removed' WHEN status = 'indexed' AND has_document THEN 'indexed' WHEN status IN ('rejected', 'failed', 'extraction_failed') THEN 'rejected' WHEN active THEN 'processing'
    WHEN mode = 'metadata_only' OR status = 'metadata_only' THEN 'metadata_only' WHEN mode = 'path_only' AND has_document THEN 'indexed' ELSE 'discovered' END AS lifecycle FROM r),
m AS (SELECT *, CASE WHEN lifecycle = 'removed' THEN 'metadata_only|historical_removed' WHEN mode = 'path_only' THEN 'path_only|' || coalesce(reason, 'path_semantic') WHEN lifecycle = 'indexed' AND has_document THEN 'backfill_object|indexed_without_artifact'
    WHEN capability = 'safe_unpack_candidate' THEN 'safe_unpack|container_requires_sandbox' WHEN capability IN ('binary_metadata', 'sensitive_metadata') THEN 'metadata_only|' || capability WHEN capability IN ('planned_text', 'planned_ocr', 'content_probe_required') THEN 'reclean|' || capability
    WHEN lifecycle = 'rejected' THEN 'reclean|' || coalesce(reason, 'prior_rejection') WHEN lifecycle IN ('processing', 'discovered') THEN 'reclean|content_not_indexed' ELSE 'metadata_only|' || coalesce(reason, 'policy_metadata') END AS decided FROM c)"""


def source_key(spark: SparkSession, d: str) -> DataFrame:
    s = read(spark, d, "documents").select("source", "lang").distinct()
    kind = F.when(F.col("lang") == "en", "local_directory").otherwise("git")
    key = P.source_key(kind, F.concat(F.lit("  /Srv/"), "source", F.lit("//")), F.lit(None).cast("string"), F.concat(F.lit("/"), "lang", F.lit("\\sub/")), F.lit("tenant"))
    return s.select("source", "lang", key.alias("source_key"))


def file_routing(spark: SparkSession, d: str) -> DataFrame:
    e = entries(read(spark, d, "documents"))
    return e.select("doc_id", "path", P.route(F.col("path"), F.col("n_chars"), MOST).alias("r")).select("doc_id", "path", "r.mode", "r.reason")


def path_semantic_text(spark: SparkSession, d: str) -> DataFrame:
    e = entries(read(spark, d, "documents"))
    return e.select("doc_id", P.semantic_text(F.col("path"), F.lit("observed")).alias("text"), P.object_key(F.sha2("path", 256)).alias("object_key"))


def manifest(e: DataFrame) -> DataFrame:
    r = e.withColumn("r", P.route(F.col("path"), F.col("n_chars"), MOST)).withColumn("mode", F.col("r.mode")).withColumn("reason", F.col("r.reason"))
    c = r.withColumn("capability", P.capability(F.col("ext"), F.col("mode"))).withColumn("lifecycle", P.lifecycle(*map(F.col, ("present", "status", "mode", "has_document", "active"))))
    decided = P.conversion(*map(F.col, ("lifecycle", "mode", "reason", "has_document", "capability")))
    return c.withColumn("c", decided).select("doc_id", "path", "lifecycle", "capability", F.col("c.action").alias("action"), F.col("c.reason").alias("decision_reason"))


def conversion_manifest(spark: SparkSession, d: str) -> DataFrame:
    return manifest(entries(read(spark, d, "documents")))


def conversion_counts(spark: SparkSession, d: str) -> DataFrame:
    """Three grouped counts in one pass."""
    keys = ["lifecycle", "action", "capability"]
    counted = conversion_manifest(spark, d).groupingSets([[k] for k in keys], *keys).agg(F.grouping_id().alias("g"), F.count("*").alias("n"))
    return counted.select(F.when(F.col("g") == 3, "lifecycle").when(F.col("g") == 5, "action").otherwise("capability").alias("measure"), F.coalesce(*keys).alias("value"), "n")


def manifest_digest(spark: SparkSession, d: str) -> DataFrame:
    m = conversion_manifest(spark, d)
    line = F.to_json(F.struct("action", "capability", "decision_reason", "lifecycle", "path"), {"ignoreNullFields": "false"})
    return M.digest_of(m, F.col("path"), line)


_DIGEST = """leaf AS (SELECT sha256(concat_ws(chr(31), k, line)) AS leaf FROM src),
s AS (SELECT count(*) AS n, """ + ", ".join(f"coalesce(sum(('0x' || substr(leaf, {1 + 15 * k}, 15))::HUGEINT), 0) AS s{k}" for k in range(4)) + """ FROM leaf)
SELECT n, sha256(concat_ws('|', n, s0, s1, s2, s3)) AS digest FROM s"""


def table_receipts(spark: SparkSession, d: str) -> DataFrame:
    """Rows and digest of ids of each table, to verify a copy."""
    out = None
    for table, key in (("customer", "c_custkey"), ("orders", "o_orderkey"), ("documents", "doc_id"), ("part", "p_partkey")):
        own = M.digest_of(read(spark, d, table), F.lpad(F.col(key).cast("string"), 12, "0"), F.col(key).cast("string")).withColumn("table_name", F.lit(table))
        out = own if out is None else out.unionByName(own)
    return out


def entry_summary_pivot(spark: SparkSession, d: str) -> DataFrame:
    e = entries(read(spark, d, "documents")).withColumn("mode", P.route(F.col("path"), F.col("n_chars"), MOST)["mode"])
    per = [F.count_if((F.col("mode") == m) & F.col("present")).alias(m) for m in ("code", "document", "metadata_only", "path_only")]
    return e.groupBy("source").agg(F.count("*").alias("total"), *per, F.count_if(~F.col("present")).alias("removed"))


def rejection_summary(spark: SparkSession, d: str) -> DataFrame:
    e = entries(read(spark, d, "documents")).withColumn("r", P.route(F.col("path"), F.col("n_chars"), MOST)).where(F.col("r.reason").isNotNull())
    return e.groupBy(F.when(F.col("r.mode") == "metadata_only", "skipped").otherwise("rejected").alias("disposition"), F.col("r.reason").alias("reason")).agg(F.count("*").alias("n"))


def incremental_diff(spark: SparkSession, d: str) -> DataFrame:
    """Two snapshots of the documents: some removed, some added, some edited."""
    docs = read(spark, d, "documents")
    before = docs.where("doc_id % 10 <> 0").select("doc_id", F.sha2("text", 256).alias("digest"))
    after = docs.where("doc_id % 10 <> 1").select("doc_id", F.sha2(F.when(F.col("doc_id") % 10 == 2, F.concat("text", F.lit("!"))).otherwise(F.col("text")), 256).alias("digest"))
    return M.difference(before, after, "doc_id", "digest")


def upsert_snapshot(spark: SparkSession, d: str) -> DataFrame:
    docs = read(spark, d, "documents")
    status = F.when(F.col("doc_id") % 4 == 0, "rejected").otherwise("indexed")
    old = docs.where("doc_id % 10 <> 0").select("doc_id", F.md5("text").alias("digest"), status.alias("status"))
    new = docs.where("doc_id % 10 <> 1").select("doc_id", F.md5(F.when(F.col("doc_id") % 10 == 2, F.lit("edited")).otherwise(F.col("text"))).alias("digest"))
    return M.upsert(old, new, "doc_id", "digest")


def rejection_merge(spark: SparkSession, d: str) -> DataFrame:
    l = read(spark, d, "lineitem").select("l_orderkey", F.when(F.col("l_returnflag") == "R", "rejected").otherwise("skipped").alias("disposition"), F.col("l_linestatus").alias("reason"), F.col("l_linenumber").cast("long").alias("line"))
    return M.merge_rejections(l, "l_orderkey", F.struct("line", "reason"))


def scd2_versions(spark: SparkSession, d: str) -> DataFrame:
    o = read(spark, d, "orders").select("o_custkey", "o_orderkey", "o_orderdate")
    v = M.versions(o, "o_custkey", "o_orderdate", "o_orderkey")
    return v.select("o_custkey", "o_orderkey", "revision", "supersedes", "valid_from", "valid_to", "status")


AS_OF = "1996-06-01"


def _applicable(spark: SparkSession, d: str) -> DataFrame:
    v = scd2_versions(spark, d)
    at = F.lit(AS_OF).cast("timestamp_ntz")
    return v.withColumn("ok", R.applicable(F.col("valid_from").cast("timestamp_ntz"), F.col("valid_to").cast("timestamp_ntz"), at))


def as_of_applicable(spark: SparkSession, d: str) -> DataFrame:
    return _applicable(spark, d).where("ok").select("o_custkey", "o_orderkey", "revision")


def as_of_excluded(spark: SparkSession, d: str) -> DataFrame:
    return _applicable(spark, d).where("NOT ok").groupBy("o_custkey").agg(F.count("*").alias("n")).withColumn("reason", F.lit("OUTSIDE_ANALYSIS_AS_OF"))


def late_finalize_guard(spark: SparkSession, d: str) -> DataFrame:
    e = read(spark, d, "events")
    entry = e.select("event_id", (F.col("event_id") % 11 != 0).alias("present"), (F.col("user_id") % 3).alias("last_seen_by"), F.col("event_id").alias("last_seen_at"))
    return M.finalise(entry, F.lit(1), F.lit(500)).select("event_id", "present", "removed")


def replica_reconcile(spark: SparkSession, d: str) -> DataFrame:
    docs = read(spark, d, "documents").select("doc_id", F.sha2("text", 256).alias("sha"))
    stores = F.explode(F.array(F.lit("a"), F.lit("b"))).alias("store")
    expected = docs.where("doc_id % 13 <> 0").select("doc_id", stores, F.col("sha").alias("checksum"))
    stored = docs.select("doc_id", stores, F.col("sha").alias("checksum")).where("NOT (store = 'b' AND doc_id % 6 = 0)").withColumn("checksum", F.when((F.col("store") == "a") & (F.col("doc_id") % 9 == 0), F.lit("x")).otherwise(F.col("checksum")))
    states = M.reconcile(expected, stored, ["doc_id", "store"])
    healthy = F.max(F.when(F.col("state") == "healthy", 1).otherwise(0)).over(Window.partitionBy("doc_id"))
    return states.withColumn("repairable", F.col("state").isin("missing", "corrupt") & (healthy == 1))


def replica_summary(spark: SparkSession, d: str) -> DataFrame:
    s = replica_reconcile(spark, d)
    return s.groupBy("store").agg(F.count("*").alias("checked"), *[F.count_if(F.col("state") == x).alias(x) for x in ("healthy", "missing", "corrupt", "orphan")], F.count_if(F.col("repairable")).alias("repaired"))


def historical_path_filter(spark: SparkSession, d: str) -> DataFrame:
    part = F.element_at(F.array(*map(F.lit, ("manual", "old", " B A K ", "旧_2020", "backup", "older", "旧版"))), (F.col("doc_id") % 7 + 1).cast("int"))
    path = F.concat_ws("/", "source", part, F.concat(F.lit("doc_"), "doc_id", F.when(F.col("doc_id") % 19 == 0, "#History/3").otherwise(".txt")))
    return read(spark, d, "documents").select("doc_id", path.alias("path")).where(~P.is_historical(F.col("path")))


def retention_prune(spark: SparkSession, d: str) -> DataFrame:
    o = read(spark, d, "orders").where(F.col("o_orderdate") >= F.lit("1997-01-01").cast("timestamp_ntz"))
    return o.groupBy("o_orderstatus").agg(F.count("*").alias("kept"))


def prefix_scope(spark: SparkSession, d: str) -> DataFrame:
    e = entries(read(spark, d, "documents"))
    return e.where(P.under(F.col("path"), "src1") | P.under(F.col("path"), "src2/en")).groupBy("source", "lang").agg(F.count("*").alias("n"))


QUERIES = {f.__name__: f for f in (
    source_key, file_routing, path_semantic_text, conversion_manifest, conversion_counts, manifest_digest, table_receipts, entry_summary_pivot, rejection_summary, incremental_diff, upsert_snapshot, rejection_merge,
    scd2_versions, as_of_applicable, as_of_excluded, late_finalize_guard, replica_reconcile, replica_summary, historical_path_filter, retention_prune, prefix_scope,
)}

_VERSIONS = """v AS (SELECT o_custkey, o_orderkey, row_number() OVER w AS revision, lag(o_orderkey) OVER w AS supersedes, o_orderdate AS valid_from, lead(o_orderdate) OVER w AS valid_to FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey))"""
_OK = f"valid_from <= TIMESTAMP '{AS_OF}' AND (valid_to IS NULL OR TIMESTAMP '{AS_OF}' < valid_to)"
_STATES = """x AS (SELECT doc_id, sha256(text) AS sha, unnest(['a', 'b']) AS store FROM documents),
e AS (SELECT doc_id, store, sha AS c FROM x WHERE doc_id % 13 <> 0), s AS (SELECT doc_id, store, CASE WHEN store = 'a' AND doc_id % 9 = 0 THEN 'x' ELSE sha END AS c FROM x WHERE NOT (store = 'b' AND doc_id % 6 = 0)),
t AS (SELECT doc_id, store, CASE WHEN e.c IS NULL THEN 'orphan' WHEN s.c IS NULL THEN 'missing' WHEN e.c = s.c THEN 'healthy' ELSE 'corrupt' END AS state FROM e FULL JOIN s USING (doc_id, store)),
r AS (SELECT *, state IN ('missing', 'corrupt') AND bool_or(state = 'healthy') OVER (PARTITION BY doc_id) AS repairable FROM t)"""

ORACLE = {
    "source_key": """SELECT source, lang, sha256(CASE WHEN lang = 'en' THEN 'local_directory' || chr(10) || lower('/Srv/' || source) ELSE 'git' || chr(10) || '/Srv/' || source END || chr(10) || '' || chr(10) || lang || '/sub' || chr(10) || 'tenant') AS source_key FROM (SELECT DISTINCT source, lang FROM documents)""",
    "file_routing": f"WITH {_ROUTED} SELECT doc_id, path, mode, reason FROM r",
    "path_semantic_text": f"""WITH {_ENTRIES} SELECT doc_id, 'relative_path: ' || path || chr(10) || 'file_name: doc_' || doc_id || ext || chr(10) || 'file_stem: doc_' || doc_id || chr(10) || 'extension: ' || ext || chr(10) || 'directories: ' || source || ' / ' || lang || chr(10) || 'entry_state: observed' AS text,
      'sha256/' || substr(sha256(path), 1, 2) || '/' || substr(sha256(path), 3, 2) || '/' || sha256(path) AS object_key FROM e""",
    "conversion_manifest": f"WITH {_MANIFEST} SELECT doc_id, path, lifecycle, capability, split_part(decided, '|', 1) AS action, split_part(decided, '|', 2) AS decision_reason FROM m",
    "conversion_counts": f"""WITH {_MANIFEST}, a AS (SELECT lifecycle, capability, split_part(decided, '|', 1) AS action FROM m)
      SELECT 'lifecycle' AS measure, lifecycle AS value, count(*) AS n FROM a GROUP BY 2 UNION ALL SELECT 'action', action, count(*) FROM a GROUP BY 2 UNION ALL SELECT 'capability', capability, count(*) FROM a GROUP BY 2""",
    "manifest_digest": f"""WITH {_MANIFEST}, src AS (SELECT path AS k, '{{"action":"' || split_part(decided, '|', 1) || '","capability":"' || capability || '","decision_reason":"' || split_part(decided, '|', 2) || '","lifecycle":"' || lifecycle || '","path":"' || path || '"}}' AS line FROM m), {_DIGEST}""",
    "table_receipts": " UNION ALL ".join(f"SELECT *, '{t}' AS table_name FROM (WITH src AS (SELECT lpad(CAST({k} AS VARCHAR), 12, '0') AS k, CAST({k} AS VARCHAR) AS line FROM {t}), {_DIGEST})" for t, k in (("customer", "c_custkey"), ("orders", "o_orderkey"), ("documents", "doc_id"), ("part", "p_partkey"))),
    "entry_summary_pivot": f"WITH {_ROUTED} SELECT source, count(*) AS total, " + ", ".join(f"count(*) FILTER (WHERE mode = '{m}' AND present) AS {m}" for m in ("code", "document", "metadata_only", "path_only")) + ", count(*) FILTER (WHERE NOT present) AS removed FROM r GROUP BY source",
    "rejection_summary": f"WITH {_ROUTED} SELECT CASE WHEN mode = 'metadata_only' THEN 'skipped' ELSE 'rejected' END AS disposition, reason, count(*) AS n FROM r WHERE reason IS NOT NULL GROUP BY 1, 2",
    "incremental_diff": """WITH b AS (SELECT doc_id, text FROM documents WHERE doc_id % 10 <> 0), a AS (SELECT doc_id, CASE WHEN doc_id % 10 = 2 THEN text || '!' ELSE text END AS text FROM documents WHERE doc_id % 10 <> 1)
      SELECT doc_id, CASE WHEN b.text IS NULL THEN 'added' WHEN a.text IS NULL THEN 'removed' WHEN a.text = b.text THEN 'unchanged' ELSE 'changed' END AS change FROM b FULL JOIN a USING (doc_id)""",
    "upsert_snapshot": """WITH o AS (SELECT doc_id, md5(text) AS od, CASE WHEN doc_id % 4 = 0 THEN 'rejected' ELSE 'indexed' END AS s FROM documents WHERE doc_id % 10 <> 0), n AS (SELECT doc_id, md5(CASE WHEN doc_id % 10 = 2 THEN 'edited' ELSE text END) AS nd FROM documents WHERE doc_id % 10 <> 1)
      SELECT doc_id, coalesce(nd, od) AS digest, CASE WHEN nd IS NULL THEN 'removed' WHEN od IS NULL OR od <> nd OR s = 'rejected' THEN 'observed' ELSE s END AS status, nd IS NOT NULL AS present FROM o FULL JOIN n USING (doc_id)""",
    "rejection_merge": """WITH l AS (SELECT l_orderkey, CASE WHEN l_returnflag = 'R' THEN 'rejected' ELSE 'skipped' END AS disposition, l_linestatus AS reason, CAST(l_linenumber AS BIGINT) AS line FROM lineitem)
      SELECT l_orderkey, disposition, reason, line FROM l QUALIFY row_number() OVER (PARTITION BY l_orderkey ORDER BY disposition = 'rejected' DESC, line DESC, reason DESC) = 1""",
    "scd2_versions": f"WITH {_VERSIONS} SELECT *, CASE WHEN valid_to IS NULL THEN 'active' ELSE 'superseded' END AS status FROM v",
    "as_of_applicable": f"WITH {_VERSIONS} SELECT o_custkey, o_orderkey, revision FROM v WHERE {_OK}",
    "as_of_excluded": f"WITH {_VERSIONS} SELECT o_custkey, count(*) AS n, 'OUTSIDE_ANALYSIS_AS_OF' AS reason FROM v WHERE NOT ({_OK}) GROUP BY 1",
    "late_finalize_guard": "WITH e AS (SELECT event_id, event_id % 11 <> 0 AS p, user_id % 3 AS b FROM events), g AS (SELECT *, p AND b <> 1 AND event_id <= 500 AS gone FROM e) SELECT event_id, p AND NOT gone AS present, gone AS removed FROM g",
    "replica_reconcile": f"WITH {_STATES} SELECT * FROM r",
    "replica_summary": f"WITH {_STATES} SELECT store, count(*) AS checked, " + ", ".join(f"count(*) FILTER (WHERE state = '{x}') AS {x}" for x in ("healthy", "missing", "corrupt", "orphan")) + ", count(*) FILTER (WHERE repairable) AS repaired FROM r GROUP BY store",
    "historical_path_filter": """WITH p AS (SELECT doc_id, source || '/' || list_extract(['manual', 'old', ' B A K ', '旧_2020', 'backup', 'older', '旧版'], CAST(doc_id % 7 + 1 AS INT)) || '/doc_' || doc_id || CASE WHEN doc_id % 19 = 0 THEN '#History/3' ELSE '.txt' END AS path FROM documents)
      SELECT * FROM p WHERE doc_id % 7 IN (0, 5, 6) AND doc_id % 19 <> 0""",
    "retention_prune": "SELECT o_orderstatus, count(*) AS kept FROM orders WHERE o_orderdate >= TIMESTAMP '1997-01-01' GROUP BY 1",
    "prefix_scope": "SELECT source, lang, count(*) AS n FROM documents WHERE source = 'src1' OR (source = 'src2' AND lang = 'en') GROUP BY 1, 2",
}
