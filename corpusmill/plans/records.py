"""Lists, pages, filters and reports over records: what users of the knowledge plane ask for day by day."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corpusmill.functions import paths as P
from corpusmill.functions import rules as R
from corpusmill.functions import text as X
from corpusmill.functions import values as V
from corpusmill.functions import vectors as N
from corpusmill.operators import merge as M
from corpusmill.operators import windows as W
from corpusmill.sources.tables import dealt, entries, read


def _day(text: str) -> F.Column:
    return F.lit(text).cast("timestamp_ntz")


def conjunction(*predicates: F.Column | None) -> F.Column:
    """All predicates that are given; none keeps every row."""
    return reduce(lambda a, b: a & b, [p for p in predicates if p is not None], F.lit(True))


def audit_tasks(spark: SparkSession, d: str) -> DataFrame:
    """Filtered, newest first, limited."""
    o = read(spark, d, "orders").where(conjunction(F.col("o_orderstatus") == "O", None, F.col("o_orderpriority") == "1-URGENT"))
    return o.orderBy(F.desc("o_orderdate"), F.desc("o_orderkey")).limit(100).select("o_orderkey", "o_custkey")


def entry_page(spark: SparkSession, d: str) -> DataFrame:
    """A page by offset, with the number of all rows that match."""
    found = entries(read(spark, d, "documents")).where(F.col("path").ilike("%/EN/%2.txt"))
    total = found.agg(F.count("*").alias("total"))
    page = found.orderBy("path", "doc_id").offset(2).limit(20).select("doc_id", "path")
    return page.join(F.broadcast(total))


def entry_keyset_page(spark: SparkSession, d: str) -> DataFrame:
    """The page after a key."""
    e = entries(read(spark, d, "documents")).where((F.col("path") > "src1/en") | ((F.col("path") == "src1/en") & (F.col("doc_id") > 3)))
    return e.orderBy("path", "doc_id").limit(50).select("doc_id", "path")


def issue_event_page(spark: SparkSession, d: str) -> DataFrame:
    """The page before a cursor in ascending order, and whether there is more."""
    top = read(spark, d, "events").where("user_id % 10 = 3 AND event_id < 900").orderBy(F.desc("event_id")).limit(21)
    ranked = top.select("event_id", "event_type", F.row_number().over(Window.orderBy(F.desc("event_id"))).alias("n"), (F.count("*").over(Window.partitionBy()) > 20).alias("has_more"))
    return ranked.where("n <= 20").select("event_id", "event_type", "has_more").orderBy("event_id")


def due_sources(spark: SparkSession, d: str) -> DataFrame:
    """Scheduled sources that are due, free and without an active run, the longest due first."""
    c = read(spark, d, "customer")
    active = read(spark, d, "orders").where("o_orderstatus = 'P'").select(F.col("o_custkey").alias("c_custkey"))
    s = c.select("c_custkey", (F.col("c_custkey") % 5 != 0).alias("enabled"), (F.col("c_custkey") % 4).alias("next"), F.when(F.col("c_custkey") % 3 == 0, F.col("c_custkey") % 7).alias("lease"))
    due = s.where(F.col("enabled") & (F.col("next") <= 2) & (F.col("lease").isNull() | (F.col("lease") <= 3))).join(active, "c_custkey", "left_anti")
    return due.orderBy("next", "c_custkey").limit(25).select("c_custkey", "next")


def reusable_files(spark: SparkSession, d: str) -> DataFrame:
    """Files whose size and time are as before, with a hash, and a document or a rejection."""
    e = entries(read(spark, d, "documents"))
    before = e.where("doc_id % 4 <> 1").select("path", F.col("n_chars").alias("size_then"), F.when(F.col("doc_id") % 6 != 0, F.md5("path")).alias("hash"), "has_document", "status")
    now = e.select("doc_id", "path", (F.col("n_chars") + (F.col("doc_id") % 10 == 0).cast("int")).alias("size_now"))
    same = F.col("size_now").eqNullSafe(F.col("size_then")) & F.col("hash").isNotNull() & (F.col("has_document") | (F.col("status") == "rejected"))
    return now.join(before, "path", "left").select("doc_id", F.coalesce(same, F.lit(False)).alias("reuse"))


def extraction_manifest(spark: SparkSession, d: str) -> DataFrame:
    """What an extraction may use of each entry: the first rule that applies."""
    e = entries(read(spark, d, "documents")).withColumn("mode", P.route(F.col("path"), F.col("n_chars"), 20_000)["mode"])
    path, doc = F.col("path"), F.col("has_document")
    changed, older = F.col("doc_id") % 8 == 0, F.col("doc_id") % 9 == 0
    status = (
        F.when(P.is_historical(path), "excluded:historical_path").when(P.name(path).startswith("~$"), "excluded:temporary_office_file").when(~F.col("present"), "source_absent")
        .when(F.col("status").isin("failed", "extraction_failed"), "extraction_failed").when((F.col("mode") == "path_only") & doc, "ready").when(F.col("mode") == "path_only", "observed_only")
        .when(~F.col("ext").isin(*P.SUPPORTED), "unsupported_extension").when((F.col("mode") == "metadata_only") | (F.col("status") == "metadata_only"), "metadata_only").when(~doc, "observed_only")
        .when(changed, "source_changed").when(older, "processing_upgrade_required").otherwise("ready")
    )
    return e.select("doc_id", status.alias("manifest_status"))


def extraction_progress(spark: SparkSession, d: str) -> DataFrame:
    m = extraction_manifest(spark, d)
    return m.agg(F.count("*").alias("total"), *[F.count_if(F.col("manifest_status") == s).alias(s) for s in ("ready", "observed_only", "source_changed", "metadata_only")], F.round(F.avg((F.col("manifest_status") == "ready").cast("int")), 6).alias("rate"))


def field_routing(spark: SparkSession, d: str) -> DataFrame:
    """Which fields a document is asked for, by the directories it lies in."""
    fields = F.array(*map(F.lit, ("organization_name", "vpns", "environments", "customizations")))
    e = read(spark, d, "documents").select("doc_id", F.element_at(F.array(*map(F.lit, ("a/custom/b", "a/remote/b", "a/b", "old/b"))), (F.col("doc_id") % 4 + 1).cast("int")).alias("path"))
    parts = F.split("path", "/")
    kept = F.when(P.is_historical(F.col("path")), F.array().cast("array<string>")).when(F.array_contains(parts, "custom"), F.filter(fields, lambda f: f == "customizations")).when(F.array_contains(parts, "remote"), F.filter(fields, lambda f: f.isin("vpns", "environments"))).otherwise(F.filter(fields, lambda f: f == "organization_name"))
    return e.select("doc_id", F.array_join(kept, ",").alias("fields"))


def code_summary(spark: SparkSession, d: str) -> DataFrame:
    """Counts by language as one map, per source."""
    c = read(spark, d, "documents").groupBy("source", "lang").agg(F.count("*").alias("n"))
    pairs = F.array_sort(F.collect_list(F.concat_ws("=", "lang", "n")))
    return c.groupBy("source").agg(F.sum("n").alias("total"), F.array_join(pairs, ",").alias("languages"))


def revisions(spark: SparkSession, d: str) -> DataFrame:
    """The next revision number of each kind of artifact."""
    l = read(spark, d, "lineitem").groupBy("l_suppkey", "l_returnflag").agg(F.count("*").alias("n"))
    return l.select("l_suppkey", "l_returnflag", (F.col("n") + 1).alias("next_revision"))


def version_leads(spark: SparkSession, d: str) -> DataFrame:
    """The last line of each section: before the next one starts, or the end."""
    l = read(spark, d, "lineitem").select("l_orderkey", "l_linenumber")
    after = F.lead("l_linenumber").over(Window.partitionBy("l_orderkey").orderBy("l_linenumber"))
    return l.select("l_orderkey", "l_linenumber", F.coalesce(after - 1, F.lit(10)).alias("last_line"))


def nested_ranges(spark: SparkSession, d: str) -> DataFrame:
    """An outer range ends before the first range that starts inside it."""
    r = read(spark, d, "lineitem").select("l_orderkey", F.col("l_linenumber").alias("start"), (F.col("l_linenumber") + F.col("l_suppkey") % 4).cast("int").alias("stop"))
    inner = r.select("l_orderkey", F.col("start").alias("s2"), F.col("stop").alias("e2"))
    met = r.join(inner, "l_orderkey").where("s2 > start AND e2 <= stop").groupBy("l_orderkey", "start", "stop").agg(F.min("s2").alias("first"))
    return r.join(met, ["l_orderkey", "start", "stop"], "left").select("l_orderkey", "start", F.greatest("start", F.coalesce(F.col("first") - 1, F.col("stop"))).alias("clipped"))


def source_priorities(spark: SparkSession, d: str) -> DataFrame:
    e = entries(read(spark, d, "documents"))
    rules = [("src1/*/doc_1*", 10), ("/fr/", 20), ("src[23]/en/*", 30)]
    return e.select("doc_id", V.source_priority(F.array("path"), rules).cast("int").alias("priority"))


def identity_codes(spark: SparkSession, d: str) -> DataFrame:
    c = read(spark, d, "customer")
    text = F.concat(F.lit("Site-"), F.col("c_custkey") % 100, F.when(F.col("c_custkey") % 2 == 0, "x").otherwise("/"), F.lit("end"))
    return c.select("c_custkey", V.code_matches(text, F.lit("42")).alias("matched"))


def evidence_locations(spark: SparkSession, d: str) -> DataFrame:
    p = read(spark, d, "part")
    text = F.when(F.col("p_partkey") % 3 == 0, F.concat(F.lit("[sheet] index=1 name=S"), "p_size", F.lit("\nB"), "p_size", F.lit("\tvalue=1"))).when(F.col("p_partkey") % 3 == 1, F.concat(F.lit("[page] index="), "p_size", F.lit("\ntext"))).otherwise("plain")
    return p.select("p_partkey", V.evidence_location(text).alias("l")).select("p_partkey", "l.sheet", "l.cell", "l.page")


def parsed_times(spark: SparkSession, d: str) -> DataFrame:
    o = read(spark, d, "orders")
    day = F.date_format("o_orderdate", "yyyy-MM-dd")
    text = F.when(F.col("o_orderkey") % 4 == 0, F.concat(day, F.lit("T10:00:00Z"))).when(F.col("o_orderkey") % 4 == 1, F.concat(day, F.lit("T12:00:00+02:00"))).when(F.col("o_orderkey") % 4 == 2, day).otherwise("soon")
    t = V.parse_time(text)
    return o.select("o_orderkey", F.date_format(t, "yyyy-MM-dd HH:mm").alias("utc"), F.date_format(t + F.make_interval(mins=R.retry_minutes(F.col("o_orderkey") % 8 + 1, F.lit(60)).cast("int")), "yyyy-MM-dd HH:mm").alias("next_sync"))


def json_fields(spark: SparkSession, d: str) -> DataFrame:
    """A key of the events' properties with a default, and their canonical form."""
    e = read(spark, d, "events")
    return e.select("event_id", F.coalesce(F.get_json_object("props", "$.k"), F.lit("none")).alias("k"), F.coalesce(F.get_json_object("props", "$.absent"), F.lit("default")).alias("absent"))


def embedded_json(spark: SparkSession, d: str) -> DataFrame:
    """The object inside fenced answers, and whether it fits a schema."""
    e = read(spark, d, "events")
    text = F.concat(F.lit("```json\nanswer {broken "), "props", F.lit("\n```"))
    fits = V.json_fits({"type": "object", "required": ["k"], "properties": {"k": {"type": "integer"}}, "additionalProperties": False})
    found = e.select("event_id", V.first_json_object(text).alias("found"))
    return found.select("event_id", "found", fits("found").alias("fits"))


def resource_links(spark: SparkSession, d: str) -> DataFrame:
    e = entries(read(spark, d, "documents"))
    kind = F.when(F.col("lang") == "en", "local_directory").when(F.col("lang") == "de", "gitlab").otherwise("svn")
    place = F.when(F.col("lang") == "en", "/srv/data").when(F.col("lang") == "de", "https://git.example/g/p.git").otherwise("svn://host/repo/")
    return e.select("doc_id", V.resource_uris(kind, place, F.lit("main"), F.lit("./docs"), F.lit(None).cast("string"), F.col("path")).alias("uri"))


def sealed_round_trip(spark: SparkSession, d: str) -> DataFrame:
    key = F.lit("0123456789abcdef0123456789abcdef").cast("binary")
    docs = read(spark, d, "documents").select("doc_id", "text", V.encrypt(F.col("text"), key).alias("sealed"))
    return docs.select("doc_id", (V.decrypt(F.col("sealed"), key) == F.col("text")).alias("opened"))


def embedding_cache(spark: SparkSession, d: str) -> DataFrame:
    """Texts that the cache of vectors does not hold yet, once each."""
    docs = read(spark, d, "documents").select(F.sha2(F.concat_ws("\x1f", F.lit("model"), F.lit("64"), "text"), 256).alias("cache_key"), (F.col("doc_id") % 3 == 0).alias("cached"))
    missing = docs.select("cache_key").join(docs.where("cached").select("cache_key"), "cache_key", "left_anti")
    return missing.groupBy("cache_key").agg(F.count("*").alias("users"))


def stand_in_vectors(spark: SparkSession, d: str) -> DataFrame:
    p = dealt(read(spark, d, "part").select("p_partkey", "p_name"), "p_partkey")
    v = N.byte_embedding(F.col("p_name"), 8)
    return p.select("p_partkey", F.round(N.norm(v), 6).alias("norm"), F.size(v).cast("long").alias("size"))


def term_sets(spark: SparkSession, d: str) -> DataFrame:
    """Union, intersection and difference of the terms of two fields, and whether they are equal."""
    p = read(spark, d, "part").select("p_partkey", X.search_terms(F.col("p_name")).alias("a"), X.search_terms(F.col("p_type")).alias("b"))
    n = lambda c: F.size(c).cast("long")
    return p.select("p_partkey", n(F.array_union("a", "b")).alias("either"), n(F.array_intersect("a", "b")).alias("both"), n(F.array_except("a", "b")).alias("only"), ((n(F.array_except("a", "b")) == 0) & (n(F.array_except("b", "a")) == 0)).alias("equal"))


def retrieval_health(spark: SparkSession, d: str) -> DataFrame:
    """State and freshness of each source from counts and the last time something was seen."""
    o = read(spark, d, "orders").groupBy(F.col("o_custkey").alias("source_id")).agg(F.count("*").alias("entries"), F.count_if(F.col("o_orderstatus") == "F").alias("indexed"), F.max(F.col("o_orderdate").cast("timestamp_ntz")).alias("seen"))
    health = F.when(F.col("indexed") == 0, "empty").when(F.col("indexed") * 2 < F.col("entries"), "degraded").otherwise("healthy")
    fresh = F.when(F.col("seen") >= _day("1998-01-01"), "fresh").when(F.col("seen") >= _day("1997-01-01"), "aging").otherwise("stale")
    return o.select("source_id", health.alias("health"), fresh.alias("freshness"))


def repair_set(spark: SparkSession, d: str) -> DataFrame:
    """Finished queue rows whose work is still alive are reset; work without a row is enqueued."""
    o = read(spark, d, "orders")
    live = read(spark, d, "customer").where("c_acctbal > 0").select("c_custkey")
    last = W.latest(o.select(F.col("o_custkey").alias("c_custkey"), "o_orderkey", "o_orderstatus", "o_orderdate"), ["c_custkey"], [F.desc("o_orderdate"), F.desc("o_orderkey")])
    both = live.join(last, "c_custkey", "left")
    return both.select("c_custkey", F.when(F.col("o_orderkey").isNull(), "enqueue").when(F.col("o_orderstatus") == "F", "reset").otherwise("keep").alias("repair"))


def batch_flush(spark: SparkSession, d: str) -> DataFrame:
    """The last write of each path in each batch of 100 observations."""
    e = read(spark, d, "events").select(F.floor(F.col("event_id") / 100).cast("long").alias("batch"), (F.col("user_id") % 20).alias("path"), "event_id", "event_type")
    return W.latest(e, ["batch", "path"], [F.desc("event_id")]).select("batch", "path", "event_type")


def memory_promotion(spark: SparkSession, d: str) -> DataFrame:
    """Candidates move only from approved to promoted."""
    status = F.when(F.col("quality") == 1, "approved").otherwise("rejected")
    l = read(spark, d, "labels").select("doc_id", status.alias("before"))
    return l.select("doc_id", F.when((F.col("before") == "approved") & (F.col("doc_id") % 2 == 0), "promoted").otherwise(F.col("before")).alias("status"))


def archive_paths(spark: SparkSession, d: str) -> DataFrame:
    """Changed and removed documents keep their text below a history path, out of search."""
    docs = read(spark, d, "documents")
    before = docs.where("doc_id % 10 <> 0").select("doc_id", F.md5("text").alias("digest"))
    after = docs.where("doc_id % 10 <> 1").select("doc_id", F.md5(F.when(F.col("doc_id") % 10 == 2, F.lit("edited")).otherwise(F.col("text"))).alias("digest"))
    gone = M.difference(before, after, "doc_id", "digest").where("change IN ('changed', 'removed')")
    return gone.join(docs.select("doc_id", "source"), "doc_id").select("doc_id", F.concat("source", F.lit("#history/"), "doc_id").alias("path"), F.lit("archive").alias("scope"))


def harness_score(spark: SparkSession, d: str) -> DataFrame:
    l = read(spark, d, "lineitem").groupBy("l_orderkey").agg(F.count_if(F.col("l_returnflag") == "R").alias("e"), F.count_if(F.col("l_linestatus") == "O").alias("r"), F.count("*").alias("n"))
    return l.select("l_orderkey", F.round(F.lit(100.0) * (F.col("e") + F.col("r")) / F.greatest(F.lit(1), F.col("n")), 2).alias("score"))


def error_lines(spark: SparkSession, d: str) -> DataFrame:
    """What each text would say as an error; some have carriage returns, some overflow, some say nothing."""
    text = F.when(F.col("doc_id") % 7 == 0, F.concat(F.lit("\r\n \r"), F.replace("text", F.lit(". "), F.lit(".\r")))).when(F.col("doc_id") % 7 == 1, F.concat("text", F.lit("\nNumericValueOutOfRange: ")))
    text = text.when(F.col("doc_id") % 7 == 2, F.lit(" \r\n\t")).otherwise(F.concat(F.lit("\n \n"), "text"))
    return read(spark, d, "documents").select("doc_id", F.md5(X.first_line(text)).alias("digest"), X.contains_cjk(F.col("text")).alias("cjk"))


def plain_urls(spark: SparkSession, d: str) -> DataFrame:
    url = F.when(F.col("page_id") % 2 == 0, F.replace("url", F.lit("://"), F.lit("://me:pw@"))).otherwise(F.col("url"))
    return read(spark, d, "pages").select("page_id", X.plain_url(url).alias("url"))


def symbol_scores(spark: SparkSession, d: str) -> DataFrame:
    """Parts as symbols, by how well their first word fits a query."""
    first = F.element_at(F.split("p_name", " "), 1)
    s = read(spark, d, "part").select("p_partkey", X.symbol_score(first, F.concat_ws(".", "p_brand", first), F.lit("lib/part"), "Blue lib/part red", ["blue", "re", "brand"]).alias("score"))
    return s.where("score > 0")


def python_symbols(spark: SparkSession, d: str) -> DataFrame:
    """Symbols of small modules by their syntax tree; what does not parse gives none."""
    from corpusmill.sources.formats import symbols_of_python

    key = F.col("p_partkey").cast("string")
    module = F.concat(F.lit("class C"), key, F.lit(":\n    def run(self):\n        return go.fast(len("), key, F.lit("))\n"), F.when(F.col("p_size") % 10 == 0, "oops (\n").otherwise(""))
    s = symbols_of_python(read(spark, d, "part").select(F.col("p_partkey").alias("doc_id"), module.alias("text")))
    return s.select("doc_id", "kind", "qualified_name", "start_line", "end_line", F.array_join("calls", ",").alias("calls"))


def shortcut_texts(spark: SparkSession, d: str) -> DataFrame:
    p = read(spark, d, "part")
    return p.select("p_partkey", X.shortcut_text(F.concat(F.lit("a/"), "p_partkey", F.lit(".lnk")), F.lit("resolved"), F.when(F.col("p_size") > 20, "D:/x"), F.when(F.col("p_size") > 30, "file")).alias("text"))


QUERIES = {f.__name__: f for f in (
    audit_tasks, entry_page, entry_keyset_page, issue_event_page, due_sources, reusable_files, extraction_manifest, extraction_progress, field_routing, code_summary, revisions, version_leads, nested_ranges, source_priorities,
    identity_codes, evidence_locations, parsed_times, json_fields, embedded_json, resource_links, sealed_round_trip, embedding_cache, stand_in_vectors, term_sets, retrieval_health, repair_set, batch_flush, memory_promotion,
    archive_paths, harness_score, error_lines, plain_urls, symbol_scores, python_symbols, shortcut_texts,
)}

from corpusmill.plans.ingest import _ENTRIES, _ROUTED  # noqa: E402

_WITH = f"WITH {_ENTRIES}"
_STATUS = f"""m AS (SELECT doc_id, CASE WHEN NOT present THEN 'source_absent' WHEN mode = 'path_only' AND has_document THEN 'ready' WHEN mode = 'path_only' THEN 'observed_only' WHEN ext NOT IN ('.txt', '.py', '.sql', '.md') THEN 'unsupported_extension'
  WHEN mode = 'metadata_only' OR status = 'metadata_only' THEN 'metadata_only' WHEN NOT has_document THEN 'observed_only' WHEN doc_id % 8 = 0 THEN 'source_changed' WHEN doc_id % 9 = 0 THEN 'processing_upgrade_required' ELSE 'ready' END AS manifest_status FROM r)"""
_TERMS = "list_distinct(list_filter(regexp_extract_all(lower({}), '[a-z_][a-z0-9_.:/-]*|[0-9]+'), lambda x: length(x) > 1))"
ORACLE = {
    "audit_tasks": "SELECT o_orderkey, o_custkey FROM orders WHERE o_orderstatus = 'O' AND o_orderpriority = '1-URGENT' ORDER BY o_orderdate DESC, o_orderkey DESC LIMIT 100",
    "entry_page": f"{_WITH}, f AS (SELECT doc_id, path FROM e WHERE path ILIKE '%/EN/%2.txt') SELECT doc_id, path, (SELECT count(*) FROM f) AS total FROM f ORDER BY path, doc_id LIMIT 20 OFFSET 2",
    "entry_keyset_page": f"{_WITH} SELECT doc_id, path FROM e WHERE (path, doc_id) > ('src1/en', 3) ORDER BY path, doc_id LIMIT 50",
    "issue_event_page": "WITH t AS (SELECT event_id, event_type FROM events WHERE user_id % 10 = 3 AND event_id < 900 ORDER BY event_id DESC LIMIT 21) SELECT event_id, event_type, (SELECT count(*) > 20 FROM t) AS has_more FROM t ORDER BY event_id DESC LIMIT 20",
    "due_sources": "SELECT c_custkey, c_custkey % 4 AS next FROM customer WHERE c_custkey % 5 <> 0 AND c_custkey % 4 <= 2 AND (c_custkey % 3 <> 0 OR c_custkey % 7 <= 3) AND c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'P') ORDER BY 2, 1 LIMIT 25",
    "reusable_files": f"{_WITH} SELECT doc_id, doc_id % 4 <> 1 AND doc_id % 10 <> 0 AND doc_id % 6 <> 0 AND (has_document OR status = 'rejected') AS reuse FROM e",
    "extraction_manifest": f"WITH {_ROUTED}, {_STATUS} SELECT * FROM m",
    "extraction_progress": f"WITH {_ROUTED}, {_STATUS} SELECT count(*) AS total, " + ", ".join(f"count(*) FILTER (WHERE manifest_status = '{s}') AS {s}" for s in ("ready", "observed_only", "source_changed", "metadata_only")) + ", round(avg(CAST(manifest_status = 'ready' AS INT)), 6) AS rate FROM m",
    "field_routing": "SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN 'customizations' WHEN 1 THEN 'vpns,environments' WHEN 2 THEN 'organization_name' ELSE '' END AS fields FROM documents",
    "code_summary": "WITH c AS (SELECT source, lang, count(*) AS n FROM documents GROUP BY 1, 2) SELECT source, CAST(sum(n) AS BIGINT) AS total, string_agg(lang || '=' || n, ',' ORDER BY lang || '=' || n) AS languages FROM c GROUP BY 1",
    "revisions": "SELECT l_suppkey, l_returnflag, count(*) + 1 AS next_revision FROM lineitem GROUP BY 1, 2",
    "version_leads": "SELECT l_orderkey, l_linenumber, coalesce(lead(l_linenumber) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber) - 1, 10) AS last_line FROM lineitem",
    "nested_ranges": "WITH r AS (SELECT l_orderkey, l_linenumber AS start, CAST(l_linenumber + l_suppkey % 4 AS INT) AS stop FROM lineitem) SELECT l_orderkey, start, greatest(start, coalesce((SELECT min(i.start) - 1 FROM r i WHERE i.l_orderkey = r.l_orderkey AND i.start > r.start AND i.stop <= r.stop), stop)) AS clipped FROM r",
    "source_priorities": f"{_WITH} SELECT doc_id, CASE WHEN regexp_matches(path, '^src1/.*/doc_1.*$') THEN 10 WHEN contains(path, '/fr/') THEN 20 WHEN regexp_matches(path, '^src[23]/en/.*$') THEN 30 ELSE 100 END AS priority FROM e",
    "identity_codes": "SELECT c_custkey, c_custkey % 100 = 42 AND c_custkey % 2 = 1 AS matched FROM customer",
    "evidence_locations": "SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 THEN 'S' || p_size END AS sheet, CASE WHEN p_partkey % 3 = 0 THEN 'B' || p_size END AS cell, CASE WHEN p_partkey % 3 = 1 THEN CAST(p_size AS BIGINT) END AS page FROM part",
    "parsed_times": """WITH t AS (SELECT o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN date_trunc('day', o_orderdate) + INTERVAL 10 HOUR WHEN 1 THEN date_trunc('day', o_orderdate) + INTERVAL 10 HOUR WHEN 2 THEN date_trunc('day', o_orderdate) END AS t, least(60, 5 * pow(2, least(o_orderkey % 8, 6))) AS m FROM orders)
      SELECT o_orderkey, strftime(t, '%Y-%m-%d %H:%M') AS utc, strftime(t + to_minutes(CAST(m AS BIGINT)), '%Y-%m-%d %H:%M') AS next_sync FROM t""",
    "json_fields": "SELECT event_id, coalesce(json_extract_string(props, '$.k'), 'none') AS k, 'default' AS absent FROM events",
    "embedded_json": "SELECT event_id, replace(replace(props, ': ', ':'), ', ', ',') AS found, true AS fits FROM events",
    "resource_links": f"{_WITH} SELECT doc_id, CASE lang WHEN 'en' THEN 'file:///srv/data/docs/' || path WHEN 'de' THEN 'https://git.example/g/p/-/blob/main/docs/' || path ELSE 'svn://host/repo/docs/' || path END AS uri FROM e",
    "sealed_round_trip": "SELECT doc_id, true AS opened FROM documents",
    "embedding_cache": "WITH k AS (SELECT sha256('model' || chr(31) || '64' || chr(31) || text) AS cache_key, doc_id FROM documents) SELECT cache_key, count(*) AS users FROM k GROUP BY 1 HAVING NOT bool_or(doc_id % 3 = 0)",
    "stand_in_vectors": "SELECT p_partkey, 1.0::DOUBLE AS norm, 8::BIGINT AS size FROM part",
    "term_sets": f"WITH t AS (SELECT p_partkey, {_TERMS.format('p_name')} AS a, {_TERMS.format('p_type')} AS b FROM part), n AS (SELECT p_partkey, len(a) AS na, len(b) AS nb, len(list_intersect(a, b)) AS nn FROM t) SELECT p_partkey, CAST(na + nb - nn AS BIGINT) AS either, CAST(nn AS BIGINT) AS both, CAST(na - nn AS BIGINT) AS only, na = nn AND nb = nn AS equal FROM n",
    "retrieval_health": "WITH o AS (SELECT o_custkey AS source_id, count(*) AS n, count(*) FILTER (WHERE o_orderstatus = 'F') AS i, max(o_orderdate) AS t FROM orders GROUP BY 1) SELECT source_id, CASE WHEN i = 0 THEN 'empty' WHEN i * 2 < n THEN 'degraded' ELSE 'healthy' END AS health, CASE WHEN t >= TIMESTAMP '1998-01-01' THEN 'fresh' WHEN t >= TIMESTAMP '1997-01-01' THEN 'aging' ELSE 'stale' END AS freshness FROM o",
    "repair_set": "WITH l AS (SELECT o_custkey, o_orderstatus AS s FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) = 1) SELECT c_custkey, CASE WHEN s IS NULL THEN 'enqueue' WHEN s = 'F' THEN 'reset' ELSE 'keep' END AS repair FROM customer LEFT JOIN l ON o_custkey = c_custkey WHERE c_acctbal > 0",
    "batch_flush": "SELECT event_id // 100 AS batch, user_id % 20 AS path, event_type FROM events QUALIFY row_number() OVER (PARTITION BY event_id // 100, user_id % 20 ORDER BY event_id DESC) = 1",
    "memory_promotion": "SELECT doc_id, CASE WHEN quality = 1 THEN CASE WHEN doc_id % 2 = 0 THEN 'promoted' ELSE 'approved' END ELSE 'rejected' END AS status FROM labels",
    "archive_paths": "SELECT doc_id, source || '#history/' || doc_id AS path, 'archive' AS scope FROM documents WHERE doc_id % 10 IN (1, 2)",
    "harness_score": "SELECT l_orderkey, round(100.0::DOUBLE * (count(*) FILTER (WHERE l_returnflag = 'R') + count(*) FILTER (WHERE l_linestatus = 'O')) / greatest(1, count(*)), 2) AS score FROM lineitem GROUP BY 1",
    "error_lines": """WITH t AS (SELECT doc_id, text, CASE doc_id % 7 WHEN 0 THEN chr(13) || chr(10) || ' ' || chr(13) || replace(text, '. ', '.' || chr(13)) WHEN 2 THEN ' ' || chr(13) || chr(10) || chr(9) ELSE text END AS m FROM documents),
      l AS (SELECT *, list_filter(list_transform(regexp_split_to_array(m, '\\r\\n|\\r|\\n'), lambda x: trim(x, ' ' || chr(9))), lambda x: x <> '')[1] AS line FROM t)
      SELECT doc_id, md5(CASE WHEN doc_id % 7 = 1 THEN '文件元数据大小超出数据库字段范围，完整技术日志已保留。' ELSE coalesce(substr(line, 1, 300), '知识学习失败') END) AS digest, regexp_matches(text, '[\\x{3400}-\\x{4dbf}\\x{4e00}-\\x{9fff}]') AS cjk FROM l""",
    "symbol_scores": """WITH p AS (SELECT p_partkey, lower(split_part(p_name, ' ', 1)) AS n, lower(p_brand) || '.' || lower(split_part(p_name, ' ', 1)) AS u FROM part),
      s AS (SELECT p_partkey, CAST(5 + 6 * CAST(contains('blue lib/part red', n) AS INT) + CAST(contains(u, 'blue') AS INT) + CAST(contains(u, 're') AS INT) + CAST(contains(u, 'brand') AS INT) AS DOUBLE) AS score FROM p) SELECT * FROM s""",
    "python_symbols": """SELECT p_partkey AS doc_id, 'class' AS kind, 'C' || p_partkey AS qualified_name, 1 AS start_line, 3 AS end_line, 'go.fast,len' AS calls FROM part WHERE p_size % 10 <> 0
      UNION ALL SELECT p_partkey, 'method', 'C' || p_partkey || '.run', 2, 3, 'go.fast,len' FROM part WHERE p_size % 10 <> 0""",
    "shortcut_texts": "SELECT p_partkey, 'relative_path: a/' || p_partkey || '.lnk' || chr(10) || 'entry_type: windows_shortcut' || chr(10) || 'shortcut_target_status: resolved' || CASE WHEN p_size > 20 THEN chr(10) || 'shortcut_target_path: D:/x' ELSE '' END || CASE WHEN p_size > 30 THEN chr(10) || 'shortcut_target_kind: file' ELSE '' END AS text FROM part",
    "plain_urls": "SELECT page_id, url FROM pages",
}
