"""Queries over sinks and stores of contents, lists that a user filters, and work that is not done twice."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusmill.functions import vectors as V
from corpusmill.operators.graph import CodeGraph
from corpusmill.sources import objects, sinks
from corpusmill.sources.tables import read, shared_path
from corpusmill.sources.versions import Table

# Kinds of events that a reader of essentials sees, and those that bring pieces of a longer text.
ESSENTIAL = (
    "task.created", "task.started", "harness.started", "agent.run.started", "agent.run.completed", "harness.completed", "runtime.connected", "runtime.thread", "agent.message",
    "command.completed", "file.changed", "test.completed", "approval.requested", "approval.pending", "approval.resolved", "task.completed", "task.failed", "task.cancelled",
)
DELTA = ("agent.message.delta", "agent.plan.delta", "agent.reasoning.summary.delta", "command.output.delta")


def _rejections(spark: SparkSession, d: str) -> DataFrame:
    l = read(spark, d, "lineitem").where("l_returnflag = 'R'")
    reason = F.concat(F.lit('no "'), F.col("l_linestatus"), F.lit('", line '), F.col("l_linenumber").cast("string"))
    return l.select(F.col("l_orderkey").alias("id"), F.col("l_linenumber").cast("long").alias("line_number"), F.lit("rejected").alias("disposition"), reason.alias("reason"))


def rejection_archive(spark: SparkSession, d: str) -> DataFrame:
    """What was rejected, as lines of JSON behind a header that tells their number, read back from the archive."""
    rows = _rejections(spark, d)
    count = rows.count()
    header = f'{{"record_type":"rejection_archive","schema_version":1,"record_count":{count}}}'
    folder = shared_path(spark, "rejections")
    sinks.publish_lines(rows.select("id", "line_number", F.to_json(F.struct(*rows.columns)).alias("line")), ["id", "line_number"], header, folder)
    return sinks.lines_of(spark, folder).groupBy("part", "line").agg(F.count("*").alias("n"))


def csv_export(spark: SparkSession, d: str) -> DataFrame:
    """The same as values between commas: a byte order mark, one header, quotes where they are needed."""
    rows = _rejections(spark, d)
    folder = shared_path(spark, "csv")
    sinks.publish_lines(rows.select("id", "line_number", sinks.csv_line([F.col(c) for c in rows.columns]).alias("line")), ["id", "line_number"], sinks.csv_header(rows.columns), folder, "none")
    # Spark's reader of lines drops a byte order mark, so the header is read as bytes
    header = spark.read.format("binaryFile").load(f"{folder}/0-header/*.txt").select(F.lit("0-header").alias("part"), F.decode("content", "UTF-8").alias("line"))
    lines = header.unionByName(sinks.lines_of(spark, folder).where("part = '1-lines'"))
    return lines.groupBy("part", F.regexp_replace("line", "[\r\n]+$", "").alias("line")).agg(F.count("*").alias("n"))


def stream_payloads(spark: SparkSession, d: str) -> DataFrame:
    """Each event as a message of its task, of its conversation and of the audit."""
    e = read(spark, d, "events")
    told = e.select(
        "event_id", F.col("user_id").alias("task_id"), (F.col("event_id") % 100).alias("sequence"), F.col("event_id").alias("global_sequence"), F.col("event_type").alias("type"),
        F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss").alias("timestamp"), F.struct(F.col("user_id").alias("user"), F.when(F.col("event_id") % 3 > 0, F.col("event_type")).alias("note")).alias("data"),
        (F.col("user_id") % 10).alias("conversation_id"), (F.col("event_id") % 1000).alias("conversation_sequence"), F.lit("ui").alias("trigger_source"), F.lit(None).cast("string").alias("client_id"),
        F.lit("réq").alias("client_request_id"), (F.col("user_id") % 5).alias("project_id"), F.concat(F.lit("P"), F.col("user_id") % 5).alias("project_code"),
    )
    return told.select("event_id", *[F.md5(f(told)).alias(n) for n, f in (("task", sinks.task_message), ("conversation", sinks.conversation_message), ("audit", sinks.audit_message))])


def object_store(spark: SparkSession, d: str) -> DataFrame:
    """Texts as objects by their digest, listed from the store."""
    objects.register(spark)
    store = shared_path(spark, "objects")
    docs = read(spark, d, "documents").select(F.encode("text", "UTF-8").alias("content"), "doc_id")
    for part in (0, 1):
        docs.where(f"doc_id % 2 = {part}").select("content").write.format("objects").mode("append").save(store)
    return spark.read.format("objects").load(store).select("sha256", "size")


def listed_symbols(symbols: DataFrame, query: str, kind: str, limit: int) -> DataFrame:
    """symbols (name, qualified, path, kind, start_line) of a kind, if one is given, that hold the query anywhere, whatever
    its case; the first ones by path, line and name."""
    holds = F.lit(not query)
    for c in ("name", "qualified", "path"):
        holds = holds | F.contains(F.lower(c), F.lit(query.casefold()))
    kept = symbols.where(holds if not kind else holds & (F.col("kind") == kind))
    return kept.orderBy(F.lower("path"), "start_line", F.lower("name")).limit(limit)


def symbol_list(spark: SparkSession, d: str) -> DataFrame:
    p = read(spark, d, "part")
    kind = F.when(F.col("p_size") % 3 == 0, "class").otherwise("function")
    symbols = p.select(F.col("p_partkey").alias("symbol_id"), F.initcap("p_name").alias("name"), F.concat_ws(".", "p_brand", "p_name").alias("qualified"), F.concat(F.lit("src/"), F.col("p_type"), F.col("p_partkey"), F.lit(".py")).alias("path"), kind.alias("kind"), F.col("p_size").alias("start_line"))
    return listed_symbols(symbols, "ST", "function", 100).select("symbol_id", "name", "path")


def shown(kind: Column, level: str) -> Column:
    """Whether a reader at a level of detail sees an event of a kind."""
    return F.lit(True) if level == "full" else kind.isin(*ESSENTIAL) if level == "essential" else ~kind.isin(*DELTA)


def feedback_events(spark: SparkSession, d: str) -> DataFrame:
    """Events that readers see at each level of detail."""
    e = read(spark, d, "events")
    names = {"view": DELTA[0], "click": "agent.message", "signup": "task.created", "error": "task.failed", "purchase": "runtime.note"}
    kind = F.create_map(*[F.lit(x) for pair in names.items() for x in pair])[F.col("event_type")]
    told = e.select("event_id", kind.alias("kind"))
    levels = [told.where(shown(F.col("kind"), level)).select(F.lit(level).alias("level"), "event_id", "kind") for level in ("full", "essential", "standard")]
    return levels[0].unionByName(levels[1]).unionByName(levels[2])


def found_issues(issues: DataFrame, query: str, status: str = "all", boundary: str = "all") -> DataFrame:
    """Issues whose code, title or summary holds the query, of a status and a boundary."""
    wanted = query.strip().lower()
    holds = F.lit(not wanted)
    for c in ("code", "title", "summary"):
        holds = holds | F.contains(F.lower(c), F.lit(wanted))
    for column, value in (("status", status), ("boundary", boundary)):
        holds = holds if value == "all" else holds & (F.col(column) == value)
    return issues.where(holds)


def issue_search(spark: SparkSession, d: str) -> DataFrame:
    p = read(spark, d, "part")
    issues = p.select(F.concat(F.lit("ISS-"), "p_partkey").alias("code"), F.col("p_name").alias("title"), F.col("p_type").alias("summary"), F.when(F.col("p_size") % 2 == 0, "open").otherwise("closed").alias("status"), F.when(F.col("p_size") % 3 == 0, "runtime").otherwise("source").alias("boundary"))
    return found_issues(issues, " Iss-1", "open").unionByName(found_issues(issues, "ST", boundary="runtime")).distinct()


def memoised(texts: DataFrame, cache: Table, round_: int) -> int:
    """Embed the texts (text) that the cache has no vector for, and put them there. -> how many there were."""
    new = texts.where("text IS NOT NULL").select(F.sha2("text", 256).alias("text_hash"), "text").dropDuplicates(["text_hash"])
    new = new.join(cache.read().select("text_hash"), "text_hash", "left_anti")
    vectors = new.select("text_hash", V.byte_embedding(F.col("text")).alias("vector"), F.lit(round_).alias("round"))
    before = cache.read().count()
    cache.commit(vectors)
    return cache.read().count() - before


def memoised_vectors(spark: SparkSession, d: str) -> DataFrame:
    """Addresses with their vectors: those of a first round are not made again in the second, and a third has nothing to do."""
    urls = read(spark, d, "pages").select("page_id", F.col("url").alias("text"))
    cache = Table.create(spark.createDataFrame([], "text_hash string, vector array<double>, round int"), shared_path(spark, "vectors"), ["text_hash"], 16)
    memoised(urls.where("page_id % 2 = 0"), cache, 0)
    memoised(urls, cache, 1)
    if memoised(urls, cache, 2):
        raise AssertionError("vectors were made twice")
    return urls.select("page_id", F.sha2("text", 256).alias("text_hash")).join(cache.read().select("text_hash", "round", F.size("vector").alias("dimensions")), "text_hash").select("page_id", "round", "dimensions")


def registered(configs: DataFrame) -> DataFrame:
    """configs (path, code, physical_id) -> path, problem: the later one, by path, of two with one code or one id."""
    seen = lambda c: configs.groupBy(F.col(c).alias(f"_{c}")).agg(F.min("path").alias(f"_first_{c}"))
    both = configs.join(seen("code"), F.col("code") == F.col("_code"), "left").join(seen("physical_id"), F.col("physical_id") == F.col("_physical_id"), "left")
    later = lambda c: F.col(f"_first_{c}") < F.col("path")
    problem = F.when(later("code"), F.concat(F.lit("Duplicate project code: "), "code")).when(later("physical_id"), F.concat(F.lit("Duplicate project physical ID: "), "physical_id"))
    return both.select("path", problem.alias("problem")).where("problem IS NOT NULL")


def registry_duplicates(spark: SparkSession, d: str) -> DataFrame:
    s = read(spark, d, "customer")
    key = F.col("c_custkey")
    return registered(s.select(F.concat(F.lit("projects/"), F.lpad(key.cast("string"), 9, "0"), F.lit(".yaml")).alias("path"), F.concat(F.lit("code-"), key % 100).alias("code"), F.concat(F.lit("id-"), key % 71).alias("physical_id")))


def graph_deltas(spark: SparkSession, d: str) -> DataFrame:
    """Edges between parts by name, after some files have lost symbols and references."""
    p = read(spark, d, "part").withColumn("file_id", (F.col("p_partkey") % 200).cast("long"))
    key = F.col("p_partkey").cast("long")
    symbols = p.select("file_id", key.alias("symbol_id"), F.element_at(F.split("p_name", " "), 1).alias("name"))
    references = p.select("file_id", key.alias("source_id"), F.concat(F.lit("lib::"), F.element_at(F.split("p_name", " "), -1), F.lit("(x)")).alias("target"))
    graph = CodeGraph.create(spark, shared_path(spark, "graph"), 16)
    graph.update(p.select("file_id"), symbols.where("symbol_id % 3 < 2"), references)
    changed = p.where("file_id % 5 = 0").select("file_id")
    graph.update(changed, symbols.where("symbol_id % 3 = 0"), references.where("source_id % 2 = 0"))
    return graph.edges()


QUERIES = {f.__name__: f for f in (
    rejection_archive, csv_export, stream_payloads, object_store, symbol_list, feedback_events, issue_search, memoised_vectors, registry_duplicates, graph_deltas,
)}

_REJECTED = """r AS (SELECT l_orderkey AS id, l_linenumber AS ln, 'no "' || l_linestatus || '", line ' || l_linenumber AS reason FROM lineitem WHERE l_returnflag = 'R')"""
ORACLE = {
    "rejection_archive": f"""WITH {_REJECTED} SELECT '0-header' AS part, '{{"record_type":"rejection_archive","schema_version":1,"record_count":' || count(*) || '}}' AS line, CAST(1 AS BIGINT) AS n FROM r
      UNION ALL SELECT '1-lines', '{{"id":' || id || ',"line_number":' || ln || ',"disposition":"rejected","reason":"' || replace(reason, '"', '\\"') || '"}}', count(*) FROM r GROUP BY ALL""",
    "csv_export": f"""WITH {_REJECTED} SELECT '0-header' AS part, chr(65279) || 'id,line_number,disposition,reason' AS line, CAST(1 AS BIGINT) AS n
      UNION ALL SELECT '1-lines', id || ',' || ln || ',rejected,"' || replace(reason, '"', '""') || '"', count(*) FROM r GROUP BY ALL""",
    "stream_payloads": """WITH e AS (SELECT event_id AS i, user_id AS t, event_id % 100 AS s, event_id % 1000 AS cs, user_id % 10 AS c, event_type AS k, strftime(ts, '%Y-%m-%dT%H:%M:%S') AS at_, user_id % 5 AS p,
        '"data":{"user":' || user_id || ',"note":' || CASE WHEN event_id % 3 > 0 THEN '"' || event_type || '"' ELSE 'null' END || '}}' || chr(10) || chr(10) AS data FROM events)
      SELECT i AS event_id, md5('id: ' || s || chr(10) || 'event: ' || k || chr(10) || 'data: {"event_id":' || i || ',"task_id":' || t || ',"sequence":' || s || ',"global_sequence":' || i || ',"type":"' || k || '","timestamp":"' || at_ || '",' || data) AS task,
        md5('id: ' || cs || chr(10) || 'event: ' || k || chr(10) || 'data: {"event_id":' || i || ',"conversation_id":' || c || ',"task_id":' || t || ',"sequence":' || cs || ',"task_sequence":' || s || ',"global_sequence":' || i || ',"type":"' || k || '","timestamp":"' || at_ || '",' || data) AS conversation,
        md5('id: ' || i || chr(10) || 'event: audit.event' || chr(10) || 'data: {"event_id":' || i || ',"trace_id":' || t || ',"task_id":' || t || ',"sequence":' || i || ',"task_sequence":' || s || ',"conversation_id":' || c || ',"type":"' || k || '","timestamp":"' || at_
          || '","trigger_source":"ui","client_id":null,"client_request_id":"réq","project_id":' || p || ',"project_code":"P' || p || '",' || data) AS audit FROM e""",
    "object_store": "SELECT DISTINCT sha256(text) AS sha256, CAST(strlen(text) AS BIGINT) AS size FROM documents WHERE text IS NOT NULL",
    "symbol_list": """WITH s AS (SELECT p_partkey AS symbol_id, array_to_string(list_transform(string_split(p_name, ' '), lambda x: upper(x[1:1]) || lower(x[2:])), ' ') AS name, p_brand || '.' || p_name AS qualified, 'src/' || p_type || p_partkey || '.py' AS path, p_size AS l FROM part WHERE p_size % 3 <> 0)
      SELECT symbol_id, name, path FROM s WHERE contains(lower(name), 'st') OR contains(lower(qualified), 'st') OR contains(lower(path), 'st') ORDER BY lower(path), l, lower(name) LIMIT 100""",
    "feedback_events": """WITH e AS (SELECT event_id, CASE event_type WHEN 'view' THEN 'agent.message.delta' WHEN 'click' THEN 'agent.message' WHEN 'signup' THEN 'task.created' WHEN 'error' THEN 'task.failed' ELSE 'runtime.note' END AS kind FROM events)
      SELECT 'full' AS level, event_id, kind FROM e UNION ALL SELECT 'essential', event_id, kind FROM e WHERE kind IN ('agent.message', 'task.created', 'task.failed') UNION ALL SELECT 'standard', event_id, kind FROM e WHERE kind <> 'agent.message.delta'""",
    "issue_search": """WITH i AS (SELECT 'ISS-' || p_partkey AS code, p_name AS title, p_type AS summary, CASE WHEN p_size % 2 = 0 THEN 'open' ELSE 'closed' END AS status, CASE WHEN p_size % 3 = 0 THEN 'runtime' ELSE 'source' END AS boundary FROM part)
      SELECT * FROM i WHERE (status = 'open' AND (contains(lower(code), 'iss-1') OR contains(lower(title), 'iss-1') OR contains(lower(summary), 'iss-1'))) OR (boundary = 'runtime' AND (contains(lower(code), 'st') OR contains(lower(title), 'st') OR contains(lower(summary), 'st')))""",
    "memoised_vectors": "SELECT page_id, CASE WHEN url IN (SELECT url FROM pages WHERE page_id % 2 = 0) THEN 0 ELSE 1 END AS round, 64 AS dimensions FROM pages WHERE url IS NOT NULL",
    "registry_duplicates": """WITH c AS (SELECT 'projects/' || lpad(CAST(c_custkey AS VARCHAR), 9, '0') || '.yaml' AS path, 'code-' || c_custkey % 100 AS code, 'id-' || c_custkey % 71 AS id FROM customer),
      n AS (SELECT path, code, id, min(path) OVER (PARTITION BY code) < path AS a, min(path) OVER (PARTITION BY id) < path AS b FROM c)
      SELECT path, CASE WHEN a THEN 'Duplicate project code: ' || code ELSE 'Duplicate project physical ID: ' || id END AS problem FROM n WHERE a OR b""",
    "graph_deltas": """WITH p AS (SELECT p_partkey AS id, p_partkey % 200 % 5 = 0 AS changed, lower(split_part(p_name, ' ', 1)) AS first, split_part(p_name, ' ', -1) AS last FROM part), s AS (SELECT id, first AS k FROM p WHERE CASE WHEN changed THEN id % 3 = 0 ELSE id % 3 < 2 END),
      r AS (SELECT id AS source_id, 'lib::' || last || '(x)' AS target, lower(last) AS k FROM p WHERE NOT changed OR id % 2 = 0)
      SELECT source_id, target, min(id) AS target_id, CASE WHEN min(id) IS NULL THEN 0.65::DOUBLE ELSE 0.95::DOUBLE END AS confidence FROM r LEFT JOIN s ON r.k = s.k AND id <> source_id GROUP BY 1, 2""",
}
