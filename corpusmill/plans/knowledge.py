"""Text, chunks, search, facts and graphs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusmill.functions import rules as R
from corpusmill.functions import text as X
from corpusmill.functions import vectors as V
from corpusmill.operators import code as C
from corpusmill.operators import search as S
from corpusmill.operators import windows as W
from corpusmill.sources.tables import EXTENSIONS, entries, read

QUERY = "erst thing of code: 42"
TERMS = ["the", "erst", "tion of", "straße", "42"]
PREAMBLE, BUDGET = 300, 12_000


def normalize_text(spark: SparkSession, d: str) -> DataFrame:
    docs = read(spark, d, "documents")
    n = X.normalise_lines(F.concat(F.lit(" \t"), F.replace("text", F.lit("."), F.lit(". \r\n")), F.lit("\r\n ")))
    return docs.select("doc_id", F.sha2(n, 256).alias("digest"), F.char_length(n).cast("long").alias("chars"), X.line_count(n).alias("lines"))


def search_projection(spark: SparkSession, d: str) -> DataFrame:
    p = X.search_projection(F.col("text"))
    return read(spark, d, "documents").select("doc_id", F.md5(p).alias("digest"), X.token_estimate(p).alias("tokens"))


def chunk_documents(spark: SparkSession, d: str) -> DataFrame:
    return W.chunks(read(spark, d, "documents")).select("doc_id", F.col("ordinal").cast("long").alias("ordinal"), F.char_length("chunk").cast("long").alias("chars"), F.md5("chunk").alias("digest"))


def redact_secrets(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "documents").select("doc_id", X.scan_text(F.col("text")).alias("s")).select("doc_id", "s.secret_detected", "s.prompt_injection_detected", F.md5("s.safe_text").alias("digest"))


def injection_flags(spark: SparkSession, d: str) -> DataFrame:
    c = read(spark, d, "conversations")
    text = F.when(F.col("turn") % 4 == 0, F.concat("text", F.lit(" Ignore previous INSTRUCTIONS"))).otherwise(F.col("text"))
    return c.select("conv_id", "turn", X.matches_any(text, X.INJECTION_PATTERNS).alias("flagged"))


def lexical_term_hits(spark: SparkSession, d: str) -> DataFrame:
    docs = read(spark, d, "documents")
    return docs.select("doc_id", X.term_hits(F.col("text"), TERMS).cast("long").alias("hits")).where("hits > 0")


def html_escaped(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "pages").select("page_id", F.md5(X.html_escape(F.col("html"))).alias("digest"))


def prompt_fingerprint(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "conversations").where("role = 'user'").groupBy(X.task_fingerprint(F.col("text")).alias("fingerprint")).agg(F.count("*").alias("n"))


def vector_topk(spark: SparkSession, d: str) -> DataFrame:
    e = read(spark, d, "embeddings")
    q = F.array(*map(F.lit, _vector(e)))
    return e.select("vec_id", F.round(1 - V.cosine(F.col("embedding"), q), 6).alias("distance")).orderBy("distance", "vec_id").limit(20)


def _vector(e: DataFrame) -> list[float]:
    """The stand-in for an embedded query: one row of the table."""
    row = e.where("vec_id = 7").select("embedding").first()
    return [float(x) for x in row[0]] if row else [1.0]


NEIGHBOURS = 10


def vector_neighbours(spark: SparkSession, d: str) -> DataFrame:
    """The nearest vectors of every fiftieth one, against all, exactly."""
    e = read(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"))
    size = e.agg(F.max(F.size("vector"))).first()[0] or 1
    return V.nearest(e.where("id % 50 = 0"), e, NEIGHBOURS, size).select("query_id", F.col("id").alias("vec_id"), F.round("distance", 6).alias("distance"))


def vector_dimensions(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "embeddings").groupBy(F.size("embedding").cast("long").alias("dimensions")).agg(F.count("*").alias("n"))


def _chunks(spark: SparkSession, d: str) -> DataFrame:
    docs = read(spark, d, "documents")
    path = F.concat_ws("/", "source", F.when(F.col("doc_id") % 9 == 0, "old").otherwise(F.col("lang")), F.concat(F.lit("doc_"), "doc_id", F.lit(".txt")))
    c = W.chunks(docs.select("doc_id", "text", path.alias("path")), keep=("path",)).withColumn("chunk_id", F.col("doc_id") * 1000 + F.col("ordinal"))
    v = read(spark, d, "embeddings").select((F.col("vec_id") * 1000).alias("chunk_id"), F.col("embedding").alias("vector"))
    return c.join(v, "chunk_id", "left").select("chunk_id", "doc_id", F.col("ordinal").cast("long").alias("ordinal"), "path", F.col("chunk").alias("text"), "vector")


def _code(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Symbols, relations and links: every fifth document defines a symbol of its language, which refers to the next one and
    is mentioned by the document after it."""
    docs = read(spark, d, "documents").where("doc_id % 5 = 1")
    name = F.element_at(F.array(*map(F.lit, ("Thing", "erst", "code", "offer", "plain", "Erstthing"))), (F.col("doc_id") % 6 + 1).cast("int"))
    path = F.concat_ws("/", "source", F.when(F.col("doc_id") % 9 == 0, "old").otherwise(F.col("lang")), F.concat(F.lit("doc_"), "doc_id", F.lit(".txt")))
    symbols = docs.select(F.col("doc_id").alias("symbol_id"), "doc_id", name.alias("name"), F.concat_ws(".", "lang", name).alias("qualified"), path.alias("path"))
    relations = docs.select(F.col("doc_id").alias("source_id"), (F.col("doc_id") + 5).alias("target_id"))
    links = docs.select(F.col("doc_id").alias("symbol_id"), (F.col("doc_id") + 1).alias("doc_id"), F.lit(0.9).alias("score"))
    return symbols, relations, links


def _found(spark: SparkSession, d: str) -> DataFrame:
    return S.search(_chunks(spark, d), QUERY, _vector(read(spark, d, "embeddings")), 10, *_code(spark, d))


def hybrid_search(spark: SparkSession, d: str) -> DataFrame:
    """The flagship: the ten best chunks for a query by path, text, vector and code."""
    return _found(spark, d).select("chunk_id", "doc_id", "path", "score", "reasons", "position")


def context_pack(spark: SparkSession, d: str) -> DataFrame:
    found = _found(spark, d)
    return S.context(found, BUDGET, PREAMBLE).select("position", "chunk_id", F.col("used").cast("long").alias("used"))


def _candidates(spark: SparkSession, d: str) -> DataFrame:
    l = read(spark, d, "lineitem")
    return l.select((F.col("l_partkey") % 97).alias("field"), F.concat_ws("-", "l_returnflag", "l_linestatus").alias("value"), (F.col("l_linenumber") + F.col("l_suppkey") % 5).cast("long").alias("priority"), F.col("l_discount").alias("confidence"), F.struct("l_orderkey", "l_linenumber").alias("seq"))


def field_winner(spark: SparkSession, d: str) -> DataFrame:
    """Of each field the values at the best priority, each with its most confident candidate; the first of equals."""
    c = _candidates(spark, d)
    best = c.groupBy("field").agg(F.min("priority").alias("priority"))
    top = c.join(best, ["field", "priority"])
    return W.latest(top, ["field", "value"], [F.desc("confidence"), F.col("seq").asc()]).select("field", "value", "priority", "confidence", F.col("seq.l_orderkey").alias("l_orderkey"))


def field_conflicts(spark: SparkSession, d: str) -> DataFrame:
    w = field_winner(spark, d)
    return w.groupBy("field").agg(F.count("*").alias("n"), F.array_join(F.array_sort(F.collect_list("value")), ",").alias("candidates")).where("n > 1").withColumn("reason", F.lit("SAME_PRIORITY_DIFFERENT_VALUES"))


def coverage(spark: SparkSession, d: str) -> DataFrame:
    l = read(spark, d, "lineitem").groupBy("l_suppkey").agg(F.count("*").alias("total"), F.count_if(F.col("l_returnflag") == "R").alias("analyzed"), F.count_if((F.col("l_linestatus") == "F") & (F.col("l_returnflag") == "A")).alias("excluded"))
    rest = F.col("total") - F.col("excluded")
    return l.withColumn("coverage", F.when(rest == 0, 1.0).otherwise(F.round(R.clamp(F.col("analyzed") / rest), 6)))


def scope_resolution(spark: SparkSession, d: str) -> DataFrame:
    """Subjects against identities: a code as a token counts 100, a name inside 10; the best alone resolves."""
    n = read(spark, d, "nation")
    subject = F.lower(F.concat_ws(" ", F.lit("site"), F.when(F.col("c_custkey") % 4 == 0, F.lit("unknown")).otherwise(F.col("n_name")), F.lit("code"), F.when(F.col("c_custkey") % 3 == 0, F.lit("999")).otherwise((F.col("c_custkey") % 25).cast("string"))))
    c = read(spark, d, "customer").join(n, F.col("c_nationkey") == F.col("n_nationkey")).select("c_custkey", subject.alias("subject"))
    tokens = c.select("c_custkey", "subject", F.explode(F.array_distinct(F.split("subject", "[^0-9a-z]+"))).alias("token"))
    by_code = tokens.join(n.select(F.col("n_nationkey").alias("root"), F.col("n_nationkey").cast("string").alias("token")), "token").select("c_custkey", "root", F.lit(100).alias("points"))
    first = F.element_at(F.split(F.lower("n_name"), "[^0-9a-z]+"), 1)
    by_name = tokens.join(n.select(F.col("n_nationkey").alias("root"), first.alias("token"), F.lower("n_name").alias("name")), "token").where(F.col("subject").contains(F.col("name"))).select("c_custkey", "root", F.lit(10).alias("points"))
    scores = by_code.unionByName(by_name).groupBy("c_custkey", "root").agg(F.sum("points").alias("score"))
    top = scores.groupBy("c_custkey").agg(F.max("score").alias("score"), F.max_by(F.struct("root"), F.struct("score", -F.col("root"))).alias("b"), F.collect_list("score").alias("all"))
    ties = F.size(F.filter("all", lambda s: s == F.col("score")))
    out = c.select("c_custkey").join(top, "c_custkey", "left")
    return out.select("c_custkey", F.when(F.col("score").isNull(), "NOT_FOUND").when(ties > 1, "AMBIGUOUS").otherwise("RESOLVED").alias("status"), F.when(ties == 1, F.col("b.root")).alias("root"), F.when(ties == 1, F.when(F.col("score") >= 100, 1.0).otherwise(0.9)).alias("confidence"))


def code_symbols_fallback(spark: SparkSession, d: str) -> DataFrame:
    key = F.col("p_partkey").cast("string")
    source = F.concat(F.lit("import x\npublic class P"), key, F.lit(" {\n  int run"), F.col("p_size").cast("string"), F.lit("(int a) {\n    return go(a);\n  }\n}\ndef f"), key, F.lit("(x):\n    return P"), key, F.lit(".run(x)\n"))
    return C.symbols(read(spark, d, "part").select(F.col("p_partkey").alias("doc_id"), source.alias("text"))).select("doc_id", "kind", "name", "start_line", "end_line", "signature")


def line_islands(spark: SparkSession, d: str) -> DataFrame:
    return W.islands(read(spark, d, "lineitem").where("l_returnflag = 'N'").select("l_orderkey", "l_linenumber").distinct(), "l_orderkey", "l_linenumber")


def name_resolution(spark: SparkSession, d: str) -> DataFrame:
    p = read(spark, d, "part")
    refs = p.select(F.col("p_partkey").alias("source_id"), F.concat(F.lit("lib::"), F.element_at(F.split("p_name", " "), -1), F.lit("(x)")).alias("target"))
    return C.resolve(refs, p.where("p_partkey % 3 = 0").select(F.element_at(F.split("p_name", " "), 1).alias("name"), F.col("p_partkey").alias("symbol_id")))


def mention_links(spark: SparkSession, d: str) -> DataFrame:
    """Which symbols the documents mention, by name or by path. The symbols are named after words of the benchmark."""
    e = entries(read(spark, d, "documents").withColumn("n_chars", F.col("n_chars"))).select("doc_id", "path")
    text = F.when(F.col("doc_id") % 50 == 3, F.concat("text", F.lit(" see LIB/mod_"), F.col("doc_id") % 40, F.lit(".py"))).otherwise(F.col("text"))
    docs = read(spark, d, "documents").select("doc_id", text.alias("text")).join(e, "doc_id")
    word = F.element_at(F.split("text", " "), (F.col("item_id") % 3 + 1).cast("int"))
    symbols = read(spark, d, "benchmark").select(F.col("item_id").alias("symbol_id"), F.when(F.col("item_id") % 4 == 0, "module").otherwise("function").alias("kind"), word.alias("name"), F.concat(F.lit("lib/mod_"), F.col("item_id") % 40, F.lit(".py")).alias("path"))
    return S.mention_links(docs, symbols)


def one_hop(spark: SparkSession, d: str) -> DataFrame:
    """From matched symbols over relations to related symbols and their documents."""
    l = read(spark, d, "lineitem").select("l_orderkey", "l_partkey", "l_suppkey")
    matched = read(spark, d, "part").where("p_size = 7").select(F.col("p_partkey").alias("l_partkey"))
    related = l.join(matched, "l_partkey", "left_semi").select("l_suppkey").distinct()
    return l.join(related, "l_suppkey").groupBy("l_suppkey").agg(F.count_distinct("l_orderkey").alias("orders"))


def event_sequences(spark: SparkSession, d: str) -> DataFrame:
    e = W.sequence_in(read(spark, d, "events").select("event_id", "user_id", "event_type", "ts"), "user_id", ["ts", "event_id"], "user_sequence")
    e = W.sequence_in(e, "event_type", ["ts", "event_id"], "type_sequence")
    return W.global_sequence(e, ["ts", "event_id"], "global_sequence").select("event_id", "user_sequence", "type_sequence", F.col("global_sequence").cast("long").alias("global_sequence"))


def event_tail_page(spark: SparkSession, d: str) -> DataFrame:
    """The page of events before a cursor, in ascending order."""
    return read(spark, d, "events").where("event_id < 800").orderBy(F.desc("event_id")).limit(50).orderBy("event_id").select("event_id", "event_type")


def event_messages(spark: SparkSession, d: str) -> DataFrame:
    from corpusmill.sources.files import event_lines

    e = read(spark, d, "events").where("event_id > 100")
    return e.select("event_id", event_lines(F.col("event_type"), F.col("event_id"), F.col("props")).alias("message"))


QUERIES = {f.__name__: f for f in (
    normalize_text, search_projection, chunk_documents, redact_secrets, injection_flags, lexical_term_hits, html_escaped, prompt_fingerprint, vector_topk, vector_neighbours, vector_dimensions, hybrid_search, context_pack, field_winner, field_conflicts,
    coverage, scope_resolution, code_symbols_fallback, line_islands, name_resolution, mention_links, one_hop, event_sequences, event_tail_page, event_messages,
)}

_BLANK = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
_CHUNKS = f"""c0 AS (SELECT doc_id, text, unnest(generate_series(0, greatest(length(text) - 481, 0), 2720)) AS s FROM documents WHERE length(text) > 0),
c1 AS (SELECT doc_id, s, trim(substr(text, s + 1, 3200), {_BLANK}) AS chunk FROM c0),
c AS (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY s) - 1 AS ordinal, chunk FROM c1 WHERE chunk <> '')"""
_FOLD = "replace(lower({}), 'ß', 'ss')"


def _hits(column: str, terms: list[str]) -> str:
    return " + ".join(f"CAST(contains({_FOLD.format(column)}, '{t}') AS INT)" for t in terms)


def _some(column: str, terms: list[str]) -> str:
    return "(" + " OR ".join(f"contains(lower({column}), '{t}')" for t in terms) + ")"


_T = X.query_terms(QUERY)
_SEARCH = f"""WITH {_CHUNKS}, k AS (SELECT doc_id * 1000 + ordinal AS chunk_id, doc_id, source || '/' || CASE WHEN doc_id % 9 = 0 THEN 'old' ELSE lang END || '/doc_' || doc_id || '.txt' AS path, chunk AS text FROM c JOIN documents USING (doc_id)),
q AS (SELECT CAST(embedding AS DOUBLE[]) AS q FROM embeddings WHERE vec_id = 7),
live AS (SELECT chunk_id FROM k WHERE doc_id % 9 <> 0),
p AS (SELECT chunk_id, row_number() OVER (ORDER BY chunk_id) AS rank FROM (SELECT chunk_id FROM k WHERE {_some("path", _T)} ORDER BY chunk_id LIMIT 40) JOIN live USING (chunk_id)),
t AS (SELECT chunk_id, row_number() OVER (ORDER BY chunk_id) AS rank FROM (SELECT chunk_id FROM k WHERE {_some("text", _T)} ORDER BY chunk_id LIMIT 40) JOIN live USING (chunk_id)),
d AS (SELECT chunk_id, 1 - list_cosine_similarity(CAST(embedding AS DOUBLE[]), q) AS dist FROM k JOIN embeddings ON vec_id * 1000 = chunk_id, q),
v AS (SELECT chunk_id, row_number() OVER (ORDER BY dist, chunk_id) AS rank FROM (SELECT * FROM d ORDER BY dist, chunk_id LIMIT 20) JOIN live USING (chunk_id)),
sy0 AS (SELECT doc_id AS symbol_id, doc_id, list_extract(['Thing', 'erst', 'code', 'offer', 'plain', 'Erstthing'], CAST(doc_id % 6 + 1 AS INT)) AS name, lang FROM documents WHERE doc_id % 5 = 1),
sy1 AS (SELECT *, lang || '.' || name AS qualified FROM sy0 WHERE {_some("name", _T)} OR {_some("lang || '.' || name", _T)} ORDER BY name, symbol_id LIMIT 40),
sy2 AS (SELECT *, CASE WHEN lower(name) = '{QUERY}' OR lower(qualified) = '{QUERY}' THEN 10.0::DOUBLE ELSE 6.0::DOUBLE * CAST(contains('{QUERY}', lower(name)) AS INT) + 7 * CAST(contains('{QUERY}', lower(qualified)) AS INT) + {" + ".join(f"CAST(contains(lower(name), '{t}') OR contains(lower(qualified), '{t}') AS INT)" for t in _T)} END AS score FROM sy1 WHERE doc_id % 9 <> 0),
sy AS (SELECT *, row_number() OVER (ORDER BY score DESC, name, symbol_id) AS rank FROM sy2),
x AS (SELECT chunk_id, row_number() OVER (ORDER BY doc_id, chunk_id) AS rank FROM (SELECT chunk_id, doc_id FROM k WHERE doc_id IN (SELECT doc_id FROM sy) ORDER BY doc_id, chunk_id LIMIT 40) JOIN live USING (chunk_id)),
hot AS (SELECT * FROM sy WHERE rank <= 20 AND score > 0),
rel AS (SELECT symbol_id AS a, symbol_id + 5 AS b FROM sy0 WHERE symbol_id IN (SELECT symbol_id FROM sy) ORDER BY 1, 2 LIMIT 80),
lnk AS (SELECT symbol_id, doc_id + 1 AS doc_id, 0.9::DOUBLE AS score FROM sy0 WHERE symbol_id IN (SELECT symbol_id FROM sy) ORDER BY 1, 2 LIMIT 80),
m AS (SELECT chunk_id, min({{'c': c, 'r': rank}}) AS seq FROM (SELECT *, 1 AS c FROM p UNION ALL SELECT *, 2 FROM t UNION ALL SELECT *, 3 FROM v UNION ALL SELECT *, 4 FROM x) GROUP BY 1),
r AS (SELECT chunk_id, doc_id, path, text, seq, {_hits("text", _T)} AS hits FROM m JOIN k USING (chunk_id)),
w AS (SELECT *, row_number() OVER (ORDER BY hits DESC, seq) AS rank FROM r WHERE seq.c < 4 QUALIFY rank <= 20),
s AS (SELECT chunk_id, 2 + 1 / rank AS part, 'exact_path' AS reason, 1 AS ch, rank FROM p UNION ALL SELECT chunk_id, 1 / (60 + rank), 'vector', 2, rank FROM v UNION ALL SELECT chunk_id, 1 / (60 + rank), 'keyword', 3, rank FROM w
  UNION ALL SELECT chunk_id, 1.0, 'exact_text', 4, rank FROM w WHERE contains({_FOLD.format("text")}, '{QUERY.casefold()}')
  UNION ALL SELECT chunk_id, 1 / (30 + hot.rank), 'code_symbol', 5, hot.rank FROM hot JOIN r USING (doc_id)
  UNION ALL SELECT chunk_id, 1 / 45, 'code_relation', 6, 0 FROM (SELECT DISTINCT sy.doc_id FROM sy JOIN rel ON b = sy.symbol_id WHERE a IN (SELECT symbol_id FROM hot)) JOIN r USING (doc_id)
  UNION ALL SELECT chunk_id, lnk.score / 45, 'code_document_link', 7, 0 FROM lnk JOIN r USING (doc_id) WHERE lnk.symbol_id IN (SELECT symbol_id FROM hot)),
g AS (SELECT chunk_id, round(sum(part), 9) AS score, string_agg(DISTINCT reason, ',' ORDER BY reason) AS reasons, min({{'a': ch, 'r': rank}}) AS f FROM s GROUP BY 1),
o AS (SELECT g.*, doc_id, path, text, row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, f, chunk_id) > 2 AS over FROM g JOIN r USING (chunk_id)),
res AS (SELECT *, row_number() OVER (ORDER BY over, score DESC, f, chunk_id) AS position FROM o QUALIFY position <= 10)"""
_FACTS = """c AS (SELECT l_partkey % 97 AS field, l_returnflag || '-' || l_linestatus AS value, CAST(l_linenumber + l_suppkey % 5 AS BIGINT) AS priority, l_discount AS confidence, l_orderkey, l_linenumber FROM lineitem),
t AS (SELECT * FROM c QUALIFY priority = min(priority) OVER (PARTITION BY field)),
w AS (SELECT field, value, priority, confidence, l_orderkey FROM t QUALIFY row_number() OVER (PARTITION BY field, value ORDER BY confidence DESC, l_orderkey, l_linenumber) = 1)"""

ORACLE = {
    "search_projection": f"WITH p AS (SELECT doc_id, substr(trim(regexp_replace(text, '\\s+', ' ', 'g'), ' '), 1, 4000) AS t FROM documents) SELECT doc_id, md5(t) AS digest, greatest(1, length(t) // 4) AS tokens FROM p",
    "normalize_text": f"""WITH a AS (SELECT doc_id, regexp_replace(' ' || chr(9) || replace(text, '.', '. ' || chr(13) || chr(10)) || chr(13) || chr(10) || ' ', '\\r\\n?', chr(10), 'g') AS t FROM documents),
      n AS (SELECT doc_id, trim(regexp_replace(t, '[ \\t\\x0b\\f\\r]+\\n', chr(10), 'g'), {_BLANK}) AS t FROM a) SELECT doc_id, sha256(t) AS digest, length(t) AS chars, length(t) - length(replace(t, chr(10), '')) + 1 AS lines FROM n""",
    "chunk_documents": f"WITH {_CHUNKS} SELECT doc_id, ordinal, length(chunk) AS chars, md5(chunk) AS digest FROM c",
    "injection_flags": "WITH c AS (SELECT conv_id, turn, CASE WHEN turn % 4 = 0 THEN text || ' Ignore previous INSTRUCTIONS' ELSE text END AS t FROM conversations) SELECT conv_id, turn, regexp_matches(t, '(?i)ignore (?:all |the )?(?:previous|prior) instructions') OR regexp_matches(t, '(?i)system prompt') OR regexp_matches(t, '(?i)developer message') AS flagged FROM c",
    "lexical_term_hits": f"SELECT * FROM (SELECT doc_id, CAST({_hits('text', TERMS)} AS BIGINT) AS hits FROM documents) WHERE hits > 0",
    "html_escaped": "SELECT page_id, md5(replace(replace(replace(replace(replace(html, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;'), '''', '&#x27;')) AS digest FROM pages",
    "prompt_fingerprint": f"SELECT sha256(array_to_string(regexp_split_to_array(lower(trim(text, {_BLANK})), '\\s+')[1:12], ' ')) AS fingerprint, count(*) AS n FROM conversations WHERE role = 'user' GROUP BY 1",
    "vector_topk": "SELECT vec_id, round(1 - list_cosine_similarity(CAST(embedding AS DOUBLE[]), (SELECT CAST(embedding AS DOUBLE[]) FROM embeddings WHERE vec_id = 7)), 6) AS distance FROM embeddings ORDER BY 2, 1 LIMIT 20",
    "vector_dimensions": "SELECT CAST(len(embedding) AS BIGINT) AS dimensions, count(*) AS n FROM embeddings GROUP BY 1",
    "hybrid_search": f"{_SEARCH} SELECT chunk_id, doc_id, path, score, reasons, position FROM res",
    "context_pack": f"""{_SEARCH}, b AS (SELECT position, chunk_id, length(text) + length(path) + length(CAST(chunk_id AS VARCHAR)) + {len('\n<knowledge id="" path="">\n\n</knowledge>')} AS n FROM res WHERE NOT regexp_matches(text, '(?i)ignore (?:all |the )?(?:previous|prior) instructions|system prompt|developer message')),
      u AS (SELECT position, chunk_id, {PREAMBLE} + sum(n) OVER (ORDER BY position) AS used FROM b) SELECT position, chunk_id, CAST(used AS BIGINT) AS used FROM u WHERE used <= {BUDGET}""",
    "field_winner": f"WITH {_FACTS} SELECT * FROM w",
    "field_conflicts": f"WITH {_FACTS} SELECT field, count(*) AS n, string_agg(value, ',' ORDER BY value) AS candidates, 'SAME_PRIORITY_DIFFERENT_VALUES' AS reason FROM w GROUP BY 1 HAVING count(*) > 1",
    "coverage": "WITH c AS (SELECT l_suppkey, count(*) AS total, count(*) FILTER (WHERE l_returnflag = 'R') AS analyzed, count(*) FILTER (WHERE l_linestatus = 'F' AND l_returnflag = 'A') AS excluded FROM lineitem GROUP BY 1) SELECT *, CASE WHEN total = excluded THEN 1.0::DOUBLE ELSE round(least(1.0::DOUBLE, greatest(0.0::DOUBLE, analyzed / (total - excluded))), 6) END AS coverage FROM c",
    "scope_resolution": """WITH c AS (SELECT c_custkey, lower('site ' || CASE WHEN c_custkey % 4 = 0 THEN 'unknown' ELSE n_name END || ' code ' || CASE WHEN c_custkey % 3 = 0 THEN '999' ELSE CAST(c_custkey % 25 AS VARCHAR) END) AS s FROM customer JOIN nation ON c_nationkey = n_nationkey),
      p AS (SELECT c_custkey, n_nationkey AS root, 100 * CAST(list_contains(regexp_split_to_array(s, '[^0-9a-z]+'), CAST(n_nationkey AS VARCHAR)) AS INT) + 10 * CAST(contains(s, lower(n_name)) AS INT) AS score FROM c, nation),
      m AS (SELECT * FROM p WHERE score > 0 QUALIFY score = max(score) OVER (PARTITION BY c_custkey)), g AS (SELECT c_custkey, count(*) AS n, min(root) AS r, max(score) AS top FROM m GROUP BY 1)
      SELECT c_custkey, CASE WHEN n IS NULL THEN 'NOT_FOUND' WHEN n > 1 THEN 'AMBIGUOUS' ELSE 'RESOLVED' END AS status, CASE WHEN n = 1 THEN r END AS root, CASE WHEN n = 1 THEN CASE WHEN top >= 100 THEN 1.0::DOUBLE ELSE 0.9::DOUBLE END END AS confidence FROM c LEFT JOIN g USING (c_custkey)""",
    "code_symbols_fallback": """SELECT p_partkey AS doc_id, 'class' AS kind, 'P' || p_partkey AS name, 2 AS start_line, 2 AS end_line, 'public class P' || p_partkey || ' {' AS signature FROM part
      UNION ALL SELECT p_partkey, 'function', 'run' || p_size, 3, 6, 'int run' || p_size || '(int a) {' FROM part UNION ALL SELECT p_partkey, 'function', 'f' || p_partkey, 7, 9, 'def f' || p_partkey || '(x):' FROM part""",
    "line_islands": "WITH l AS (SELECT DISTINCT l_orderkey, l_linenumber FROM lineitem WHERE l_returnflag = 'N'), r AS (SELECT *, l_linenumber - row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber) AS g FROM l) SELECT l_orderkey, min(l_linenumber) AS first, max(l_linenumber) AS last FROM r GROUP BY l_orderkey, g",
    "name_resolution": """WITH s AS (SELECT p_partkey AS id, lower(split_part(p_name, ' ', 1)) AS k FROM part WHERE p_partkey % 3 = 0), r AS (SELECT p_partkey AS source_id, 'lib::' || split_part(p_name, ' ', -1) || '(x)' AS target, lower(split_part(p_name, ' ', -1)) AS k FROM part)
      SELECT source_id, target, min(id) AS target_id, CASE WHEN min(id) IS NULL THEN 0.65::DOUBLE ELSE 0.95::DOUBLE END AS confidence FROM r LEFT JOIN s ON r.k = s.k AND id <> source_id GROUP BY 1, 2""",
    "mention_links": f"""WITH d AS (SELECT doc_id, lower(CASE WHEN doc_id % 50 = 3 THEN text || ' see LIB/mod_' || doc_id % 40 || '.py' ELSE text END) AS t FROM documents WHERE list_extract([{", ".join(map(repr, EXTENSIONS))}], CAST(doc_id % {len(EXTENSIONS)} + 1 AS INT)) NOT IN ('.py', '.sql')),
      s AS (SELECT item_id AS symbol_id, item_id % 4 = 0 AS module, lower(string_split(text, ' ')[item_id % 3 + 1]) AS n, 'lib/mod_' || item_id % 40 || '.py' AS p FROM benchmark),
      m AS (SELECT doc_id, symbol_id, module, length(n) >= 3 AND contains(replace(t, 'ß', 'ss'), replace(n, 'ß', 'ss')) AS named, contains(t, p) AS placed FROM d, s)
      SELECT doc_id, symbol_id, CASE WHEN module AND placed THEN 'code_path_mention' WHEN module THEN 'module_name_mention' WHEN named THEN 'symbol_name_mention' ELSE 'code_path_context' END AS method,
        CASE WHEN module AND placed THEN 1.0::DOUBLE WHEN module THEN 0.82::DOUBLE WHEN named THEN 0.9::DOUBLE ELSE 0.75::DOUBLE END AS score FROM m WHERE named OR placed""",
    "vector_neighbours": f"""WITH q AS (SELECT vec_id AS query_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings WHERE vec_id % 50 = 0), d AS (SELECT query_id, vec_id, 1 - list_cosine_similarity(v, CAST(embedding AS DOUBLE[])) AS dist FROM q, embeddings)
      SELECT query_id, vec_id, round(dist, 6) AS distance FROM d QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY dist, vec_id) <= {NEIGHBOURS}""",
    "one_hop": "WITH s AS (SELECT DISTINCT l_suppkey FROM lineitem WHERE l_partkey IN (SELECT p_partkey FROM part WHERE p_size = 7)) SELECT l_suppkey, count(DISTINCT l_orderkey) AS orders FROM lineitem JOIN s USING (l_suppkey) GROUP BY 1",
    "event_sequences": "SELECT event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS user_sequence, row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) AS type_sequence, row_number() OVER (ORDER BY ts, event_id) AS global_sequence FROM events",
    "event_tail_page": "SELECT event_id, event_type FROM events WHERE event_id < 800 ORDER BY event_id DESC LIMIT 50",
    "event_messages": "SELECT event_id, 'id: ' || event_id || chr(10) || 'event: ' || event_type || chr(10) || 'data: ' || props || chr(10) || chr(10) AS message FROM events WHERE event_id > 100",
}
