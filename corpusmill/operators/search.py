"""Hybrid search: channels of candidates, reciprocal ranks, spread over documents, context within a budget; and an index of
stretches of three characters for substrings."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusmill.functions import text as X
from corpusmill.functions import vectors as V
from corpusmill.functions.paths import CODE, is_historical, suffix
from corpusmill.operators.windows import diversified
from corpusmill.sources.tables import written

CANDIDATES, RANKED = 40, 20
#: Characters of a stretch of the substring index.
GRAM = 3


def top(rows: DataFrame, keep: Column, order: list[Column], limit: int, number: int) -> DataFrame:
    """chunk_id, channel, rank: the first rows of one channel. Old copies are left out after the limit, as rows of the limit."""
    best = rows.where(keep).select("chunk_id", "path", F.struct(*order).alias("_by")).orderBy("_by").limit(limit).where(~is_historical(F.col("path")))
    return best.select("chunk_id", F.lit(number).alias("channel"), F.row_number().over(Window.orderBy("_by")).alias("rank"))


def any_term(c: Column, terms: list[str]) -> Column:
    return reduce(lambda a, b: a | b, [F.lower(c).contains(t) for t in terms], F.lit(False))


def search(chunks: DataFrame, query: str, vector: list[float] | None, limit: int = 10, symbols: DataFrame | None = None, relations: DataFrame | None = None, links: DataFrame | None = None) -> DataFrame:
    """chunks (chunk_id, doc_id, ordinal, path, text, vector) -> the best chunks for query, with score and reasons.

    symbols (symbol_id, doc_id, name, qualified, path), relations (source_id, target_id) and links (symbol_id, doc_id,
    score) add what code says: chunks of documents of matching symbols, of symbols they refer to, and of documents that
    mention them.

    Texts are read once: the chunks' hits and distances are written without the texts, each channel is a bounded top-k
    over those, and the texts of what they leave, at most two hundred rows, are fetched by id."""
    terms = X.query_terms(query)
    by_id = F.col("chunk_id")
    distance = F.lit(None).cast("double") if vector is None else 1 - V.cosine(F.col("vector"), F.array(*map(F.lit, vector)))
    # each text is folded once, however many terms are looked for in it
    folded = chunks.select("chunk_id", "doc_id", "ordinal", "path", F.lower("path").alias("_path"), F.lower("text").alias("_text"), distance.alias("distance"))
    holds = lambda c: reduce(lambda a, b: a | b, [F.contains(c, F.lit(t)) for t in terms], F.lit(False))
    facts = folded.select("chunk_id", "doc_id", "ordinal", "path", holds("_path").alias("in_path"), holds("_text").alias("in_text"), "distance")
    facts = written(facts, "search-facts")
    channels = [top(facts, F.col("in_path"), [by_id], CANDIDATES, 1), top(facts, F.col("in_text"), [by_id], CANDIDATES, 2)]
    if vector is not None:
        channels.append(top(facts, F.col("distance").isNotNull(), [F.col("distance"), by_id], RANKED, 3))
    parts = []
    if symbols is not None:
        found = written(matching_symbols(symbols, query, terms), "symbols-found")
        near = facts.join(F.broadcast(found.select("doc_id").distinct()), "doc_id", "left_semi")
        channels.append(top(near, F.lit(True), [F.col("doc_id"), F.col("ordinal"), by_id], CANDIDATES, 4))
        ranked = found.where(F.col("rank") <= RANKED).where("score > 0")
        parts.append(ranked.select("doc_id", (1 / (30 + F.col("rank"))).alias("part"), F.lit("code_symbol").alias("reason"), F.lit(5).alias("at"), "rank"))
        later = lambda df, part, reason, at: df.select("doc_id", part.alias("part"), F.lit(reason).alias("reason"), F.lit(at).alias("at"), F.lit(0).alias("rank"))
        ids = F.broadcast(ranked.select("symbol_id"))
        if relations is not None:
            related = first_of(relations.where("target_id IS NOT NULL"), F.broadcast(found.select("symbol_id")), "source_id", "target_id")
            targets = related.join(ids, F.col("source_id") == F.col("symbol_id"), "left_semi").select(F.col("target_id").alias("symbol_id")).distinct()
            parts.append(later(found.join(targets, "symbol_id", "left_semi"), F.lit(1 / 45), "code_relation", 6))
        if links is not None:
            mentioned = first_of(links, F.broadcast(found.select("symbol_id")), "symbol_id", "doc_id")
            parts.append(later(mentioned.join(ids, "symbol_id", "left_semi"), F.col("score") / 45, "code_document_link", 7))
    met = written(reduce(DataFrame.unionByName, channels).coalesce(1), "candidates")
    wanted = F.broadcast(met.groupBy("chunk_id").agg(F.min(F.struct("channel", "rank")).alias("seq")))
    # the channels' limits bound these documents, so a filter on them reaches the scan, before texts are cut into chunks
    some = [r[0] for r in facts.join(F.broadcast(met.select("chunk_id").distinct()), "chunk_id", "left_semi").select("doc_id").distinct().collect()]
    rows = written(chunks.where(F.col("doc_id").isin(some)).select("chunk_id", "doc_id", "path", "text").join(wanted, "chunk_id").withColumn("hits", X.term_hits(F.col("text"), terms)).coalesce(1), "found-chunks")
    lexical = rows.where("seq.channel < 4")
    keyword = lexical.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("hits"), "seq"))).where(F.col("rank") <= RANKED)
    exact = X.fold(F.col("text")).contains(query.casefold())
    score = lambda df, part, reason, at: df.select("chunk_id", part.alias("part"), F.lit(reason).alias("reason"), F.lit(at).alias("at"), "rank")
    scored = [
        score(met.where("channel = 1"), 2 + 1 / F.col("rank"), "exact_path", 1), score(met.where("channel = 3"), 1 / (60 + F.col("rank")), "vector", 2),
        score(keyword, 1 / (60 + F.col("rank")), "keyword", 3), score(keyword.where(exact), F.lit(1.0), "exact_text", 4),
        *(rows.select("chunk_id", "doc_id").join(F.broadcast(p), "doc_id").select("chunk_id", "part", "reason", "at", "rank") for p in parts),
    ]
    scores = reduce(DataFrame.unionByName, scored).groupBy("chunk_id").agg(F.round(F.sum("part"), 9).alias("score"), F.array_join(F.array_sort(F.collect_set("reason")), ",").alias("reasons"), F.min(F.struct("at", "rank")).alias("first"))
    ranked = scores.join(rows.select("chunk_id", "doc_id", "path", "text"), "chunk_id")
    return diversified(ranked, "doc_id", [F.desc("score"), F.col("first").asc(), by_id.asc()]).where(F.col("position") <= limit).drop("first")


def matching_symbols(symbols: DataFrame, query: str, terms: list[str]) -> DataFrame:
    """The first symbols whose names hold a term, without those of old copies; with their score and rank by it."""
    held = any_term(F.col("name"), terms) | any_term(F.col("qualified"), terms)
    first = symbols.where(held).orderBy("name", "symbol_id").limit(CANDIDATES).where(~is_historical(F.col("path")))
    scored = first.withColumn("score", X.symbol_score(F.col("name"), F.col("qualified"), F.col("path"), query, terms))
    return scored.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("score"), "name", "symbol_id")))


def first_of(pairs: DataFrame, ids: DataFrame, key: str, then: str) -> DataFrame:
    """The first pairs, in order, whose key is one of a bounded list of symbols."""
    return pairs.join(ids.withColumnRenamed("symbol_id", key), key, "left_semi").orderBy(key, then).limit(2 * CANDIDATES)


def context(results: DataFrame, budget: int, preamble: int) -> DataFrame:
    """Results as escaped blocks, without those that try to instruct, until the first that would exceed the budget."""
    from corpusmill.operators.windows import within_budget

    e = X.html_escape
    block = F.concat(F.lit('\n<knowledge id="'), e(F.col("chunk_id").cast("string")), F.lit('" path="'), e(F.col("path")), F.lit('">\n'), F.col("text"), F.lit("\n</knowledge>"))
    safe = results.where(~X.matches_any(F.col("text"), X.INJECTION_PATTERNS)).withColumn("block", block)
    return within_budget(safe, "position", F.char_length("block"), budget, preamble)


def grams_of(needles: DataFrame) -> DataFrame:
    """needle_id, gram of needles that are long enough to have one."""
    return needles.where(F.char_length("needle") >= GRAM).select("needle_id", F.explode(X.grams(F.col("needle"), GRAM)).alias("gram"))


def gram_index(texts: DataFrame, key: str, name: str = "gram-index", needles: DataFrame | None = None) -> DataFrame:
    """texts (key, text) -> (gram, key) as a written table: every stretch of GRAM characters of each folded text, once; with
    needles only those that one of them has."""
    rows = texts.select(key, F.explode(X.grams(X.fold(F.col("text")), GRAM)).alias("gram")).select("gram", key)
    return written(rows if needles is None else rows.join(grams_of(needles).select("gram").distinct(), "gram", "left_semi"), name)


def holding(index: DataFrame, texts: DataFrame, needles: DataFrame, key: str) -> DataFrame:
    """texts (key, text), needles (needle_id, needle: folded, GRAM characters or more) -> (key, needle_id) where the folded
    text holds the needle anywhere.

    Each needle is filed under its rarest stretch in the index; texts with that stretch are its candidates, and only
    those are looked through. A text that holds the needle has all of its stretches, so none is lost."""
    own = grams_of(needles)
    seen = index.join(own.select("gram").distinct(), "gram", "left_semi").groupBy("gram").agg(F.count("*").alias("n"))
    filed = own.join(seen, "gram", "left").groupBy("needle_id").agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "gram")).alias("r")).select("needle_id", F.col("r.gram").alias("gram"))
    pairs = written(index.join(filed, "gram").select(key, "needle_id"), "gram-candidates")
    folded = texts.select(key, X.fold(F.col("text")).alias("folded"))
    return pairs.join(needles, "needle_id").join(folded, key).where(F.contains("folded", "needle")).select(key, "needle_id")


# What a link between a symbol and a document scores, by what the document mentions.
MODULE_PATH, MODULE_NAME, SYMBOL_NAME, SYMBOL_PATH = 1.0, 0.82, 0.9, 0.75


def mention_links(docs: DataFrame, symbols: DataFrame) -> DataFrame:
    """docs (doc_id, path, text), symbols (symbol_id, kind, name, path) -> doc_id, symbol_id, method, score.

    Documents that are no code mention a symbol by its name, of three characters or more, or by the path of its file; for
    a module the path counts more, for others the name."""
    texts = docs.where(~suffix(F.col("path")).isin(*CODE)).select("doc_id", "text")
    needles = symbols.select("symbol_id", "kind", F.posexplode(F.array(X.fold(F.col("name")), X.fold(F.col("path")))).alias("what", "needle")).withColumn("needle_id", F.struct("symbol_id", "what"))
    looked_for = needles.select("needle_id", "needle")
    found = holding(gram_index(texts, "doc_id", needles=looked_for), texts, looked_for, "doc_id")
    by = found.groupBy("doc_id", F.col("needle_id.symbol_id").alias("symbol_id")).agg(F.max(F.col("needle_id.what") == 0).alias("named"), F.max(F.col("needle_id.what") == 1).alias("placed")).join(symbols.select("symbol_id", "kind"), "symbol_id")
    to = lambda method, score: F.struct(F.lit(method).alias("method"), F.lit(score).alias("score"))
    module = F.col("kind") == "module"
    link = (
        F.when(module & F.col("placed"), to("code_path_mention", MODULE_PATH)).when(module, to("module_name_mention", MODULE_NAME))
        .when(F.col("named"), to("symbol_name_mention", SYMBOL_NAME)).otherwise(to("code_path_context", SYMBOL_PATH))
    )
    return by.withColumn("link", link).select("doc_id", "symbol_id", "link.method", "link.score")
