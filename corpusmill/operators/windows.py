"""Ranking, sequences, islands, chunks and budgets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusmill.functions.text import py_strip
from corpusmill.sources.tables import written


def latest(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The first row of each group in the given order."""
    return df.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("_n = 1").drop("_n")


def sequence_in(df: DataFrame, key: str, order: list[str], name: str) -> DataFrame:
    """A gap-free number within each entity, however many rows one has: sort by ranges of entity and order, number the
    part of each entity in each range, add what lies before it."""
    sort = df.repartitionByRange(key, *order).sortWithinPartitions(key, *order)
    place = F.monotonically_increasing_id()
    parts = written(sort.withColumn("_p", F.shiftright(place, 33)).withColumn("_i", place.bitwiseAND((1 << 33) - 1)), "ranges")
    # a row for each entity and range it reaches into: as good as one for each entity
    sizes = parts.groupBy(F.col(key).alias("_k"), F.col("_p").alias("_q")).agg(F.count("*").alias("_n"), F.min("_i").alias("_first"))
    before = F.sum("_n").over(Window.partitionBy("_k").orderBy("_q").rowsBetween(Window.unboundedPreceding, -1))
    offsets = sizes.select("_k", "_q", (F.coalesce(before, F.lit(0)) - F.col("_first") + 1).alias("_offset"))
    both = parts.join(offsets, F.col(key).eqNullSafe(F.col("_k")) & (F.col("_p") == F.col("_q")))
    return both.withColumn(name, F.col("_i") + F.col("_offset")).drop("_p", "_i", "_k", "_q", "_offset")


def global_sequence(df: DataFrame, order: list[str], name: str) -> DataFrame:
    """A gap-free number over all rows, without one task for all: sort by ranges, number each range, add what lies before it."""
    sort = df.repartitionByRange(*order).sortWithinPartitions(*order)
    place = F.monotonically_increasing_id()
    parts = written(sort.withColumn("_p", F.shiftright(place, 33)).withColumn("_i", place.bitwiseAND((1 << 33) - 1)), "ranges")
    sizes = parts.groupBy("_p").agg(F.count("*").alias("_n"))  # a row for each range
    before = sizes.withColumn("_before", F.coalesce(F.sum("_n").over(Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    return parts.join(F.broadcast(before.select("_p", "_before")), "_p").withColumn(name, F.col("_before") + F.col("_i") + 1).drop("_p", "_i", "_before")


def islands(df: DataFrame, key: str, line: str) -> DataFrame:
    """(key, first, last) of each run of consecutive numbers."""
    run = F.col(line) - F.row_number().over(Window.partitionBy(key).orderBy(line))
    return df.select(key, line, run.alias("_r")).groupBy(key, "_r").agg(F.min(line).alias("first"), F.max(line).alias("last")).drop("_r")


def chunks(docs: DataFrame, size: int = 3200, overlap: int = 480, keep: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, columns of `keep`, ordinal, chunk: overlapping windows of characters, stripped; empty ones are left out before numbering."""
    n, step = F.char_length("text"), size - overlap
    starts = F.when(n > 0, F.sequence(F.lit(0), F.greatest(n - overlap - 1, F.lit(0)), F.lit(step))).otherwise(F.array().cast("array<int>"))
    cut = F.filter(F.transform(starts, lambda s: py_strip(F.substring(F.col("text"), s + 1, F.lit(size)))), lambda c: c != "")
    return docs.select("doc_id", *keep, F.posexplode(cut).alias("ordinal", "chunk"))


def diversified(ranked: DataFrame, document: str, order: list[Column], most: int = 2) -> DataFrame:
    """ranked is a result list, short enough for one task. Adds position: at most `most` rows of a document come first, the rest follow in their order."""
    nth = F.row_number().over(Window.partitionBy(document).orderBy(*order))
    with_n = ranked.withColumn("_over", (nth > most).cast("int"))
    return with_n.withColumn("position", F.row_number().over(Window.orderBy("_over", *order)).cast("long")).drop("_over")


def within_budget(ranked: DataFrame, position: str, size: Column, budget: int, preamble: int = 0) -> DataFrame:
    """ranked is a result list, short enough for one task. Rows in order until the first that would exceed the budget."""
    used = F.sum(size).over(Window.orderBy(position).rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return ranked.withColumn("used", used + preamble).where(F.col("used") <= budget)


def streaks(df: DataFrame, key: str, order: list[str], success: Column) -> DataFrame:
    """Adds failures and successes in a row up to each event."""
    w = Window.partitionBy(key).orderBy(*order)
    up = df.withColumn("_ok", success.cast("int"))
    up = up.withColumn("_f", F.sum("_ok").over(w)).withColumn("_s", F.sum(1 - F.col("_ok")).over(w))
    fails = F.sum(1 - F.col("_ok")).over(Window.partitionBy(key, "_f").orderBy(*order))
    wins = F.sum("_ok").over(Window.partitionBy(key, "_s").orderBy(*order))
    return up.withColumn("failures", fails.cast("long")).withColumn("successes", wins.cast("long")).drop("_ok", "_f", "_s")
