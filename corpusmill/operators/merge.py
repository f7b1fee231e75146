"""Snapshots and versions: differences, upserts, histories, reconciliation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def difference(before: DataFrame, after: DataFrame, key: str, digest: str) -> DataFrame:
    """key, change: added, changed, unchanged or removed between two snapshots."""
    b = before.select(F.col(key), F.col(digest).alias("_b"), F.lit(True).alias("_in_b"))
    a = after.select(F.col(key), F.col(digest).alias("_a"), F.lit(True).alias("_in_a"))
    change = F.when(F.col("_in_b").isNull(), "added").when(F.col("_in_a").isNull(), "removed").when(F.col("_a").eqNullSafe(F.col("_b")), "unchanged").otherwise("changed")
    return b.join(a, key, "full_outer").select(key, change.alias("change"))


def upsert(snapshot: DataFrame, observed: DataFrame, key: str, digest: str) -> DataFrame:
    """The next snapshot (key, digest, status, present): new rows are observed, changed rows too, others keep their
    status; rows that were not observed stay but are no longer present."""
    old = snapshot.select(key, F.col(digest).alias("_old"), F.col("status").alias("_status"))
    new = observed.select(key, F.col(digest).alias("_new"), F.lit(True).alias("_seen"))
    seen = F.coalesce("_seen", F.lit(False))
    kept = F.when(~seen, "removed").when(F.col("_old").isNull() | ~F.col("_old").eqNullSafe(F.col("_new")) | F.col("_status").isin("removed", "rejected"), "observed").otherwise(F.col("_status"))
    return old.join(new, key, "full_outer").select(key, F.coalesce("_new", "_old").alias(digest), kept.alias("status"), seen.alias("present"))


def merge_rejections(rows: DataFrame, key: str, order: Column) -> DataFrame:
    """One row per key: rejected beats skipped, and among equals the last."""
    rank = F.struct((F.col("disposition") == "rejected").alias("r"), order.alias("o"))
    rest = [c for c in rows.columns if c != key]
    return rows.groupBy(key).agg(F.max_by(F.struct(*rest), rank).alias("_m")).select(key, "_m.*")


def versions(facts: DataFrame, key: str, at: str, identity: str) -> DataFrame:
    """Type-2 history: revision, predecessor, and half-open validity of each version."""
    w = Window.partitionBy(key).orderBy(at, identity)
    until = F.lead(at).over(w)
    return (
        facts.withColumn("revision", F.row_number().over(w).cast("long")).withColumn("supersedes", F.lag(identity).over(w))
        .withColumn("valid_from", F.col(at)).withColumn("valid_to", until).withColumn("status", F.when(until.isNull(), "active").otherwise("superseded"))
    )


def finalise(entries: DataFrame, run: Column, started: Column) -> DataFrame:
    """A finished run marks absent what it has not seen, but not what a newer run has seen since."""
    gone = F.col("present") & ~F.col("last_seen_by").eqNullSafe(run) & (F.col("last_seen_at") <= started)
    return entries.withColumn("removed", gone).withColumn("present", F.col("present") & ~F.col("removed"))


def reconcile(expected: DataFrame, stored: DataFrame, keys: list[str]) -> DataFrame:
    """keys, state: healthy, corrupt, missing or orphan. expected and stored carry `checksum`."""
    e = expected.select(*keys, F.col("checksum").alias("_e"), F.lit(1).alias("_in_e"))
    s = stored.select(*keys, F.col("checksum").alias("_s"), F.lit(1).alias("_in_s"))
    state = F.when(F.col("_in_e").isNull(), "orphan").when(F.col("_in_s").isNull(), "missing").when(F.col("_e") == F.col("_s"), "healthy").otherwise("corrupt")
    return e.join(s, keys, "full_outer").select(*keys, state.alias("state"))


#: Hexadecimal digits of each of the words that a row's SHA-256 is cut into.
DIGEST_WORD, DIGEST_WORDS = 15, 4


def digest_of(rows: DataFrame, key: Column, line: Column) -> DataFrame:
    """n and a digest of all rows (key and line), whatever order they come in: words of each row's SHA-256 are summed.

    Sums are combined before they are shuffled, so no task gathers rows, and a key that holds many of them costs no more."""
    leaf = F.sha2(F.concat_ws("\x1f", key, line), 256)
    word = lambda k: F.conv(F.substring("leaf", 1 + k * DIGEST_WORD, DIGEST_WORD), 16, 10).cast("decimal(20,0)")
    sums = [F.coalesce(F.sum(word(k)), F.lit(0).cast("decimal(30,0)")).cast("string").alias(f"s{k}") for k in range(DIGEST_WORDS)]
    out = rows.select(leaf.alias("leaf")).agg(F.count("*").alias("n"), *sums)
    return out.select("n", F.sha2(F.concat_ws("|", F.col("n").cast("string"), *[f"s{k}" for k in range(DIGEST_WORDS)]), 256).alias("digest"))
