"""Hashes of files that have none yet, in parts that a rerun goes on from.

A part's hashes are written to a folder of its own, which counts when it is whole; a run that was killed hashes only what
no finished part has, at the same size and time. Files are listed before they are hashed and again afterwards: one whose
size or time differs is reported as changed and hashed by the next run, one that is gone as missing. Counts come with the
writing, as observed metrics, not by another pass. Files without content, which Spark's readers do not list, have no row.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from corpusmill.sources.tables import written

SCHEMA = "path string, size long, modified timestamp, sha256 string, status string"
PARTS = 16


@dataclass
class Summary:
    hashed: int = 0
    bytes: int = 0
    changed: int = 0
    missing: int = 0
    known: int = 0


def listed(spark: SparkSession, folder: str) -> DataFrame:
    """path, size, modified of all files below a folder; contents are not read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder)
    return files.select("path", F.col("length").alias("size"), F.col("modificationTime").alias("modified"))


def progress(spark: SparkSession, store: str) -> DataFrame:
    """What finished parts have: path, size, modified, sha256, status."""
    where = spark._jvm.org.apache.hadoop.fs.Path(store)
    fs = where.getFileSystem(spark._jsc.hadoopConfiguration())
    names = [f.getPath().toString() for f in fs.listStatus(where)] if fs.exists(where) else []
    whole = [n for n in names if fs.exists(spark._jvm.org.apache.hadoop.fs.Path(f"{n}/_SUCCESS"))]
    return spark.read.schema(SCHEMA).parquet(*whole) if whole else spark.createDataFrame([], SCHEMA)


def hashes(spark: SparkSession, store: str) -> DataFrame:
    """path, size, modified, sha256: the last one of each path that holds."""
    last = F.max_by(F.struct("size", "modified", "sha256"), "modified").alias("_last")
    return progress(spark, store).where("status = 'hashed'").groupBy("path").agg(last).select("path", "_last.*")


def backfill(spark: SparkSession, folder: str, store: str, parts: int = PARTS, after: Callable[[int], None] | None = None) -> Summary:
    """Hash what has no hash. after: called with the number of each part that is done."""
    summary = Summary()
    seen = Observation("known")
    before = listed(spark, folder).observe(seen, F.count("*").alias("files"))
    done = progress(spark, store).where("status = 'hashed'").select("path", "size", "modified")
    todo = written(before.join(done, ["path", "size", "modified"], "left_anti"), "unhashed")
    left = todo.count()
    summary.known = seen.get["files"] - left
    for part in range(parts if left else 0):
        own = todo.where(F.pmod(F.xxhash64("path"), F.lit(parts)) == part)
        content = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder).select("path", F.sha2("content", 256).alias("sha256"))
        read = written(own.join(content, "path", "left"), "hashed")
        now = listed(spark, folder).select("path", F.col("size").alias("_size"), F.col("modified").alias("_modified"))
        same = (F.col("size") == F.col("_size")) & (F.col("modified") == F.col("_modified"))
        status = F.when(F.col("_size").isNull() | F.col("sha256").isNull(), "missing").when(same, "hashed").otherwise("changed")
        told = Observation(f"part-{part}")
        count = lambda s: F.count_if(F.col("status") == s).alias(s)
        size = F.coalesce(F.sum(F.when(F.col("status") == "hashed", F.col("size"))), F.lit(0)).alias("bytes")
        rows = read.join(now, "path", "left").select("path", "size", "modified", F.when(status == "hashed", F.col("sha256")).alias("sha256"), status.alias("status"))
        rows.observe(told, count("hashed"), count("changed"), count("missing"), size).write.parquet(f"{store}/{part:06d}-{uuid.uuid4().hex}")
        for name, value in told.get.items():
            setattr(summary, name, getattr(summary, name) + value)
        if after:
            after(part)
    return summary
