"""Versioned tables: files in buckets of the key, and a log of commits.

A commit is a file of the log, named by its number and made once: who comes second finds it there. It lists for every
bucket the folder that holds its rows, so a version is read from its entry alone, and stays readable while later ones
are written. An upsert reads and writes only the buckets of its keys; the others keep their files. If another writer
has committed meanwhile, a commit whose buckets it did not touch is made on top of it; else it raises Conflict, and
nothing of it is seen.

Defined results: keys must not be null and stand once in what is written, else ValueError; deleting a key that is not
there changes nothing; an empty change makes a version like the one before.
"""

from __future__ import annotations

import json
import os
import uuid
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

BUCKET = "_bucket"
#: Keys that are looked up by a filter; more of them are joined.
FEW = 1000
#: Keys of a commit that may be sent to all tasks; more of them are joined by a shuffle.
SENT = 100_000
#: What an entry names besides its files, and the new version's number -> what the new entry names.
Attach = Callable[[dict, int], dict]


class Conflict(RuntimeError):
    """Another writer has committed to the same buckets."""


def _path(spark: SparkSession, path: str):
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()), where


def create_once(spark: SparkSession, path: str, text: str) -> bool:
    """Make a file with this text unless there is one: it appears whole, and of several writers one makes it.

    Local file systems link a finished draft to its name, others rename it, which fails where the name is taken, as HDFS
    guarantees."""
    fs, where = _path(spark, path)
    draft = f"{path}.{uuid.uuid4().hex}.draft"
    _, drafted = _path(spark, draft)
    out = fs.create(drafted, True)
    out.write(bytearray(text.encode()))
    out.close()
    if fs.getUri().getScheme() == "file":
        try:
            os.link(drafted.toUri().getPath(), where.toUri().getPath())
            return True
        except FileExistsError:
            return False
        finally:
            fs.delete(drafted, False)
    made = not fs.exists(where) and fs.rename(drafted, where)
    if not made:
        fs.delete(drafted, False)
    return made


def numbered(spark: SparkSession, folder: str) -> list[int]:
    """The numbers of a log's entries."""
    fs, where = _path(spark, folder)
    names = [f.getPath().getName() for f in fs.listStatus(where)] if fs.exists(where) else []
    return sorted(int(n) for n in names if n.isdigit())


def read_text(spark: SparkSession, path: str) -> str:
    fs, where = _path(spark, path)
    stream = fs.open(where)
    try:
        return bytes(spark._jvm.org.apache.commons.io.IOUtils.toByteArray(stream)).decode()
    finally:
        stream.close()


def entry_path(folder: str, number: int) -> str:
    return f"{folder}/log/{number:012d}"


@dataclass(frozen=True)
class Table:
    spark: SparkSession
    folder: str

    @classmethod
    def create(cls, rows: DataFrame, folder: str, keys: list[str], buckets: int = 64, extra: dict | None = None, by: list[str] | None = None) -> Table:
        """A new table with rows as version 0. More buckets make commits smaller and versions' entries longer. extra: what
        else the entry should name. by: the keys that buckets go by, all of them by default; what is looked up by."""
        table = cls(rows.sparkSession, folder)
        head = {"keys": keys, "by": by or keys, "buckets": buckets, "schema": rows.schema.json()}
        files = table._write(rows, head)
        if not create_once(table.spark, entry_path(folder, 0), json.dumps(head | {"changed": sorted(map(int, files)), "files": files, "extra": extra or {}})):
            raise Conflict(f"there is a table in {folder}")
        return table

    def latest(self) -> int:
        return numbered(self.spark, f"{self.folder}/log")[-1]

    def entry(self, version: int | None = None) -> dict:
        return json.loads(read_text(self.spark, entry_path(self.folder, self.latest() if version is None else version)))

    def bucket(self, head: dict) -> Column:
        return F.pmod(F.xxhash64(*head["by"]), F.lit(head["buckets"])).cast("int")

    def _write(self, rows: DataFrame, head: dict) -> dict[str, str]:
        """Bucket -> folder of what was written. Files are sorted by key, so that lookups of keys skip most of them."""
        keys, at = head["keys"], f"data/{uuid.uuid4().hex}"
        bad = rows.groupBy(*keys).count().where("count > 1 OR " + " OR ".join(f"`{k}` IS NULL" for k in keys))
        if not bad.isEmpty():
            raise ValueError(f"a key of {keys} is null or stands twice")
        dealt = rows.withColumn(BUCKET, self.bucket(head)).repartition(head["buckets"], BUCKET).sortWithinPartitions(BUCKET, *keys)
        dealt.write.partitionBy(BUCKET).option("compression", "zstd").parquet(f"{self.folder}/{at}")
        fs, where = _path(self.spark, f"{self.folder}/{at}")
        names = [f.getPath().getName() for f in fs.listStatus(where) if f.isDirectory()]
        return {n.split("=")[1]: f"{at}/{n}" for n in names if n.startswith(f"{BUCKET}=")}

    def _read(self, entry: dict, buckets: list[int] | None = None) -> DataFrame:
        schema = T.StructType.fromJson(json.loads(entry["schema"]))
        chosen = entry["files"] if buckets is None else {str(b): entry["files"][str(b)] for b in buckets if str(b) in entry["files"]}
        if not chosen:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(*[f"{self.folder}/{p}" for p in chosen.values()])

    def read(self, version: int | None = None) -> DataFrame:
        """All rows of a version; the newest one by default."""
        return self._read(self.entry(version))

    def lookup(self, keys: DataFrame, version: int | None = None) -> DataFrame:
        """The rows of some values of the columns that buckets go by: only their buckets are read."""
        entry = self.entry(version)
        by = entry["by"]
        found = keys.select(*by).distinct()
        few = found.limit(FEW + 1).collect() if len(by) == 1 else []
        if few and len(few) <= FEW:  # the filter reaches the files, which are sorted by key
            here = self.spark.createDataFrame(few, found.schema)
            buckets = {r[0] for r in here.select(self.bucket(entry)).collect()}
            return self._read(entry, sorted(buckets)).where(F.col(by[0]).isin([r[0] for r in few]))
        buckets = [r[0] for r in found.select(self.bucket(entry)).distinct().collect()]  # no more than there are buckets
        return self._read(entry, buckets).join(found, by, "left_semi")

    def page(self, version: int, size: int, after: Column | None = None) -> DataFrame:
        """The first rows of a fixed version by key past a condition: a sequence of pages sees no later commit."""
        rows = self.read(version) if after is None else self.read(version).where(after)
        return rows.orderBy(*self.entry(version)["keys"]).limit(size)

    def commit(self, changes: DataFrame, deleted: DataFrame | None = None, base: int | None = None, attach: Attach | None = None) -> int:
        """Rows of changes are new or take the place of those with their keys; keys of deleted go. -> the new version's
        number. base: the version that the changes were made from. attach: what else the entry names, from what the one
        before it names and the new number."""
        base = self.latest() if base is None else base
        entry = self.entry(base)
        keys = entry["keys"]
        gone = changes.select(*keys) if deleted is None else changes.select(*keys).unionByName(deleted.select(*keys))
        each = {r[0]: r[1] for r in gone.groupBy(self.bucket(entry)).count().collect()}  # a row for each bucket
        touched = sorted(each)
        taken = gone.distinct() if sum(each.values()) <= SENT else gone.distinct().hint("merge")
        kept = self._read(entry, touched).join(taken, keys, "left_anti")
        files = self._write(kept.unionByName(changes.select(kept.columns)), entry) if touched else {}
        while True:
            head = {k: entry[k] for k in ("keys", "by", "buckets", "schema")}
            left = {b: p for b, p in entry["files"].items() if int(b) not in touched}
            extra = attach(entry["extra"], base + 1) if attach else entry["extra"]
            if create_once(self.spark, entry_path(self.folder, base + 1), json.dumps(head | {"changed": touched, "files": left | files, "extra": extra})):
                return base + 1
            base += 1
            entry = self.entry(base)
            if set(entry["changed"]) & set(touched):
                raise Conflict(f"version {base} has changed buckets of this commit")

    def vacuum(self, keep: int = 2) -> int:
        """Remove entries but for the newest `keep`, and folders that none of these names. -> how many folders went.

        Not while others write: what they have not committed yet is named by no entry."""
        numbers = numbered(self.spark, f"{self.folder}/log")
        live = {p for n in numbers[-keep:] for p in self.entry(n)["files"].values()}
        gone = 0
        fs, where = _path(self.spark, f"{self.folder}/data")
        for write in fs.listStatus(where):
            for bucket in fs.listStatus(write.getPath()):
                name = f"data/{write.getPath().getName()}/{bucket.getPath().getName()}"
                if bucket.isDirectory() and name not in live:
                    gone += fs.delete(bucket.getPath(), True)
        for n in numbers[:-keep]:
            fs.delete(_path(self.spark, entry_path(self.folder, n))[1], False)
        return gone
