"""A graph of code that is kept by deltas: symbols, references and the edges between them, in versioned tables.

When files change, their own references are resolved again, and of the others those alone whose name has a symbol more or
less than before; buckets go by file or by name, so both are looked up without reading the rest. What does not change is
not written, so a change that is repeated does nothing.

Defined results: as `code.resolve` of all references against all symbols; files that bring neither symbols nor references
are gone; a reference that a file names twice counts once; null names and targets are left out.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusmill.operators.code import resolve, target_key
from corpusmill.sources.tables import written
from corpusmill.sources.versions import Table

SYMBOLS = "file_id long, symbol_id long, key string"
REFERENCES = "file_id long, source_id long, target string, key string"
NAMES = "key string, symbol_id long"
EDGES = "key string, file_id long, source_id long, target string, target_id long, confidence double"


def large(df: DataFrame) -> DataFrame:
    """A side of a join that is not to be sent through the driver: tables just written are many times their files."""
    return df.hint("merge")


@dataclass(frozen=True)
class Touched:
    """What an update has looked at: symbols that came or went, names that they changed, references resolved again."""

    symbols: int
    names: int
    references: int


@dataclass(frozen=True)
class CodeGraph:
    spark: SparkSession
    folder: str

    @classmethod
    def create(cls, spark: SparkSession, folder: str, buckets: int = 64) -> CodeGraph:
        for name, schema, keys, by in (("symbols", SYMBOLS, ["file_id", "symbol_id"], "file_id"), ("references", REFERENCES, ["file_id", "source_id", "target"], "file_id"), ("names", NAMES, ["key", "symbol_id"], "key"), ("edges", EDGES, ["key", "file_id", "source_id", "target"], "key")):
            Table.create(spark.createDataFrame([], schema), f"{folder}/{name}", keys, buckets, by=[by])
        return cls(spark, folder)

    def table(self, name: str) -> Table:
        return Table(self.spark, f"{self.folder}/{name}")

    def edges(self) -> DataFrame:
        return self.table("edges").read().select("source_id", "target", "target_id", "confidence")

    def update(self, files: DataFrame, symbols: DataFrame, references: DataFrame) -> Touched:
        """files (file_id) that changed, are new or have gone; symbols (file_id, symbol_id, name) and references (file_id,
        source_id, target) that they have now."""
        changed = written(files.select(F.col("file_id").cast("long").alias("file_id")).where("file_id IS NOT NULL").distinct(), "changed-files")
        new_s = written(symbols.where("name IS NOT NULL").join(changed, "file_id", "left_semi").select("file_id", "symbol_id", F.lower("name").alias("key")).distinct(), "new-symbols")
        new_r = references.where("target IS NOT NULL").join(changed, "file_id", "left_semi").select("file_id", "source_id", "target", target_key(F.col("target")).alias("key"))
        new_r = written(new_r.distinct(), "new-references")
        old_s = written(self.table("symbols").lookup(changed).select("file_id", "symbol_id", "key"), "old-symbols")
        old_r = written(self.table("references").lookup(changed).select("file_id", "source_id", "target", "key"), "old-references")
        gone_s, come_s = (written(a.join(large(b), a.columns, "left_anti"), "symbols-moved") for a, b in ((old_s, new_s), (new_s, old_s)))
        gone_r, come_r = (written(a.join(large(b), a.columns, "left_anti"), "references-moved") for a, b in ((old_r, new_r), (new_r, old_r)))
        names = written(gone_s.select("key").unionByName(come_s.select("key")).distinct(), "names-moved")
        # edges of names that moved, but for those that went with their file's references
        again = self.table("edges").lookup(names).select("file_id", "source_id", "target", "key").join(large(gone_r), ["file_id", "source_id", "target"], "left_anti")
        open_ = written(again.unionByName(come_r).distinct(), "references-open")
        sizes = [df.count() for df in (gone_s, come_s, names, open_)]
        if not gone_s.isEmpty() or not come_s.isEmpty():
            self.table("symbols").commit(come_s, gone_s.join(large(come_s), ["file_id", "symbol_id"], "left_anti"))
            self.table("names").commit(come_s.select("key", "symbol_id"), gone_s.select("key", "symbol_id").join(large(come_s), ["key", "symbol_id"], "left_anti"))
        if not gone_r.isEmpty() or not come_r.isEmpty():
            self.table("references").commit(come_r, gone_r)
        if sizes[-1] or not gone_r.isEmpty():
            known = self.table("names").lookup(open_.select("key").distinct())
            told = resolve(open_.select("source_id", "target").distinct(), known.select(F.col("key").alias("name"), "symbol_id"))
            self.table("edges").commit(open_.join(large(told), ["source_id", "target"]).select("key", "file_id", "source_id", "target", "target_id", "confidence"), gone_r)
        return Touched(sizes[0] + sizes[1], sizes[2], sizes[3])
