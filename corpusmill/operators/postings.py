"""A stored index of the stretches of characters of texts, for finding substrings without reading the texts again.

Texts lie in a versioned table; each commit adds a segment of postings (gram, keys) for the texts that it brought, and the
keys that it took away or replaced, and one entry of the log names both, so that readers see all of a commit or none.
A gram is written as a number, its code points side by side, with the keys of those texts of a slice that have it. Postings
lie in buckets of the gram, sorted by it: a search reads the buckets of its grams alone, and of those the parts that hold
them. A key of a posting holds unless a later segment names it. `compact` makes one segment of all that hold, from the
texts, which costs less than to look each key of each posting up among those that went.

Texts that have all grams of a needle are its candidates; where a needle is longer than a gram, they are fetched by key and
looked through. Needles are folded by lower(), as the texts are.

Defined results: null and empty texts hold nothing; an empty needle is refused, as it is everywhere; needles shorter than a
gram are prefixes of grams, which the last characters of a text have too, filled up with marks.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce
from math import ceil
from operator import or_

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusmill.sources.tables import importable
from corpusmill.sources.versions import BUCKET, Table, _path

#: Characters of a gram.
GRAM = 3
#: Bits of a code point.
POINT = 21
#: Texts whose postings of one bucket go into one file.
TEXTS_PER_FILE = 1 << 17
#: Characters of the texts that are looked through at a time (one text at least), and places of the tables for that.
SLICE, PLACES = 1 << 21, 1 << 26
#: Fills up the grams of a text's last characters: no text has this noncharacter.
END = "\uffff"


def grams_of(needle: str) -> list[str]:
    """Grams that every text with the needle has; one that is shorter than a gram is a prefix."""
    return sorted({needle[i : i + GRAM] for i in range(max(1, len(needle) - GRAM + 1))})


def code(gram: str) -> int:
    """The number of a gram; of a prefix, the least number of the grams that begin with it."""
    return sum(ord(c) << POINT * (GRAM - 1 - i) for i, c in enumerate(gram))


def postings_of(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(grams, ends, places): each gram of any of the texts, and up to where the places of the texts with it go."""
    points = np.frombuffer("".join(texts).encode("utf-32-le"), np.uint32)
    lengths = np.fromiter(map(len, texts), np.int64, len(texts))
    whole = np.maximum(lengths - (GRAM - 1), 0)  # grams of each text
    text = np.repeat(np.arange(len(texts), dtype=np.int64), whole)
    start = np.arange(whole.sum()) + np.repeat(np.cumsum(lengths) - lengths - (np.cumsum(whole) - whole), whole)
    alphabet = np.flatnonzero(np.bincount(points))
    size = len(alphabet)
    if size**GRAM <= PLACES:  # few letters: grams are numbered by a table
        letter = np.zeros(int(alphabet[-1]) + 1 if size else 1, np.int32)
        letter[alphabet] = np.arange(size)
        letters = letter[points]
        packed = (letters[start] * size + letters[start + 1]) * size + letters[start + 2]
        there = np.zeros(size**GRAM, bool)
        there[packed] = True
        found = np.flatnonzero(there)
        number = np.zeros(size**GRAM, np.int32)
        number[found] = np.arange(len(found))
        which = number[packed].astype(np.int64)
        three = (alphabet[found // size**2], alphabet[found // size % size], alphabet[found % size])
        grams = sum(c.astype(np.int64) << POINT * (GRAM - 1 - i) for i, c in enumerate(three))
    else:
        wide = points.astype(np.int64)
        grams, which = np.unique(wide[start] << 2 * POINT | wide[start + 1] << POINT | wide[start + 2], return_inverse=True)
    pairs = which * len(texts) + text
    if len(grams) * len(texts) <= PLACES:
        there = np.zeros(len(grams) * len(texts), bool)
        there[pairs] = True
        pairs = np.flatnonzero(there)
    else:
        pairs = np.unique(pairs)
    return grams, np.cumsum(np.bincount(pairs // max(1, len(texts)), minlength=len(grams))), pairs % max(1, len(texts))


def slices(lengths: list[int]) -> Iterator[tuple[int, int]]:
    """From and to of texts that have SLICE characters together, or of one that has more."""
    begin = total = 0
    for i, n in enumerate(lengths):
        if i > begin and total + n > SLICE:
            yield begin, i
            begin, total = i, 0
        total += n
    if begin < len(lengths):
        yield begin, len(lengths)


def posted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches of (key, folded) as batches of (gram, keys)."""
    for batch in batches:
        folded = batch.column("folded").to_pylist()
        for a, b in slices([len(x) for x in folded]):
            grams, ends, places = postings_of(folded[a:b])
            keys = batch.column("key").take(pa.array(places + a))
            lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]), pa.int32()), keys)
            yield pa.RecordBatch.from_arrays([pa.array(grams, pa.int64()), lists], ["gram", "keys"])


@dataclass(frozen=True)
class PostingIndex:
    """An index in a folder; `text` is the table's column that is indexed, `key` its only key."""

    spark: SparkSession
    folder: str
    text: str = "text"
    buckets: int = 64

    @property
    def table(self) -> Table:
        return Table(self.spark, self.folder)

    @classmethod
    def create(cls, texts: DataFrame, folder: str, key: str, text: str = "text", buckets: int = 64) -> PostingIndex:
        index = cls(texts.sparkSession, folder, text, buckets)
        segment = {"number": 0, "postings": index._postings(texts, key), "dead": None}
        Table.create(texts, folder, [key], buckets, {"segments": [segment]})
        return index

    def _postings(self, texts: DataFrame, key: str) -> str:
        """Write the postings of texts. A gram that most texts have is dealt to several files of its bucket."""
        importable(self.spark)
        rows = texts.where(F.col(self.text).isNotNull()).select(F.col(key).alias("key"), F.concat(F.lower(self.text), F.lit(END * (GRAM - 1))).alias("folded"))
        rows = rows.mapInArrow(posted, f"gram long, keys array<{rows.dtypes[0][1]}>")
        files = ceil(max(1, texts.count()) / TEXTS_PER_FILE)
        path = f"postings/{uuid.uuid4().hex}"
        dealt = rows.withColumn(BUCKET, self._bucket(F.col("gram"))).repartition(self.buckets * files, BUCKET, F.pmod(F.xxhash64(F.element_at("keys", 1)), F.lit(files)))
        dealt.sortWithinPartitions(BUCKET, "gram").write.partitionBy(BUCKET).option("compression", "zstd").parquet(f"{self.folder}/{path}")
        return path

    def _bucket(self, gram: Column) -> Column:
        return F.pmod(F.xxhash64(gram), F.lit(self.buckets)).cast("int")

    def commit(self, changes: DataFrame, deleted: DataFrame | None = None) -> int:
        """Texts that are new or changed, and keys of texts that go. -> the version's number."""
        table = self.table
        entry = table.entry()
        key = entry["keys"][0]
        postings = self._postings(changes, key)
        dead = f"dead/{uuid.uuid4().hex}"
        gone = changes.select(F.col(key).alias("key")) if deleted is None else changes.select(F.col(key).alias("key")).unionByName(deleted.select(F.col(key).alias("key")))
        gone.distinct().write.parquet(f"{self.folder}/{dead}")

        def attach(extra: dict, number: int) -> dict:
            return {"segments": [*extra["segments"], {"number": number, "postings": postings, "dead": dead}]}

        return table.commit(changes, deleted, attach=attach)

    def compact(self) -> int:
        """One segment of all postings that hold, those of the texts that are there. Segments of commits made meanwhile stay
        beside it."""
        table = self.table
        base = table.latest()
        path = self._postings(table.read(base), table.entry(base)["keys"][0])

        def attach(extra: dict, number: int) -> dict:
            later = [s for s in extra["segments"] if s["number"] > base]
            return {"segments": [{"number": base, "postings": path, "dead": None}, *later]}

        nothing = table.read(base).limit(0)
        return table.commit(nothing, base=base, attach=attach)

    def _live(self, entry: dict, wanted: list[int] | None, within: Column | None = None) -> DataFrame:
        """gram, key of postings that hold, of some grams, or of those of a condition; of some only their buckets are listed
        and read."""
        key_type = self.table._read(entry, []).select(entry["keys"][0]).dtypes[0][1]
        schema = f"gram long, key {key_type}"
        if wanted is None:
            numbers = list(range(self.buckets))
        else:
            numbers = sorted({r[0] for r in self.spark.createDataFrame([(g,) for g in wanted], "gram long").select(self._bucket(F.col("gram"))).collect()})
        found, dead = self.spark.createDataFrame([], f"{schema}, number long"), self.spark.createDataFrame([], f"key {key_type}, number long")
        for s in entry["extra"]["segments"]:
            paths = [p for p in (f"{self.folder}/{s['postings']}/{BUCKET}={b}" for b in numbers) if self._there(p)]
            if paths:
                rows = self.spark.read.schema(f"gram long, keys array<{key_type}>").parquet(*paths)
                rows = rows.where(within if wanted is None else F.col("gram").isin(wanted)).select("gram", F.explode("keys").alias("key"))
                found = found.unionByName(rows.withColumn("number", F.lit(s["number"]).cast("long")))
            if s["dead"]:
                dead = dead.unionByName(self.spark.read.schema(f"key {key_type}").parquet(f"{self.folder}/{s['dead']}").withColumn("number", F.lit(s["number"]).cast("long")))
        last = dead.groupBy("key").agg(F.max("number").alias("gone"))
        return found.join(last, "key", "left").where("gone IS NULL OR number >= gone").select("gram", "key")

    def _there(self, path: str) -> bool:
        fs, where = _path(self.spark, path)
        return fs.exists(where)

    def candidates(self, needles: list[str], version: int | None = None) -> DataFrame:
        """needle, key of the texts that have all grams of a needle: counts of grams a key, without a join for each."""
        entry = self.table.entry(version)
        if not all(needles):
            raise ValueError("an empty needle is everywhere")
        pairs = [(n, g) for n in dict.fromkeys(x.lower() for x in needles) for g in grams_of(n)]
        short = sorted({g for _, g in pairs if len(g) < GRAM})
        whole = sorted({code(g) for _, g in pairs if len(g) == GRAM})
        named = {g: -1 - i for i, g in enumerate(short)}  # prefixes have numbers that no gram has
        full = self._live(entry, whole) if whole else None
        if short:  # grams with these prefixes may lie in any bucket, where sorting lets all but their ranges be skipped
            begins = {g: F.col("gram").between(code(g), code(g) + (1 << POINT * (GRAM - len(g))) - 1) for g in short}
            some = self._live(entry, None, reduce(or_, begins.values()))
            cut = F.array_compact(F.array(*[F.when(begins[g], F.lit(named[g]).cast("long")) for g in short]))
            some = some.select(F.explode(cut).alias("gram"), "key").distinct()
            full = some if full is None else full.unionByName(some)
        own = self.spark.createDataFrame([(n, named[g] if g in named else code(g)) for n, g in pairs], "needle string, gram long")
        sizes = self.spark.createDataFrame([(n, len(grams_of(n))) for n in dict.fromkeys(p[0] for p in pairs)], "needle string, size long")
        met = full.join(F.broadcast(own), "gram").groupBy("needle", "key").agg(F.count("*").alias("met"))
        return met.join(F.broadcast(sizes), "needle").where("met = size").select("needle", "key")

    def holding(self, needles: list[str], version: int | None = None) -> DataFrame:
        """needle, key of the texts that hold it: candidates' texts alone are read, and only for needles past a gram."""
        table = self.table
        version = table.latest() if version is None else version
        key = table.entry(version)["keys"][0]
        found = self.candidates(needles, version)
        sure = found.where(F.char_length("needle") <= GRAM)
        open_ = found.where(F.char_length("needle") > GRAM)
        texts = table.lookup(open_.select(F.col("key").alias(key)), version).select(F.col(key).alias("key"), F.lower(self.text).alias("_folded"))
        return sure.unionByName(open_.join(texts, "key").where(F.contains("_folded", "needle")).select("needle", "key"))
