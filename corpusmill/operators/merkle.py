"""Ordered digests of tables as trees: which ranges of two copies differ, without comparing their rows.

Rows are sorted by ranges of their key and cut into leaves of a bounded number of rows; a leaf's digest is of its rows in
order, a node's of its children in order. Both copies are cut at the same places, those of either and where a range of the
sort begins, so equal ranges have equal digests. The copies are sorted together, and a task cuts and digests its range in
one pass, so a row is shuffled twice, as part of its content's count and of its range, and written once. The descent
compares the roots and then the children of nodes that differ; rows are read for leaves that differ alone.

Defined results: rows are told apart by key and content, where null is a value; rows that are equal in both count as one
with their number; a repeated key with different rows is ordered by their digests, so however many rows a key has, no leaf
outgrows its bound; empty tables have a tree of no leaves and the digest of the empty text.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusmill.sources.tables import importable, shared_path, written
from corpusmill.sources.versions import _path

LEAF_ROWS, FANOUT = 1024, 16
#: Leaves whose rows are fetched by a filter that reaches the files; more are joined.
FEW = 1000


@dataclass(frozen=True)
class Tree:
    """rows: key, _h (digest of the content), _n, leaf, sorted by leaf in its files; leaves: the leaf of each node of the
    lowest level, which are numbered without gaps; levels: from leaves to the root, each (node, digest, rows)."""

    keys: list[str]
    rows: DataFrame
    leaves: DataFrame
    levels: list[DataFrame]

    def root(self) -> str:
        """The digest of the whole table."""
        top = self.levels[-1].select("digest").first()
        return top.digest if top else self.levels[-1].select(F.sha2(F.lit(""), 256)).sparkSession.range(1).select(F.sha2(F.lit(""), 256)).first()[0]


def content(rows: DataFrame, keys: list[str], line: Column) -> DataFrame:
    """key, _h, _n: each different row once, with its number."""
    return rows.select(*keys, F.unhex(F.sha2(F.coalesce(line, F.lit("\x00")), 256)).alias("_h")).groupBy(*keys, "_h").agg(F.count("*").alias("_n"))


#: A leaf is named by its range of the sort and its place there.
PLACE_BITS = 32


class Cutter:
    """Leaves of a range of both copies that comes in order. A leaf begins at the first row and at each place, a key and
    content, that either copy has after as many rows as make whole leaves. Held are a batch and the lines of one leaf."""

    def __init__(self, every: int):
        self.every, self.seen, self.leaf = every, [0, 0], -1
        self.lines, self.rows = ([], []), [0, 0]

    def leaves(self, side: np.ndarray, place: np.ndarray) -> np.ndarray:
        """The leaf of each row; place: numbers from 0 on, and no place goes on in a later call."""
        begins = np.zeros(place[-1] + 1, bool)
        for k in (0, 1):
            own = np.flatnonzero(side == k)
            begins[place[own[(np.arange(len(own)) + self.seen[k]) % self.every == 0]]] = True
            self.seen[k] += len(own)
        return self.leaf + np.cumsum(begins)[place]

    def digests(self) -> list[tuple[int, int, str, int]]:
        """(side, leaf, digest, rows) of the leaf that ends."""
        out = [(k, self.leaf, hashlib.sha256("\n".join(self.lines[k]).encode()).hexdigest(), self.rows[k]) for k in (0, 1) if self.lines[k]]
        self.lines, self.rows = ([], []), [0, 0]
        return out

    def add(self, side: np.ndarray, place: np.ndarray, names: list[str], n: np.ndarray) -> tuple[np.ndarray, list[tuple]]:
        """The leaf of each row, and the digests of leaves that have ended."""
        leaf, out = self.leaves(side, place), []
        edges = [0, *(np.flatnonzero(np.diff(leaf)) + 1).tolist(), len(leaf)]
        sides, counts = side.tolist(), n.tolist()
        for a, b in zip(edges, edges[1:]):
            if leaf[a] != self.leaf:
                out += self.digests()
                self.leaf = int(leaf[a])
            for i in range(a, b):
                self.lines[sides[i]].append(f"{names[i]}\x1f{counts[i]}")
                self.rows[sides[i]] += counts[i]
        return leaf, out


def cut(every: int):
    """Batches of a range (_side, _p, _place, _n, others) -> all but _p and _place, with leaf; and rows of digests, with
    _side 2, the copy, leaf, digest and rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cutter, rest, first = Cutter(every), None, 0

        def told(t: pa.Table) -> Iterator[pa.RecordBatch]:
            names = t.column("_place").combine_chunks()
            other = np.ones(len(names), np.int64)
            other[1:] = pc.not_equal(names[1:], names[:-1]).to_numpy(zero_copy_only=False)
            side, n = t.column("_side").to_numpy(), t.column("_n").to_numpy()
            leaf, ended = cutter.add(side, np.cumsum(other) - 1, names.to_pylist(), n)
            rows = t.drop_columns(["_place", "_p"])
            blank = {"leaf": pa.array(leaf + first), "_copy": pa.nulls(len(leaf), pa.int32()), "digest": pa.nulls(len(leaf), pa.string()), "rows": pa.nulls(len(leaf), pa.int64())}
            for name, column in blank.items():
                rows = rows.append_column(name, column)
            rows = rows.cast(pa.schema([f.with_nullable(True) for f in rows.schema]))
            yield from rows.combine_chunks().to_batches()
            yield from ends(ended, rows.schema)

        def ends(ended: list[tuple], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
            if ended:
                own = {"_side": pa.array([2] * len(ended), pa.int32()), "_copy": pa.array([e[0] for e in ended], pa.int32()), "leaf": pa.array([e[1] + first for e in ended], pa.int64()), "digest": pa.array([e[2] for e in ended]), "rows": pa.array([e[3] for e in ended], pa.int64())}
                yield pa.RecordBatch.from_arrays([own.get(f.name, pa.nulls(len(ended), f.type)) for f in schema], schema=schema)

        schema = None
        for batch in batches:
            if not batch.num_rows:
                continue
            first = batch.column("_p")[0].as_py() << PLACE_BITS
            rest = pa.Table.from_batches([batch]) if rest is None else pa.concat_tables([rest, pa.Table.from_batches([batch])])
            last = rest.column("_place")[-1].as_py()
            held = 1 + (len(rest) > 1 and rest.column("_place")[-2].as_py() == last)  # a place has a row of each copy at most
            if len(rest) > held:
                for out in told(rest.slice(0, len(rest) - held)):
                    schema = out.schema
                    yield out
                rest = rest.slice(len(rest) - held)
        if rest is not None:
            for out in told(rest):
                schema = out.schema
                yield out
            yield from ends(cutter.digests(), schema)

    return run


def trees(left: DataFrame, right: DataFrame, keys: list[str], line: Column, every: int = LEAF_ROWS) -> tuple[Tree, Tree]:
    """Trees of two copies, cut at the same places."""
    spark = left.sparkSession
    importable(spark)
    both = [content(side, keys, line).withColumn("_side", F.lit(k)) for k, side in enumerate((left, right))]
    order = [*keys, "_h"]
    place = F.concat_ws("\x1f", *[F.coalesce(F.col(k).cast("string"), F.lit("\x00")) for k in keys], F.lower(F.hex("_h")))
    sort = both[0].unionByName(both[1]).repartitionByRange(*order).sortWithinPartitions(*order, "_side")
    sort = sort.select(*order, "_n", "_side", F.spark_partition_id().cast("long").alias("_p"), place.alias("_place"))
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in both[0].schema)
    told = sort.mapInArrow(cut(every), f"{fields}, leaf long, _copy int, digest string, rows long")
    path = shared_path(spark, "merkle-rows")
    told.sortWithinPartitions("_side", "leaf").write.partitionBy("_side").option("compression", "zstd").parquet(path)
    schema = told.drop("_side").schema

    def part(k: int) -> DataFrame:  # a folder is missing where there was no row for it
        fs, where = _path(spark, f"{path}/_side={k}")
        return spark.read.schema(schema).parquet(f"{path}/_side={k}") if fs.exists(where) else spark.createDataFrame([], schema)

    digests = part(2).select("_copy", "leaf", "digest", "rows", F.shiftright("leaf", PLACE_BITS).alias("_p"), (F.col("leaf") % (1 << PLACE_BITS)).alias("_at"))
    ranges = digests.groupBy("_p").agg((F.max("_at") + 1).alias("_leaves"))  # a row for each range
    sum_before = F.coalesce(F.sum("_leaves").over(Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    begin = ranges.select("_p", sum_before.alias("_begin"))
    nodes = written(digests.join(F.broadcast(begin), "_p").select("_copy", "leaf", (F.col("_begin") + F.col("_at")).alias("node"), "digest", "rows"), "merkle-leaves")
    x, y = (tree(part(k).select(*order, "_n", "leaf"), nodes.where(F.col("_copy") == k), keys) for k in (0, 1))
    return _as_high(x, y), _as_high(y, x)


def tree(rows: DataFrame, nodes: DataFrame, keys: list[str]) -> Tree:
    """nodes: leaf, node, digest, rows of a copy."""
    levels = [nodes.select("node", "digest", "rows")]
    top = levels[0].agg(F.max("node")).first()[0]
    while top:
        children = F.transform(F.array_sort(F.collect_list(F.struct("node", "digest"))), lambda c: F.concat_ws(":", c["node"].cast("string"), c["digest"]))
        up = levels[-1].withColumn("_parent", F.floor(F.col("node") / FANOUT)).groupBy(F.col("_parent").alias("node"))
        levels.append(written(up.agg(F.sha2(F.array_join(children, "\n"), 256).alias("digest"), F.sum("rows").alias("rows")), "merkle-level"))
        top //= FANOUT
    return Tree(keys, rows, nodes.select("node", "leaf"), levels)


def _as_high(one: Tree, other: Tree) -> Tree:
    """one with as many levels as other: the top of a shorter tree is the first node of each further level."""
    levels = list(one.levels)
    while len(levels) < len(other.levels):
        child = F.concat_ws(":", F.lit("0"), F.col("digest"))
        levels.append(levels[-1].select(F.lit(0).cast("long").alias("node"), F.sha2(child, 256).alias("digest"), "rows"))
    return Tree(one.keys, one.rows, one.leaves, levels)


def differing(a: Tree, b: Tree) -> tuple[DataFrame, list[int]]:
    """node of the leaves that differ; and how many nodes were compared at each level, from the root down."""
    compared, open_ = [], None
    for x, y in zip(reversed(a.levels), reversed(b.levels), strict=True):
        if open_ is not None:  # children of nodes that differ
            x, y = (side.join(open_, F.floor(side["node"] / FANOUT) == F.col("_parent"), "left_semi") for side in (x, y))
        met = written(x.select("node", F.col("digest").alias("_a")).join(y.select("node", F.col("digest").alias("_b")), "node", "full_outer"), "merkle-met")
        compared.append(met.count())
        found = met.where(~F.col("_a").eqNullSafe(F.col("_b"))).select("node")
        open_ = found.withColumnRenamed("node", "_parent")
    return found, compared


def rows_of(t: Tree, leaves: DataFrame) -> DataFrame:
    """The rows of some leaves. A few are fetched by a filter, as files are sorted by leaf."""
    found = t.leaves.join(leaves, "node", "left_semi").select("leaf")
    few = [r[0] for r in found.limit(FEW + 1).collect()]
    if len(few) <= FEW:
        return t.rows.where(F.col("leaf").isin(few))
    return t.rows.join(found, "leaf", "left_semi")


def changes(a: Tree, b: Tree) -> DataFrame:
    """key, change: what makes b out of a, from the rows of leaves that differ alone: added, removed or changed.

    Of a key whose rows fill several leaves those in equal leaves are not looked at, and its change is that of the others.
    Counts are combined before they are shuffled, so a key with many rows costs no more."""
    leaves, _ = differing(a, b)
    told = [rows_of(t, leaves).select(*a.keys, "_h", *[(F.col("_n") if k == side else F.lit(0)).alias(f"_n{k}") for k in (0, 1)]) for side, t in enumerate((a, b))]
    each = told[0].unionByName(told[1]).groupBy(*a.keys, "_h").agg(F.sum("_n0").alias("_n0"), F.sum("_n1").alias("_n1"))
    by_key = each.groupBy(*a.keys).agg(F.sum("_n0").alias("_n0"), F.sum("_n1").alias("_n1"), F.max(F.col("_n0") != F.col("_n1")).alias("_differs"))
    change = F.when(F.col("_n0") == 0, "added").when(F.col("_n1") == 0, "removed").otherwise("changed")
    return by_key.where("_differs").select(*a.keys, change.alias("change"))
