"""A stored index of vectors by cells: nearest neighbours by cosine distance, a fast way and an exact one.

Centres come from k-means over a bounded sample; every vector is filed under its nearest centre, in one folder a cell,
and each cell knows its radius. On unit vectors the cosine distance is half the squared distance, so no vector of a cell
is nearer to a query than the distance to the centre less the radius. The fast way reads the cells whose centres are
nearest. The exact way then reads those that this bound does not rule out, by the k-th distance found so far.

Defined results: vectors of another size, without values or without an id are left out; zero vectors are at distance 1 from
everything, lie in a cell of their own and are always read, and a zero query reads all; ties go to the smaller id, at
twelve digits; repeated rows count each. What a task compares is bounded: large cells and cells with many queries are
dealt to several tasks.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from math import ceil

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corpusmill.sources.tables import importable, written
from corpusmill.sources.versions import _path

#: Rows that centres are learned from, at most; rounds of k-means; centres at most.
SAMPLE, ROUNDS, MOST_CELLS = 20_000, 10, 1024
#: The fast way reads so many cells that they hold this share of the nearest neighbours of some rows of the sample.
SHARE, NEIGHBOURS, MEASURED = 0.95, 10, 256
#: Rows of a cell, and queries of a cell, that a task compares.
CELL_ROWS, CELL_QUERIES = 1 << 15, 1 << 12
#: The cell of zero vectors.
ZERO = -1
SLACK = 1e-9


def units(vectors: np.ndarray) -> np.ndarray:
    return vectors / np.maximum(np.linalg.norm(vectors, axis=1, keepdims=True), 1e-12)


def distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Of all rows of a to all rows of b, both unit vectors."""
    return np.sqrt(np.maximum(2 - 2 * (a @ b.T), 0))


def centres_of(sample: np.ndarray, cells: int) -> np.ndarray:
    """Unit centres by k-means from spread starts: each next one is the row farthest from those before."""
    if not len(sample):
        return np.zeros((0, sample.shape[1]))
    starts = [0]
    far = distances(sample, sample[:1])[:, 0]
    while len(starts) < min(cells, len(sample)) and far.max() > SLACK:
        starts.append(int(far.argmax()))
        far = np.minimum(far, distances(sample, sample[starts[-1:]])[:, 0])
    centres = sample[starts]
    for _ in range(ROUNDS):
        own = np.concatenate([distances(sample[i : i + 4096], centres).argmin(axis=1) for i in range(0, len(sample), 4096)])
        sums = np.zeros_like(centres)
        np.add.at(sums, own, sample)
        held = np.linalg.norm(sums, axis=1) > SLACK
        moved = np.where(held[:, None], units(sums), centres)
        if np.allclose(moved, centres):
            break
        centres = moved
    return centres


def probes_of(sample: np.ndarray, centres: np.ndarray, share: float = SHARE, k: int = NEIGHBOURS) -> int:
    """How many of the nearest cells hold `share` of the k nearest neighbours, as measured on some of the sample's rows."""
    if len(sample) < 2 or not len(centres):
        return 1
    own = np.concatenate([distances(sample[i : i + 4096], centres).argmin(axis=1) for i in range(0, len(sample), 4096)])
    asked = sample[:MEASURED]
    near = np.argsort(distances(asked, sample), axis=1, kind="stable")[:, : k + 1]
    rank = np.argsort(np.argsort(distances(asked, centres), axis=1, kind="stable"), axis=1, kind="stable")
    ranks = np.sort(np.take_along_axis(rank, own[near], 1).ravel())
    return int(ranks[min(len(ranks) - 1, ceil(share * len(ranks)) - 1)]) + 1


def fit(rows: DataFrame, dimensions: int) -> DataFrame:
    """id, vector of the rows that can be compared."""
    known = (F.size("vector") == dimensions) & F.col("id").isNotNull() & ~F.exists("vector", lambda x: x.isNull())
    return rows.where(known).select(F.col("id").cast("long").alias("id"), F.col("vector").cast("array<double>").alias("vector"))


def matrix(column: pa.Array, dimensions: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dimensions)


@dataclass(frozen=True)
class CellIndex:
    """cells: a row (cell, n, radius) for each; bounded by MOST_CELLS, as the centres are."""

    spark: SparkSession
    folder: str
    dimensions: int
    centres: np.ndarray
    cells: dict[int, tuple[int, float]]
    probes: int = 1

    @classmethod
    def create(cls, rows: DataFrame, folder: str, dimensions: int, cells: int | None = None) -> CellIndex:
        spark = rows.sparkSession
        importable(spark)
        known = fit(rows, dimensions)
        total = known.count()
        wanted = min(MOST_CELLS, cells or ceil(total**0.5) or 1)
        drawn = known.orderBy(F.xxhash64("id"), "id").limit(SAMPLE).toPandas()
        sample = np.array(drawn["vector"].tolist(), float).reshape(-1, dimensions)
        sample = units(sample[np.linalg.norm(sample, axis=1) > 1e-12])
        centres = centres_of(sample, wanted)
        shared = spark.sparkContext.broadcast(centres)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                x = matrix(b.column("vector"), dimensions)
                cell, far = np.full(len(x), ZERO, np.int32), np.full(len(x), np.inf)
                some = np.flatnonzero(np.linalg.norm(x, axis=1) > 1e-12) if len(shared.value) else np.zeros(0, np.int64)
                if len(some):
                    d = distances(units(x[some]), shared.value)
                    cell[some], far[some] = d.argmin(axis=1), d.min(axis=1)
                yield pa.RecordBatch.from_arrays([pa.array(cell), b.column("id"), b.column("vector"), pa.array(far)], ["cell", "id", "vector", "far"])

        filed = written(known.mapInArrow(run, "cell int, id long, vector array<double>, far double"), "cells")
        facts = {r.cell: (r.n, r.radius) for r in filed.groupBy("cell").agg(F.count("*").alias("n"), F.max("far").alias("radius")).collect()}
        index = cls(spark, folder, dimensions, centres, facts, probes_of(sample, centres))
        part = F.pmod(F.xxhash64("id"), index.parts(F.col("cell")))
        filed.select("cell", "id", "vector").repartition(max(1, sum(-(-n // CELL_ROWS) for n, _ in facts.values())), "cell", part).write.partitionBy("cell").parquet(f"{folder}/lists")
        return index

    def parts(self, cell: Column) -> Column:
        """Into how many parts a cell goes."""
        large = {c: -(-n // CELL_ROWS) for c, (n, _) in self.cells.items() if n > CELL_ROWS}
        return F.coalesce(F.element_at(F.create_map(*[F.lit(x) for pair in large.items() for x in pair]), cell), F.lit(1)) if large else F.lit(1)

    def lists(self, cells: list[int]) -> DataFrame:
        """cell, id, vector of some cells, from their folders alone."""
        schema = "id long, vector array<double>, cell int"
        paths = [p for p in (f"{self.folder}/lists/cell={c}" for c in cells) if _path(self.spark, p)[0].exists(_path(self.spark, p)[1])]
        if not paths:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).option("basePath", f"{self.folder}/lists").parquet(*paths)

    def _bounds(self, queries: DataFrame) -> DataFrame:
        """query_id, q, cell, near (distance to the centre), bound (no vector of the cell is nearer): a row for each query
        and cell, the cells by their distance."""
        shared = self.spark.sparkContext.broadcast((self.centres, np.array([self.cells.get(c, (0, 0.0))[1] for c in range(len(self.centres))])))
        filled, dimensions = sorted(c for c in self.cells if c != ZERO), self.dimensions

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            centres, radii = shared.value
            for b in batches:
                x = matrix(b.column("vector"), dimensions)
                near = distances(units(x), centres)[:, filled] if filled else np.zeros((len(x), 0))
                bound = np.maximum(near - radii[filled] - SLACK, 0)
                bound[np.linalg.norm(x, axis=1) <= 1e-12] = 0
                order = near.argsort(axis=1)
                cells = np.array(filled, np.int32)[order]
                sorted_ = [np.take_along_axis(a, order, 1).tolist() for a in (near, bound)]
                yield pa.RecordBatch.from_arrays([b.column("id"), b.column("vector"), pa.array(cells.tolist(), pa.list_(pa.int32())), *(pa.array(a, pa.list_(pa.float64())) for a in sorted_)], ["query_id", "q", "cells", "near", "bound"])

        return queries.mapInArrow(run, "query_id long, q array<double>, cells array<int>, near array<double>, bound array<double>")

    def _compared(self, pairs: DataFrame, k: int) -> DataFrame:
        """pairs (query_id, q, cell) -> query_id, id, distance: the k best of each query in each part of its cells."""
        told = written(pairs, "cell-queries")
        asked = {r.cell: -(-r.n // CELL_QUERIES) for r in told.groupBy("cell").agg(F.count("*").alias("n")).collect()}  # a row a cell
        if not asked:
            return self.spark.createDataFrame([], "query_id long, id long, distance double")
        blocks = F.element_at(F.create_map(*[F.lit(x) for pair in asked.items() for x in pair]), F.col("cell"))
        left = told.select("cell", "query_id", "q", F.explode(F.sequence(F.lit(0), self.parts(F.col("cell")) - 1)).alias("part"), F.pmod(F.xxhash64("query_id"), blocks).cast("int").alias("block"))
        right = self.lists(sorted(asked)).select("cell", "id", "vector", F.pmod(F.xxhash64("id"), self.parts(F.col("cell"))).cast("int").alias("part"), F.explode(F.sequence(F.lit(0), blocks - 1)).alias("block"))

        def compare(q: pd.DataFrame, r: pd.DataFrame) -> pd.DataFrame:
            if not len(q) or not len(r):
                return pd.DataFrame({"query_id": np.zeros(0, np.int64), "id": np.zeros(0, np.int64), "distance": np.zeros(0)})
            rows, ids, out = units(np.stack(r["vector"].to_numpy())), r["id"].to_numpy(), []
            for at in range(0, len(q), 256):
                part = q.iloc[at : at + 256]
                d = np.round(1 - units(np.stack(part["q"].to_numpy())) @ rows.T, 12)
                first = np.lexsort((np.broadcast_to(ids, d.shape), d), axis=1)[:, :k]
                n = first.shape[1]
                out.append(pd.DataFrame({"query_id": np.repeat(part["query_id"].to_numpy(), n), "id": ids[first].ravel(), "distance": np.take_along_axis(d, first, 1).ravel()}))
            return pd.concat(out)

        keys = ["cell", "part", "block"]
        return left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInPandas(compare, "query_id long, id long, distance double")

    def search(self, queries: DataFrame, k: int, probes: int | None = None, exact: bool = True) -> tuple[DataFrame, DataFrame]:
        """queries (id, vector) -> the k nearest (query_id, id, distance), and query_id, cells: how many cells were read."""
        probes = probes or self.probes
        met = written(self._bounds(fit(queries, self.dimensions).dropDuplicates(["id"])), "cell-bounds")
        first = F.slice("cells", 1, probes)
        opening = F.array_append(first, F.lit(ZERO)) if ZERO in self.cells else first
        best = written(_best(self._compared(met.select("query_id", "q", F.explode(opening).alias("cell")), k), k), "cell-best")
        if not exact:
            return best, met.select("query_id", F.size(opening).alias("cells"))
        # half a squared distance is what cosine distances are, so the bound is compared as one
        reach = best.groupBy("query_id").agg(F.count("*").alias("n"), F.max("distance").alias("far")).select("query_id", F.when(F.col("n") < k, F.lit(None)).otherwise(F.col("far")).alias("far"))
        rest = F.arrays_zip(F.slice("cells", probes + 1, F.greatest(F.size("cells"), F.lit(1))).alias("cell"), F.slice("bound", probes + 1, F.greatest(F.size("cells"), F.lit(1))).alias("bound"))
        open_ = met.join(reach, "query_id", "left").select("query_id", "q", F.filter(rest, lambda c: F.col("far").isNull() | (c["bound"] * c["bound"] / 2 <= F.col("far") + SLACK)).alias("open"), F.size(opening).alias("opened"))
        open_ = written(open_, "cells-open")
        further = self._compared(open_.select("query_id", "q", F.explode(F.transform("open", lambda c: c["cell"])).alias("cell")), k)
        return _best(best.unionByName(further), k), open_.select("query_id", (F.col("opened") + F.size("open")).alias("cells"))


def _best(found: DataFrame, k: int) -> DataFrame:
    nth = F.row_number().over(Window.partitionBy("query_id").orderBy("distance", "id"))
    return found.withColumn("_n", nth).where(F.col("_n") <= k).drop("_n")
