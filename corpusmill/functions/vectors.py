"""Vector functions over array columns, in double precision; the nearest vectors of a set of queries."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Queries of a block that every task holds, and rows that it compares with them at a time.
QUERY_BLOCK, ROW_BLOCK = 4096, 2048
#: Queries of a block that are compared at a time: what a task holds besides the block is a tile of these and those rows.
QUERY_TILE = 256
#: Stands for a neighbour that is not found yet.
NO_ID = np.iinfo(np.int64).max
#: A distance of or to a vector that has a null: after all others.
UNKNOWN = 1e300
#: Bytes of texts that are embedded at a time.
TEXT_BYTES = 1 << 22


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column) -> Column:
    return dot(a, b) / F.greatest(norm(a) * norm(b), F.lit(1e-12))


def l2_normalise(a: Column) -> Column:
    n = F.greatest(norm(a), F.lit(1e-12))
    return F.transform(a, lambda x: x.cast("double") / n)


def byte_embedding(text: Column, size: int = 64) -> Column:
    """A deterministic stand-in for a model: (byte + 1) / 256 summed at its place modulo size, then normalised."""

    @F.arrow_udf("array<double>")
    def embedded(texts: pa.Array) -> pa.Array:
        return _embedded(texts, size)

    return embedded(text)


def _embedded(texts: pa.Array, size: int) -> pa.Array:
    """byte_embedding of an array of texts; a null is as an empty text. Sums are made in the order of the bytes."""
    data = pa.array([], pa.large_binary()) if not len(texts) else pc.fill_null(pc.cast(pc.cast(texts, pa.large_string()), pa.large_binary()), b"")
    ends = np.frombuffer(data.buffers()[1], np.int64)[data.offset : data.offset + len(data) + 1] if len(data) else np.zeros(1, np.int64)
    held = np.frombuffer(data.buffers()[2] or b"", np.uint8)
    out, at = [np.zeros((0, size))], 0
    while at < len(data):
        upto = max(at + 1, int(np.searchsorted(ends, ends[at] + TEXT_BYTES, "right")) - 1)
        lengths = np.diff(ends[at : upto + 1])
        place = np.repeat(np.arange(upto - at) * size, lengths) + (np.arange(ends[at], ends[upto]) - np.repeat(ends[at:upto], lengths)) % size
        sums = np.bincount(place, (held[ends[at] : ends[upto]] + 1.0) / 256, (upto - at) * size).reshape(-1, size)
        square = np.zeros(upto - at)
        for k in range(size):
            square += sums[:, k] * sums[:, k]
        out.append(sums / np.maximum(np.sqrt(square), 1e-12)[:, None])
        at = upto
    return pa.ListArray.from_arrays(pa.array(np.arange(len(data) + 1) * size, pa.int32()), pa.array(np.concatenate(out).ravel()))


def nearest(queries: DataFrame, rows: DataFrame, k: int, dimensions: int) -> DataFrame:
    """queries and rows (id, vector) -> query_id, id, distance: the k rows of least cosine distance to each query, exactly;
    ties, at twelve digits, by id. Vectors of another size or none are left out.

    Queries go to all tasks in blocks of a bounded size, rows pass by once for each block, and a task keeps the k best of
    each query; so what is shuffled grows with tasks, not with pairs."""
    told = queries.where((F.size("vector") == dimensions) & F.col("id").isNotNull()).select(F.col("id").cast("long").alias("id"), F.col("vector").cast("array<double>").alias("vector"))
    blocks = -(-told.count() // QUERY_BLOCK)
    best = None
    for block in range(max(1, blocks)):
        part = told.where(F.pmod(F.xxhash64("id"), F.lit(max(1, blocks))) == block).toPandas()
        shared = rows.sparkSession.sparkContext.broadcast((part["id"].to_numpy(np.int64), _unit(np.array(part["vector"].tolist(), float).reshape(-1, dimensions))))

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            yield _compared(batches, *shared.value, k, dimensions)

        fit = rows.where((F.size("vector") == dimensions) & F.col("id").isNotNull()).select(F.col("id").cast("long").alias("id"), F.col("vector").cast("array<double>").alias("vector"))
        found = fit.mapInArrow(run, "query_id long, id long, distance double")
        best = found if best is None else best.unionByName(found)
    nth = F.row_number().over(Window.partitionBy("query_id").orderBy("distance", "id"))
    return best.withColumn("n", nth).where(F.col("n") <= k).drop("n")


def _compared(batches: Iterator[pa.RecordBatch], names: np.ndarray, wanted: np.ndarray, k: int, dimensions: int) -> pa.RecordBatch:
    """The k best rows (id, vector) of a task for each query."""
    ids, distances = np.full((len(names), k), NO_ID), np.full((len(names), k), np.inf)
    for b in batches:
        own = b.column("id").to_numpy(zero_copy_only=False)
        flat = b.column("vector").flatten().to_numpy(zero_copy_only=False).reshape(-1, dimensions)
        for at in range(0, len(own), ROW_BLOCK):
            some = _unit(flat[at : at + ROW_BLOCK]).T
            for q in range(0, len(names), QUERY_TILE):
                found = np.nan_to_num(np.round(1 - wanted[q : q + QUERY_TILE] @ some, 12), nan=UNKNOWN)
                _take(ids[q : q + QUERY_TILE], distances[q : q + QUERY_TILE], own[at : at + ROW_BLOCK], found)
    held = np.isfinite(distances)
    distances[distances == UNKNOWN] = np.nan
    return pa.RecordBatch.from_arrays([pa.array(np.repeat(names, held.sum(axis=1))), pa.array(ids[held]), pa.array(distances[held])], ["query_id", "id", "distance"])


def _take(ids: np.ndarray, distances: np.ndarray, own: np.ndarray, found: np.ndarray) -> None:
    """Put what is nearer among found (query, row of own) into the k best of each query, in place; ties by id."""
    k = ids.shape[1]
    query, row = np.nonzero(found <= distances[:, -1:])
    if not len(query):
        return
    asked = np.unique(query)
    query = np.concatenate([query, np.repeat(asked, k)])
    far = np.concatenate([found[query[: len(row)], row], distances[asked].ravel()])
    near = np.concatenate([own[row], ids[asked].ravel()])
    order = np.lexsort((near, far, query))
    first = np.searchsorted(query[order], asked)[:, None] + np.arange(k)
    ids[asked], distances[asked] = near[order][first], far[order][first]


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)
