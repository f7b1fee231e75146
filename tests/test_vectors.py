"""Vectors at size: embeddings without a step for each byte and place, neighbours without a matrix of all queries of a block."""

import time
import tracemalloc

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from corpusmill.functions import vectors as V
from corpusmill.plans import records as P


def by_steps(text, size):
    v = [0.0] * size
    for i, b in enumerate((text or "").encode()):
        v[i % size] += (b + 1) / 256
    n = 0.0
    for x in v:
        n += x * x
    return [x / max(n**0.5, 1e-12) for x in v]


def test_embeddings_by_batches(monkeypatch):
    texts = ["", "abc", None, "é" * 40, "x" * 5000] * 20
    monkeypatch.setattr(V, "TEXT_BYTES", 7000)
    for size in (1, 8, 64):
        assert V._embedded(pa.array(texts)[3:], size).to_pylist() == [by_steps(t, size) for t in texts[3:]]
    assert V._embedded(pa.array([], pa.string()), 4).to_pylist() == []


def test_many_embeddings(spark):
    """A step for each byte and place took 64 times the bytes of a text: minutes for these."""
    started = time.time()
    rows = spark.range(100_000).select(V.byte_embedding(F.repeat(F.col("id").cast("string"), 20)).alias("v"))
    assert rows.agg(F.sum(F.size("v"))).first()[0] == 6_400_000
    assert time.time() - started < 30


def test_rows_are_dealt_to_all_tasks(spark):
    assert P.stand_in_vectors(spark, "/root/testdata/sf0.001").rdd.getNumPartitions() == 8


def test_neighbours_in_tiles(monkeypatch):
    rng = np.random.default_rng(2)
    x = np.round(rng.normal(size=(9000, 4)), 1)
    x[5], x[17] = np.nan, 0
    ids = rng.permutation(9000)
    batches = lambda: (pa.record_batch([pa.array(ids[i : i + 3000]), pa.array(x[i : i + 3000].tolist(), pa.list_(pa.float64()))], ["id", "vector"]) for i in range(0, 9000, 3000))
    found = V._compared(batches(), np.arange(300), V._unit(x[:300]), 7, 4).to_pandas()
    distance = np.round(1 - V._unit(x[:300]) @ V._unit(x).T, 12)
    for q, own in found.groupby("query_id"):
        assert own["id"].tolist() == ids[np.lexsort((ids, distance[q]))[:7]].tolist()
    assert len(found) == 2100
    tracemalloc.start()
    V._compared(batches(), np.arange(V.QUERY_BLOCK), V._unit(x[: V.QUERY_BLOCK]), 7, 4)
    assert tracemalloc.get_traced_memory()[1] < 60 << 20
    tracemalloc.stop()
