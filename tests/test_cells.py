"""Vectors in cells: the exact way equals brute force, the fast way finds nine of ten."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpusmill.operators import cells
from corpusmill.operators.cells import CellIndex

SF = "/root/testdata/sf0.01"


def brute(rows, queries, k):
    ids = np.array([i for i, _ in rows])
    x = cells.units(np.array([v for _, v in rows], float))
    out = {}
    for i, q in queries:
        d = np.round(1 - cells.units(np.array([q], float)) @ x.T, 12)[0]
        first = np.lexsort((ids, d))[:k]
        out[i] = [(int(ids[j]), float(d[j])) for j in first]
    return out


def lists(df):
    out = {}
    for r in df.orderBy("query_id", "distance", "id").collect():
        out.setdefault(r.query_id, []).append((r.id, r.distance))
    return out


def same(got, want):
    assert got.keys() == want.keys()
    for q, rows in want.items():
        assert [i for i, _ in got[q]] == [i for i, _ in rows]
        assert [d for _, d in got[q]] == pytest.approx([d for _, d in rows], abs=1e-9)


@pytest.fixture(scope="module")
def clustered():
    rng = np.random.default_rng(4)
    middles = rng.normal(size=(20, 8))
    rows = [(i, (middles[i % 20] + rng.normal(size=8) * 0.1).tolist()) for i in range(1500)]
    return rows + [(5000 + i, rows[3][1]) for i in range(40)] + [(6000, [0.0] * 8), (6001, [0.0] * 8)]


def test_exact_equals_brute_force_and_leaves_cells_unread(spark, tmp_path, clustered, monkeypatch):
    queries = [*clustered[::100], clustered[-1]]
    df = spark.createDataFrame(clustered, "id long, vector array<double>")
    q = spark.createDataFrame(queries, "id long, vector array<double>")
    want = brute(clustered, queries, 7)
    for rows, asked in ((cells.CELL_ROWS, cells.CELL_QUERIES), (30, 2)):  # also with cells and their queries dealt to several tasks
        monkeypatch.setattr(cells, "CELL_ROWS", rows)
        monkeypatch.setattr(cells, "CELL_QUERIES", asked)
        index = CellIndex.create(df, f"{tmp_path}/i{rows}", 8, 20)
        found, read = index.search(q, 7, probes=1)
        same(lists(found), want)
        counts = {r.query_id: r.cells for r in read.collect()}
        assert counts.pop(6001) == len(index.cells) and max(counts.values()) < len(index.cells) / 2


def test_few_rows_and_odd_ones(spark, tmp_path):
    rows = [(1, [1.0, 0.0]), (2, [0.0, 1.0]), (2, [0.0, 1.0]), (None, [1.0, 1.0]), (4, None), (5, [1.0]), (6, [1.0, None])]
    df = spark.createDataFrame(rows, "id long, vector array<double>")
    index = CellIndex.create(df, f"{tmp_path}/i", 2)
    found, _ = index.search(df, 5, probes=1)
    assert lists(found) == {1: [(1, 0.0), (2, 1.0), (2, 1.0)], 2: [(2, 0.0), (2, 0.0), (1, 1.0)]}
    none = CellIndex.create(df.limit(0), f"{tmp_path}/e", 2)
    assert none.search(df, 3)[0].count() == 0
    assert index.search(df.limit(0), 3)[0].count() == 0


def test_recall_of_the_fast_way(spark, tmp_path):
    rows = [(r.vec_id, list(r.embedding)) for r in spark.read.parquet(f"{SF}/embeddings.parquet").collect()]
    df = spark.createDataFrame(rows, "id long, vector array<double>")
    queries = [r for r in rows if r[0] % 50 == 0]
    index = CellIndex.create(df, f"{tmp_path}/i", len(rows[0][1]))
    want = brute(rows, queries, 10)
    q = df.where(F.col("id") % 50 == 0)
    same(lists(index.search(q, 10)[0]), want)
    got = lists(index.search(q, 10, exact=False)[0])
    recall = np.mean([len({i for i, _ in got[k]} & {i for i, _ in v}) / len(v) for k, v in want.items()])
    assert recall >= 0.9 and index.probes < len(index.cells), (recall, index.probes)
