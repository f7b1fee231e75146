"""Chains, closures, roots and links against brute force; graphs kept by deltas against full rebuilds."""

import random

import pytest
from pyspark.sql import functions as F

from corpusmill.operators import lineage as L
from corpusmill.operators import roots as R
from corpusmill.operators.code import resolve
from corpusmill.operators.graph import CodeGraph


def test_chains_of_thousands_and_circles(spark):
    edges = [(i, i + 1) for i in range(3000)] + [(5000 + i, 5000 + (i + 1) % 7) for i in range(7)] + [(6000, 5003), (7000, 7000), (None, 1), (8000, None)]
    got = {r.n: (r.end, r.steps, r.circular) for r in L.chains(spark.createDataFrame(edges, "n long, m long"), "n", "m").collect()}
    want = {i: (3000, 3000 - i, False) for i in range(3000)} | {k: (None, 0, True) for k in [*range(5000, 5007), 6000, 7000]}
    assert got == want
    with pytest.raises(Exception, match="several following"):
        L.chains(spark.createDataFrame([(1, 2), (1, 3)], "n long, m long"), "n", "m").collect()


def test_closure(spark):
    rng = random.Random(3)
    edges = {(rng.randrange(30), rng.randrange(30)) for _ in range(45)} | {(100 + i, 101 + i) for i in range(60)}
    want = {}
    for start in {a for a, _ in edges}:
        level, frontier, seen = 0, {start}, set()
        while frontier:
            level += 1
            frontier = {b for a, b in edges if a in frontier} - seen
            seen |= frontier
            want |= {(start, b): level for b in frontier}
    rows = L.closure(spark.createDataFrame([*edges, (None, 1), (2, None)], "a long, b long")).collect()
    assert {(r.a, r.b): r.steps for r in rows} == want and len(rows) == len(want)


def test_children_and_detail(spark):
    edges = spark.createDataFrame([(1, 5, "calls"), (1, 4, "imports"), (2, 1, "calls"), (1, None, "calls"), (None, 1, "x")], "s long, t long, k string")
    assert [(r.s, r.t, r.position) for r in L.children(edges, "s", "t", [F.col("t").asc_nulls_last()]).orderBy("s", "position").collect()] == [(1, 4, 1), (1, 5, 2), (1, None, 3), (2, 1, 1)]
    got = {r.node: (list(map(tuple, r.outgoing)), list(map(tuple, r.incoming))) for r in L.detail(spark.createDataFrame([(1,), (9,)], "node long"), edges, "s", "t", "k").collect()}
    assert got == {1: ([("calls", None), ("calls", 5), ("imports", 4)], [("calls", 2), ("x", None)]), 9: ([], [])}


def test_covering_roots(spark):
    rng = random.Random(4)
    paths = ["/".join(rng.choices(["a", "ab", "a b", "a-b", "ä", "b"], k=rng.randint(1, 5))) for _ in range(120)] + ["x/y/", "x/y", "x/y/z", "x/y0", "", None]
    clean = {p.rstrip("/") for p in paths if p and p.strip("/")}
    want = {p for p in clean if not any(p.startswith(q + "/") for q in clean)}
    rows = [r.path for r in R.covering(spark.createDataFrame([(p,) for p in paths], "path string").repartition(7)).collect()]
    assert sorted(rows) == sorted(want)
    deep = ["/".join(["a"] * n) for n in range(200, 0, -1)]
    assert [r.path for r in R.covering(spark.createDataFrame([(p,) for p in deep], "path string")).collect()] == ["a"]


def test_links_loops_and_missing_targets(spark):
    directories = [(d,) for d in ("r", "r/a", "b", "c", "d", "island")]
    links = [
        ("r/1", "r", "b"), ("r/2", "r", "b"), ("r/3", "r", "nowhere"), ("r/4", "r", "r"), ("b/1", "b", "c"), ("b/2", "b", "r"), ("c/1", "c", "b"), ("c/2", "c", "d"),
        ("d/1", "d", "d"), ("r/a/1", "r/a", "r"), ("island/1", "island", "r"), (None, "r", "b"), ("r/5", "r", None),
    ]
    df = lambda rows, schema: spark.createDataFrame(rows, schema)
    got = {r.path: (r.status, r.level) for r in R.followed(df(links, "path string, directory string, target string"), df(directories, "directory string"), df([("r",), ("r/a",), ("gone",)], "directory string")).collect()}
    assert got == {
        "r/1": ("followed", 1), "r/2": ("duplicate", 1), "r/3": ("missing", 1), "r/5": ("missing", 1), "r/4": ("loop", 1), "r/a/1": ("loop", 1), "b/1": ("followed", 2),
        "b/2": ("covered", 2), "c/1": ("covered", 3), "c/2": ("followed", 3), "d/1": ("loop", 4),
    }


def test_customer_roots(spark):
    df = lambda *paths: spark.createDataFrame([(p,) for p in paths], "path string")
    found = R.customer_roots(df("Acme\\sub", "other/acme", None), df("z acme/x", "acme inc/y", "Acme/z", "none"), [" ACME ", "", "acme"])
    assert [r.root for r in found.orderBy("position").collect()] == ["Acme", "acme inc", "z acme"]
    assert R.customer_roots(df("acme"), df("acme"), [" "]).count() == 0


def test_graph_by_deltas_equals_a_rebuild(spark, tmp_path):
    rng = random.Random(9)
    names = ["Run", "stop", "go", "Walk", "sit"]
    state: dict[int, tuple[list, list]] = {}

    def content(file):
        symbols = [(file, file * 10 + k, rng.choice(names)) for k in range(rng.randint(0, 3))]
        references = [(file, file * 10 + k, rng.choice(["lib::", "x.", ""]) + rng.choice([*names, "nobody"]) + rng.choice(["", "(a)"])) for k in range(rng.randint(0, 4))]
        return symbols, references

    graph = CodeGraph.create(spark, str(tmp_path / "g"), 4)

    def update(files):
        rows = [state.get(f, ([], [])) for f in files]
        return graph.update(
            spark.createDataFrame([(f,) for f in files], "file_id long"), spark.createDataFrame([s for r in rows for s in r[0]], "file_id long, symbol_id long, name string"),
            spark.createDataFrame([s for r in rows for s in r[1]], "file_id long, source_id long, target string"),
        )

    def rebuilt():
        symbols = spark.createDataFrame([(s[1], s[2]) for r in state.values() for s in r[0]], "symbol_id long, name string")
        references = spark.createDataFrame(list({(s[1], s[2]) for r in state.values() for s in r[1]}), "source_id long, target string")
        return sorted(map(str, resolve(references, symbols).collect()))

    state |= {f: content(f) for f in range(12)}
    update(range(12))
    assert sorted(map(str, graph.edges().collect())) == rebuilt()
    for files in ([3], [5, 20], [7]):
        state |= {f: content(f) for f in files}
        if files == [7]:
            del state[7]
        told = update(files)
        assert sorted(map(str, graph.edges().collect())) == rebuilt()
        before = {n: graph.table(n).latest() for n in ("symbols", "references", "names", "edges")}
        assert update(files).symbols == update(files).references == 0
        assert before == {n: graph.table(n).latest() for n in before} and told.references < 60
