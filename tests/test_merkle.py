"""Trees of digests: planted differences are found by reading few ranges."""

import hashlib

import pytest
from pyspark.sql import functions as F

from corpusmill.operators import merkle as M


def frame(spark, rows):
    return spark.createDataFrame(rows, "k string, v string")


def both(spark, a, b, every=8):
    return M.trees(frame(spark, a), frame(spark, b), ["k"], F.col("v"), every)


def found(a, b):
    return {(r.k, r.change) for r in M.changes(a, b).collect()}


def test_planted_differences(spark):
    rows = [(f"k{i:05d}", f"v{i}") for i in range(2000)]
    other = [r for r in rows if r[0] != "k00100"] + [("k01500x", "new")]
    other[700] = (other[700][0], "changed")
    a, b = both(spark, rows, other)
    leaves, compared = M.differing(a, b)
    assert leaves.count() <= 4 and compared[0] == 1 and sum(compared) < 120 and len(compared) == 4
    assert found(a, b) == {("k00100", "removed"), ("k01500x", "added"), (other[700][0], "changed")}
    plan = M.rows_of(a, leaves)._jdf.queryExecution().toString()
    assert "PushedFilters: [In(leaf" in plan or "PushedFilters: [IsNotNull(leaf)" in plan


def test_equal_copies_in_another_order(spark):
    rows = [(f"k{i % 500}", f"v{i}") for i in range(1000)] + [("dup", "x")] * 5
    a, b = both(spark, rows, rows[::-1])
    assert a.root() == b.root() and found(a, b) == set()
    assert M.differing(a, b)[1] == [1] + [0] * (len(a.levels) - 1)
    moved = [(k, rows[(i + 1) % 1000][1]) if i < 1000 else (k, v) for i, (k, v) in enumerate(rows)]
    c, d = both(spark, rows, moved)  # the same keys and the same contents, paired otherwise
    assert c.root() != d.root()


def test_one_key_with_most_rows_and_counts(spark):
    hot = [("hot", str(i)) for i in range(600)]
    a, b = both(spark, [*hot, ("z", None)], [*hot[:-1], ("z", ""), ("z2", "a"), ("z2", "a")])
    assert a.rows.groupBy("leaf").count().agg(F.max("count")).first()[0] <= 16
    assert found(a, b) == {("hot", "changed"), ("z", "changed"), ("z2", "added")}
    c, d = both(spark, [("z", "a")], [("z", "a"), ("z", "a")])
    assert found(c, d) == {("z", "changed")}


@pytest.mark.parametrize("sizes", [(0, 0), (0, 300), (300, 0), (1, 1)])
def test_empty_and_small(spark, sizes):
    a, b = both(spark, *[[(f"k{i}", "v") for i in range(n)] for n in sizes])
    change = "added" if sizes[1] else "removed"
    want = set() if sizes[0] == sizes[1] else {(f"k{i}", change) for i in range(300)}
    assert found(a, b) == want
    if not sizes[0]:
        assert a.root() == hashlib.sha256(b"").hexdigest()


def test_digest_is_of_rows_in_order(spark):
    a, _ = both(spark, [("b", "2"), ("a", "1")], [])
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    assert a.root() == sha(f"a\x1f{sha('1')}\x1f1\nb\x1f{sha('2')}\x1f1")


def test_a_row_is_written_once(spark):
    """The tables written for trees of two copies take less than two digests of 32 bytes a row."""
    import os

    from corpusmill.sources import tables

    rows = spark.range(20_000).select(F.col("id").cast("string").alias("k"), F.md5(F.col("id").cast("string")).alias("v"))
    since = tables.mark()
    a, b = M.trees(rows, rows.where("k <> '777'"), ["k"], F.col("v"), 64)
    size = sum(os.path.getsize(os.path.join(d, f)) for top in tables._WRITTEN[since:] for d, _, names in os.walk(top) for f in names if f.startswith("part-"))
    assert size < 64 * 40_000 and dict(a.rows.dtypes)["_h"] == "binary"
    assert found(a, b) == {("777", "removed")}


def test_cuts_do_not_depend_on_batches():
    """Two copies in order, whichever way they are cut into batches, also between the two rows of a place."""
    import random

    import pyarrow as pa

    rng, rows = random.Random(5), []
    for k in range(300):
        sides = rng.choice([(0, 1)] * 6 + [(0,), (1,)])
        rows += [(s, f"k{k:04d}", 1 + (k % 50 == 0)) for s in sides]

    def told(sizes):
        at, parts = 0, []
        while at < len(rows):
            n = next(sizes)
            s, p, c = zip(*rows[at : at + n])
            parts.append(pa.RecordBatch.from_arrays([pa.array(s, pa.int32()), pa.array([3] * len(s)), pa.array(p), pa.array(p), pa.array(c)], ["_side", "_p", "_place", "k", "_n"]))
            at += n
        return [r for b in M.cut(7)(iter(parts)) for r in b.to_pylist()]

    from itertools import repeat

    whole = told(repeat(10_000))
    data = [r for r in whole if r["_side"] < 2]
    assert [(r["_side"], r["k"], r["_n"]) for r in data] == rows
    by_leaf, by_key = {}, {}
    for r in data:
        by_leaf.setdefault((r["_side"], r["leaf"]), []).append(f"{r['k']}\x1f{r['_n']}")
        by_key.setdefault(r["k"], set()).add(r["leaf"])
    assert max(map(len, by_leaf.values())) <= 7 and all(len(x) == 1 for x in by_key.values()) and min(r["leaf"] for r in data) == 3 << M.PLACE_BITS
    want = {k: hashlib.sha256("\n".join(v).encode()).hexdigest() for k, v in by_leaf.items()}
    assert {(r["_copy"], r["leaf"]): r["digest"] for r in whole if r["_side"] == 2} == want
    key = lambda r: tuple(map(str, r.values()))
    for sizes in (repeat(1), repeat(2), repeat(3), (rng.randrange(1, 40) for _ in repeat(0))):
        assert sorted(told(sizes), key=key) == sorted(whole, key=key)
