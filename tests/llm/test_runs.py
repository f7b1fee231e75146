"""Periodic runs against brute force."""

import hashlib
import random
import zlib

import numpy as np
from corpusmill.llm import runs

SF = "/root/testdata/sf0.001"


def brute(words, least=24, times=3):
    """Every period at every place, and of each stretch the smallest period by trial."""
    n, found = len(words), set()
    for q in range(1, n // times + 1):
        i = 0
        while i + q < n:
            if words[i] != words[i + q]:
                i += 1
                continue
            start = i
            while i + q < n and words[i] == words[i + q]:
                i += 1
            part = words[start : i + q]
            if len(part) >= max(least, times * q) and not any(part[p:] == part[:-p] for p in range(1, q)):
                found.add((start, len(part), q))
    return sorted(found, key=lambda r: (r[0], r[2]))


def test_runs_of_random_words_equal_brute_force():
    rng = random.Random(5)
    docs = []
    for _ in range(400):
        n = rng.randint(0, 150)
        w = [b"%d" % rng.randrange(rng.choice((1, 2, 3, 50))) for _ in range(n)]
        for _ in range(rng.randint(0, 3)):
            if n > 30:
                a, p = rng.randrange(n), rng.randint(1, 25)
                size = rng.randint(1, n - a)
                w[a : a + size] = (w[a : a + p] * (size + 1))[:size]
        docs.append(w)
    got = runs.runs_of_many(docs)
    want = [brute(d) for d in docs]
    assert [list(map(tuple, g.tolist())) for g in got] == want
    assert sum(map(len, want)) > 50
    assert [list(map(tuple, g.tolist())) for g in runs.runs_of_many(docs, 6, 4)] == [brute(d, 6, 4) for d in docs]


def test_bounds_of_a_run():
    short = [b"x"] * 23
    assert not len(runs.runs_of_many([short])[0])
    assert runs.runs_of_many([[*short, b"x"]])[0].tolist() == [[0, 24, 1]]
    block = [b"%d" % i for i in range(30)]
    assert not len(runs.runs_of_many([[*block * 3][:89]])[0])
    assert runs.runs_of_many([[b"-", *block * 3, b"-"]])[0].tolist() == [[1, 90, 30]]
    # documents that end and begin alike do not run into one another
    assert [len(x) for x in runs.runs_of_many([[b"x"] * 20, [b"x"] * 20, []])] == [0, 0, 0]


def test_a_long_text_is_taken_whole():
    words = [b"a"] * 100_000 + [b"%d" % i for i in range(50_000)] + [b"%d" % (i % 9_000) for i in range(60_000)]
    assert runs.runs_of_many([words])[0].tolist() == [[0, 100_000, 1], [150_000, 60_000, 9_000]]


def test_names_stand_for_their_words():
    names = np.array([1, 2, 1, 2, 1, 2, 3, 1, 2, 1, 2])
    for k, level in enumerate(runs.named_levels(names, len(names))):
        words = [tuple(names[i : i + (1 << k)]) for i in range(len(names))]
        for i in range(len(names)):
            for j in range(i):
                if len(words[i]) == len(words[j]) == 1 << k:
                    assert (level[i] == level[j]) == (words[i] == words[j])


def test_query_equals_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").collect()
    got = {r["doc_id"]: r for r in runs.op11_periodic_runs(spark, SF).collect()}
    assert len(got) == len(docs)
    planted = 0
    for d in docs:
        words = (d["text"] or "").encode().split()
        n, h = len(words), zlib.crc32(str(d["doc_id"]).encode())
        g = h // 10
        if h % 10 == 0 and n:
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
            planted += 1
        found = brute(words)
        gone = {i for s, size, q in found for i in range(s + q, s + size)}
        row = got[d["doc_id"]]
        best = min(found, key=lambda r: (-(r[1] / r[2]), r[0], r[2]), default=(None,) * 3)
        assert (row["n_runs"], row["start"], row["length"], row["period"]) == (len(found), *best)
        assert row["exponent_milli"] == (1000 * best[1] // best[2] if found else None)
        assert row["runs_sha256"] == hashlib.sha256("".join(f"{s},{size},{q}\n" for s, size, q in found).encode()).hexdigest()
        assert row["collapsed_sha256"] == hashlib.sha256(b" ".join(w for i, w in enumerate(words) if i not in gone)).hexdigest()
    assert planted and any(r["n_runs"] for r in got.values())


def test_odd_rows(spark):
    rows = [(1, None, "p"), (2, "", "q"), (None, "a b " * 12, "r"), (None, "a b " * 12, "r"), (5, "\x1c\x0bz　z" * 30, "s")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, runs string")
    got = sorted(map(str, runs.periodic_runs(docs).collect()))
    assert len(got) == 5 and sum("start=0, length=24, period=2" in r and "collapsed='a b'" in r for r in got) == 2
    assert runs.periodic_runs(docs.limit(0)).count() == 0
    ties = spark.createDataFrame([(1, " ".join(["a"] * 30 + [str(i) for i in range(9)] + ["b"] * 30))], "doc_id long, text string")
    assert runs.periodic_runs(ties).select(runs.strongest(runs.F.col("runs")).alias("b")).first()["b"]["start"] == 0
