import numpy as np
from pyspark.sql import functions as F

from corpusmill.llm import nearcopies as N
from corpusmill.llm.simhash import fingerprint_of, shingle_hashes, simhash_batch


def jaccard(a, b):
    x, y = set(shingle_hashes(a, 5)), set(shingle_hashes(b, 5))
    return len(x & y) / len(x | y) if x | y else 1.0


def edited(rng, words, share):
    w = list(words)
    for _ in range(int(len(w) * share)):
        w[int(rng.integers(len(w)))] = f"new{rng.integers(10**9)}"
    return w


def corpus(seed=5):
    rng = np.random.default_rng(seed)
    words = [f"w{i}" for i in range(4000)]
    out = []
    for n in rng.integers(60, 900, 60):
        base = list(rng.choice(words, n))
        out.append(base)
        for share in (0.004, 0.012, 0.02, 0.08, 0.3):
            out.append(edited(rng, base, share))
    return [" ".join(w) for w in out]


def test_fingerprints_agree():
    texts = ["", "one", *corpus()[:20], "a b c d e f " * 500]
    assert [fingerprint_of(np.array(shingle_hashes(t, 5), np.uint64)) for t in texts] == simhash_batch(texts, 5).tolist()


def test_estimates():
    texts = corpus()
    bins = np.array([N.bins_of(N.set_of(t)) for t in texts])
    a = np.repeat(np.arange(0, len(texts), 6), 5)
    b = a + np.tile(np.arange(1, 6), len(a) // 5)
    values, spread = N.estimates(bins, a, b)
    errors = values - [jaccard(texts[i], texts[j]) for i, j in zip(a, b, strict=True)]
    assert abs(errors.mean()) < 0.01 and errors.std() < 0.03 and (abs(errors) < spread).all() and spread.min() > 0.06


def test_keeps_one_of_each_group(spark):
    texts = corpus()
    rows = [(1000 - i, t, "a") for i, t in enumerate(texts)]
    rows += [(2000, texts[0], "copy"), (2000, texts[0], "copy"), (2001, None, None), (2002, "", "b"), (2003, " \n", "c"), (2004, "Few words", "d"), (2005, "few  WORDS", "e"), (None, texts[0], "f"), (None, None, "g")]
    df = spark.createDataFrame(rows, "doc_id long, text string, node string")
    for tile in (N.TILE, 2):
        out = N.keep_one(df, tile=tile)
        assert out.columns == df.columns
        kept = [r.doc_id for r in out.collect()]
        assert kept.count(None) == 2 and len(kept) == len(set(kept)) + 1
        kept = set(kept) - {None}
        assert {2001, 2004} <= kept and not kept & {2000, 2002, 2003, 2005}
        # every document that went has a near copy among those of its own base; every pair over the threshold lost one
        for g in range(0, len(texts), 6):
            own = list(range(g, g + 6))
            near = [(i, j) for i in own for j in own if i < j and jaccard(texts[i], texts[j]) >= 0.8]
            for i, j in near:
                assert not {1000 - i, 1000 - j} <= kept
            for i in own:
                if all(jaccard(texts[i], texts[j]) < 0.8 for j in own if j != i):
                    assert 1000 - i in kept


def test_pairs_around_the_threshold_are_settled_exactly(spark):
    """Pairs from 0.7 to 0.9: a text goes if and only if its similarity to the one before is 0.8 or more."""
    rng = np.random.default_rng(11)
    words = [f"w{i}" for i in range(50_000)]
    rows, goes = [], {}
    for k in range(150):
        base = list(rng.choice(words, int(rng.integers(40, 700))))
        other = list(base)
        for i in rng.integers(0, len(base), max(1, int(len(base) * rng.uniform(0.008, 0.03)))):
            other[i] = f"x{i}"
        a, b = " ".join(base), " ".join(other)
        rows += [(2 * k, a), (2 * k + 1, b)]
        goes[2 * k + 1] = jaccard(a, b) >= 0.8
    df = spark.createDataFrame(rows, "doc_id long, text string")
    kept = {r.doc_id for r in N.keep_one(df).collect()}
    assert kept == {r.doc_id for r in N.keep_one(df, unit_bytes=1 << 14).collect()}  # units cut by the bytes of their sets
    assert 20 < sum(goes.values()) < 130 and {2 * k for k in range(150)} <= kept
    wrong = [d for d, g in goes.items() if g == (d in kept)]
    assert len(wrong) <= 1  # a pair at 0.8 shares no band with a probability of 0.003


def test_two_texts_under_one_id(spark):
    """The copy goes, whichever text its id has besides; the only one of its kind stays."""
    rows = [(1, "first text of many words here"), (2, "first text of many words here"), (2, "second text that is only here once"), (2, "second text that is only here once")]
    out = N.keep_one(spark.createDataFrame(rows, "doc_id long, text string"))
    assert sorted(map(tuple, out.collect())) == [rows[0], rows[2]]


def test_long_chains_and_null_ends(spark):
    from corpusmill.llm.components import connected_components

    edges = [(i, i + 1) for i in range(300)] + [(1000, 1001), (1001, 1000), (7, 7), (None, 3), (5, None), (2000, 2001), (2000, 2001)]
    got = {r.node: r.label for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(301)} | {1000: 1000, 1001: 1000, 2000: 2000, 2001: 2000}
    assert connected_components(spark.createDataFrame([(1, 1), (None, None)], "a long, b long")).count() == 0


def test_empty(spark):
    assert N.keep_one(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_repeated_lines_do_not_hide_copies(spark):
    """Two texts with the same 1000 shingles and each its own line, repeated thousands of times, are near copies."""
    rng = np.random.default_rng(8)
    common = " ".join(rng.choice([f"w{i}" for i in range(4000)], 1004))
    texts = [f"{common} {' '.join([line] * 3000)}" for line in ("alpha beta gamma", "delta epsilon zeta")]
    assert jaccard(*texts) > 0.97
    prints = [N.signature(N.set_of(t))[1] for t in texts]
    assert (prints[0] ^ prints[1]).bit_count() < 10
    out = N.keep_one(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"))
    assert [r.doc_id for r in out.collect()] == [0]


def test_columns_that_clash_and_rows_that_differ_elsewhere(spark):
    """Names that differ in case alone are one name to Spark; of rows that differ in another column one stays, always the same."""
    text = "some words that stand in both of these rows"
    df = spark.createDataFrame([(1, text, "keep me"), (1, text, "me too"), (3, "other words that are not like the rest", "x")], "doc_id long, text string, _Row_Hash string")
    out = N.keep_one(df)
    assert out.columns == df.columns
    rows = sorted(map(tuple, out.collect()))
    assert len(rows) == 2 and rows[0][2] in ("keep me", "me too") and rows[1] == (3, "other words that are not like the rest", "x")
    again = df.repartition(5).orderBy(F.desc("_Row_Hash"))
    assert sorted(map(tuple, N.keep_one(again).collect())) == rows
