import math

import numpy as np

from corpusmill.llm import quality as Q
from corpusmill.llm.common import read

SF = "/root/testdata/sf0.01"


def test_gradient():
    rng = np.random.default_rng(0)
    sizes = np.array([1, 4, 2])
    starts = np.cumsum(sizes) - sizes
    x, y = rng.normal(size=(7, Q.N_FEATURES)), np.array([1.0, 0.0, 1.0])
    shapes = {"We": (Q.N_FEATURES, 5), "be": (5,), "Wv": (5, 3), "Wu": (5, 3), "wa": (3,), "wo": (5,), "bo": ()}
    p = {k: np.array(rng.normal(size=s) * 0.4) for k, s in shapes.items()}

    def loss(p):
        o = Q._forward(p, x, starts, sizes)["out"]
        return -(y * np.log(o) + (1 - y) * np.log(1 - o)).mean()

    g = Q._gradient(p, x, starts, sizes, y)
    for k in shapes:
        at = tuple(int(rng.integers(n)) for n in shapes[k])
        up, down = ({**p, k: np.array(p[k])} for _ in range(2))
        up[k][at] += 1e-5
        down[k][at] -= 1e-5
        assert abs((loss(up) - loss(down)) / 2e-5 - g[k][at]) < 1e-6


def test_passages_cover_the_text():
    words = [f"w{i}" for i in range(Q.PASSAGE * 3 + 1)]
    f = Q.passages_of("  " + " \n".join(words))
    assert f.shape == (4, Q.N_FEATURES) and np.isfinite(f).all()
    for odd in ("", " ", "x", "é" * 100_000, "a b", "\ud83d"):
        assert np.isfinite(Q.passages_of(odd)).all()


def brute_passages(text):
    """The features of each passage, one character and one word at a time."""
    words = text.split()
    if not words:
        return [[0.0] * Q.N_FEATURES]
    out, seen = [], set()
    kind = lambda b: 7 if b > 127 else 0 if chr(b).isspace() else 1 if chr(b).islower() else 2 if chr(b).isupper() else 3 if chr(b).isdigit() else 4 if chr(b) in ",." else 5 if chr(b) in "!?:;'\"()-" else 6
    for k in range(0, len(words), Q.PASSAGE):
        own = words[k : k + Q.PASSAGE]
        last = k + Q.PASSAGE >= len(words)
        data = (" ".join(own) + ("" if last else " ")).encode()
        grams = [0.0] * 64
        # a pair belongs to the passage of its second byte, so the first byte of a passage pairs with the blank before it
        pairs = ([] if not k else [(32, data[0])]) + list(zip(data, data[1:], strict=False))
        for a, b in pairs:
            grams[kind(a) * 8 + kind(b)] += 1
        grams = [(g / len(data)) ** 0.5 for g in grams]
        n = [len(w.encode()) for w in own]
        mean = sum(n) / len(n)
        fresh = len(set(own) - seen) / len(set(own))
        seen |= set(own)
        var = max(0.0, sum(x * x for x in n) / len(n) - mean * mean)
        out.append([*grams, math.log1p(mean), var**0.5 / 4, sum(x > 20 for x in n) / len(n), text.count("\n") / len(words), len(set(own)) / len(own), fresh, math.log1p(len(own)) / 5])
    return [[*f, len(seen) / len(words)] for f in out]


def brute_score(p, features):
    """Gated attention over the passages by plain loops."""
    dot = lambda a, b: sum(x * y for x, y in zip(a, b, strict=True))
    hs, es = [], []
    for f in features:
        x = [(v - m) / s for v, m, s in zip(f, p["mean"], p["std"], strict=True)]
        h = [math.tanh(dot(x, p["We"][:, j]) + p["be"][j]) for j in range(Q.HIDDEN)]
        v = [math.tanh(dot(h, p["Wv"][:, j])) for j in range(Q.ATTENTION)]
        u = [1 / (1 + math.exp(-dot(h, p["Wu"][:, j]))) for j in range(Q.ATTENTION)]
        hs.append(h)
        es.append(math.exp(sum(a * b * w for a, b, w in zip(v, u, p["wa"], strict=True))))
    z = [sum(e * h[j] for e, h in zip(es, hs, strict=True)) / sum(es) for j in range(Q.HIDDEN)]
    return 1 / (1 + math.exp(-(dot(z, p["wo"]) + float(p["bo"]))))


def test_scores_match_brute_force(spark):
    docs = read(spark, SF, "documents")
    model = Q.fit(docs, read(spark, SF, "labels"), Q.teaches())
    got = {r.doc_id: r.score for r in Q.score(docs, model).collect()}
    rows = docs.orderBy("doc_id").limit(80).collect() + docs.orderBy(Q.F.desc("n_chars")).limit(2).collect()
    for r in rows:
        assert np.allclose(Q.passages_of(r.text), brute_passages(r.text), atol=1e-5)
        assert abs(got[r.doc_id] - brute_score(model.p, brute_passages(r.text))) < 1e-4


def test_one_long_text_does_not_end_learning(spark):
    """A labelled text beyond the bound on passages is passed over; what follows it teaches."""
    long_ = "long text " * 5000
    texts = [(i, long_ if i % 3 == 0 else f"good words of number {i}" if i % 2 else "BAD!!! $$$ 0x00") for i in range(90)]
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(90)], "doc_id long, quality int")
    taught = []
    real = Q.train
    try:
        Q.train = lambda bags, y: taught.extend(map(len, bags)) or real(bags, y, 1)
        Q.fit(docs, labels, Q.F.lit(True), passages=60)
    finally:
        Q.train = real
    assert len(taught) > 20 and sum(taught) <= 60 + max(taught)


def test_held_out_accuracy(spark):
    out = Q.op2_quality_attention(spark, SF).join(read(spark, SF, "labels"), "doc_id").toPandas()
    held = out[out.held_out]
    assert len(held) > 50 and (held.predicted == held.quality).mean() > 0.95
    assert out.score.between(0, 1).all()


def test_odd_rows(spark):
    docs = spark.createDataFrame([(1, None, 0.5), (2, "", 0.5), (3, "some text", 0.5), (3, "some text", 0.5), (None, "x" * 300_000, None)], "doc_id long, text string, score double")
    for labels in ([], [(3, 1)], [(3, 1), (2, 0)], [(None, 1), (1, None)]):
        model = Q.fit(docs, spark.createDataFrame(labels, "doc_id long, quality int"), Q.teaches())
        rows = Q.score(docs, model).collect()
        assert len(rows) == 5 and all(0 <= r.score <= 1 for r in rows)
        assert Q.good(docs, model).columns == docs.columns
    assert Q.score(docs.limit(0), model).count() == 0
