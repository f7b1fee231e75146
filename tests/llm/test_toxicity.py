import random

import pytest

from corpusmill.llm import toxicity as X
from corpusmill.llm.common import read

SF = "/root/testdata/sf0.01"


def brute_segments(values):
    """All maximal scoring segments by their definition: take the best segment, then search both sides."""
    best = max(((sum(values[i:j]), -(j - i), -i, i, j) for i in range(len(values)) for j in range(i + 1, len(values) + 1)), default=(0,))
    if best[0] <= 0:
        return []
    i, j = best[3:]
    return [*brute_segments(values[:i]), (i, j - 1), *((a + j, b + j) for a, b in brute_segments(values[j:]))]


def test_segments_match_brute_force():
    r = random.Random(5)
    for _ in range(300):
        n = r.randrange(1, 30)
        # odd weights keep sums from tying
        hits = sorted(r.sample(range(n), r.randrange(0, n + 1)))
        scores = [(i, r.uniform(0.1, 3)) for i in hits]
        values = [-0.7] * n
        for i, s in scores:
            values[i] = s
        got = X.maximal_segments(scores, n, -0.7)
        assert [(a, b) for a, b, _ in got] == brute_segments(values)
        for a, b, s in got:
            assert s == pytest.approx(sum(values[a : b + 1]))


def test_many_hits_take_linear_time():
    """A million hits that each lower the running total, then a passage that joins them none, some and all."""
    apart = [(11 * i, 1.0) for i in range(1_000_000)]
    assert len(X.maximal_segments(apart, 11_000_000, -0.2)) == 1_000_000
    falling = [(3 * i, 0.1) for i in range(200_000)]
    joined = X.maximal_segments([*falling, (600_000, 1e9)], 600_001, -0.2)
    assert [s[:2] for s in joined[-1:]] == [(600_000, 600_000)] and len(joined) == 200_001
    close = X.maximal_segments([(i, 1.0) for i in range(0, 400_000, 2)], 400_000, -0.5)
    assert [s[:2] for s in close] == [(0, 399_998)]


TEACH = [(f"{w} filthy scum {w} rug", 1) for w in "you such big that what old poor sad".split()]
TEACH += [(f"{w} rug is {w} washed by {v} people, scummiest {w}", 0) for w in "a one the her his my any no".split() for v in ("nice", "few", "many")]
TEACH = [(t.replace(",", ""), y) for t, y in TEACH]


def brute_contexts(rows):
    """token -> contexts of each kind, by hand."""
    seen = {}
    for text, y in rows:
        words = text.split()
        for before, w in zip(["", *words], words, strict=False):
            for name in [w, *([w[: X.STEM] + "*"] if len(w) > X.STEM else [])]:
                seen.setdefault(name, {}).setdefault((before, w), set()).add(y)
    return {t: tuple(sum(k in v for v in c.values()) for k in (1, 0)) for t, c in seen.items()}


def test_contexts_and_log_odds_match_brute_force(spark):
    import math

    parts = [i % X.FOLDS for i in range(len(TEACH))]
    df = spark.createDataFrame([(t, y, p) for (t, y), p in zip(TEACH, parts, strict=True)] * 2, "text string, y int, part int")
    contexts = X.token_contexts(df)
    got = {r.token: (r.y1, r.y0) for r in contexts.collect()}
    for out in range(X.FOLDS + 1):
        want = brute_contexts([r for r, p in zip(TEACH, parts, strict=True) if p != out])
        assert {t: (a[out], b[out]) for t, (a, b) in got.items() if a[out] or b[out]} == want
    whole = brute_contexts(TEACH)
    n1, n0 = (sum(c[k] for c in whole.values()) for k in (0, 1))
    counts = X.counted(contexts)
    assert counts.n1[X.FOLDS] == n1 and counts.n0[X.FOLDS] == n0
    s = X.GRID[0]
    kept = counts.kept(s)[:, X.FOLDS]
    for token, i in counts.at.items():
        y1, y0 = whole[token]
        a, w = s.prior * (y1 + y0), s.prior * (n1 + n0)
        odds = math.log((y1 + a) / (n1 + w - y1 - a)) - math.log((y0 + a) / (n0 + w - y0 - a))
        z = odds / math.sqrt(1 / (y1 + a) + 1 / (y0 + a))
        if y1 >= s.contexts and z >= s.z and odds >= s.odds:
            assert kept[i] == pytest.approx(odds, rel=1e-6)
        else:
            assert kept[i] != kept[i]
    assert "filthy" in counts.at and "rug" not in counts.at


def test_evidence_matches_brute_force(spark):
    """A fitted model's score of whole texts, from its tokens on, by plain loops; also what cross-validation measures."""
    import math

    import numpy as np

    docs = read(spark, SF, "documents")
    model = X.fit(docs, read(spark, SF, "labels"), X.teaches())
    assert model.log_odds and min(model.log_odds.values()) > 0 and any(s.drift == model.drift for s in X.GRID)
    rows = {r.doc_id: r for r in X.score(docs, model).collect()}
    for d in docs.where("length(text) < 1500").collect():
        words = X.tokens_of(d.text)
        values = [model.log_odds.get(w) or (model.log_odds.get(w[: X.STEM] + "*") if len(w) > X.STEM else None) or model.drift for w in words]
        if sum(v > 0 for v in values) and len(values) < 80:
            e = 0.0
            for a, b in brute_segments(values):
                e += max(0.0, model.rate * sum(values[a : b + 1]) - math.log(model.size * len(words)))
            want = 1 / (1 + math.exp(-(model.weights[0] * math.log1p(e) + model.weights[1])))
            assert rows[d.doc_id].score == pytest.approx(want, rel=1e-6)
    drawn = X.sample(docs, read(spark, SF, "labels"), "toxic", X.teaches(), 60, balanced=True).withColumn("part", X.F.pmod(X.F.xxhash64("doc_id", X.F.lit(1)), X.F.lit(X.FOLDS)).cast("int"))
    counts = X.counted(X.token_contexts(drawn.select("text", "y", "part")))
    texts = {(r.y, len(X.tokens_of(r.text)), r.part): r.text for r in drawn.collect()}
    table_ = X.measured(drawn, counts)
    found = table_.toPandas()
    assert len(found) == drawn.count()
    models = [X.Model(rate=0.5 + k / 10, size=0.01 * (k + 1)) for k in range(len(X.GRID))]
    for r in X.evidence_of(table_, models).join(table_.drop("y"), "doc_id").collect():
        assert r.e == pytest.approx([m.evidence(r.n, [(0, 0, x) for x in s]) for m, s in zip(models, r.segments, strict=True)])
    for k in (0, 17, len(X.GRID) - 1):
        table = counts.kept(X.GRID[k])
        by_part = [X.Model({t: float(table[i, p]) for t, i in counts.at.items() if not np.isnan(table[i, p])}, X.GRID[k].drift) for p in range(X.FOLDS)]
        want = sorted((y, n, [round(x, 9) for *_, x in by_part[p].segments(t)[1]]) for (y, n, p), t in texts.items())
        assert want == [x for x in sorted((r.y, r.n, [round(x, 9) for x in r.segments[k]]) for r in found.itertuples()) if x in want]


def test_only_admitted_rows_teach(spark):
    """Labels of the other rows change nothing, whatever they say."""
    docs, labels = read(spark, SF, "documents"), read(spark, SF, "labels")
    lies = labels.withColumn("toxic", X.F.when(X.teaches(), X.F.col("toxic")).otherwise(1 - X.F.col("toxic")))
    a, b = X.fit(docs, labels, X.teaches()), X.fit(docs, lies, X.teaches())
    assert (a.log_odds, a.drift, a.rate, a.size, a.weights) == (b.log_odds, b.drift, b.rate, b.size, b.weights)


def test_held_out_accuracy(spark):
    out = X.op9_toxic_segments(spark, SF).join(read(spark, SF, "labels"), "doc_id").toPandas()
    held = out[out.held_out]
    assert len(held) > 50 and (held.predicted == held.toxic).mean() > 0.93
    assert out.score.between(0, 1).all()


def test_odd_rows(spark):
    docs = [(1, None, "z"), (2, "", None), (3, "you idiot and scum", "z"), (3, "you idiot and scum", "z"), (None, "plain", "z"), (4, "idiot " * 50_000, "z")]
    df = spark.createDataFrame(docs, "doc_id long, text string, score string")
    model = X.Model({"idiot": 4.0, "scum": 4.0}, -0.25, 3.0, 0.01, (3.0, -4.0))
    rows = X.score(df, model).collect()
    assert len(rows) == 6
    by = {r.doc_id: r for r in rows}
    assert by[1].score == by[2].score < 0.1 and by[3].score > 0.9 and by[4].score > 0.9
    assert [(p.first, p.last) for p in by[3].passages] == [(1, 3)]
    kept = X.clean(df, model)
    assert kept.columns == df.columns and sorted(map(str, (r.doc_id for r in kept.collect()))) == ["1", "2", "None"]


def test_nothing_to_learn(spark):
    docs = spark.createDataFrame([(1, "a b"), (2, None)], "doc_id long, text string")
    for labels in ([], [(1, 1)], [(7, 0)], [(None, 1), (1, None)]):
        model = X.fit(docs, spark.createDataFrame(labels, "doc_id long, toxic int"), X.teaches())
        assert X.score(docs, model).count() == 2
    assert X.score(docs.limit(0), model).count() == 0
