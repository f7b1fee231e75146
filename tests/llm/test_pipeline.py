import itertools

import corpus_pipeline as P
import pytest

from corpusmill.llm import decontaminate as D
from corpusmill.llm import packing as K
from corpusmill.llm.common import read, write_cut
from corpusmill.llm.simhash import shingle_hashes

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def steps(spark):
    """The documents before and after each stage, as run() makes them."""
    out = [read(spark, SF, "documents")]
    for name, stage in P.STAGES[:-1]:
        out.append(write_cut(stage(spark, out[-1], SF), name))
    return out


def test_stages_keep_the_columns(steps):
    assert [n for n, _ in P.STAGES] == ["toxicity", "quality", "near-dedup", "decontamination", "packing"]
    assert all(s.columns == steps[0].columns for s in steps)
    sizes = [s.count() for s in steps]
    assert sizes == sorted(sizes, reverse=True) and sizes[-1] > 0.5 * sizes[0]


def test_filters_follow_the_labels(spark, steps):
    labels = read(spark, SF, "labels")
    for before, after, label, bad in ((0, 1, "toxic", 1), (1, 2, "quality", 0)):
        known = steps[before].join(labels, "doc_id").select("doc_id", label).collect()
        kept = {r.doc_id for r in steps[after].select("doc_id").collect()}
        wrong = sum((r.doc_id in kept) == (r[label] == bad) for r in known)
        assert wrong <= 0.03 * len(known)


def test_no_near_copies_left(steps):
    before, after = ({r.doc_id: set(shingle_hashes(r.text, 5)) for r in s.collect()} for s in steps[2:4])
    for a, b in itertools.combinations(sorted(after), 2):
        x, y = after[a], after[b]
        if 0.8 * max(len(x), len(y)) <= min(len(x), len(y)):
            assert len(x & y) < 0.8 * len(x | y), (a, b)
    for d in before.keys() - after.keys():
        assert any(len(before[d] & s) >= 0.8 * len(before[d] | s) for e, s in before.items() if e != d)


def test_no_leaks_left(spark, steps):
    items = [D.words_of(r.text) for r in read(spark, SF, "benchmark").collect()]
    after = {r.doc_id for r in steps[4].collect()}
    for r in steps[3].collect():
        text = D.words_of(r.text)
        least = min(min(D.myers(list(i), text), default=99) - int(0.2 * len(i)) for i in items if D.why_skipped(i) is None)
        assert (r.doc_id in after) == (least > 0)


def test_all_is_packed(spark, steps):
    pieces = P.run(spark, SF).select("doc_id", "length", "doc_tokens").collect()
    enc = K.encoder(K.default_vocabulary())
    want = {r.doc_id: len(enc.ids(r.text)) for r in steps[4].collect()}
    got = {}
    for r in pieces:
        got[r.doc_id] = got.get(r.doc_id, 0) + r.length
    assert got == want
