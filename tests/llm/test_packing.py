import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from corpusmill.llm import packing as K
from corpusmill.llm.common import read


def whole(rows, texts, window):
    """Every id lies in exactly one piece, sequences are gapless and within the window; returns the room left."""
    path = K.default_vocabulary()
    plain = Tokenizer.from_file(path)
    pieces, filled = {}, {}
    for r in rows:
        pieces.setdefault(r.doc_id, []).append(r)
        filled.setdefault(r.sequence_id, []).append(r)
    for s in filled.values():
        s.sort(key=lambda r: r.offset)
        at = 0
        for r in s:
            assert r.offset == at and r.length > 0
            at += r.length
        assert at <= window
    copies = Counter(d for d, _ in texts)
    for d, t in texts:
        ids = [*plain.encode(t or "", add_special_tokens=False).ids, 1]
        own = [r for r in pieces[d] if r.doc_tokens == len(ids)]
        if copies[d] == 1:
            at = 0
            for r in sorted(own, key=lambda r: r.start):
                assert r.start == at and r.ids_crc32 == zlib.crc32(np.array(ids[at : at + r.length], "<u4").tobytes())
                at += r.length
            assert at == len(ids)
    assert sum(r.length for r in rows) == sum(len(plain.encode(t or "", add_special_tokens=False).ids) + 1 for _, t in texts)
    return sum(window - sum(r.length for r in s) for s in filled.values())


def test_round_trip(spark):
    texts = [(r.doc_id, r.text) for r in read(spark, "/root/testdata/sf0.001", "documents").collect()]
    texts += [(9001, None), (9002, ""), (9003, "a <|endoftext|> b"), (9004, " " * 5000 + "x"), (9005, "é" * 60_000), (9006, "same"), (9006, "same"), (None, "no id")]
    df = spark.createDataFrame([(d, t, "z") for d, t in texts], "doc_id long, text string, ids string")
    one = K.pack(df, K.default_vocabulary()).collect()
    assert whole(one, texts, K.WINDOW) < K.WINDOW
    many = K.pack(df, K.default_vocabulary(), 64, 20_000).collect()
    assert whole(many, texts, 64) < 64 * 40
    assert sorted(many, key=repr) == sorted(K.pack(df.repartition(3), K.default_vocabulary(), 64, 20_000).collect(), key=repr)


def test_empty(spark):
    assert K.pack(spark.createDataFrame([], "doc_id long, text string"), K.default_vocabulary()).count() == 0


@pytest.mark.parametrize("dense", [1, K.DENSE, 10**6])
def test_neighbours_match_brute_force(monkeypatch, dense):
    monkeypatch.setattr(K, "DENSE", dense)
    rng = np.random.default_rng(3)
    docs = [rng.integers(0, 60, n).astype(np.uint16) for n in rng.integers(1, 40, 30)]
    df = np.bincount(np.concatenate([np.unique(d) for d in docs]), minlength=60)
    idf = np.log1p((len(docs) - df + 0.5) / (df + 0.5)) + np.arange(60) * 1e-6
    mean = np.mean([len(d) for d in docs])
    index = K.Bm25Shard(docs, idf, mean)
    used = rng.random(30) < 0.3
    for seed in range(60):
        if seed == 30:  # what used documents leave behind changes nothing
            index.forget(used)
            used |= rng.random(30) < 0.2
        seed %= 30
        terms = [t for t in set(docs[seed].tolist()) if df[t] > 1]
        scores = {}
        for i, d in enumerate(docs):
            s = 0.0
            for t in terms:
                tf = int((d == t).sum())
                s += idf[t] * tf * (K.K1 + 1) / (tf + K.K1 * (1 - K.B + K.B * len(d) / mean))
            if s > 0 and not used[i]:
                scores[i] = s
        got = list(index.neighbours(seed, used))
        assert set(got) == set(scores)
        assert np.allclose([scores[i] for i in got], sorted(scores.values(), reverse=True))


def test_neighbours_share_a_window():
    """Two topics, mixed: windows hold one topic each."""
    rng = np.random.default_rng(4)
    docs = [rng.integers(50 * (i % 2), 50 * (i % 2) + 50, 16).astype(np.uint16) for i in range(64)]
    idf = np.ones(100)
    windows = {}
    for d, _, _, q, _ in K.pack_shard(docs, idf, 16.0, 128):
        windows.setdefault(q, []).append(d % 2)
    assert sum(len(set(w)) > 1 for w in windows.values()) <= 1


def test_related_documents_meet_at_every_size(spark):
    """Near copies share a shard far more often than by chance, with few or many shards; a seed's terms all count; shards stay even."""
    rng = np.random.default_rng(6)
    words = [f"{a}{b}{c}" for a in "bcdfgklm" for b in "aeiou" for c in "nprstvz"]
    texts = []
    for _ in range(300):
        base = list(rng.choice(words, 120))
        for _ in range(2):
            copy = list(base)
            for i in rng.integers(0, 120, 4):
                copy[i] = str(rng.choice(words))
            texts.append(" ".join(copy))
    texts += ["one text of many copies"] * 2000
    enc = K.encoder(K.default_vocabulary())
    ids = [enc.ids(t) for t in texts]
    df = np.bincount(np.concatenate([np.unique(x) for x in ids]), minlength=enc.size)
    idf = np.log1p((len(ids) - df + 0.5) / (df + 0.5))
    frame = spark.createDataFrame([(i, len(x), bytearray(x.tobytes())) for i, x in enumerate(ids)], "doc_id long, n long, ids binary")
    total = sum(map(len, ids))
    for shards in (8, 40):
        of = {r.doc_id: r.shard for r in K.sharded(frame, idf, df, enc.kind, total, shards).collect()}
        assert len(of) == len(ids) and max(of.values()) < shards
        sizes = np.bincount([of[i] for i in range(len(ids))], [len(x) for x in ids], shards)
        assert sizes.max() <= total / shards * (1 + 1 / K.CELLS) + max(map(len, ids)) * 4
        assert np.mean([of[i] == of[i + 1] for i in range(0, 600, 2)]) > 0.3
    docs = [np.arange(40, dtype=np.uint16), np.arange(20, dtype=np.uint16), np.array([39, 41], np.uint16)]  # the last shares the 21st term alone
    index = K.Bm25Shard(docs, np.linspace(9, 1, 60), 10.0)
    assert sorted(index.neighbours(0, np.array([True, False, False]))) == [1, 2]


def test_neighbours_over_all_shards_equal_brute_force(spark):
    """At three numbers of shards the best ten of every fiftieth document are those of BM25 over the whole table."""
    docs = read(spark, "/root/testdata/sf0.001", "documents")
    path = K.default_vocabulary()
    enc = K.encoder(path)
    texts = {r.doc_id: enc.ids(r.text or "") for r in docs.collect()}
    ids = sorted(texts)
    df = np.zeros(enc.size)
    for x in texts.values():
        df[np.unique(x)] += 1
    idf = np.log1p((len(ids) - df + 0.5) / (df + 0.5))
    mean = sum(map(len, texts.values())) / len(ids)
    want = {}
    for q in (i for i in ids if i % 50 == 0):
        terms, scores = np.unique(texts[q]), {}
        for d in ids:
            counts = np.bincount(texts[d], minlength=enc.size)[terms]
            scores[d] = float((idf[terms] * counts * (K.K1 + 1) / (counts + K.K1 * (1 - K.B + K.B * len(texts[d]) / mean))).sum())
        want[q] = sorted((d for d in ids if d != q and scores[d] > 0), key=lambda d: (-round(scores[d], 3), d))[:10], scores
    seeds = docs.where("doc_id % 50 = 0").select("doc_id")
    for shard_tokens in (1 << 22, 20_000, 4_000):
        got = {}
        for r in K.neighbours_of(docs, seeds, path, 10, shard_tokens).orderBy("query_id", F.desc("score"), "doc_id").collect():
            got.setdefault(r.query_id, []).append((r.doc_id, r.score))
        assert got.keys() == want.keys()
        for q, (best, scores) in want.items():
            assert [s for _, s in got[q]] == pytest.approx([scores[d] for d in best], rel=1e-4)
            assert all(scores[d] == pytest.approx(s, rel=1e-4) for d, s in got[q])


def test_neighbours_of_odd_rows(spark):
    docs = spark.createDataFrame([(1, "one two three"), (1, "one two three"), (2, "one two"), (None, "three one"), (4, None), (5, "")], "doc_id long, text string")
    out = K.neighbours_of(docs, spark.createDataFrame([(1,), (99,), (None,)], "doc_id long"), K.default_vocabulary(), 10, 4)
    assert sorted(str(r.doc_id) for r in out.collect()) == ["2", "4", "5", "None"]  # every document ends with the same id
    assert K.neighbours_of(docs.limit(0), docs.select("doc_id"), K.default_vocabulary()).count() == 0


def test_pieces_are_those_of_the_published_pattern():
    """The faster form of the pattern is used, and gives the ids of the tokenizer's own for any mixture of kinds of characters."""
    import random

    from corpusmill.llm import packing

    enc = packing.encoder(packing.default_vocabulary())
    assert enc.fast._pat_str == packing.PIECES
    rng = random.Random(7)
    parts = [" ", "  ", "\n", "\t", "\r\n", "\u00a0", "\u3000", "\x1c", "\x85", "a", "word", "Ünï", "日本", "7", "12", "½", "٣", "'s", "'ll", "'", "'re", "'Re", "!", "...", "😀", "e\u0301", "\u200b", "\0", "_"]
    for k in range(3000):
        text = "".join(rng.choice(parts) for _ in range(k % 12))
        assert enc.ids(text).tolist() == [*enc.plain.encode(text, add_special_tokens=False).ids, packing.END_ID], repr(text)
