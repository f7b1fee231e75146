"""SentencePiece ids and texts against the library."""

import hashlib
import random

import numpy as np
import pytest
import sentencepiece

from corpusmill.llm import pieces

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def vocab():
    return pieces.Vocabulary(pieces.default_vocabulary())


def back(v, ids):
    return v.decode(np.array([i for d in ids for i in d], np.int32), np.cumsum([0, *map(len, ids)])[1:], v.surfaces)


def test_odd_texts(vocab):
    odd = ["", " ", "  a", "a  b   c ", "\n\n x", "▁x ▁", "▁", "日本語 テキスト", "<s> </s> <unk> <0x41>", "\0a", "é😀", "a" * 1000, " " * 100, "\t", "x\ny z", "the the"]
    ids = vocab.encode(odd)
    assert ids == vocab.library.encode(odd)
    assert back(vocab, ids) == vocab.library.decode(ids)


def test_random_texts_and_ids(vocab):
    rng = random.Random(4)
    alphabet = [*" ▁abcdeéßst\n\tthe<>0x日😀", "the", "ing", "  "]
    texts = ["".join(rng.choices(alphabet, k=rng.randint(0, 60))) for _ in range(5000)]
    ids = vocab.encode(texts)
    assert ids == vocab.library.encode(texts)
    assert back(vocab, ids) == vocab.library.decode(ids)
    any_ids = [[rng.choice((rng.randrange(32000), rng.randrange(300))) for _ in range(rng.randint(0, 12))] for _ in range(5000)]
    assert back(vocab, any_ids) == vocab.library.decode(any_ids)


def test_both_agendas_agree(vocab):
    rng = random.Random(6)
    words = ["▁" + "".join(rng.choices("abcdefghi-.\nü", k=rng.randint(1, 31))) for _ in range(3000)]
    assert vocab.fresh_many(words) == [vocab.fresh(w) for w in words]


def test_long_texts_without_blanks(vocab):
    text = "abcdefghij" * 20_000
    assert vocab.encode([text])[0] == vocab.library.encode(text)
    assert not any(len(w if isinstance(w, str) else w[0]) > pieces.LONGEST for w in vocab.memo)


def test_what_is_remembered_stays_bounded(vocab, monkeypatch):
    monkeypatch.setattr(pieces, "REMEMBERED", 50)
    rng = random.Random(7)
    for _ in range(20):
        texts = [" ".join("".join(rng.choices("abc", k=4)) for _ in range(30))]
        assert vocab.encode(texts) == vocab.library.encode(texts)
        assert len(vocab.memo) <= 50 + 2 * 30


def test_a_vocabulary_that_folds_is_refused(tmp_path, vocab):
    def field(number, kind, data):
        return bytes([number << 3 | kind]) + data

    with open(pieces.default_vocabulary(), "rb") as f:
        model = f.read()
    folding = field(4, 0, b"\x01")
    path = tmp_path / "m.model"
    path.write_bytes(model + field(3, 2, bytes([len(folding)]) + folding))
    with pytest.raises(ValueError):
        pieces.Vocabulary(str(path))


def test_query_equals_library(spark):
    library = sentencepiece.SentencePieceProcessor(model_file=pieces.default_vocabulary())
    docs = spark.read.parquet(f"{SF}/documents.parquet").collect()
    got = {r["doc_id"]: tuple(r)[1:] for r in pieces.op13_sentencepiece_agenda(spark, SF).select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256").collect()}
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    want = {}
    for d in docs:
        ids = library.encode(d["text"] or "")
        want[d["doc_id"]] = (len(ids), sha(",".join(map(str, ids))), sha(library.decode(ids)))
    assert got == want


def test_odd_rows(spark):
    path = pieces.default_vocabulary()
    docs = spark.createDataFrame([(1, None, 5), (2, "", 5), (None, "a b", 5), (None, "a b", 5)], "doc_id long, text string, ids int")
    got = pieces.decoded(pieces.encoded(docs, path), path).collect()
    assert sorted((str(r["doc_id"]), len(r["ids"]), r["text"]) for r in got) == [("1", 0, ""), ("2", 0, ""), ("None", 2, "a b"), ("None", 2, "a b")]
    assert pieces.encoded(docs.limit(0), path).count() == 0
    none = spark.createDataFrame([(7, None), (8, [])], "doc_id long, ids array<int>")
    assert {r["doc_id"]: r["text"] for r in pieces.decoded(none, path).collect()} == {7: None, 8: ""}
    checked = pieces.verified(spark.read.parquet(f"{SF}/documents.parquet"), path)
    assert checked.where("same_ids AND same_text").count() == checked.count() == 200
