"""Spelling variants against brute force."""

import random
import re
import zlib
from collections import Counter

import numpy as np

from corpusmill.llm import spelling

SF = "/root/testdata/sf0.001"


def near_of(words):
    """All near words of each word, by trying every change over the words' own letters."""
    letters = set("".join(words))
    out = {}
    for w in words:
        tried = {w[:i] + w[i + 1 :] for i in range(len(w))}
        tried |= {w[:i] + a + w[i + 1 :] for i in range(len(w)) for a in letters}
        tried |= {w[:i] + a + w[i:] for i in range(len(w) + 1) for a in letters}
        out[w] = (tried & words.keys()) - {w}
    return out


def brute(counts, times=2):
    near, form = near_of(counts), {}
    for w, n in counts.items():
        best = min(near[w], key=lambda x: (-counts[x], x), default=None)
        form[w] = best if best is not None and counts[best] >= times * n else None
    out = {}
    for w, n in counts.items():
        root = w
        while form[root] is not None:
            root = form[root]
        out[w] = (n, form[w], counts.get(form[w]), root, len(near[w]))
    return out


def as_dict(df):
    rows = df.collect()
    found = {r["word"]: (r["n"], r["form"], r["form_n"], r["root"], r["n_near"]) for r in rows}
    assert len(found) == len(rows)
    return found


def test_query_equals_brute_force(spark):
    counts = Counter()
    for r in spark.read.parquet(f"{SF}/documents.parquet").collect():
        for w in re.findall("[A-Za-zÀ-ÿ]+", r["text"] or ""):
            w = re.sub("[A-Z]", lambda m: chr(ord(m[0]) + 32), w)
            h = zlib.crc32(f"{r['doc_id']}:{w}".encode())
            k = h % len(w)
            counts[w[:k] + w[k + 1 :] if h % 97 == 0 else w] += 1
    counts = {w: n for w, n in counts.items() if len(w) >= 5 and n >= 3}
    want = brute(counts)
    assert as_dict(spelling.op12_spelling_variants(spark, SF)) == want
    assert any(v[1] for v in want.values())


def test_dense_words_equal_brute_force(spark):
    rng = random.Random(2)
    counts = {"".join(rng.choices("abé", k=rng.randint(1, 6))): rng.randint(1, 40) for _ in range(700)}
    words = spark.createDataFrame(list(counts.items()), "word string, n long")
    assert as_dict(spelling.variants(words)) == brute(counts)


def test_runs_of_equal_letters_ties_and_chains(spark):
    counts = {"aaaaa": 1, "aaaa": 2, "aaaab": 2, "aaabb": 4, "aabbb": 8, "abbbb": 16, "bbbbb": 32, "abbab": 64, "zzzzz": 1}
    got = as_dict(spelling.variants(spark.createDataFrame(list(counts.items()), "word string, n long")))
    assert got == brute(counts)
    assert got["aaaaa"][1] == "aaaab" or got["aaaaa"][1] == "aaaa"
    assert got["aaaab"][3] == "abbab" and got["zzzzz"] == (1, None, None, "zzzzz", 0)


def test_keys_stand_for_strings():
    rng = random.Random(1)
    words = ["".join(rng.choices("abßÿ", k=rng.randint(1, 7))) for _ in range(300)]
    owner, place, key = spelling.deletion_keys(words)
    strings = [words[o] if p < 0 else words[o][:p] + words[o][p + 1 :] for o, p in zip(owner, place, strict=True)]
    by_key = {}
    for k, s in zip(key.tolist(), strings, strict=True):
        by_key.setdefault(k, set()).add(s)
    assert all(len(s) == 1 for s in by_key.values()) and len(by_key) == len(set(strings))
    for w in set(words):  # every string that a deletion leaves has one row
        mine = sorted(s for o, p, s in zip(owner, place, strings, strict=True) if o == words.index(w) and p >= 0)
        assert mine == sorted({w[:i] + w[i + 1 :] for i in range(len(w))})


def test_shared_keys_of_different_strings_are_told_apart():
    rows = [(0, "xabcd", 5), (0, "yabcd", 3), (4, "qrstu", 9), (-1, "abcd", 1)]
    assert sorted(spelling.group_facts(rows)) == [("abcd", 2, 5, "xabcd"), ("xabcd", 1, 1, "abcd"), ("xabcd", 1, 3, "yabcd"), ("yabcd", 1, 1, "abcd"), ("yabcd", 1, 5, "xabcd")]


def test_odd_rows(spark):
    docs = spark.createDataFrame([(1, None, "x"), (None, "Wörter wörter WÖRTER", "y"), (None, "Wörter wörter WÖRTER", "y"), (3, "", "z"), (4, "q" * 100_000, "z")], "doc_id long, text string, word string")
    assert {r["word"]: r["n"] for r in spelling.word_counts(docs).collect()} == {"wörter": 4}
    assert {r["word"] for r in spelling.word_counts(docs, least_count=1).collect()} == {"wörter", "wÖrter", "q" * 100_000}
    assert spelling.variants(spelling.word_counts(docs.limit(0))).count() == 0
    assert as_dict(spelling.variants(spelling.word_counts(docs, least_count=1)))["wÖrter"] == (2, "wörter", 4, "wörter", 1)


def test_batches_share_a_key(spark, monkeypatch):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "3")
    monkeypatch.setattr(spelling, "tune", lambda s: None)
    counts = {f"stem{c}": i + 1 for i, c in enumerate("abcdefghijklmnop")}
    got = as_dict(spelling.variants(spark.createDataFrame(list(counts.items()), "word string, n long")))
    assert got == brute(counts)
    assert np.unique([v[4] for v in got.values()]).tolist() == [15]
