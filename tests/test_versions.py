"""Commits on versioned tables, and the posting index that is stored beside one."""

import os
import threading

import pytest
from pyspark.sql import functions as F

from corpusmill.operators.postings import PostingIndex
from corpusmill.sources import tables
from corpusmill.sources.versions import Conflict, Table, create_once


def frame(spark, rows):
    return spark.createDataFrame(rows, "k long, v string")


def content(df):
    return dict(map(tuple, df.collect()))


def files(folder):
    return {os.path.join(d, f): os.path.getmtime(os.path.join(d, f)) for d, _, names in os.walk(folder) for f in names if f.startswith("part-")}


def test_commits_rewrite_only_their_buckets(spark, tmp_path):
    folder = str(tmp_path / "t")
    table = Table.create(frame(spark, [(i, f"v{i}") for i in range(200)]), folder, ["k"], 16)
    before = files(folder)
    assert table.commit(frame(spark, [(7, "new"), (500, "more")]), frame(spark, [(9, None), (1234, None)])) == 1
    want = {i: f"v{i}" for i in range(200)} | {7: "new", 500: "more"}
    want.pop(9)
    assert content(table.read()) == want and content(table.read(0)) == {i: f"v{i}" for i in range(200)}
    entry, first = table.entry(1), table.entry(0)
    assert len(entry["changed"]) <= 4 and all(entry["files"][b] == p for b, p in first["files"].items() if int(b) not in entry["changed"])
    after = files(folder)
    assert all(after[f] == t for f, t in before.items()) and len(after) - len(before) <= 4
    assert content(table.lookup(spark.createDataFrame([(7,), (9,), (11,)], "k long"))) == {7: "new", 11: "v11"}
    assert table.commit(frame(spark, [])) == 2 and content(table.read()) == want


def test_two_writers(spark, tmp_path):
    """Both start from version 0. Where they meet in a bucket one is told so; where not, both are kept."""
    table = Table.create(frame(spark, [(i, "old") for i in range(100)]), str(tmp_path / "t"), ["k"], 8)
    assert table.commit(frame(spark, [(1, "first")]), base=0) == 1
    with pytest.raises(Conflict):
        table.commit(frame(spark, [(1, "second")]), base=0)
    assert content(table.read())[1] == "first" and table.latest() == 1
    mine = set(table.entry(1)["changed"])
    other = next(k for k in range(100) if not mine & set(b for (b,) in frame(spark, [(k, "")]).select(table.bucket(table.entry(0))).collect()))
    assert table.commit(frame(spark, [(other, "third")]), base=0) == 2
    rows = content(table.read())
    assert rows[1] == "first" and rows[other] == "third" and len(rows) == 100


def test_writers_at_once(spark, tmp_path):
    table = Table.create(frame(spark, [(i, "old") for i in range(50)]), str(tmp_path / "t"), ["k"], 4)
    told = []

    def write(name):
        try:
            told.append((name, table.commit(frame(spark, [(i, name) for i in range(50)]), base=0)))
        except Conflict:
            told.append((name, None))

    threads = [threading.Thread(target=write, args=(f"w{n}",)) for n in range(3)]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    won = [name for name, version in told if version == 1]
    assert len(told) == 3 and len(won) == 1 and [v for _, v in told if v is None] == [None, None]
    assert content(table.read()) == dict.fromkeys(range(50), won[0])


def test_an_entry_is_made_once(spark, tmp_path):
    os.makedirs(tmp_path / "log")
    made = []
    threads = [threading.Thread(target=lambda n=n: made.append(create_once(spark, f"{tmp_path}/log/1", str(n)))) for n in range(8)]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    assert sorted(made) == [False] * 7 + [True] and os.listdir(tmp_path / "log") == ["1"]


def test_pages_see_no_later_commit(spark, tmp_path):
    table = Table.create(frame(spark, [(i, "a") for i in range(10)]), str(tmp_path / "t"), ["k"], 4)
    first = table.page(0, 4).collect()
    table.commit(frame(spark, [(5, "changed"), (100, "b")]), frame(spark, [(6, None)]))
    second = table.page(0, 4, F.col("k") > first[-1].k).collect()
    third = table.page(0, 4, F.col("k") > second[-1].k).collect()
    assert [tuple(r) for r in first + second + third] == [(i, "a") for i in range(10)]


def test_bad_keys_and_vacuum(spark, tmp_path):
    table = Table.create(frame(spark, [(1, "a"), (2, None)]), str(tmp_path / "t"), ["k"], 2)
    for rows in ([(3, "x"), (3, "y")], [(None, "x")]):
        with pytest.raises(ValueError):
            table.commit(frame(spark, rows))
    for n in range(4):
        table.commit(frame(spark, [(1, f"a{n}"), (2, f"b{n}")]))
    assert table.vacuum(2) > 0
    assert content(table.read()) == {1: "a3", 2: "b3"} and content(table.read(3)) == {1: "a2", 2: "b2"}
    empty = Table.create(frame(spark, []), str(tmp_path / "e"), ["k"], 2)
    assert empty.read().columns == ["k", "v"] and empty.commit(frame(spark, [(1, "a")])) == 1 and content(empty.read()) == {1: "a"}


def test_generations(spark, tmp_path):
    folder = str(tmp_path / "g")
    numbers = [tables.publish(spark.range(n), folder) for n in (1, 2, 3)]
    assert numbers == [0, 1, 2] and tables.current(spark, folder).count() == 3
    assert len([d for d in os.listdir(folder) if d.startswith("generation-")]) == 2


TEXTS = [(1, "the quick brown fox"), (2, "A QUICK red fox"), (3, None), (4, ""), (5, "über 42 straße 42"), (6, "fo"), (7, "x" * 5000 + "needle" + "y" * 5000)]
NEEDLES = ["quick", "FOX", "42", "fo", "x", "needle", "straße", "not there", "xy", "ck r"]


def scan(rows, needles=NEEDLES):
    return {(n.lower(), k) for n in needles for k, t in rows if t is not None and n.lower() in t.lower()}


def test_index_equals_scan_after_changes(spark, tmp_path):
    schema = "id long, text string"
    index = PostingIndex.create(spark.createDataFrame(TEXTS, schema), str(tmp_path / "i"), "id", buckets=4)
    found = lambda v=None: {tuple(r) for r in index.holding(NEEDLES, v).collect()}
    assert found() == scan(TEXTS)
    index.commit(spark.createDataFrame([(2, "no more"), (8, "quick needle")], schema), spark.createDataFrame([(5,), (99,)], "id long"))
    then = {k: t for k, t in TEXTS} | {2: "no more", 8: "quick needle"}
    del then[5]
    assert found() == scan(then.items()) and found(0) == scan(TEXTS)
    index.commit(spark.createDataFrame([(5, "back with 42"), (2, "quick again")], schema))
    then |= {5: "back with 42", 2: "quick again"}
    assert found() == scan(then.items())
    index.compact()
    assert found() == scan(then.items()) and len(index.table.entry()["extra"]["segments"]) == 1
    index.commit(spark.createDataFrame([], schema), spark.createDataFrame([(1,)], "id long"))
    del then[1]
    assert found() == scan(then.items())
    with pytest.raises(ValueError):
        index.holding([""])


def test_a_search_reads_postings_and_candidates_alone(spark, tmp_path):
    """Of many texts a rare needle reads the files of its grams' buckets, and of the texts those of the candidates' buckets."""
    rows = spark.range(3000).select(F.col("id"), F.concat(F.lit("common words "), F.md5(F.col("id").cast("string"))).alias("text"))
    index = PostingIndex.create(rows, str(tmp_path / "i"), "id", buckets=16)
    needle = rows.where("id = 1234").first()["text"][20:30]
    found = index.holding([needle])
    assert [tuple(r) for r in found.collect()] == [(needle, 1234)]
    read = {f.split("/_bucket=")[0].rsplit("/", 1)[0].rsplit("/", 1)[-1] for f in found.inputFiles()}
    buckets = [f for f in found.inputFiles()]
    postings, data = [f for f in buckets if "/postings/" in f], [f for f in buckets if "/data/" in f]
    assert read == {"postings", "data"} and len(postings) <= 8 and len(data) == 1
    plan = found._jdf.queryExecution().toString()
    assert "PushedFilters: [In(gram" in plan and "id" in plan and "EqualTo(id,1234)" in plan


def test_postings_are_lists_and_large_alphabets_count(spark, tmp_path):
    """A gram that many texts have is a row with their keys, not a row for each, in the first segment and after compaction;
    slices and the way for many letters give what the scan gives."""
    from corpusmill.operators import postings as P

    rows = spark.range(2000).select(F.col("id"), F.concat(F.lit("the same words again "), F.col("id") % 10).alias("text"))
    index = PostingIndex.create(rows, str(tmp_path / "i"), "id", buckets=4)
    index.commit(spark.createDataFrame([(3, "other")], "id long, text string"), spark.createDataFrame([(5,)], "id long"))
    index.compact()
    for folder in os.listdir(tmp_path / "i" / "postings"):
        assert spark.read.parquet(f"{tmp_path}/i/postings/{folder}").count() < 1000
    assert {r.key for r in index.holding(["same"]).collect()} == set(range(2000)) - {3, 5}
    texts = ["abcab", "ab", "日本語x", "\U0001f600a\U0001f600ab", "", "ab\0"]
    want = {(t[i : i + 3], k) for k, t in enumerate(texts) for i in range(len(t) - 2)}
    before = P.PLACES
    try:
        for P.PLACES in (1 << 26, 40, 1):
            grams, ends, places = P.postings_of(texts)
            starts = [0, *ends[:-1]]
            told = [(int(g), int(k)) for g, a, b in zip(grams, starts, ends, strict=True) for k in places[a:b]]
            assert len(told) == len(want) and set(told) == {(P.code(g), k) for g, k in want}
    finally:
        P.PLACES = before
    assert [len(x) for x in P.postings_of([])] == [len(x) for x in P.postings_of(["", "ab"])] == [0, 0, 0]
    assert list(P.slices([P.SLICE, 1, P.SLICE * 3, 5, 6])) == [(0, 1), (1, 2), (2, 3), (3, 5)] and list(P.slices([])) == []
