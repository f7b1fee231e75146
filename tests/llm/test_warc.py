import gzip
import hashlib

import duckdb
import pytest
from pyspark.sql import functions as F

from corpusmill.llm import warc as W
from corpusmill.llm.common import shared_path

SF = "/root/testdata/sf0.001"
PAGES = [
    (5, "http://a/1", "x" * 100), (3, "http://a/2", "x" * 100), (9, None, "x" * 100), (4, "http://b", "short"), (6, "http://c", "short"), (7, "http://d\r\n x/é", None), (8, "http://e", ""),
    (10, "http://f", "é\r\n\r\nWARC/1.0\r\n" * 20), (11, "http://g", "é" * 300_000), (3, "http://a/2", "x" * 100), (None, "http://h", "x" * 100), (None, "http://i", "y" * 200), (None, "http://j", "y" * 200),
]


def frame(spark, rows):
    return spark.createDataFrame([(*r, "z") for r in rows], "page_id long, url string, html string, digest string")


def test_round_trip(spark):
    folder = shared_path(spark, "warc-test")
    index = W.write_archives(frame(spark, PAGES), folder)
    out = W.read_records(index).collect()
    assert len(out) == len(PAGES)
    first = {"x" * 100: 3}
    want = []
    for i, u, h in PAGES:
        data = (h or "").encode()
        to = first.get(h) if first.get(h) != i else None
        want.append((i, u, len(data), hashlib.sha256(data).hexdigest(), "response" if to is None else "revisit", to, data if to is None else None))
    assert sorted(map(repr, want)) == sorted(repr((*r[:6], None if r.payload is None else bytes(r.payload))) for r in out)
    some = W.read_records(index.where("page_id IN (5, 10)"), payloads=False).collect()
    assert {r.page_id: r.record_type for r in some} == {5: "revisit", 10: "response"} and all(r.payload is None for r in some)
    for r in index.collect():  # each range is a gzip member of its own, and together they are the archive
        with open(r.archive.removeprefix("file:"), "rb") as f:
            whole = f.read()
        assert W.parse_record(gzip.decompress(whole[r.offset : r.offset + r.length]))[0]["WARC-Payload-Digest"] == f"sha256:{r.digest}"


def test_empty(spark):
    assert W.read_records(W.write_archives(frame(spark, []), shared_path(spark, "warc-test"))).count() == 0


def test_ranges():
    ranges = [("a", *r) for r in sorted([(100, 10), (0, 50), (50, 50), (500, 5), (111, 4), (500, 5)])]
    reads = lambda *more: [(a, b, own) for _, a, b, own in W.coalesce_ranges(ranges, *more)]
    assert reads(0) == [(0, 110, [0, 1, 2]), (111, 115, [3]), (500, 505, [4, 5])]
    assert reads(1000) == [(0, 505, [0, 1, 2, 3, 4, 5])]
    assert [r[:2] for r in reads(1000, 100)] == [(0, 100), (100, 115), (500, 505)]
    assert [r[0] for r in W.coalesce_ranges([("a", 0, 5), ("b", 0, 5), ("b", 5, 5)])] == ["a", "b"] and not list(W.coalesce_ranges([]))


def test_scattered_selections_are_read_together(spark, monkeypatch):
    """A selection in any order, over many batches, takes few reads: the index is sorted before it is followed."""
    pages = spark.range(3000).selectExpr("id AS page_id", "concat('http://', id) AS url", "repeat(cast(id AS string), 50) AS html")
    index = W.write_archives(pages, shared_path(spark, "warc-test"))
    mixed = index.orderBy(F.xxhash64("page_id")).where("page_id % 3 = 0")
    got = W.read_records(mixed).collect()
    assert {(r.page_id, bytes(r.payload)) for r in got} == {(i, str(i).encode() * 50) for i in range(0, 3000, 3)} and len(got) == 1000
    rows = sorted((r.archive, r.offset, r.length) for r in mixed.collect())
    assert len(list(W.coalesce_ranges(rows))) == len({a for a, *_ in rows})


def test_damage_is_found():
    data = W.record(1, "u", b"payload", hashlib.sha256(b"payload").hexdigest(), None)
    assert W.parse_record(data)[1] == b"payload"
    for bad in (data[:-1], data[1:], b"", data.replace(b"msgtype=response\r\nContent-Length: ", b"msgtype=response\r\nContent-Length: 1")):
        with pytest.raises(ValueError):
            W.parse_record(bad)


def test_query_matches_sql(spark):
    db = duckdb.connect()
    db.execute(f"CREATE VIEW pages AS SELECT * FROM '{SF}/pages.parquet'")
    want = db.execute(W.ORACLE["op6_warc_index_first"]).fetchall()
    cols = [d[0] for d in db.description]
    got = W.op6_warc_index_first(spark, SF).select(cols).collect()
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, want))
