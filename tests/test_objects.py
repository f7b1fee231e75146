"""The store of contents as a data source, and sinks of lines."""

import gzip
import hashlib
import os

import pytest
from pyspark.sql import functions as F

from corpusmill.sources import objects as O
from corpusmill.sources import sinks as S
from corpusmill.streaming import events as E


def sha(b):
    return hashlib.sha256(b).hexdigest()


@pytest.fixture
def store(spark, tmp_path):
    O.register(spark)
    return str(tmp_path / "store")


def write(spark, contents, store, mode="append"):
    spark.createDataFrame([(c,) for c in contents], "content binary").repartition(3).write.format("objects").mode(mode).save(store)


def test_write_list_replace(spark, store):
    contents = [b"", b"one", b"one", b"two" * 1000, None]
    write(spark, contents, store)
    rows = lambda: [(r.sha256, bytes(r.content)) for r in spark.read.format("objects").load(store).collect()]
    want = {sha(c): c for c in contents if c is not None}
    assert sorted(rows()) == sorted(want.items())
    write(spark, [b"three", b"one"], store)
    assert sorted(rows()) == sorted({**want, sha(b"three"): b"three"}.items())
    write(spark, [b"four"], store, "overwrite")
    assert rows() == [(sha(b"four"), b"four")]


def test_a_filter_reads_that_object_alone(spark, store):
    write(spark, [b"%d" % i for i in range(200)], store)
    one = spark.read.format("objects").load(store).where(F.col("sha256") == sha(b"7"))
    assert [bytes(r.content) for r in one.collect()] == [b"7"] and one.rdd.getNumPartitions() == 1


def test_corrupt_objects_are_refused(spark, store):
    write(spark, [b"good", b"bad"], store)
    path = f"{store}/{sha(b'bad')[:2]}/{sha(b'bad')}"
    with open(path, "wb") as f:
        f.write(b"other")
    rows = spark.read.format("objects").load(store)
    with pytest.raises(Exception, match="corrupt object"):
        rows.collect()
    assert [bytes(r.content) for r in rows.where(F.col("sha256") == sha(b"good")).collect()] == [b"good"]
    with pytest.raises(Exception, match="corrupt object"):
        write(spark, [b"bad"], store)


def test_an_aborted_write_shows_nothing(spark, store):
    write(spark, [b"before"], store)
    bad = spark.createDataFrame([(sha(b"x"), b"x"), (sha(b"x"), b"not x")], "sha256 string, content binary").repartition(2)
    with pytest.raises(Exception, match="has the digest"):
        bad.write.format("objects").mode("append").save(store)
    assert [bytes(r.content) for r in spark.read.format("objects").load(store).collect()] == [b"before"]
    assert not [f for _, _, names in os.walk(store) for f in names if f.startswith(".")]


def test_stream_goes_on_from_its_offset(spark, store, tmp_path):
    write(spark, [b"a", b"b"], store)
    stream = lambda: spark.readStream.format("objects").load(store).select("sha256", "size")
    checkpoint = str(tmp_path / "offsets")
    assert {r.sha256 for r in E.drained(stream(), "objects-1", checkpoint).collect()} == {sha(b"a"), sha(b"b")}
    write(spark, [b"c"], store)
    out = E.latest_state(stream().groupBy("sha256").agg(F.max("size").alias("size")), "objects-2")
    assert out.count() == 3
    assert spark.read.format("objects").load(f"{store}-none").count() == 0


def test_archive_and_csv(spark, tmp_path):
    rows = spark.createDataFrame([(2, 'say "hi", then'), (1, None), (3, "two\nlines"), (10, "plain")], "id long, text string")
    folder = str(tmp_path / "a.csv")
    told = S.publish_lines(rows.select("id", S.csv_line([F.col("id"), F.col("text")]).alias("line")), ["id"], S.csv_header(["id", "text"]), folder)
    files = sorted(os.path.join(d, f) for d, _, names in os.walk(folder) for f in names if f.endswith(".gz"))
    text = b"".join(gzip.open(f).read() for f in files).decode()
    assert text == '﻿id,text\r\n1,\r\n2,"say ""hi"", then"\r\n3,"two\nlines"\r\n10,plain\r\n'
    assert {r.part.split("/")[1]: (r.bytes, r.sha256) for r in told.collect()} == {os.path.basename(f): (os.path.getsize(f), sha(open(f, "rb").read())) for f in files}
    S.publish_lines(rows.limit(0).select("id", F.lit("").alias("line")), ["id"], "again", folder)
    assert [r.line for r in S.lines_of(spark, folder).collect()] == ["again"]
    assert os.listdir(tmp_path) == ["a.csv"]
