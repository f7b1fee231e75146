"""A backfill that goes on after it was killed, and a stream's late rows and outer joins."""

import hashlib
import os
import time
from datetime import datetime, timedelta, timezone

import pytest
from pyspark.sql import functions as F

from corpusmill.sources import backfill as B
from corpusmill.streaming import events as E

START = datetime(2024, 5, 1, tzinfo=timezone.utc)


def test_killed_half_way(spark, tmp_path):
    source, store = tmp_path / "in", str(tmp_path / "store")
    (source / "sub").mkdir(parents=True)
    for i in range(40):
        (source / ("sub" if i % 2 else ".") / f"f{i}.bin").write_bytes(b"%d" % i * i)  # the first one is empty, and so not listed

    def die(part):
        if part == 2:
            raise RuntimeError("killed")

    with pytest.raises(RuntimeError, match="killed"):
        B.backfill(spark, str(source), store, 6, die)
    done = B.hashes(spark, store).count()
    assert 0 < done < 39
    again = B.backfill(spark, str(source), store, 6)
    assert (again.known, again.hashed, again.changed, again.missing) == (done, 39 - done, 0, 0)
    got = {r.path.split("/")[-1]: r.sha256 for r in B.hashes(spark, store).collect()}
    assert got == {f"f{i}.bin": hashlib.sha256(b"%d" % i * i).hexdigest() for i in range(1, 40)}
    assert B.backfill(spark, str(source), store).hashed == 0


def test_a_file_that_changes_meanwhile(spark, tmp_path):
    source, store = tmp_path / "in", str(tmp_path / "store")
    source.mkdir()
    for i in range(10):
        (source / f"f{i}").write_bytes(b"old")

    def change(part):
        if part == 0:
            for i in range(10):
                (source / f"f{i}").write_bytes(b"longer")
                os.utime(source / f"f{i}", (time.time() + 60, time.time() + 60))
            (source / "f9").unlink()

    first = B.backfill(spark, str(source), store, 2, change)
    assert first.changed + first.missing + first.hashed == 10 and first.changed >= 1
    second = B.backfill(spark, str(source), store, 2)
    assert second.hashed == 9
    assert {r.sha256 for r in B.hashes(spark, store).where("path NOT LIKE '%f9'").collect()} == {hashlib.sha256(b"longer").hexdigest()}


def put(spark, rows, schema, folder, k):
    spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{folder}/.{k}")
    part = next(f for f in os.listdir(f"{folder}/.{k}") if f.startswith("part-"))
    os.rename(f"{folder}/.{k}/{part}", f"{folder}/{k}.parquet")
    os.utime(f"{folder}/{k}.parquet", (1_700_000_000 + k, 1_700_000_000 + k))


def test_cancel_against_complete_over_micro_batches(spark, tmp_path):
    at = lambda h: START + timedelta(hours=h)
    completes = [[(1, 1, at(1)), (2, 2, at(2))], [(3, 1, at(50)), (4, 3, at(51))], [(5, 9, at(200))]]
    cancels = [[(1, at(0.5)), (2, at(2))], [(1, at(49)), (3, at(52))], [(9, at(201))]]
    (tmp_path / "a").mkdir()
    (tmp_path / "b").mkdir()
    for k in range(3):
        put(spark, completes[k], "event_id long, item long, at timestamp", tmp_path / "a", k)
        put(spark, cancels[k], "item long, at timestamp", tmp_path / "b", k)
    stream = lambda name, schema: spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / name))
    raced = E.cancel_race(stream("a", "event_id long, item long, at timestamp"), stream("b", "item long, at timestamp"), "1 hour", "2 days")
    got = {r.event_id: r.outcome for r in E.outcomes(E.drained(raced, "race-test")).collect()}
    assert {k: v for k, v in got.items() if k != 5} == {1: "cancelled", 2: "cancelled", 3: "cancelled", 4: "completed"}


def test_late_rows_go_aside(spark, tmp_path):
    at = lambda m: START + timedelta(minutes=m)
    (tmp_path / "in").mkdir()
    batches = [[(1, at(0)), (2, at(60)), (3, None)], [(4, at(49)), (5, at(51)), (6, at(100))], [(7, at(89)), (8, at(95))]]
    schema = "id long, at timestamp"
    stream = lambda: spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    told = None
    for k, rows in enumerate(batches):  # the second run goes on from the first
        put(spark, rows, schema, tmp_path / "in", k)
        if k:
            told = E.split_late(stream(), "at", 600, "late-test", str(tmp_path / "offsets"), str(tmp_path / "store"))
    assert [sorted(r.id for r in side.collect()) for side in told] == [[1, 2, 5, 6, 8], [3, 4, 7]]
    assert told[0].where(F.col("at").isNull()).count() == 0
