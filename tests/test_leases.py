"""Leases with timers: any split into micro-batches and a restart give what one pass in order gives."""

import random
from datetime import datetime, timedelta, timezone

from corpusmill.streaming import events as E
from corpusmill.streaming import leases as L

START = datetime(2024, 5, 1, tzinfo=timezone.utc)
SCHEMA = "item long, at timestamp, n long, kind string"
LEASE = 60_000


def ms(at):
    return int(at.timestamp() * 1000)


def commands(seed=3, n=500):
    rng = random.Random(seed)
    kinds = ["claim"] * 4 + ["heartbeat", "heartbeat", "complete", "fail", "fail", "cancel", None]
    rows = [(rng.randrange(60), START + timedelta(milliseconds=rng.randrange(500_000)), k, rng.choice(kinds)) for k in range(n)]
    return sorted(rows, key=lambda r: r[1])


def in_order(rows, delay_ms=0):
    """Every item's commands in order, up to the last slot that the watermark has passed; then what has run out goes."""
    slot = LEASE // L.SLOTS
    edge = (ms(max(r[1] for r in rows)) - delay_ms + 1) // slot * slot - 1
    states = {}
    for item, at, _, kind in sorted(rows, key=lambda r: (ms(r[1]), r[2])):
        if item is not None and ms(at) <= edge:
            states[item] = L.step(states.get(item, L.Item()), kind, ms(at), LEASE)
    states = {i: L.expired(s, edge) for i, s in states.items()}
    return {i: (s.status, s.attempts) for i, s in states.items() if s.changes}


def run(spark, folder, checkpoint, files=1, delay="0 seconds"):
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", files).option("latestFirst", False).parquet(str(folder))
    with L.stored(spark):
        return E.latest_state(L.leases(stream, LEASE, delay), "leases-test", ("item",), "changes", checkpoint)


def states(df):
    rows = df.collect()
    assert len({r.item for r in rows}) == len(rows)
    return {r.item: (r.status, r.attempts) for r in rows}


def put(spark, rows, folder, name):
    import os

    spark.createDataFrame(rows, SCHEMA).coalesce(1).write.parquet(f"{folder}/.{name}")
    part = next(f for f in os.listdir(f"{folder}/.{name}") if f.startswith("part-"))
    os.rename(f"{folder}/.{name}/{part}", f"{folder}/{name}.parquet")
    stamp = 1_700_000_000 + int(name)  # files come in the order of their times
    os.utime(f"{folder}/{name}.parquet", (stamp, stamp))


def test_steps():
    s = L.step(L.Item(), "claim", 10_000, LEASE)
    assert s[:3] == ("leased", 1, 70_000)
    assert L.step(s, "claim", 20_000, LEASE) == s
    assert L.step(s, "complete", 30_000, LEASE).status == "done"
    failed = L.step(s, "fail", 30_000, LEASE)
    assert failed[:3] == ("queued", 1, 31_000) and L.step(failed, "claim", 30_500, LEASE) == failed
    assert L.expired(s, 69_999) == s and L.expired(s, 70_000)[:3] == ("queued", 1, 71_000)
    again = L.step(s, "claim", 100_000, LEASE)  # the lease has run out
    assert again[:3] == ("leased", 2, 160_000)
    third = L.step(again, "claim", 1_000_000, LEASE)
    assert L.step(third, "fail", 1_001_000, LEASE).status == "failed"
    cancelled = L.step(s, "cancel", 20_000, LEASE)
    assert cancelled.status == "leased" and L.step(cancelled, "complete", 30_000, LEASE).status == "cancelled"
    assert L.expired(cancelled, 70_000).status == "cancelled" and L.step(L.Item(), "cancel", 1, LEASE).status == "cancelled"


def test_any_split_gives_the_same(spark, tmp_path):
    rows = commands()
    want = in_order(rows)
    assert {s for s, _ in want.values()} >= {"queued", "leased", "done", "cancelled"}
    for split in (1, 4):
        folder = tmp_path / f"in{split}"
        folder.mkdir()
        for k in range(split):
            put(spark, rows[k * len(rows) // split : (k + 1) * len(rows) // split], folder, str(k))
        assert states(run(spark, folder, str(tmp_path / f"offsets{split}"))) == want


def test_a_restart_goes_on(spark, tmp_path):
    """The worker of item 1 dies: nothing comes for it any more, and yet a later run over other items' commands lets it go."""
    rows = [(1, START, 1, "claim"), (2, START, 2, "claim"), (2, START + timedelta(seconds=10), 3, "complete"), (None, START, 4, "claim"), (3, START + timedelta(seconds=20), 5, None)]
    later = [(4, START + timedelta(seconds=100), 6, "claim"), (4, START + timedelta(seconds=130), 7, "heartbeat"), (5, START + timedelta(seconds=150), 8, "claim")]
    folder = tmp_path / "in"
    folder.mkdir()
    put(spark, rows, folder, "0")
    first = states(run(spark, folder, str(tmp_path / "offsets")))
    assert first == in_order(rows) == {1: ("leased", 1), 2: ("done", 1)}
    put(spark, later, folder, "1")
    then = states(run(spark, folder, str(tmp_path / "offsets")))
    assert first | then == in_order(rows + later) == {1: ("queued", 1), 2: ("done", 1), 4: ("leased", 1)}


def test_late_and_repeated_commands(spark, tmp_path):
    rows = commands(8, 120)
    folder = tmp_path / "in"
    folder.mkdir()
    put(spark, rows + rows[:50], folder, "0")
    further = [(77, rows[-1][1] + timedelta(seconds=1), 1, "heartbeat")]
    put(spark, further, folder, "1")
    put(spark, [(r[0], START, 9999, "cancel") for r in rows[:20]], folder, "2")  # their slot was settled a batch ago
    assert states(run(spark, folder, str(tmp_path / "offsets"), delay="30 seconds")) == in_order(rows + further, 30_000)


def test_a_group_costs_few_calls_of_the_store(spark):
    """Forty items with five hundred commands: one value is read and written for all of them, and one timer is set."""
    from pyspark.sql import Row

    calls = []

    class Value:
        held = None

        def get(self):
            calls.append("get")
            return self.held

        def update(self, held):
            calls.append("update")
            self.held = held

    class Slots(dict):
        def containsKey(self, key):
            calls.append("contains")
            return key in self

        def getValue(self, key):
            return self[key]

        def updateValue(self, key, value):
            self[key] = value

        def removeKey(self, key):
            del self[key]

    class Handle:
        def __init__(self):
            self.timers = set()

        def getValueState(self, *_):
            return Value()

        def getMapState(self, *_):
            return Slots()

        def registerTimer(self, at):
            calls.append("timer")
            self.timers.add(at)

    class Times:
        def getCurrentWatermarkInMs(self):
            return ms(START) + 600_000

    class Expired:
        def __init__(self, at):
            self.at = at

        def getExpiryTimeInMs(self):
            return self.at

    def drive(rows, split):
        leases = L.Leases(LEASE)
        handle = Handle()
        leases.init(handle)
        calls.clear()
        for part in split(rows):
            list(leases.handleInputRows((0,), iter([Row(item=i, at=a, ms=ms(a), n=n, kind=k or "") for i, a, n, k in part]), Times()))
        last = {}
        for at in sorted(handle.timers):
            if at <= Times().getCurrentWatermarkInMs():
                last |= {r.item: (r.status, r.attempts) for r in leases.handleExpiredTimer((0,), Times(), Expired(at))}
        return last, len(calls)

    rows = commands()
    want = {}
    for item, at, _, kind in sorted(rows, key=lambda r: (r[1], r[2])):
        want[item] = L.step(want.get(item, L.Item()), kind, ms(at), LEASE)
    edge = (ms(START) + 600_001) // (LEASE // L.SLOTS) * (LEASE // L.SLOTS) - 1
    want = {i: (s.status, s.attempts) for i, s in ((i, L.expired(s, edge)) for i, s in want.items()) if s.changes}
    told, cost = drive(rows, lambda r: [r])
    assert told == want and cost <= 8
    assert drive(rows, lambda r: [r[:200], r[200:]])[0] == want
    before, L.WAITING = L.WAITING, 50  # more than may wait in one value
    try:
        assert drive(rows, lambda r: [r])[0] == want
        assert drive(rows, lambda r: [r[:30], r[30:60], r[60:]])[0] == want
    finally:
        L.WAITING = before
