"""Leases of a work queue as a stateful stream: timers release what a lost worker holds.

Commands (item, at, n, kind) come as a stream with a watermark. An item's commands wait in its state until the watermark
has passed their slot of time, and are then applied in the order of their times; a lease that nothing renews is released
by a timer. So the result depends on what has come up to the watermark, not on how it was cut into micro-batches, and a
restart goes on from the stored state. A slot is a part of the lease. Items with neighbouring ids are kept as a group; what
a worker holds at a time is a bounded number of a group's commands or, where it has more, those of one slot.

Commands: claim, heartbeat, complete, fail and cancel; others, and null ones, change nothing. Rows without an item or a
time are left out; repeated rows count once, if time and number are the same. A row that comes after its time's slot
has been settled is late and left out.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager
from itertools import islice
from typing import NamedTuple

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from corpusmill.sources.tables import importable

#: A failed item is tried so many times.
MAX_ATTEMPTS = 3
#: Slots of a lease.
SLOTS = 8
#: What an item that failed or was let go waits: 1, 2, 4, ... seconds, a minute at most.
LONGEST_WAIT = 60
#: Ids of a group of items: those that are equal but for so many last bits.
GROUP_BITS = 6
#: Commands of a group that wait in one value; those of a group with more wait by slots.
WAITING = 4096

COMMANDS = "commands array<struct<at: long, n: long, kind: string, item: long>>"
STATE_STORE = "spark.sql.streaming.stateStore.providerClass"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class Item(NamedTuple):
    """until: the lease's end, or from when a queued item can be claimed; milliseconds. changes: transitions so far."""

    status: str = "queued"
    attempts: int = 0
    until: int = 0
    cancel: bool = False
    changes: int = 0

    def to(self, status: str, attempts: int, until: int, cancel: bool = False) -> Item:
        return Item(status, attempts, until, cancel, self.changes + 1)


def wait(attempts: int) -> int:
    return 1000 * min(LONGEST_WAIT, 2 ** max(0, attempts - 1))


def expired(s: Item, at: int) -> Item:
    """s as it is at a time: a lease that has run out makes the item claimable again, or cancelled if that was asked for."""
    if s.status != "leased" or at < s.until:
        return s
    return s.to("cancelled", s.attempts, s.until) if s.cancel else s.to("queued", s.attempts, s.until + wait(s.attempts))


def step(s: Item, kind: str | None, at: int, lease: int) -> Item:
    """One command. A cancel that comes before a worker's completion wins; a final status stays."""
    s = expired(s, at)
    if s.status == "queued":
        if kind == "claim" and at >= s.until:
            return s.to("leased", s.attempts + 1, at + lease)
        return s.to("cancelled", s.attempts, s.until) if kind == "cancel" else s
    if s.status != "leased":
        return s
    if kind == "heartbeat":
        return s.to("leased", s.attempts, at + lease, s.cancel)
    if kind == "cancel" and not s.cancel:
        return s.to("leased", s.attempts, s.until, True)
    if kind in ("complete", "fail") and s.cancel:
        return s.to("cancelled", s.attempts, s.until)
    if kind == "complete":
        return s.to("done", s.attempts, s.until)
    if kind == "fail":
        return s.to("queued", s.attempts, at + wait(s.attempts)) if s.attempts < MAX_ATTEMPTS else s.to("failed", s.attempts, s.until)
    return s


class Leases(StatefulProcessor):
    """A group of items with neighbouring ids. Their states and first waiting commands are one value, so that a group costs
    a few calls of the store for all that a micro-batch brings it, and it has one timer: for the first slot that has
    commands or in which a lease ends. A group with more than WAITING commands keeps them by slots, with a timer for each,
    so that a worker never holds more of them than one slot's."""

    def __init__(self, lease: int):
        self.lease, self.slot = lease, max(1, lease // SLOTS)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.group = handle.getValueState("group", f"items array<struct<item: long, status: string, attempts: long, until: long, cancel: boolean, changes: long>>, large boolean, {COMMANDS}")
        self.pending = handle.getMapState("pending", "slot long", COMMANDS)

    def end(self, slot: int) -> int:
        """The last millisecond of a slot."""
        return (slot + 1) * self.slot - 1

    def load(self) -> tuple[dict[int, Item], bool, list[tuple]]:
        """The items that have changed so far, whether commands lie by slots, and else the commands."""
        stored = self.group.get()
        return ({i[0]: Item(*i[1:]) for i in stored[0]}, stored[1], [tuple(c) for c in stored[2]]) if stored else ({}, False, [])

    def store(self, items: dict[int, Item], large: bool, waiting: list[tuple]) -> None:
        self.group.update(([(i, *s) for i, s in items.items()], large, waiting))

    def file(self, new: list[tuple]) -> None:
        """Put commands into the map by slots."""
        by_slot = {}
        for c in new:
            by_slot.setdefault(c[0] // self.slot, []).append(c)
        for slot, part in by_slot.items():
            if self.pending.containsKey((slot,)):
                part = [tuple(c) for c in self.pending.getValue((slot,))[0]] + part
            else:
                self.handle.registerTimer(self.end(slot))
            self.pending.updateValue((slot,), (part,))

    def handleInputRows(self, key: tuple, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        items, large, waiting = self.load()
        before, filed = min(waiting)[0] // self.slot if waiting else None, large
        commands = ((r.ms, r.n, r.kind, r.item) for r in rows)
        while new := list(islice(commands, WAITING)):
            if large or len(waiting) + len(new) > WAITING:
                self.file(waiting + new)
                large, waiting = True, []
            else:
                waiting += new
        if not filed:
            self.store(items, large, waiting)
        first = min(waiting)[0] // self.slot if waiting else None
        if first is not None and (before is None or first < before):
            self.handle.registerTimer(self.end(first))
        return iter(())

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[Row]:
        passed = (timerValues.getCurrentWatermarkInMs() + 1) // self.slot - 1  # the last slot that is over
        slot = expiredTimerInfo.getExpiryTimeInMs() // self.slot
        before, large, waiting = self.load()
        items, due, left = dict(before), [c for c in waiting if c[0] // self.slot <= passed], [c for c in waiting if c[0] // self.slot > passed]
        if large and self.pending.containsKey((slot,)):
            due = [tuple(c) for c in self.pending.getValue((slot,))[0]]
            self.pending.removeKey((slot,))
        for (at, _, item), kind in sorted({(at, n, item): kind for at, n, kind, item in due}.items()):
            items[item] = step(items.get(item, Item()), kind, at, self.lease)
        ends = {i: s.until // self.slot for i, s in items.items() if s.status == "leased"}
        over = {i: e for i, e in ends.items() if e <= passed}
        further = [k for k in range(slot + 1, max(over.values(), default=slot) + 1) if self.pending.containsKey((k,))] if large else []
        for item, e in over.items():
            if not any(k <= e for k in further):  # no command of the time in between is waiting
                items[item] = expired(items[item], items[item].until)
        following = [e for e in ends.values() if e > passed] + [c[0] // self.slot for c in left]
        if following:
            self.handle.registerTimer(self.end(min(following)))
        items = {i: s for i, s in items.items() if s.changes}
        if due or items != before:
            self.store(items, large, left)
        for item, s in items.items():
            if s != before.get(item):
                yield Row(item=item, status=s.status, attempts=s.attempts, changes=s.changes)

    def close(self) -> None:
        pass


def leases(commands: DataFrame, lease_ms: int, delay: str) -> DataFrame:
    """commands (item long, at timestamp, n long, kind string), a stream -> item, status, attempts, changes whenever an
    item changes; the row with most changes holds. Run it under `stored`."""
    importable(commands.sparkSession)
    rows = commands.where("item IS NOT NULL AND at IS NOT NULL").withWatermark("at", delay)
    rows = rows.select(F.shiftright("item", GROUP_BITS).alias("group"), "item", "at", F.unix_millis("at").alias("ms"), F.coalesce("n", F.lit(0)).cast("long").alias("n"), F.coalesce("kind", F.lit("")).alias("kind"))
    return rows.groupBy("group").transformWithState(Leases(lease_ms), "item long, status string, attempts long, changes long", "Update", "EventTime")


@contextmanager
def stored(spark: SparkSession) -> Iterator[None]:
    """Streams that start in here keep their state in RocksDB, so that it may exceed memory."""
    before = spark.conf.get(STATE_STORE, None)
    spark.conf.set(STATE_STORE, ROCKSDB)
    try:
        yield
    finally:
        spark.conf.unset(STATE_STORE) if before is None else spark.conf.set(STATE_STORE, before)
