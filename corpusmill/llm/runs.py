"""Periodic runs of words: stretches that repeat a block of q words three times or more, found exactly.

Names by powers of two, after Karp, Miller and Rosenberg: the name of level k at a place stands for the 2^k words from
there on, and pairs of names of one level are named to give the next. A name that occurs once in its document can match
nothing, so its place takes a name of its own and leaves the naming. Two places have as many words in common as a descent
through the levels finds, forwards or backwards.

Candidates lie on grids: a run with period q holds a place that is a multiple of q and agrees with the place q words on
for at least q + 1 words, so for each q the names of one level are compared at the multiples of q alone: n/q comparisons,
n log n in all. Those that agree are extended both ways by the levels. There are no hashes and no sorted suffixes. All
documents of a batch lie one after another, each with its own names, so nothing reaches into the next one.

Defined results: a null or empty text has no words and no runs; repeated rows and null ids keep their rows; runs may
overlap; of periods that are multiples of one another the smallest is given; an empty table gives no rows. Texts of any
length are taken whole. Columns other than id and text are not read.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusmill.llm.common import read, texts_of, tune

#: A run has so many words at least, and its period so many times.
LEAST, TIMES = 24, 3
#: Words that are named together; a longer document is named alone.
TOGETHER = 1 << 17

#: doc_id and words of a document -> the words in which runs are looked for.
Planting = Callable[[int | None, list[bytes]], list[bytes]]


def named_levels(names: np.ndarray, longest: int) -> list[np.ndarray]:
    """Names of level 0, 1, ... up to the last whose stretches are no longer than longest words. Equal names, equal words;
    negative names occur once."""
    n = len(names)
    own = -1 - np.arange(n, dtype=np.int32)

    def ranked(keys: np.ndarray, at: np.ndarray) -> np.ndarray:
        """A name for each place: numbers for keys that recur, negative ones for the rest."""
        out = own.copy()
        order = np.argsort(keys, kind="stable")
        keys, at = keys[order], at[order]
        new = np.ones(len(keys), bool)
        new[1:] = keys[1:] != keys[:-1]
        number = np.cumsum(new)
        again = np.zeros(len(keys), bool)
        again[1:] = ~new[1:]
        again[:-1] |= ~new[1:]
        out[at[again]] = number[again]
        return out

    levels = [ranked(names, np.arange(n))]
    size = 1
    while 2 * size <= longest:
        name = levels[-1]
        at = np.flatnonzero((name[: n - size] >= 0) & (name[size:] >= 0))
        levels.append(ranked(name[at].astype(np.int64) * (n + 1) + name[at + size], at))
        size *= 2
    return levels


def common(levels: list[np.ndarray], i: np.ndarray, j: np.ndarray, backwards: bool = False) -> np.ndarray:
    """Words that places i and j have in common from there on (backwards: before them), by descending levels."""
    n = len(levels[0])
    out = np.zeros(len(i), np.int64)
    for k in range(len(levels) - 1, -1, -1):
        a, b = (i - out - (1 << k), j - out - (1 << k)) if backwards else (i + out, j + out)
        inside = (a >= 0) & (b >= 0) & (a < n) & (b < n)
        same = np.zeros(len(i), bool)
        same[inside] = levels[k][a[inside]] == levels[k][b[inside]]
        out += same.astype(np.int64) << k
    return out


def runs_of(names: np.ndarray, longest: int, least: int = LEAST, times: int = TIMES) -> np.ndarray:
    """Rows (start, length, period) of all runs, by start and period. names: a number for each word, of which equal ones
    stand for equal words; no run is longer than `longest` words."""
    if longest < max(least, times):
        return np.zeros((0, 3), np.int64)
    levels = named_levels(names, longest)
    found_i, found_q = [], []
    for q in range(1, longest // times + 1):
        agree = max(least - 2 * q + 1, (times - 2) * q + 1)
        name = levels[agree.bit_length() - 1]
        grid = name[::q]
        at = np.flatnonzero((grid[1:] == grid[:-1]) & (grid[1:] >= 0))
        if len(at):
            found_i.append(at * q)
            found_q.append(np.full(len(at), q))
    if not found_i:
        return np.zeros((0, 3), np.int64)
    i, q = np.concatenate(found_i), np.concatenate(found_q)
    start = i - common(levels, i, i + q, backwards=True)
    length = i + q + common(levels, i, i + q) - start
    enough = length >= np.maximum(least, times * q)
    start, length, q = start[enough], length[enough], q[enough]
    order = np.lexsort((q, length, start))
    start, length, q = start[order], length[order], q[order]
    first = np.ones(len(start), bool)  # of one stretch the smallest period
    first[1:] = (start[1:] != start[:-1]) | (length[1:] != length[:-1])
    out = np.stack([start, length, q], axis=1)[first]
    return out[np.lexsort((out[:, 2], out[:, 0]))]


def runs_of_many(documents: list[list[bytes]], least: int = LEAST, times: int = TIMES) -> list[np.ndarray]:
    """runs_of each document's words, all of them at once. least and times must be 2 or more."""
    numbers: dict[bytes, int] = {}
    sizes = np.fromiter(map(len, documents), np.int64, len(documents))
    flat = np.fromiter((numbers.setdefault(w, len(numbers)) for d in documents for w in d), np.int64, int(sizes.sum()))
    ends = np.cumsum(sizes)
    names = flat + np.repeat(np.arange(len(documents)), sizes) * max(1, len(numbers))
    found = runs_of(names, int(sizes.max(initial=0)), least, times)
    owner = np.searchsorted(ends, found[:, 0], side="right")
    cuts = np.searchsorted(owner, np.arange(len(documents) + 1))
    return [found[a:b] - [begin, 0, 0] for a, b, begin in zip(cuts[:-1], cuts[1:], ends - sizes, strict=True)]


def collapsed(words: list[bytes], runs: np.ndarray) -> list[bytes]:
    """words without those that a run has after its first period."""
    if not len(runs):
        return words
    edges = np.zeros(len(words) + 1, np.int64)
    np.add.at(edges, runs[:, 0] + runs[:, 2], 1)
    np.add.at(edges, runs[:, 0] + runs[:, 1], -1)
    keep = np.cumsum(edges[:-1]) == 0
    return [words[i] for i in np.flatnonzero(keep)]


def periodic_runs(docs: DataFrame, least: int = LEAST, times: int = TIMES, planting: Planting | None = None) -> DataFrame:
    """doc_id, runs (array of start, length, period, by start and period) and collapsed, the text's words without the
    repetitions of its runs, joined by a blank. Words are what ASCII blanks leave."""
    if times < 3:
        raise ValueError("a run repeats its period three times or more")
    tune(docs.sparkSession)

    def groups(batches: Iterator[pa.RecordBatch]) -> Iterator[list[tuple[int | None, list[bytes]]]]:
        group, size = [], 0
        for b in batches:
            for i, t in zip(b.column("doc_id").to_pylist(), b.column("text").to_pylist(), strict=True):
                words = t.encode("utf-8", "surrogatepass").split()
                words = planting(i, words) if planting else words
                if group and size + len(words) > TOGETHER:
                    yield group
                    group, size = [], 0
                group.append((i, words))
                size += len(words)
        if group:
            yield group

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in groups(batches):
            found = runs_of_many([w for _, w in group], least, times)
            ends = np.cumsum([0, *map(len, found)]).astype(np.int32)
            flat = np.concatenate(found)
            parts = pa.StructArray.from_arrays([pa.array(flat[:, k].copy()) for k in range(3)], ["start", "length", "period"])
            texts = pa.array([b" ".join(collapsed(w, r)) for (_, w), r in zip(group, found, strict=True)], pa.binary()).cast(pa.string())
            yield pa.RecordBatch.from_arrays([pa.array([i for i, _ in group], pa.int64()), pa.ListArray.from_arrays(pa.array(ends), parts), texts], ["doc_id", "runs", "collapsed"])

    return texts_of(docs).mapInArrow(run, "doc_id long, runs array<struct<start: long, length: long, period: long>>, collapsed string")


def strongest(runs: Column) -> Column:
    """The run that repeats its period most often, by exact fractions; of equals the first, then the shortest period."""

    def order(a: Column, b: Column) -> Column:
        more = b["length"] * a["period"] - a["length"] * b["period"]
        return F.when(more != 0, F.signum(more)).when(a["start"] != b["start"], F.signum(a["start"] - b["start"])).otherwise(F.signum(a["period"] - b["period"])).cast("int")

    return F.try_element_at(F.array_sort(runs, order), F.lit(1))


def planted_run(doc_id: int | None, words: list[bytes]) -> list[bytes]:
    """In every tenth document, by the checksum of its id, the words from some place on repeat a block of their own. A
    null id plants nothing."""
    h = zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    n, g = len(words), h // 10
    if h % 10 or not n:
        return words
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return words[:a] + (words[a : a + p] * -(-(n - a) // p))[: n - a]


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = periodic_runs(read(spark, sf_dir, "documents"), planting=planted_run).withColumn("best", strongest(F.col("runs")))
    lines = F.transform("runs", lambda r: F.concat(r["start"], F.lit(","), r["length"], F.lit(","), r["period"], F.lit("\n")))
    return out.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), "best.start", "best.length", "best.period",
        F.expr("1000 * best.length DIV best.period").alias("exponent_milli"),
        F.sha2(F.array_join(lines, ""), 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )
