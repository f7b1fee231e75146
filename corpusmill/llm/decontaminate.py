"""Benchmark decontamination by pigeonhole edit matching.

Texts and items are sequences of lower-case words; in scripts that put no blanks between words each character is one.
An item of m words may differ by k = floor(0.2 m) word edits (insertions, deletions, substitutions), a similarity of
0.8. It is split into k + 1 pieces; a passage within the budget keeps at least one of them whole, so exact piece hits
find every candidate. A candidate of which a text lacks more than k distinct words is none, which settles pieces that
many items share before their places are looked at. Each candidate's surroundings are verified with Myers'
bit-parallel edit distance.

Items under five words have no budget: they match word by word, however short they are. A caller who takes short ones
for too little evidence sets `min_letters`; `skipped` lists what that leaves out, and items without any word.

Defined results: a null text is empty and matches nothing; repeated rows of documents or items give one pair with its
best place; a null doc_id or item_id is kept as a null in the pair. Columns other than ids and texts are not read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from math import ceil

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusmill.llm.common import read, texts_of, tune

EDITS = 0.2
#: Letters that an item has at least: by default none is left out.
MIN_LETTERS = 0
#: Items and characters of items that one pass holds in memory; more items take more passes over the documents.
BLOCK_ITEMS = 100_000
BLOCK_CHARS = 32 << 20

#: Thai to Burmese, Khmer, kana, and Chinese characters: written without blanks.
_UNSPACED = "\u0e00-\u0eff\u1000-\u109f\u1780-\u17ff\u3040-\u30ff\u3400-\u4dbf\u4e00-\u9fff\uf900-\ufaff\U00020000-\U0003ffff"
_WORD = re.compile(rf"[{_UNSPACED}]|[^\W_{_UNSPACED}]+")
_MIX = np.uint64(0x9E3779B97F4A7C15)
_FILTER_BITS = 20


def words_of(text: str) -> list[str]:
    return _WORD.findall(text.lower())


def why_skipped(words: list[str], min_letters: int = MIN_LETTERS) -> str | None:
    """Why an item of these words is no evidence; None for one that is."""
    if not words:
        return "no_words"
    return "under_least_letters" if sum(map(len, words)) < min_letters else None


def pieces_of(m: int, budget: int) -> list[tuple[int, int]]:
    """(start, length) of budget + 1 pieces of nearly equal length."""
    cuts = [i * m // (budget + 1) for i in range(budget + 2)]
    return [(a, b - a) for a, b in zip(cuts, cuts[1:], strict=False)]


def myers(pattern: list[int], text: list[int]) -> list[int]:
    """Edit distance of the whole pattern to the best stretch of text ending at each position. One bit per word."""
    m = len(pattern)
    full, top = (1 << m) - 1, 1 << (m - 1)
    where: dict[int, int] = {}
    for i, w in enumerate(pattern):
        where[w] = where.get(w, 0) | 1 << i
    plus, minus, score, out = full, 0, m, []
    for w in text:
        eq = where.get(w, 0)
        x = eq | minus
        zero = (((eq & plus) + plus) ^ plus) | x
        up = minus | (~(zero | plus) & full)
        down = plus & zero
        score += bool(up & top) - bool(down & top)
        up = up << 1 & full
        down = down << 1 & full
        plus = down | (~(x | up) & full)
        minus = up & x
        out.append(score)
    return out


@dataclass
class PieceIndex:
    """Pieces of one block of items by their hash. Items with the same words are one pattern; a piece that several
    patterns share is one group."""

    vocabulary: dict[str, int]
    ids: list[list[int | None]]  # of the items of each pattern
    words: np.ndarray  # of all patterns, one after the other
    bounds: np.ndarray
    budgets: np.ndarray
    distinct: np.ndarray  # as words, each word of a pattern once
    distinct_bounds: np.ndarray
    lengths: list[int]
    keys: list[np.ndarray]  # hashes of the groups of each length, sorted
    first_group: list[int]
    owners: np.ndarray  # patterns of each group, one group after the other
    owner_bounds: np.ndarray
    pieces: dict[int, list[tuple[int, int]]]  # pattern -> (group, start)
    filters: list[np.ndarray]

    @classmethod
    def of(cls, rows: list[tuple[int | None, str | None]], edits: float, min_letters: int) -> PieceIndex:
        vocabulary: dict[str, int] = {}
        patterns: dict[tuple[int, ...], list[int | None]] = {}
        for item_id, text in rows:
            words = words_of(text or "")
            if why_skipped(words, min_letters) is None:
                patterns.setdefault(tuple(vocabulary.setdefault(w, len(vocabulary) + 1) for w in words), []).append(item_id)
        bounds = lambda sizes: np.concatenate([[0], np.cumsum(np.array(sizes, np.int64))])
        budgets = [int(edits * len(p)) for p in patterns]
        found: dict[int, list[tuple[int, int, int]]] = {}
        for k, (p, budget) in enumerate(zip(patterns, budgets, strict=True)):
            for start, length in pieces_of(len(p), budget):
                key = int(hashes_of(np.array(p[start : start + length], np.uint64), length)[0])
                found.setdefault(length, []).append((key, k, start))
        lengths, keys, first_group, filters = sorted(found), [], [], []
        owners: list[int] = []
        sizes: list[int] = []
        pieces: dict[int, list[tuple[int, int]]] = {}
        for length in lengths:
            first_group.append(len(sizes))
            own = sorted(found[length])
            keys.append(np.unique(np.array([r[0] for r in own], np.uint64)))
            groups = np.searchsorted(keys[-1], np.array([r[0] for r in own], np.uint64)) + first_group[-1]
            sizes += np.bincount(groups - first_group[-1]).tolist()
            for g, (_, k, start) in zip(groups.tolist(), own, strict=True):
                owners.append(k)
                pieces.setdefault(k, []).append((g, start))
            maybe = np.zeros(1 << _FILTER_BITS, bool)
            maybe[keys[-1] >> np.uint64(64 - _FILTER_BITS)] = True
            filters.append(maybe)
        distinct = [sorted(set(p)) for p in patterns]
        flat = lambda parts: np.array([w for p in parts for w in p], np.int64)
        return cls(vocabulary, list(patterns.values()), flat(patterns), bounds([len(p) for p in patterns]), np.array(budgets, np.int64), flat(distinct), bounds([len(d) for d in distinct]), lengths, keys, first_group, np.array(owners, np.int64), bounds(sizes), pieces, filters)

    def hits(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(position, group) of each exact piece in ids."""
        places, groups = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for length, keys, first, maybe in zip(self.lengths, self.keys, self.first_group, self.filters, strict=True):
            if len(ids) < length:
                continue
            hashes = hashes_of(ids, length)
            at = np.flatnonzero(maybe[hashes >> np.uint64(64 - _FILTER_BITS)])
            k = np.minimum(np.searchsorted(keys, hashes[at]), len(keys) - 1)
            same = keys[k] == hashes[at]
            places.append(at[same])
            groups.append(k[same] + first)
        return np.concatenate(places), np.concatenate(groups)

    def candidates(self, groups: np.ndarray, words: np.ndarray, mask: np.ndarray) -> np.ndarray:
        """Patterns with a piece among groups of which a text of these words lacks no more distinct words than its budget."""
        spans = zip(self.owner_bounds[groups].tolist(), self.owner_bounds[groups + 1].tolist(), strict=True)
        found = np.unique(np.concatenate([self.owners[a:b] for a, b in spans]))
        mask[words] = True
        kept = []
        for at in range(0, len(found), 4096):  # a bounded number of patterns at a time
            part = found[at : at + 4096]
            n = self.distinct_bounds[part + 1] - self.distinct_bounds[part]
            ends = np.cumsum(n)
            flat = np.repeat(self.distinct_bounds[part] - ends + n, n) + np.arange(ends[-1])
            missing = np.add.reduceat(~mask[self.distinct[flat]], ends - n, dtype=np.int64)
            kept.append(part[missing <= self.budgets[part]])
        mask[words] = False
        return np.concatenate(kept)

    def matches(self, texts: list[str]) -> list[dict[int, tuple[int, int, int, int]]]:
        """For each text: pattern's number -> (edits, first word, last word, places), its best place."""
        get = self.vocabulary.get
        docs = [[get(w, 0) for w in words_of(t)] for t in texts]
        sizes = np.array([len(d) + 1 for d in docs])
        ends = np.cumsum(sizes)
        ids = np.zeros(int(ends[-1]) if len(ends) else 0, np.uint64)
        for d, e in zip(docs, ends.tolist(), strict=True):
            ids[e - 1 - len(d) : e - 1] = d
        places, groups = self.hits(ids)
        of = np.searchsorted(ends, places, "right")
        order = np.lexsort((places, groups, of))
        places, groups, of = places[order], groups[order], of[order]
        mask = np.zeros(len(self.vocabulary) + 1, bool)
        out: list[dict] = [{} for _ in texts]
        cuts = np.searchsorted(of, np.arange(len(texts) + 1))
        for doc in np.unique(of).tolist():
            own_places, own_groups = places[cuts[doc] : cuts[doc + 1]], groups[cuts[doc] : cuts[doc + 1]]
            begin = int(ends[doc] - sizes[doc])
            for k in self.candidates(np.unique(own_groups), np.array(docs[doc], np.int64), mask).tolist():
                starts: set[int] = set()
                for g, start in self.pieces[k]:
                    a, b = np.searchsorted(own_groups, [g, g + 1])
                    starts.update((own_places[a:b] - begin - start).tolist())
                if best := self._verify(docs[doc], k, sorted(starts)):
                    out[doc][k] = best
        return out

    def _verify(self, words: list[int], k: int, starts: list[int]) -> tuple[int, int, int, int] | None:
        """Candidates whose surroundings overlap are verified as one window."""
        pattern, budget = self.words[self.bounds[k] : self.bounds[k + 1]].tolist(), int(self.budgets[k])
        m, best, places, at = len(pattern), None, 0, 0
        while at < len(starts):
            first = max(0, starts[at] - budget)
            last = starts[at] + m + budget
            at += 1
            while at < len(starts) and starts[at] - budget <= last:
                last = starts[at] + m + budget
                at += 1
            window = words[first:last]
            free = 0
            for end, edits in enumerate(myers(pattern, window)):
                if edits <= budget:
                    places += end >= free
                    if end >= free:
                        free = end + m
                    if best is None or edits < best[0]:
                        best = (edits, self._start(pattern, window[: end + 1], edits) + first, first + end)
        return best and (*best, places)

    @staticmethod
    def _start(pattern: list[int], window: list[int], edits: int) -> int:
        """Where the best stretch that ends with the window starts: the same scan from behind."""
        back = myers(pattern[::-1], window[::-1])
        return len(window) - 1 - back.index(edits) if edits in back else 0


def hashes_of(ids: np.ndarray, length: int) -> np.ndarray:
    """A 64-bit key for each run of `length` ids."""
    n = len(ids) - length + 1
    key = np.full(n, length, np.uint64)
    for j in range(length):
        key = (key ^ ids[j : j + n]) * _MIX
        key ^= key >> np.uint64(29)
    return key * _MIX


def blocks_of(items: DataFrame, edits: float, min_letters: int) -> Iterator[PieceIndex]:
    """The items' indexes, a bounded block at a time."""
    size = items.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.length("text")), F.lit(0)).alias("chars")).first()
    n = max(1, ceil(size.n / BLOCK_ITEMS), ceil(size.chars / BLOCK_CHARS))
    block = F.pmod(F.xxhash64("item_id", "text"), F.lit(n))
    for k in range(n):
        rows = items.select("item_id", "text").where(block == k).distinct().collect()
        yield PieceIndex.of([tuple(r) for r in sorted(rows, key=repr)], edits, min_letters)


def leaks(docs: DataFrame, items: DataFrame, edits: float = EDITS, min_letters: int = MIN_LETTERS) -> DataFrame:
    """One row per document and item found in it: doc_id, item_id, edits, similarity, first_word, last_word, places."""
    spark = docs.sparkSession
    tune(spark)
    texts, found = texts_of(docs), None
    for index in blocks_of(items, edits, min_letters):
        shared = spark.sparkContext.broadcast(index)

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            index = shared.value
            for b in batches:
                ids = b.column("doc_id").to_pylist()
                rows = [
                    (d, item, e, 1 - e / int(index.bounds[k + 1] - index.bounds[k]), first, last, places)
                    for d, hit in zip(ids, index.matches(b.column("text").to_pylist()), strict=True)
                    for k, (e, first, last, places) in hit.items()
                    for item in index.ids[k]
                ]
                columns = list(zip(*rows, strict=True)) or [[]] * 7
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, _PAIR, strict=True)], _NAMES)

        part = texts.mapInArrow(run, "doc_id long, item_id long, edits long, similarity double, first_word long, last_word long, places long")
        found = part if found is None else found.unionByName(part)
    best = F.min(F.struct("edits", "first_word", "last_word", "similarity")).alias("b")
    out = found.groupBy("doc_id", "item_id").agg(best, F.max("places").alias("places"))
    return out.select("doc_id", "item_id", "b.edits", F.round("b.similarity", 6).alias("similarity"), "b.first_word", "b.last_word", "places")


def skipped(items: DataFrame, min_letters: int = MIN_LETTERS) -> DataFrame:
    """item_id, reason of the items that are no evidence."""
    tune(items.sparkSession)

    @F.pandas_udf("string")
    def reason(texts: pd.Series) -> pd.Series:
        return pd.Series([why_skipped(words_of(t or ""), min_letters) for t in texts], dtype=object)

    return items.select("item_id", reason("text").alias("reason")).where("reason IS NOT NULL")


_PAIR = [pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.int64(), pa.int64(), pa.int64()]
_NAMES = ["doc_id", "item_id", "edits", "similarity", "first_word", "last_word", "places"]


def without_leaks(docs: DataFrame, items: DataFrame, edits: float = EDITS, min_letters: int = MIN_LETTERS) -> DataFrame:
    """The rows of docs in whose text no item is found. Only texts go to Python and only an answer comes back."""
    spark = docs.sparkSession
    tune(spark)
    for index in blocks_of(items, edits, min_letters):
        docs = docs.where(~_leaky(spark.sparkContext.broadcast(index))("text"))
    return docs


def _leaky(shared):
    @F.pandas_udf("boolean")
    def leaky(texts: pd.Series) -> pd.Series:
        return pd.Series([bool(m) for m in shared.value.matches([t or "" for t in texts])], dtype=bool)

    return leaky


def op5_pigeonhole_leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leaks(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))
