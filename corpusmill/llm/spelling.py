"""Spelling variants: words that differ by one inserted, deleted or replaced code point, and the form each belongs to.

Words are counted over all texts first. Each word then gives a key for itself and one for each string that deleting a
code point leaves: with prefix and suffix polynomial hashes modulo 2^64 the key of word[:i] + word[i + 1:] is
prefix * base^(rest) + suffix, so all keys of an Arrow batch are integers that NumPy makes at once. Keys are dealt by
their leading bits, sorted within each part, and what shares a key is verified on the strings themselves.

A key's group tells all near pairs without writing one. For the string s that its rows have left: words that lost a code
point at the same place of s differ by one replaced code point, each with all others; the word s itself differs from each
of them by an insertion. A pair meets in one group and at one place alone, as equal neighbours count as one place. So
counts are sizes, and the near word of largest n is the best of a place or, for that one itself, the second best. A
place's words differ at one code point, so a group is no larger than the alphabet times the places of a word.

Defined results: null texts have no words; a null id counts as an empty one in the checksum; repeated rows count each;
ties go to the word that is first in code-point order; an empty table gives no rows. Forms have at least twice the count
of their word, so following them ends. Columns other than id and text are not read.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusmill.llm.common import read, tune, write_cut

#: What counts as a run of letters, and how words are lowered.
LETTERS = re.compile("[A-Za-zÀ-ÿ]+")
LOWER = {c: c + 32 for c in range(ord("A"), ord("Z") + 1)}
#: Words that are grouped have so many code points and occurrences; a form has so many times its word's.
LEAST_LENGTH, LEAST_COUNT, TIMES = 5, 3, 2
#: Distinct words that a task counts before it passes them on.
COUNTED = 1 << 18
#: The base of the polynomials: odd, so that no factor is lost modulo 2^64.
BASE = 0x9E3779B97F4A7C15
#: Leading bits of a key by which rows are dealt.
RADIX = 16

#: doc_id as text and a lowered word -> the word that counts.
Misspelling = Callable[[str, str], str]


def word_counts(docs: DataFrame, misspelling: Misspelling | None = None, least_length: int = LEAST_LENGTH, least_count: int = LEAST_COUNT) -> DataFrame:
    """word, n: the words of all texts with enough code points and occurrences."""
    tune(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[str, int] = {}

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(list(seen), pa.string()), pa.array(list(seen.values()), pa.int64())], ["word", "n"])

        for b in batches:
            for i, text in zip(b.column("id").to_pylist(), b.column("text").to_pylist(), strict=True):
                own: dict[str, int] = {}
                for w in LETTERS.findall(text.translate(LOWER)):
                    own[w] = own.get(w, 0) + 1
                for w, n in own.items():
                    w = misspelling(i, w) if misspelling else w
                    if len(w) >= least_length:
                        seen[w] = seen.get(w, 0) + n
                if len(seen) > COUNTED:
                    yield out()
                    seen.clear()
        yield out()

    texts = docs.where("text IS NOT NULL").select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("id"), "text")
    return texts.mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= least_count)


def deletion_keys(words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(word, place, key), a row for each word itself at place -1 and one for each place where a code point goes; of
    equal neighbours only the first goes."""
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    begin = np.cumsum(sizes) - sizes
    points = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32).astype(np.uint64) + np.uint64(1)
    owner = np.repeat(np.arange(len(words)), sizes)
    place = np.arange(len(points)) - begin[owner]
    longest = int(sizes.max(initial=0))
    power = np.ones(longest + 1, np.uint64)
    np.multiply.accumulate(np.full(longest, BASE, np.uint64), out=power[1:])
    with np.errstate(over="ignore"):
        # as sums of code point * base^(code points after it), from the left and from the right
        weighted = points * power[sizes[owner] - 1 - place]
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(weighted, dtype=np.uint64)])
        whole = sums[begin + sizes] - sums[begin]
        suffix = sums[(begin + sizes)[owner]] - sums[1:]
        # the prefix's code points have one fewer after them: its polynomial is made one place lower
        lower = points * power[np.maximum(sizes[owner] - 2 - place, 0)]
        lowered = np.concatenate([np.zeros(1, np.uint64), np.cumsum(lower, dtype=np.uint64)])
        prefix = lowered[:-1] - lowered[begin[owner]]
        key = prefix + suffix
    first = np.ones(len(points), bool)
    first[1:] = (points[1:] != points[:-1]) | (place[1:] == 0)
    at = np.flatnonzero(first)
    every = np.arange(len(words))
    mixed = np.concatenate([whole, key[at]])
    mixed ^= mixed >> np.uint64(29)  # leading bits, by which rows are dealt, should depend on all of a key
    mixed *= np.uint64(0xBF58476D1CE4E5B9)
    mixed ^= mixed >> np.uint64(32)
    return np.concatenate([every, owner[at]]), np.concatenate([np.full(len(words), -1), place[at]]), mixed.view(np.int64)


def keyed(words: DataFrame) -> DataFrame:
    """words (word, n) -> key, place, word, n."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            word, place, key = deletion_keys(b.column("word").to_pylist())
            at = pa.array(word)
            yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(place.astype(np.int32)), b.column("word").take(at), b.column("n").take(at)], ["key", "place", "word", "n"])

    return words.select("word", "n").mapInArrow(run, "key long, place int, word string, n long")


def group_facts(rows: list[tuple[int, str, int]]) -> list[tuple[str, int, int, str]]:
    """rows (place, word, n) of one key -> (word, near, best n, best word) for what the group knows of each word."""
    strings: dict[str, list[tuple[int, str, int]]] = {}
    for place, word, n in rows:  # rows whose strings differ share a key by accident
        strings.setdefault(word if place < 0 else word[:place] + word[place + 1 :], []).append((place, word, n))
    out = []
    for left, group in strings.items():
        if len(group) < 2:
            continue
        own = next(((w, n) for place, w, n in group if place < 0), None)
        places: dict[int, list[tuple[int, str]]] = {}
        ranked = sorted((-n, w, place) for place, w, n in group if place >= 0)
        for minus, w, place in ranked:
            stop = place  # a deletion in a stretch of equal code points is one at each of its places
            while stop < len(w) and w[stop] == w[place]:
                places.setdefault(stop, []).append((minus, w))
                stop += 1
        for rivals in places.values():
            if len(rivals) > 1:
                for k, (_, w) in enumerate(rivals):
                    minus, best = rivals[1 if k == 0 else 0]
                    out.append((w, len(rivals) - 1, -minus, best))
        if own and ranked:
            out.append((own[0], len(ranked), -ranked[0][0], ranked[0][1]))
            out += [(w, 1, own[1], own[0]) for _, w, _ in ranked]
    return out


def near_words(words: DataFrame) -> DataFrame:
    """words (word, n), each word once -> word, n_near, best_n, best for words that have near ones: how many, and the one
    of largest n."""
    tune(words.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows sorted by key; the last key of a batch may go on in the next one."""
        rest: list[pa.RecordBatch] = []

        def facts(table: pa.RecordBatch) -> pa.RecordBatch:
            keys = table.column("key").to_numpy()
            cuts = np.concatenate([[0], np.flatnonzero(keys[1:] != keys[:-1]) + 1, [len(keys)]])
            many = np.flatnonzero(np.diff(cuts) > 1)
            wanted = np.repeat(many, np.diff(cuts)[many])
            at = cuts[wanted] + np.arange(len(wanted)) - np.repeat(np.cumsum(np.diff(cuts)[many]) - np.diff(cuts)[many], np.diff(cuts)[many])
            part = table.take(pa.array(at))
            rows = list(zip(part.column("place").to_pylist(), part.column("word").to_pylist(), part.column("n").to_pylist(), strict=True))
            found, end = [], 0
            for size in np.diff(cuts)[many].tolist():
                found += group_facts(rows[end : end + size])
                end += size
            columns = list(zip(*found, strict=True)) or [()] * 4
            kinds = [pa.string(), pa.int64(), pa.int64(), pa.string()]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], ["word", "near", "best_n", "best"])

        for b in batches:
            if not b.num_rows:
                continue
            both = pa.Table.from_batches([*rest, b]).combine_chunks().to_batches()[0]
            keys = both.column("key").to_numpy()
            last = int(np.searchsorted(keys, keys[-1]))
            if last:
                yield facts(both.slice(0, last))
            rest = [both.slice(last)]
        if rest:
            yield facts(rest[0])

    rows = keyed(words)
    dealt = rows.repartition(F.shiftrightunsigned("key", 64 - RADIX)).sortWithinPartitions("key")
    found = dealt.mapInArrow(run, "word string, near long, best_n long, best string")
    best = F.min(F.struct((-F.col("best_n")).alias("minus"), F.col("best").alias("word")))
    return found.groupBy("word").agg(F.sum("near").alias("n_near"), best.alias("b")).select("word", "n_near", (-F.col("b.minus")).alias("best_n"), F.col("b.word").alias("best"))


def roots(forms: DataFrame) -> DataFrame:
    """forms (word, form), each word once and no circles -> word, root: what following forms ends at.

    Pointer jumping: each round doubles the steps that a pointer stands for, so rounds grow with the logarithm of the
    longest chain. Hot targets are on the side that adaptive execution may split."""
    ahead = write_cut(forms.select("word", F.col("form").alias("root"), F.lit(True).alias("moved")), "forms")
    while not ahead.where("moved").isEmpty():
        further = ahead.select(F.col("word").alias("root"), F.col("root").alias("next"))
        ahead = write_cut(ahead.join(further, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "roots")
    return ahead.select("word", "root")


def variants(words: DataFrame, times: int = TIMES) -> DataFrame:
    """words (word, n), each word once -> word, n, form, form_n, root, n_near."""
    counted = write_cut(words.select("word", "n"), "words")
    near = counted.join(near_words(counted), "word", "left")
    chosen = F.col("best_n") >= times * F.col("n")
    found = write_cut(near.select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(chosen, F.col("best")).alias("form"), F.when(chosen, F.col("best_n")).alias("form_n")), "variants")
    ends = roots(found.where("form IS NOT NULL").select("word", "form"))
    return found.join(ends, "word", "left").select("word", "n", "form", "form_n", F.coalesce("root", "word").alias("root"), "n_near")


def planted_misspelling(doc_id: str, word: str) -> str:
    """One word in ninety-seven, by the checksum of it and its document's id, loses a code point."""
    h = zlib.crc32(word.encode(), zlib.crc32(f"{doc_id}:".encode()))
    if h % 97:
        return word
    k = h % len(word)
    return word[:k] + word[k + 1 :]


def op12_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return variants(word_counts(read(spark, sf_dir, "documents"), planted_misspelling))
