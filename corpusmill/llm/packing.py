"""Packing by lexical retrieval.

Documents become token ids, which are written once. Shards of bounded size hold an inverted BM25 index over their
documents' token ids; document frequencies, document count and mean length come from the whole corpus. Documents are
dealt to shards by content: by a token that is drawn by its IDF, the same one for documents that share most of their
weight, so that related documents meet whatever the number of shards. A seed document opens a window; its best unused
neighbours by BM25 over all its terms fill it greedily; the last one is cut at the window's end, and what is left of it
seeds the next window. Only a shard's last window can have room left.

In packing, a seed's neighbours in other shards are not found: README gives the measured share that is. `neighbours_of`
finds the best over all shards for a stated set of seeds.

Defined results: a null or empty text is the end id alone; repeated rows are packed each; a null doc_id stays null;
an empty table gives no rows. Columns other than id and text are not read.
"""

from __future__ import annotations

import json
import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import lru_cache
from math import ceil

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corpusmill.llm.common import read, texts_of, tune, write_cut

WINDOW = 2048
END_ID = 1
#: Tokens of a shard: bounds what a task holds.
SHARD_TOKENS = 1 << 22
#: A shard is made of cells of at most this part of it, where documents can be told apart by content.
CELLS = 4
#: A term in at least one of so many documents of a shard has a row of its own.
DENSE = 8
K1, B = 1.2, 0.75
#: Seeds that every shard is asked about at a time.
SEED_BLOCK = 512
#: Runs of blanks over this length go through the slower encoder.
LONG_RUN = " " * 512
#: The pattern of the pieces that are encoded each, as it is published, and a form that finds the same ones in less time: what
#: may begin with a blank is one alternative, and at the end of a text no white space is followed by anything else.
SPELLED = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
PIECES = r"'(?:[sdmt]|ll|ve|re)| ?(?:\p{L}+|\p{N}+|[^\s\p{L}\p{N}]+)|\s+(?!\S)|\s"


def byte_alphabet() -> dict[str, int]:
    """Byte-level vocabularies write bytes as letters: printable ones stand for themselves, others follow from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Encoder:
    """Ids of the byte-level BPE in a tokenizer file. The plain case runs in a faster encoder that is built from the
    same file and gives the same ids; texts with the file's added tokens or very long blanks take the file's own."""

    def __init__(self, path: str):
        import tiktoken
        from public_tokenizers import PATTERN
        from tokenizers import Tokenizer

        self.plain = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.added = [t["content"] for t in spec.get("added_tokens", [])]
        alphabet = byte_alphabet()
        vocabulary = {t: i for t, i in spec["model"]["vocab"].items() if t not in self.added}
        ranks = {bytes(alphabet[c] for c in t): i for t, i in vocabulary.items()}
        self.fast = tiktoken.Encoding("from-file", pat_str=PIECES if PATTERN == SPELLED else PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.size = max([END_ID, *spec["model"]["vocab"].values(), *(t["id"] for t in spec.get("added_tokens", []))]) + 1
        self.kind = np.uint16 if self.size <= 1 << 16 else np.uint32

    def ids(self, text: str) -> np.ndarray:
        if any(t in text for t in self.added) or LONG_RUN in text:
            return np.array([*self.plain.encode(text, add_special_tokens=False).ids, END_ID], self.kind)
        found = self.fast.encode_ordinary(text)
        found.append(END_ID)
        return np.fromiter(found, self.kind, len(found))


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    return Encoder(path)


def tokenised(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, n, ids for each document, and a row for each task with the document frequencies it saw (terms)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path)
        seen = np.zeros(enc.size, np.uint32)
        names = ["doc_id", "n", "ids", "terms"]
        for b in batches:
            ids = [enc.ids(t) for t in b.column("text").to_pylist()]
            once = [pd.unique(x) for x in ids]
            if once:  # a document's term counts once, and a batch is added in one go
                seen += np.bincount(np.concatenate(once), minlength=enc.size).astype(np.uint32)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(map(len, ids), pa.int64()), pa.array([x.tobytes() for x in ids], pa.binary()), pa.nulls(len(ids), pa.binary())], names)
        yield pa.RecordBatch.from_arrays([pa.nulls(1, pa.int64()), pa.array([0], pa.int64()), pa.nulls(1, pa.binary()), pa.array([seen.tobytes()], pa.binary())], names)

    return texts_of(docs).mapInArrow(run, "doc_id long, n long, ids binary, terms binary")


def document_frequencies(tokens: DataFrame, size: int) -> np.ndarray:
    """Over the whole corpus; as many numbers as the vocabulary has ids, whatever the corpus."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size, np.int64)
        for b in batches:
            for x in b.column("terms").to_pylist():
                total += np.frombuffer(x, np.uint32)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], ["term", "df"])

    rows = tokens.where("terms IS NOT NULL").select("terms").mapInArrow(run, "term long, df long").groupBy("term").agg(F.sum("df").alias("df")).collect()
    out = np.zeros(size, np.int64)
    for term, df in rows:
        out[term] = df
    return out


class Bm25Shard:
    """Inverted index of one shard: for each term the documents with it and their BM25 weights.

    Postings of a term that is in at least one of DENSE documents are a row with a place for every document, which is
    summed without looking places up; rows take no more room than DENSE times the postings. Others are lists."""

    def __init__(self, ids: list[np.ndarray], idf: np.ndarray, mean_length: float):
        self.lengths = np.array([len(x) for x in ids])
        doc = np.repeat(np.arange(len(ids), dtype=np.uint64), self.lengths)
        pairs, counts = np.unique(doc << np.uint64(32) | np.concatenate(ids).astype(np.uint64), return_counts=True)
        doc, self.term = (pairs >> np.uint64(32)).astype(np.int64), (pairs & np.uint64(0xFFFFFFFF)).astype(np.int64)
        self.of_doc = np.searchsorted(doc, np.arange(len(ids) + 1))
        weight = (idf[self.term] * counts * (K1 + 1) / (counts + K1 * (1 - B + B * self.lengths[doc] / mean_length))).astype(np.float32)
        heavy = np.flatnonzero(np.bincount(self.term, minlength=len(idf)) * DENSE >= len(ids))
        self.row = np.full(len(idf), -1)
        self.row[heavy] = np.arange(len(heavy))
        in_row = self.row[self.term] >= 0
        self.live = np.arange(len(ids))
        self.rows = np.zeros((len(heavy), len(ids)), np.float32)
        self.rows[self.row[self.term[in_row]], doc[in_row]] = weight[in_row]
        light = np.flatnonzero(~in_row)
        order = light[np.argsort(self.term[light], kind="stable")]
        self.posting_doc, self.posting_weight = doc[order], weight[order]
        self.of_term = np.concatenate([[0], np.cumsum(np.bincount(self.term[light], minlength=len(idf)))])

    def forget(self, used: np.ndarray) -> None:
        """Drop the postings of used documents, which are never returned."""
        self.rows = np.ascontiguousarray(self.rows[:, ~used[self.live]])
        self.live = np.flatnonzero(~used)
        left = ~used[self.posting_doc]
        self.of_term = np.concatenate([[0], np.cumsum(left)])[self.of_term]
        self.posting_doc, self.posting_weight = self.posting_doc[left], self.posting_weight[left]

    def scores(self, seed: int, used: np.ndarray) -> np.ndarray:
        """BM25 of every document for the terms of the seed; 0 for used ones."""
        return self.scores_of(self.term[self.of_doc[seed] : self.of_doc[seed + 1]], used)

    def scores_of(self, terms: np.ndarray, used: np.ndarray) -> np.ndarray:
        """BM25 of every document for some terms, each once; 0 for used ones."""
        rows = self.row[terms]
        terms = terms[self.of_term[terms + 1] > self.of_term[terms]]
        out = np.zeros(len(used))
        if len(terms):
            slices = [slice(a, b) for a, b in zip(self.of_term[terms], self.of_term[terms + 1], strict=True)]
            out += np.bincount(np.concatenate([self.posting_doc[s] for s in slices]), np.concatenate([self.posting_weight[s] for s in slices]), len(used))
        rows = rows[rows >= 0]
        dense = np.zeros(len(self.live), np.float32)
        for at in range(0, len(rows), 32):  # a bounded copy of rows at a time
            dense += self.rows[rows[at : at + 32]].sum(axis=0)
        out[self.live] += dense
        out[used] = 0
        return out

    def neighbours(self, seed: int, used: np.ndarray) -> Iterator[int]:
        """Unused documents that share a term with the seed, best first; ties by position."""
        scores = self.scores(seed, used)
        found = np.flatnonzero(scores)
        if len(found) > 64:  # the best few mostly fill the window; the rest follows if they do not
            least = np.partition(scores[found], len(found) - 32)[len(found) - 32]
            first, rest = found[scores[found] >= least], found[scores[found] < least]
        else:
            first, rest = found, found[:0]
        for part in (first, rest):
            yield from part[np.argsort(-scores[part], kind="stable")].tolist()


def pack_shard(ids: list[np.ndarray], idf: np.ndarray, mean_length: float, window: int = WINDOW) -> Iterator[tuple[int, int, int, int, int]]:
    """(document, start, length, sequence, offset) of each piece; every document is placed once and cut where a window ends."""
    index = Bm25Shard(ids, idf, mean_length)
    used = np.zeros(len(ids), bool)
    sequence = offset = 0
    seed, following = None, 0
    placed, forgotten = 0, 0
    while True:
        if placed - forgotten > (len(ids) - forgotten) // 4:
            index.forget(used)
            forgotten = placed
        picks = index.neighbours(seed, used) if seed is not None else iter(())
        pick = next(picks, None)
        if pick is None:  # no neighbour: the next unused document is a seed of its own
            while following < len(ids) and used[following]:
                following += 1
            if following == len(ids):
                return
            pick, picks = following, iter(())
        while pick is not None:
            used[pick] = True
            placed += 1
            start, opened = 0, sequence
            while start < len(ids[pick]):
                length = min(len(ids[pick]) - start, window - offset)
                yield pick, start, length, sequence, offset
                start, offset = start + length, offset + length
                if offset == window:
                    sequence, offset = sequence + 1, 0
            seed = pick
            pick = next(picks, None) if sequence == opened else None


def races(idf: np.ndarray, df: np.ndarray) -> np.ndarray:
    """(2, ids): numbers of which a document's least one is at the same id for two documents with a probability that
    is their shared part of the squared IDF. Ids of one document only come last."""
    drawn = np.random.default_rng(1).exponential(size=(2, len(idf))) / np.maximum(idf, 1e-9) ** 2
    drawn[:, df < 2] += 1e30
    return drawn


def winners(ids: list[np.ndarray], race: np.ndarray) -> np.ndarray:
    """The id that wins a race in each document."""
    return np.array([x[race[x].argmin()] for x in ids], np.int64)


def keys_of(texts: DataFrame, race, kind: type) -> DataFrame:
    """texts (n, ids) -> n, and the ids a and b that win each race; the ids themselves go no further."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = [np.frombuffer(x, kind) for x in batch.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("n"), *(pa.array(winners(ids, r)) for r in race.value)], ["n", "a", "b"])

    return texts.select("n", "ids").mapInArrow(run, "n long, a long, b long")


def dealt(keys: DataFrame, size: int, tokens: int, shards: int) -> tuple[np.ndarray, ...]:
    """Arrays (parts, first, pieces, start, shard): a document with keys a, b and hash h is in shard
    shard[start[c] + h % pieces[c]], where its cell c is first[a] + b % parts[a].

    A key of too many tokens is split by the second key, and what that leaves too large (copies) by a hash. Cells in
    order fill shards of equal size, so no shard exceeds its share by more than a cell. Sizes are bounded by the
    vocabulary and the number of shards."""
    most = max(1, tokens // (shards * CELLS))
    mass = np.zeros(size, np.int64)
    for a, n in keys.groupBy("a").agg(F.sum("n").alias("n")).collect():
        mass[a] = n
    parts = np.where(mass > most, 16 * -(-mass // most), 1)
    first = np.cumsum(parts) - parts
    cells = np.zeros(parts.sum(), np.int64)
    cells[first] = mass
    heavy = np.flatnonzero(parts > 1)
    cells[first[heavy]] = 0
    if len(heavy):
        split = keys.sparkSession.createDataFrame([(int(a), int(parts[a]), int(first[a])) for a in heavy], "a long, parts long, first long")
        cell = (F.col("first") + F.col("b") % F.col("parts")).alias("cell")
        for c, n in keys.join(F.broadcast(split), "a").groupBy(cell).agg(F.sum("n").alias("n")).collect():
            cells[c] = n
    pieces = np.maximum(1, -(-cells // most))
    start = np.cumsum(pieces) - pieces
    each = np.repeat(cells / pieces, pieces)
    middle = np.cumsum(each) - each / 2
    shard = np.minimum(shards - 1, middle * shards / max(1, tokens)).astype(np.int64)
    return parts, first, pieces, start, shard


_PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def sharded(texts: DataFrame, idf: np.ndarray, df: np.ndarray, kind: type, tokens: int, shards: int) -> DataFrame:
    """texts (doc_id, n, ids) -> (doc_id, ids, shard). The keys alone are written, and made again where ids are dealt."""
    context = texts.sparkSession.sparkContext
    race = context.broadcast(races(idf, df))
    found = context.broadcast(dealt(write_cut(keys_of(texts, race, kind), "shard-keys"), len(idf), tokens, shards))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, first, pieces, start, shard = found.value
        for batch in batches:
            ids = [np.frombuffer(x, kind) for x in batch.column("ids").to_pylist()]
            a, b = (winners(ids, r) for r in race.value)
            cell = first[a] + b % parts[a]
            h = batch.column("h").to_numpy(zero_copy_only=False)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("ids"), pa.array(shard[start[cell] + h % pieces[cell]])], ["doc_id", "ids", "shard"])

    rows = texts.select("doc_id", "ids", F.xxhash64("doc_id", F.crc32("ids")).alias("h"))
    return rows.mapInArrow(run, "doc_id long, ids binary, shard long")


@dataclass
class Placed:
    """Documents' ids in shards, and what the whole corpus says of terms and lengths."""

    tokens: DataFrame
    rows: DataFrame
    idf: Broadcast
    mean_length: float
    kind: type
    shards: int


def placed_in_shards(docs: DataFrame, path: str, shard_tokens: int) -> Placed:
    spark = docs.sparkSession
    tune(spark)
    enc = encoder(path)
    tokens = write_cut(tokenised(docs, path), "token-ids")
    texts = tokens.where("terms IS NULL")
    total = texts.agg(F.count("*").alias("docs"), F.coalesce(F.sum("n"), F.lit(0)).alias("tokens")).first()
    df = document_frequencies(tokens, enc.size)
    idf = spark.sparkContext.broadcast(np.log1p((total.docs - df + 0.5) / (df + 0.5)))
    shards = max(1, ceil(total.tokens / shard_tokens))
    return Placed(texts, sharded(texts, idf.value, df, enc.kind, total.tokens, shards), idf, max(1.0, total.tokens / max(1, total.docs)), enc.kind, shards)


def pack(docs: DataFrame, path: str, window: int = WINDOW, shard_tokens: int = SHARD_TOKENS) -> DataFrame:
    """The pieces of all documents. Shards are dealt by content, with large groups split; a lost task reads the written
    ids again."""
    placed = placed_in_shards(docs, path, shard_tokens)
    idf, mean_length, kind, shards = placed.idf, placed.mean_length, placed.kind, placed.shards

    def run(key: tuple, part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values(["doc_id", "ids"], kind="stable", na_position="last")
        ids = [np.frombuffer(x, kind) for x in part["ids"]]
        rows = [(d, s, n, zlib.crc32(ids[d][s : s + n].astype("<u4").tobytes()), len(ids[d]), (int(key[0]) << 32) + q, o) for d, s, n, q, o in pack_shard(ids, idf.value, mean_length, window)]
        out = pd.DataFrame(rows, columns=["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"])
        out["doc_id"] = part["doc_id"].astype("Int64").to_numpy()[out["doc_id"].to_numpy(dtype=np.int64)]
        return out

    # as many parts as shards, whatever the session's number of partitions, so that no task grows with the corpus; a part may
    # get several shards, which pass through it one after the other
    return placed.rows.repartition(shards, "shard").groupBy("shard").applyInPandas(run, _PIECES)


def neighbours_of(docs: DataFrame, seeds: DataFrame, path: str, k: int = 10, shard_tokens: int = SHARD_TOKENS) -> DataFrame:
    """query_id, doc_id, score: the k best documents by BM25 for each of some seeds (doc_id), over all shards, exactly.

    Seeds go to all shards in blocks of bounded size, each shard gives its k best, and the best of those are the corpus's
    own: documents of other shards are found, as packing does not. The work grows with seeds times corpus, so seeds are a
    stated set. A seed that stands several times or under several texts asks once for each text; itself and other
    rows of its id are left out; ties go to the smaller id; documents that share no term are no neighbours."""
    placed = placed_in_shards(docs, path, shard_tokens)
    idf, mean_length, kind = placed.idf, placed.mean_length, placed.kind
    asked = placed.tokens.join(seeds.select(F.col("doc_id").cast("long").alias("doc_id")).where("doc_id IS NOT NULL").distinct(), "doc_id").select("doc_id", "ids").distinct()
    asked = write_cut(asked, "seeds")
    blocks = max(1, -(-asked.count() // SEED_BLOCK))
    best = None

    def asking(shared: Broadcast) -> Callable[[pd.DataFrame], pd.DataFrame]:
        def run(rows: pd.DataFrame) -> pd.DataFrame:
            rows = rows.sort_values(["doc_id", "ids"], kind="stable", na_position="last")
            index = Bm25Shard([np.frombuffer(x, kind) for x in rows["ids"]], idf.value, mean_length)
            names, none, out = rows["doc_id"].astype("Int64"), np.zeros(len(rows), bool), []
            own = names.to_numpy(dtype=float, na_value=np.nan)
            for query, terms in shared.value:
                scores = index.scores_of(terms, none)
                scores[own == query] = 0
                found = np.flatnonzero(scores)
                first = found[np.argsort(-scores[found], kind="stable")[:k]]
                out.append(pd.DataFrame({"query_id": query, "doc_id": names.iloc[first].array, "score": scores[first]}))
            return pd.concat(out) if out else pd.DataFrame({"query_id": [], "doc_id": [], "score": []})

        return run

    for block in range(blocks):
        part = asked.where(F.pmod(F.xxhash64("doc_id", "ids"), F.lit(blocks)) == block).collect()
        shared = docs.sparkSession.sparkContext.broadcast([(i, np.unique(np.frombuffer(x, kind)).astype(np.int64)) for i, x in part])

        found = placed.rows.repartition(placed.shards, "shard").groupBy("shard").applyInPandas(asking(shared), "query_id long, doc_id long, score double")
        best = found if best is None else best.unionByName(found)
    nth = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "doc_id"))
    return best.withColumn("n", nth).where(F.col("n") <= k).drop("n")


def op1_bm25_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(read(spark, sf_dir, "documents"), default_vocabulary())


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")
