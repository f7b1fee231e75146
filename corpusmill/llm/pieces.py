"""SentencePiece encoding and decoding for merge-type vocabularies.

A text is written with the vocabulary's blank mark and cut where no merge can cross: between two characters that stand
side by side in no piece of the vocabulary. Within a stretch an agenda of adjacent symbol pairs, ordered by score and then
from the left, is worked off: the best pair merges, its new neighbours join the agenda, entries whose symbols have changed
since are passed over. Characters that end as no piece fall back to their bytes. Stretches recur, so each worker remembers
a bounded number of them; what it does not know of an Arrow batch is worked off together and checked there against the
sentencepiece library, id by id. `verified` holds whole texts against the library.

Decoding takes the bytes of all pieces of a batch at once; documents are slices of them.

Defined results: a null or empty text has no ids and decodes to the empty text; repeated rows and null ids keep their
rows; null ids of pieces decode to null; an empty table gives no rows. Blanks are kept, all of them, if the vocabulary's
normaliser says so; a vocabulary that rewrites characters, folds blanks, has symbols of a user or is not of the merge
type is refused. A text's blank marks come back as blanks, as with the library. Columns other than id and text (or ids)
are not read.
"""

from __future__ import annotations

import re
import struct
from collections.abc import Iterator
from functools import lru_cache
from heapq import heapify, heappop, heappush
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusmill.llm.common import read, texts_of, tune

MARK = "▁"
#: Fixed values of the model file's format: kinds of pieces, and the merge type.
NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
MERGE_TYPE = 2
#: Stretches that a worker remembers, and the longest that is worth it.
REMEMBERED, LONGEST = 1 << 18, 48
#: Stretches up to SHORT characters are worked off side by side, ROWS of them at a time.
SHORT, ROWS = 32, 1 << 13
#: More than all pieces and characters together.
STRIDE = 1 << 32
#: The cost of two symbols that make no piece.
NEVER = np.iinfo(np.int32).max


def fields(message: bytes) -> Iterator[tuple[int, int | bytes]]:
    """(number, value) of a message in the wire format; four and eight fixed bytes stay bytes."""

    def number(at: int) -> tuple[int, int]:
        value = shift = 0
        while True:
            byte = message[at]
            value, shift, at = value | (byte & 127) << shift, shift + 7, at + 1
            if byte < 128:
                return value, at

    at = 0
    while at < len(message):
        tag, at = number(at)
        if tag & 7 == 0:
            value, at = number(at)
        else:
            size, at = number(at) if tag & 7 == 2 else (8 if tag & 7 == 1 else 4, at)
            value, at = message[at : at + size], at + size
        yield tag >> 3, value


class Vocabulary:
    """The pieces of a model file, and the rules by which texts become them."""

    def __init__(self, path: str):
        from sentencepiece import SentencePieceProcessor

        with open(path, "rb") as f:
            model = f.read()
        self.library = SentencePieceProcessor(model_proto=model)
        self.pieces, normaliser, trainer = [], {}, {}
        for n, value in fields(model):
            if n == 1:
                piece = dict(fields(value))
                self.pieces.append((piece.get(1, b"").decode(), struct.unpack("<f", piece.get(2, bytes(4)))[0], piece.get(3, NORMAL)))
            elif n in (2, 3):
                (trainer if n == 2 else normaliser).update(fields(value))
        self.prefix = normaliser.get(3, 1) == 1
        rewrites = normaliser.get(2) or normaliser.get(4, 1) or not normaliser.get(5, 1)
        if trainer.get(3, 1) != MERGE_TYPE or rewrites or trainer.get(24, 0) or any(kind == USER for *_, kind in self.pieces):
            raise ValueError("not a vocabulary of the merge type that takes texts as they are")
        ids = {p: (k, i) for i, (p, _, k) in enumerate(self.pieces)}
        self.id_of = {p: i for p, (k, i) in ids.items() if k in (NORMAL, UNUSED)}
        self.cost = {p: -s for p, s, k in self.pieces if k in (NORMAL, UNUSED)}
        self.unused = {p for p, _, k in self.pieces if k == UNUSED}
        self.unknown = next(i for i, p in enumerate(self.pieces) if p[2] == UNKNOWN)
        self.byte_ids = [ids[f"<0x{b:02X}>"][1] for b in range(256)] if trainer.get(35, 0) else None
        self.controls = np.array([k == CONTROL for *_, k in self.pieces])
        self.beside = {p[i : i + 2] for p in self.id_of for i in range(len(p) - 1)}
        #: Whether texts may be cut before each run of blank marks: no piece has a mark after another character.
        self.by_blank = not any(pair[1] == MARK != pair[0] for pair in self.beside)
        self.memo: dict[str | tuple[str], list[int]] = {}
        # what stands for a character: its piece; past all pieces if no piece has it; -1 if it is only part of pieces
        self.char_ids = np.arange(0x110000, dtype=np.int32) + len(self.pieces)
        for c in {c for p in self.id_of for c in p}:
            self.char_ids[ord(c)] = self.id_of.get(c, -1)
        ranks = {c: r for r, c in enumerate(sorted(set(self.cost.values())))}
        splits = [(self.id_of[p[:k]] * STRIDE + self.id_of[p[k:]], ranks[self.cost[p]], i) for p, i in self.id_of.items() for k in range(1, len(p)) if p[:k] in self.id_of and p[k:] in self.id_of]
        pairs = np.array(sorted(splits) or [(-1, 0, 0)], np.int64)
        self.pair_keys, self.pair_rank, self.pair_piece = pairs[:, 0].copy(), pairs[:, 1].astype(np.int32), pairs[:, 2].astype(np.int32)

    def merged(self, stretch: str) -> list[str]:
        """The symbols that are left when the agenda is empty."""
        n = len(stretch)
        cost = self.cost.get
        symbol = list(stretch)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        agenda = []
        for i in range(n - 1):
            c = cost(stretch[i : i + 2])
            if c is not None:
                agenda.append((c, i, i + 1, 2))
        heapify(agenda)
        halves = {}
        while agenda:
            _, i, j, size = heappop(agenda)
            left, right = symbol[i], symbol[j]
            if not left or not right or len(left) + len(right) != size:
                continue  # one of the two has merged since
            both = left + right
            if both in self.unused:
                halves[both] = left, right
            symbol[i], symbol[j] = both, ""
            k = after[i] = after[j]
            if k < n:
                before[k] = i
                c = cost(both + symbol[k])
                if c is not None:
                    heappush(agenda, (c, i, k, size + len(symbol[k])))
            h = before[i]
            if h >= 0:
                c = cost(symbol[h] + both)
                if c is not None:
                    heappush(agenda, (c, h, i, size + len(symbol[h])))
        out = [s for s in symbol if s]
        while any(s in halves for s in out):  # a piece that only serves merging comes apart again
            out = [part for s in out for part in halves.get(s, (s,))]
        return out

    def stretches(self, text: str) -> list[str]:
        """text cut wherever no piece of the vocabulary holds the two characters side by side."""
        cuts = [i for i in range(1, len(text)) if text[i - 1 : i + 1] not in self.beside]
        return [text[i:j] for i, j in zip([0, *cuts], [*cuts, len(text)], strict=True)]

    def fresh(self, word: str) -> list[int]:
        """Ids of one stretch, whatever its length and characters."""
        found, ids = self.id_of.get, []
        for part in self.stretches(word):
            for symbol in self.merged(part) if len(part) > 1 else [part]:
                i = found(symbol)
                ids += self.spelled(symbol) if i is None else [i]
        return ids

    def pair_costs(self, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Cost of each pair of ids, NEVER if they make no piece, and the piece that they make."""
        key = a.astype(np.int64) * STRIDE + b
        at = np.minimum(np.searchsorted(self.pair_keys, key), len(self.pair_keys) - 1)
        known = (self.pair_keys[at] == key) & (a >= 0) & (b >= 0)
        return np.where(known, self.pair_rank[at], NEVER), self.pair_piece[at]

    def spelled(self, symbol: str) -> list[int]:
        """What stands for a symbol that is no piece."""
        return [self.byte_ids[b] for b in symbol.encode("utf-8", "surrogatepass")] if self.byte_ids else [self.unknown]

    def fresh_many(self, words: list[str]) -> list[list[int]]:
        """Ids of many stretches. The agendas of those that are short and have characters of the vocabulary alone are
        worked off side by side, an entry of each at a time: a row of pair costs holds a stretch's agenda, and the first of
        its least costs is the entry that comes next."""
        out: list[list[int]] = [[]] * len(words)
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        points = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), np.uint32)
        symbols = self.char_ids[points]
        begin = np.cumsum(sizes) - sizes
        plain = (sizes > 0) & (sizes <= SHORT) & (not self.unused)
        odd = np.cumsum(np.concatenate([[0], symbols < 0]))
        plain &= odd[begin + sizes] == odd[begin]
        for k in np.flatnonzero(~plain).tolist():
            out[k] = self.fresh(words[k])
        order = np.flatnonzero(plain)
        order = order[np.argsort(sizes[order], kind="stable")]
        for i in range(0, len(order), ROWS):
            part = order[i : i + ROWS]
            width = int(sizes[part[-1]])
            column = np.arange(width)
            inside = column < sizes[part][:, None]
            grid = np.where(inside, symbols[np.minimum(begin[part][:, None] + column, len(symbols) - 1)], -1)
            self.work_off(grid)
            left = grid >= 0
            flat = grid[left].tolist()
            end = 0
            known = len(self.pieces)
            rare = (grid >= known).any(axis=1).tolist()
            for k, n, odd in zip(part.tolist(), left.sum(axis=1).tolist(), rare, strict=True):
                ids = flat[end : end + n]
                out[k] = [x for i in ids for x in ([i] if i < known else self.spelled(chr(i - known)))] if odd else ids
                end += n
        return out

    def work_off(self, grid: np.ndarray) -> None:
        """Rows of ids, -1 past their ends, become rows of merged ids, -1 where a symbol went into the one before it."""
        n, width = grid.shape
        if width < 2:
            return
        cost = np.empty((n, width), np.int32)
        piece = np.empty((n, width), np.int32)
        cost[:, -1], piece[:, -1] = NEVER, -1
        cost[:, :-1], piece[:, :-1] = self.pair_costs(grid[:, :-1], grid[:, 1:])
        after = np.tile(np.arange(1, width + 1), (n, 1))
        before = np.tile(np.arange(-1, width - 1), (n, 1))
        rows = np.arange(n)
        while len(rows):
            i = cost[rows].argmin(axis=1)  # the leftmost of equals
            more = cost[rows, i] != NEVER
            rows, i = rows[more], i[more]
            if not len(rows):
                return
            j = after[rows, i]
            grid[rows, i], grid[rows, j] = piece[rows, i], -1
            cost[rows, j] = NEVER
            k = after[rows, j]
            after[rows, i] = k
            inside = k < width
            before[rows[inside], k[inside]] = i[inside]
            right = np.where(inside, grid[rows, np.minimum(k, width - 1)], -1)
            cost[rows, i], piece[rows, i] = self.pair_costs(grid[rows, i], right)
            h = before[rows, i]
            r, h, i = rows[h >= 0], h[h >= 0], i[h >= 0]
            cost[r, h], piece[r, h] = self.pair_costs(grid[r, h], grid[r, i])

    def words(self, text: str) -> list:
        """text in the vocabulary's writing, cut before blank marks where that is right; else whole. A word after one mark
        goes without it, any other stretch as a tuple."""
        if not text:
            return []
        if self.by_blank and self.prefix and "  " not in text and MARK not in text and text[0] != " " != text[-1]:
            return text.split(" ")
        marked = (MARK if self.prefix else "") + text.replace(" ", MARK)
        found = _WORDS.findall(marked) if self.by_blank else [marked]
        return [w[1:] if w[0] == MARK and len(w) > 1 and w[1] != MARK else (w,) for w in found]

    def learn(self, cut: list[list]) -> list:
        """Stretches of a batch that were not remembered, worked off and checked against the library in one call."""
        memo = self.memo
        if len(memo) > REMEMBERED:  # what this batch has stays
            self.memo = memo = {w: memo[w] for words in cut for w in words if w in memo}
        new = list({w for words in cut for w in words if w not in memo})
        ids = self.fresh_many([MARK + w if isinstance(w, str) else w[0] for w in new])
        at = [k for k, w in enumerate(new) if isinstance(w, str)] if self.prefix else []
        for k, theirs in zip(at, self.library.encode([new[k] for k in at], num_threads=1), strict=True):
            if ids[k] != theirs:
                raise AssertionError(f"ids of {new[k]!r} differ from the library's")
        memo.update(zip(new, map(tuple, ids), strict=True))
        return [w for w in new if len(w if isinstance(w, str) else w[0]) > LONGEST]

    def encode(self, texts: list[str]) -> list[list[int]]:
        cut = [self.words(t) for t in texts]
        long = self.learn(cut)
        out = [list(chain.from_iterable(map(self.memo.__getitem__, words))) for words in cut]
        for w in long:
            del self.memo[w]
        return out

    @property
    def surfaces(self) -> pa.Array:
        """What each id writes, as bytes."""
        text = {UNKNOWN: " ⁇ ", CONTROL: ""}
        return pa.array([bytes([int(p[3:5], 16)]) if k == BYTE else text.get(k, p.replace(MARK, " ")).encode() for p, _, k in self.pieces], pa.binary())

    def decode(self, flat: np.ndarray, ends: np.ndarray, surfaces: pa.Array) -> list[str]:
        """Texts of documents whose ids lie one after another in flat, up to ends each."""
        bytes_ = surfaces.take(pa.array(flat, pa.int32()))
        data = b"".join(x for x in [bytes_.buffers()[2]] if x)
        at = np.frombuffer(bytes_.buffers()[1], np.int32, len(flat) + 1)
        silent = np.cumsum(np.concatenate([[0], self.controls[flat]]))
        out, begin = [], 0
        for end in ends.tolist():
            written = data[at[begin] : at[end]]
            try:
                if silent[begin] != silent[end]:  # ids that write nothing, but end a run of bytes
                    raise ValueError
                text = written.decode()
                out.append(text[1:] if self.prefix and text[:1] == " " and self._blank_first(flat[begin:end]) else text)
            except ValueError:  # bytes that are no text: what stands for them is the library's choice
                out.append(self.library.decode(flat[begin:end].tolist()))
            begin = end
        return out

    def _blank_first(self, ids: np.ndarray) -> bool:
        """Whether the first id is a piece with a blank mark, not the byte of a blank."""
        piece, _, kind = self.pieces[ids[0]]
        return kind in (NORMAL, UNUSED) and piece.startswith(MARK)


_WORDS = re.compile(f"{MARK}*[^{MARK}]+|{MARK}+")


@lru_cache(2)
def vocabulary(path: str) -> Vocabulary:
    return Vocabulary(path)


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def encoded(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, ids (array of int) of each row of docs."""
    tune(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = vocabulary(path)
        for b in batches:
            ids = v.encode(b.column("text").to_pylist())
            ends = np.cumsum([0, *map(len, ids)], dtype=np.int32)
            flat = pa.array([i for d in ids for i in d], pa.int32())
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.ListArray.from_arrays(pa.array(ends), flat)], ["doc_id", "ids"])

    return texts_of(docs).mapInArrow(run, "doc_id long, ids array<int>")


def decoded(encodings: DataFrame, path: str) -> DataFrame:
    """doc_id, ids and the text that they write."""
    tune(encodings.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = vocabulary(path)
        surfaces = v.surfaces
        for b in batches:
            ids = b.column("ids")
            lengths = np.array([0 if n is None else n for n in ids.value_lengths().to_pylist()], np.int64)
            texts = v.decode(ids.flatten().to_numpy(zero_copy_only=False), np.cumsum(lengths), surfaces)
            known = ids.is_valid().to_pylist()
            texts = pa.array([t if k else None for t, k in zip(texts, known, strict=True)], pa.string())
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), ids, texts], ["doc_id", "ids", "text"])

    return encodings.select("doc_id", "ids").mapInArrow(run, "doc_id long, ids array<int>, text string")


def verified(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, same_ids, same_text: whole texts held against the library, batch by batch."""
    tune(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = vocabulary(path)
        surfaces = v.surfaces
        for b in batches:
            texts = b.column("text").to_pylist()
            ids = v.encode(texts)
            theirs = v.library.encode(texts, num_threads=1)
            mine = v.decode(np.array([i for d in ids for i in d], np.int32), np.cumsum([*map(len, ids)]), surfaces)
            same = [pa.array([x == y for x, y in zip(*two, strict=True)], pa.bool_()) for two in ((ids, theirs), (mine, v.library.decode(theirs)))]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), *same], ["doc_id", "same_ids", "same_text"])

    return texts_of(docs).mapInArrow(run, "doc_id long, same_ids boolean, same_text boolean")


def op13_sentencepiece_agenda(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = default_vocabulary()
    out = decoded(encoded(read(spark, sf_dir, "documents"), path), path)
    ids = F.array_join(F.col("ids").cast("array<string>"), ",")
    return out.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(ids, 256).alias("ids_sha256"), F.sha2("text", 256).alias("decoded_sha256"))
