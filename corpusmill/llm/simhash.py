"""SimHash near-duplicates by bit-sliced comparison.

Fingerprints are 64-bit SimHashes of word shingles. Distinct fingerprints meet in buckets of equal bits: five
blocks of bits, of which any two must agree when at most three bits differ, so ten tables lose no link. Within a
bucket the fingerprints are stored as vertical bit planes; a plane updates the distances of 64 fingerprints at a
time with carry-save counters, and a block is abandoned once all its distances exceed the radius.

Defined results: null or empty text has fingerprint 0 and links like any other; repeated rows share a fingerprint
and so a component; a null id stays as a row, and takes part in its component without naming it (the smallest
known id does). An empty table gives an empty result. Columns other than the id and the text are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusmill.llm.common import read, texts_of, tune, write_cut
from corpusmill.llm.components import connected_components

RADIUS = 3
SEED = 42
#: Sizes of the bit blocks; any two of them agree between fingerprints within RADIUS.
BLOCKS = (13, 13, 13, 13, 12)
#: Fingerprints of a tile; a larger bucket is compared tile by tile.
TILE = 2048
#: Fingerprints from different small buckets that are compared in one go.
CHUNK = 512

_LANES = np.uint64(0x0101010101010101)
_ALL = np.uint64(0xFFFFFFFFFFFFFFFF)


def shingle_hashes(text: str, width: int) -> list[int]:
    """XXH64 of each shingle; bytes.lower() changes A-Z alone and bytes.split() cuts at the six ASCII blanks."""
    words = text.encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return []
    digest = xxhash.xxh64_intdigest
    if len(words) < width:
        return [digest(b" ".join(words), SEED)]
    columns = (words[i:] for i in range(width))
    return [digest(b" ".join(s), SEED) for s in zip(*columns, strict=False)]


def simhash_batch(texts: list[str], width: int) -> np.ndarray:
    """Fingerprints as uint64. Bit counts are added in byte lanes, at most 255 shingles at a time."""
    hashes = [shingle_hashes(t, width) for t in texts]
    sizes = np.fromiter(map(len, hashes), np.int64, len(hashes))
    out = np.zeros(len(texts), np.uint64)
    full = np.flatnonzero(sizes)
    if not len(full):
        return out
    flat = np.concatenate([np.array(hashes[i], np.uint64) for i in full])
    n = sizes[full]
    begin = np.cumsum(n) - n
    pieces = (n + 254) // 255
    first = np.cumsum(pieces) - pieces
    at = np.repeat(begin, pieces) + 255 * (np.arange(pieces.sum()) - np.repeat(first, pieces))
    for k in range(8):
        lanes = np.add.reduceat((flat >> np.uint64(k)) & _LANES, at)
        counts = np.add.reduceat(lanes.view(np.uint8).reshape(-1, 8).astype(np.int64), first, axis=0)
        for byte in range(8):
            out[full] |= (2 * counts[:, byte] > n).astype(np.uint64) << np.uint64(8 * byte + k)
    return out


def fingerprint_of(hashes: np.ndarray) -> int:
    """One text's fingerprint from its shingle hashes."""
    n = len(hashes)
    if not n:
        return 0
    at = np.arange(0, n, 255)
    out = 0
    for k in range(8):
        counts = np.add.reduceat((hashes >> np.uint64(k)) & _LANES, at).view(np.uint8).reshape(-1, 8).sum(axis=0, dtype=np.int64)
        for byte in np.flatnonzero(2 * counts > n).tolist():
            out |= 1 << (8 * byte + k)
    return out


def fingerprints(docs: DataFrame, width: int = 3) -> DataFrame:
    """doc_id, fp (the fingerprint's bits as a long)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fp = simhash_batch(b.column("text").to_pylist(), width).view(np.int64)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(fp)], ["doc_id", "fp"])

    return texts_of(docs).mapInArrow(run, "doc_id long, fp long")


def bit_planes(fps: np.ndarray) -> np.ndarray:
    """(64, words): bit b of fingerprint i is bit i % 64 of word i // 64 of plane b."""
    pad = np.zeros(-(-len(fps) // 64) * 64, np.uint64)
    pad[: len(fps)] = fps
    bits = np.unpackbits(pad.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    return np.ascontiguousarray(np.packbits(bits.T, axis=1, bitorder="little")).view(np.uint64)


def within(queries: np.ndarray, planes: np.ndarray, n: int, radius: int = RADIUS) -> tuple[np.ndarray, np.ndarray]:
    """Indices (query, fingerprint) of all pairs at distance up to radius.

    Carry-save planes count the differing bits of 64 fingerprints at once. The counters start so that they overflow
    just past the radius; overflow is remembered, and queries whose whole block has overflowed leave the comparison."""
    alive = np.arange(len(queries))
    shape = (len(queries), planes.shape[1])
    over = np.zeros(shape, np.uint64)
    if n % 64:
        over[:, -1] = _ALL << np.uint64(n % 64)
    size = radius.bit_length()
    start = (1 << size) - 1 - radius
    counters = [np.full(shape, _ALL if start >> k & 1 else 0, np.uint64) for k in range(size)]
    for b in range(64):
        carry = planes[b] ^ (np.uint64(0) - ((queries >> np.uint64(b)) & np.uint64(1)))[:, None]
        for c in counters:
            after = c & carry
            c ^= carry
            carry = after
        over |= carry
        if b % 8 == 7:
            keep = (over != _ALL).any(axis=1)
            if not keep.all():
                alive, queries, over, counters = alive[keep], queries[keep], over[keep], [c[keep] for c in counters]
                if not len(alive):
                    break
    q, w = np.nonzero(~over)
    if not len(q):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    bits = np.unpackbits((~over)[q, w].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    r, c = np.nonzero(bits)
    return alive[q[r]], w[r] * 64 + c


def spanning(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """For each of n nodes the smallest node of its component under the links a, b."""
    root = np.arange(n)
    while len(a):
        low = np.minimum(root[a], root[b])
        before = root.copy()
        np.minimum.at(root, root[a], low)
        np.minimum.at(root, root[b], low)
        while (root[root] != root).any():
            root = root[root]
        if (before == root).all():
            break
    return root


def local_links(fps: np.ndarray) -> np.ndarray:
    """A spanning set of the links within fps: rows (smaller, larger) of each local component's star.

    Any two fingerprints of fps within the radius end in one component, whichever bucket each came from."""
    fps = np.unique(fps)
    planes = bit_planes(fps)
    found = []
    for at in range(0, len(fps), 256):
        q, w = within(fps[at : at + 256], planes, len(fps))
        q = q + at
        found.append(np.stack([q[q < w], w[q < w]]))
    root = spanning(len(fps), *np.concatenate(found, axis=1)) if found else np.arange(0)
    far = np.flatnonzero(root != np.arange(len(fps)))
    return np.stack([fps[root[far]], fps[far]], axis=1)


def _link_groups(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Input sorted by unit; small units are compared together, as any link found between them is a link too."""

    def links(parts: list[np.ndarray]) -> pa.RecordBatch:
        found = local_links(np.concatenate(parts).view(np.uint64)).view(np.int64)
        return pa.RecordBatch.from_arrays([pa.array(found[:, 0]), pa.array(found[:, 1])], ["a", "b"])

    unit, open_unit, ready, size = None, [], [], 0
    for batch in batches:
        units = batch.column("unit").to_numpy(zero_copy_only=False)
        fps = batch.column("fp").to_numpy(zero_copy_only=False)
        cuts = [0, *(np.flatnonzero(units[1:] != units[:-1]) + 1), len(units)]
        for i, j in zip(cuts, cuts[1:], strict=False):
            if i == j:
                continue
            if units[i] != unit:
                ready += open_unit
                if size >= CHUNK:
                    yield links(ready)
                    ready, size = [], 0
                unit, open_unit = units[i], []
            open_unit.append(fps[i:j].copy())
            size += j - i
    if ready + open_unit:
        yield links(ready + open_unit)


def _masks() -> list[int]:
    """One for each pair of blocks, as signed longs."""
    ends = np.cumsum(BLOCKS)
    block = [((1 << size) - 1) << int(end - size) for size, end in zip(BLOCKS, ends, strict=True)]
    return [m - (1 << 64) if m >> 63 else m for m in (a | b for a, b in combinations(block, 2))]


def units_of(rows: DataFrame, node: str, tile: int = TILE) -> DataFrame:
    """rows (node, t, key) -> (unit, node): nodes that share a key of a table share a unit; a bucket of over `tile`
    nodes becomes a unit for each pair of tiles. Buckets of one never leave the counting join."""
    sizes = write_cut(rows.groupBy("t", "key").count().where("count > 1"), "buckets")
    tiles = F.ceil(F.col("count") / tile).cast("int")
    met = rows.join(sizes, ["t", "key"]).select(node, "t", "key", tiles.alias("tiles")).withColumn("mine", F.pmod(F.xxhash64(node), F.col("tiles")).cast("int"))
    pairs = met.select(node, "t", "key", "mine", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)).alias("other"))
    return pairs.select(F.xxhash64("t", "key", F.least("mine", "other"), F.greatest("mine", "other")).alias("unit"), node)


def candidate_units(fps: DataFrame, tile: int = TILE) -> DataFrame:
    """(unit, fp) of distinct fingerprints that share two blocks."""
    masks = F.array(*[F.struct(F.lit(i).alias("t"), F.col("fp").bitwiseAND(F.lit(m)).alias("key")) for i, m in enumerate(_masks())])
    return units_of(fps.select("fp", F.explode(masks).alias("m")).select("fp", "m.t", "m.key"), "fp", tile)


#: Rows of units that a task should see.
UNIT_ROWS = 1 << 18


def parts_of(units: DataFrame) -> int:
    """Into how many parts units, a written table, go: the session's number, and more where a part would hold too many rows."""
    return max(int(units.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-units.count() // UNIT_ROWS))


def fingerprint_links(fps: DataFrame, tile: int = TILE) -> DataFrame:
    """(a, b): links of fps that span each component of fingerprints within RADIUS."""
    units = write_cut(candidate_units(fps, tile), "units")
    return units.repartition(parts_of(units), "unit").sortWithinPartitions("unit", "fp").mapInArrow(_link_groups, "a long, b long").distinct()


#: Groups without any known id are numbered from here; such numbers leave as null.
_NO_ID = 1 << 62


def near_duplicates(docs: DataFrame, width: int = 3, tile: int = TILE) -> DataFrame:
    """doc_id, fp, component_id for each row of docs."""
    tune(docs.sparkSession)
    prints = write_cut(fingerprints(docs, width), "fingerprints")
    stand_in = F.lit(_NO_ID) + F.pmod(F.col("fp"), F.lit(_NO_ID))
    classes = write_cut(prints.groupBy("fp").agg(F.min("doc_id").alias("least")).select("fp", F.coalesce("least", stand_in).alias("rep")), "classes")
    links = write_cut(fingerprint_links(classes.select("fp"), tile), "fp-links")
    ends = links.join(classes.select(F.col("fp").alias("a"), F.col("rep").alias("ra")), "a").join(classes.select(F.col("fp").alias("b"), F.col("rep").alias("rb")), "b")
    found = connected_components(ends.select(F.col("ra").alias("a"), F.col("rb").alias("b")))
    named = classes.join(found.withColumnRenamed("node", "rep"), "rep", "left").select("fp", F.coalesce("label", "rep").alias("c"))
    named = write_cut(named.select("fp", F.when(F.col("c") < _NO_ID, F.col("c")).alias("component_id")), "components")
    return prints.join(named, "fp").select("doc_id", "fp", "component_id")


def op10_simhash_bitsliced(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = near_duplicates(read(spark, sf_dir, "documents"))
    return out.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
