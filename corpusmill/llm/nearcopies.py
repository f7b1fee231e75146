"""Near copies at a similarity of 0.8: the SimHash operator's stage for whole texts.

A 64-bit SimHash within three bits finds few pairs of this similarity, as about ten bits differ, and no set of bit
blocks can index such a radius. So texts meet by MinHash bands of their five-word shingles and are compared there by
the same bit-sliced SimHash distances with a wide radius. What is left is settled in two steps: a bin-wise signature of
the shingle sets settles pairs whose estimated similarity lies four standard errors from 0.8; the others are verified
on the shingle sets themselves, as far as the first step has not brought them together.

Defined results: null and empty texts have the same, empty set of shingles and count as copies of each other; texts
under five words are one shingle; repeated rows are copies; rows of one id that differ in any column are told apart, and
of those the one of the smallest hash may stay; rows with a null id have no name to be chosen by and all stay. An empty
table gives no rows. Extra columns pass through, whatever their names.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusmill.llm.common import tune, write_cut
from corpusmill.llm.components import connected_components
from corpusmill.llm.simhash import CHUNK, bit_planes, fingerprint_of, parts_of, shingle_hashes, spanning, units_of, within

WIDTH, SIMILARITY = 5, 0.8
#: Standard errors of the estimate around the threshold within which a pair is verified on its sets.
ERRORS = 4.0
#: Bands of three minima: a pair at 0.8 shares one with probability 0.997, and one at 0.9 with 0.9999.
BANDS, BAND_ROWS = 8, 3
BINS = 512
#: Shingle sets of a tile: a bucket of more is dealt to several tasks.
TILE = 256
#: Bytes of the shingle sets that a task verifies together; a unit of more is dealt to several, by pairs of its parts.
UNIT_BYTES = 64 << 20
#: A pair at 0.8 differs in about ten bits, an unrelated one in 32.
WIDE = 24

_FACTORS = np.random.default_rng(20).integers(1 << 62, 1 << 63, BANDS * BAND_ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def set_of(text: str, width: int = WIDTH) -> np.ndarray:
    """The distinct shingle hashes of a text, sorted."""
    return np.unique(np.array(shingle_hashes(text, width), np.uint64))


def key_of(h: np.ndarray) -> int:
    """A number that equal sets share."""
    return (int(h.sum(dtype=np.uint64)) ^ len(h) * 0x9E3779B97F4A7C15) & 0xFFFFFFFFFFFFFFFF if len(h) else 0


def bins_of(h: np.ndarray) -> np.ndarray:
    """A byte of the smallest hash in each bin; 0 where a bin has none."""
    bins = np.full(BINS, 1 << 32, np.int64)
    np.minimum.at(bins, (h >> np.uint64(55)).astype(np.int64), (h & np.uint64(0xFFFFFFFF)).astype(np.int64))
    return np.where(bins < 1 << 32, bins % 255 + 1, 0).astype(np.uint8)


def signature(h: np.ndarray) -> tuple[int, int, bytes, list[int]]:
    """(set key, SimHash, bins, band keys) of a set of shingle hashes."""
    if not len(h):
        return 0, 0, bytes(BINS), [0] * BANDS
    least = np.array([(h * f).min() for f in _FACTORS], np.uint64).reshape(BANDS, BAND_ROWS)
    mixed = (least[:, 0] * np.uint64(3) ^ (least[:, 1] >> np.uint64(7)) * np.uint64(5) ^ (least[:, 2] << np.uint64(9))) * np.uint64(0x9E3779B97F4A7C15)
    return key_of(h), fingerprint_of(h), bins_of(h).tobytes(), mixed.view(np.int64).tolist()


def _signed(values: list[int]) -> pa.Array:
    return pa.array(np.array(values, np.uint64).view(np.int64))


def signatures(texts: DataFrame, width: int = WIDTH) -> DataFrame:
    """texts (doc_id, text, h) -> doc_id, h, node (key of the shingle set), fp, bins, bands."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [signature(set_of(t, width)) for t in b.column("text").to_pylist()]
            columns = [_signed([r[0] for r in rows]), _signed([r[1] for r in rows]), pa.array([r[2] for r in rows], pa.binary()), pa.array([r[3] for r in rows], pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("h"), *columns], ["doc_id", "h", "node", "fp", "bins", "bands"])

    return texts.mapInArrow(run, "doc_id long, h long, node long, fp long, bins binary, bands array<long>")


def shingle_sets(texts: DataFrame, width: int = WIDTH) -> DataFrame:
    """texts (text) -> node, shingles: the set's hashes as bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sets = [set_of(t, width) for t in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([_signed([key_of(h) for h in sets]), pa.array([h.tobytes() for h in sets], pa.binary())], ["node", "shingles"])

    return texts.select("text").mapInArrow(run, "node long, shingles binary")


def estimates(bins: np.ndarray, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Similarity of each pair: equal bins over bins that either fills, less what bytes agree on by chance; and how far
    an estimate may lie from the threshold's own value."""
    out, spread = np.empty(len(a)), np.empty(len(a))
    for at in range(0, len(a), 4096):
        x, y = bins[a[at : at + 4096]], bins[b[at : at + 4096]]
        filled = ((x | y) != 0).sum(axis=1)
        same = ((x == y) & (x != 0)).sum(axis=1)
        out[at : at + 4096] = np.where(filled > 0, (same / np.maximum(filled, 1) - 1 / 255) / (1 - 1 / 255), 1.0)
        spread[at : at + 4096] = ERRORS * np.sqrt(SIMILARITY * (1 - SIMILARITY) / np.maximum(filled, 1))
    return out, spread


def near_pairs(fps: np.ndarray, bins: np.ndarray, least: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(a, b, sure) of the pairs within the wide radius whose similarity is surely or perhaps at least `least`."""
    planes = bit_planes(fps)
    found = [np.zeros((3, 0))]
    for at in range(0, len(fps), 256):
        q, w = within(fps[at : at + 256], planes, len(fps), WIDE)
        q = q + at
        q, w = q[q < w], w[q < w]
        value, spread = estimates(bins, q, w)
        may = value >= least - spread
        found.append(np.stack([q, w, value >= least + spread])[:, may])
    a, b, sure = np.concatenate(found, axis=1)
    return a.astype(np.int64), b.astype(np.int64), sure.astype(bool)


def settled(nodes: np.ndarray, fps: np.ndarray, bins: np.ndarray, least: float) -> tuple[np.ndarray, np.ndarray]:
    """Rows (root, node) that span the sure links among nodes; and the nodes of pairs that are open and not joined by them."""
    nodes, first = np.unique(nodes, return_index=True)
    a, b, sure = near_pairs(fps[first], bins[first], least)
    root = spanning(len(nodes), a[sure], b[sure])
    far = np.flatnonzero(root != np.arange(len(nodes)))
    apart = ~sure & (root[a] != root[b])
    return np.stack([nodes[root[far]], nodes[far]], axis=1), nodes[np.unique(np.concatenate([a[apart], b[apart]]))]


def verified(nodes: np.ndarray, labels: np.ndarray, sets: list[np.ndarray], least: float) -> np.ndarray:
    """Rows (node, node): links of at least `least` on the sets, between nodes that neither labels nor earlier links join."""
    a, b, _ = near_pairs(np.array([fingerprint_of(h) for h in sets], np.uint64), np.array([bins_of(h) for h in sets]), least)
    sizes = np.array([len(h) for h in sets])
    may = (labels[a] != labels[b]) & (np.minimum(sizes[a], sizes[b]) >= np.maximum(1, least * np.maximum(sizes[a], sizes[b]) - 1e-9))
    a, b = a[may], b[may]
    group = np.unique(labels, return_inverse=True)[1].tolist()
    root = list(range(len(sets)))

    def find(i: int) -> int:
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    values, ids = np.unique(np.concatenate(sets), return_inverse=True)
    own = np.split(ids, np.cumsum(sizes)[:-1])
    present, out = np.zeros(len(values), bool), []
    for i in np.unique(a).tolist():
        js = [j for j in b[a == i].tolist() if find(group[i]) != find(group[j])]
        if not js:
            continue
        present[own[i]] = True
        n = sizes[js]
        both = np.add.reduceat(present[np.concatenate([own[j] for j in js])], np.cumsum(n) - n, dtype=np.int64)
        present[own[i]] = False
        for j in np.array(js)[both >= least * (sizes[i] + n - both) - 1e-9].tolist():
            x, y = find(group[i]), find(group[j])
            if x != y:
                root[x] = y
                out.append((nodes[i], nodes[j]))
    return np.array(out, np.int64).reshape(-1, 2)


def near_links(classes: DataFrame, least: float = SIMILARITY, tile: int = TILE) -> DataFrame:
    """classes (node, fp, bins, bands: one row per shingle set) -> (unit, a, b): links that span the sure groups of near
    copies; where b is null, a is a node of an open pair whose nodes meet in the unit."""
    rows = classes.select("node", F.posexplode("bands").alias("t", "key"))
    units = write_cut(units_of(rows, "node", tile), "near-units")

    def links(parts: list[tuple]) -> pa.RecordBatch:
        unit = parts[0][0]
        nodes, fps = (np.concatenate([p[k] for p in parts]) for k in (1, 2))
        bins = np.frombuffer(b"".join(x for p in parts for x in p[3]), np.uint8).reshape(-1, BINS)
        sure, open_ = settled(nodes, fps.view(np.uint64), bins, least)
        a = pa.array(np.concatenate([sure[:, 0], open_]))
        b = pa.concat_arrays([pa.array(sure[:, 1]), pa.nulls(len(open_), pa.int64())])
        return pa.RecordBatch.from_arrays([pa.array(np.full(len(a), unit, np.int64)), a, b], ["unit", "a", "b"])

    told = units.join(classes.select("node", "fp", "bins"), "node").select("unit", "node", "fp", "bins")
    return _by_unit(told, parts_of(units), links, CHUNK, "unit long, a long, b long").distinct()


def verified_links(open_: DataFrame, labels: DataFrame, sets: DataFrame, least: float = SIMILARITY, unit_bytes: int = UNIT_BYTES) -> DataFrame:
    """open_ (unit, node), labels (node, label) of the groups so far, sets (node, shingles) -> (a, b): further links.

    A unit whose sets take more than unit_bytes is cut into parts, and each pair of parts is a unit of its own, so that
    what a worker holds does not grow with the length of texts, but for single ones."""
    labelled = write_cut(open_.join(labels, "node", "left").select("unit", "node", F.coalesce("label", "node").alias("label")), "open-labels")
    # units whose nodes have all met by now have nothing left to verify
    sizes = sets.select("node", F.octet_length("shingles").alias("size"))
    weighed = labelled.join(sizes, "node").groupBy("unit").agg((F.min("label") < F.max("label")).alias("several"), F.sum("size").alias("bytes"))
    parts = weighed.where("several").select("unit", F.when(F.col("bytes") <= unit_bytes, 1).otherwise(F.ceil(2 * F.col("bytes") / unit_bytes)).cast("int").alias("parts"))
    met = labelled.join(parts, "unit").withColumn("mine", F.pmod(F.xxhash64("node"), F.col("parts")).cast("int"))
    pairs = met.select("unit", "node", "label", "mine", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("other"))
    told = pairs.select(F.xxhash64("unit", F.least("mine", "other"), F.greatest("mine", "other")).alias("unit"), "node", "label").join(sets, "node")

    def links(parts: list[tuple]) -> pa.RecordBatch:
        nodes, labels_ = (np.concatenate([p[k] for p in parts]) for k in (1, 2))
        own = [np.frombuffer(x, np.uint64) for p in parts for x in p[3]]
        out = verified(nodes, labels_, own, least)
        return pa.RecordBatch.from_arrays([pa.array(out[:, 0]), pa.array(out[:, 1])], ["a", "b"])

    return _by_unit(told.select("unit", "node", "label", "shingles"), parts_of(open_), links, 1, "a long, b long").distinct()


def _by_unit(rows: DataFrame, n: int, links: Callable[[list[tuple]], pa.RecordBatch], chunk: int, schema: str) -> DataFrame:
    """links of each unit's rows (unit, two columns of longs, a column of bytes), in n parts. Units of under `chunk` rows together
    are handed over in one go, as what is near between them is near, too."""
    names = rows.columns[1:]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unit, ready, held, size = None, [], [], 0
        for batch in batches:
            u, x, y = (batch.column(c).to_numpy(zero_copy_only=False).copy() for c in ("unit", *names[:2]))
            data = batch.column(names[2]).to_pylist()
            cuts = [0, *(np.flatnonzero(u[1:] != u[:-1]) + 1), len(u)]
            for i, j in zip(cuts, cuts[1:], strict=False):
                if i == j:
                    continue
                if u[i] != unit:
                    ready += held
                    if size >= chunk:
                        yield links(ready)
                        ready, size = [], 0
                    unit, held = u[i], []
                held.append((u[i], x[i:j], y[i:j], data[i:j]))
                size += j - i
        if ready + held:
            yield links(ready + held)

    return rows.repartition(n, "unit").sortWithinPartitions("unit").mapInArrow(run, schema)


def keep_one(docs: DataFrame, similarity: float = SIMILARITY, tile: int = TILE, unit_bytes: int = UNIT_BYTES) -> DataFrame:
    """The rows of docs without near copies: of each group the document with the smallest id stays, once."""
    tune(docs.sparkSession)
    h, taken = "_row_hash", {c.lower() for c in docs.columns}  # Spark tells names apart without their case
    while h in taken:
        h += "_"
    others = [f"`{c}`" for c in docs.columns if c.lower() not in ("doc_id", "text")]
    row = [F.coalesce("text", F.lit("")), *([F.to_json(F.struct(*others))] if others else [])]
    named = docs.where("doc_id IS NOT NULL").withColumn(h, F.xxhash64(*row))
    texts = named.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"), F.col(h).alias("h"))
    signed = write_cut(signatures(texts), "signatures")
    classes = write_cut(signed.select("node", "fp", "bins", "bands").dropDuplicates(["node"]), "shingle-sets")
    holders = write_cut(signed.groupBy("node").agg(F.min(F.struct("doc_id", "h")).alias("first")), "set-holders")
    found = write_cut(near_links(classes, similarity, tile), "near-links")
    sure = found.where("b IS NOT NULL").select("a", "b")
    open_ = write_cut(found.where("b IS NULL").select("unit", F.col("a").alias("node")), "open-pairs")
    # one text for each set that is in an open pair; only those are shingled again and moved
    wanted = open_.select("node").distinct().join(holders, "node").select("first.doc_id", "first.h").distinct()
    sets = write_cut(shingle_sets(texts.join(wanted, ["doc_id", "h"], "left_semi").dropDuplicates(["doc_id", "h"])), "open-sets")
    further = write_cut(verified_links(open_, connected_components(sure), sets, similarity, unit_bytes), "verified-links")
    groups = connected_components(sure.unionByName(further))
    group = holders.join(groups, "node", "left").select(F.coalesce("label", "node").alias("group"), "first")
    kept = write_cut(group.groupBy("group").agg(F.min("first").alias("first")).select("first.doc_id", F.col("first.h").alias(h)).distinct(), "kept-ids")
    return named.join(kept, ["doc_id", h], "left_semi").dropDuplicates(["doc_id", h]).select(docs.columns).unionByName(docs.where("doc_id IS NULL"))
