"""Quality by attention-based multiple-instance learning.

A document is a bag of passages of PASSAGE words. Each passage is encoded from its own characters and words: how
often classes of characters follow each other, how many words repeat within the passage and from earlier ones, how
long they are. A learned layer encodes these features, gated attention weighs the passages, and the weighted sum
is scored. Weights are learned from document labels alone.

Defined results: null and empty texts are one passage without words and get the score that the model gives it;
repeated rows each get a row; without labels of both kinds every score is the share of label 1 (0.5 without any).
Columns other than id and text are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusmill.llm.common import read, texts_of, tune
from corpusmill.llm.labelled import fold, sample, sigmoid

PASSAGE = 96
#: At most so many labelled documents, and passages of them, are learned from.
TRAIN_ROWS = 6_000
TRAIN_PASSAGES = 60_000
HIDDEN, ATTENTION, EPOCHS = 24, 12, 150
THRESHOLD = 0.7

#: Character classes: blank, lower, upper, digit, comma or stop, other sentence marks, other ASCII, beyond ASCII.
N_CLASS = 8


def _classes() -> np.ndarray:
    out = np.full(256, 7, np.uint8)
    for b in range(128):
        c = chr(b)
        out[b] = 0 if c.isspace() else 1 if c.islower() else 2 if c.isupper() else 3 if c.isdigit() else 4 if c in ",." else 5 if c in "!?:;'\"()-" else 6
    return out


_CLASS = _classes()
N_FEATURES = N_CLASS * N_CLASS + 8


def passages_of(text: str) -> np.ndarray:
    """(passages, N_FEATURES): the features of each passage of the whole text."""
    words = text.split()
    if not words:
        return np.zeros((1, N_FEATURES), np.float32)
    data = np.frombuffer(" ".join(words).encode("utf-8", "surrogatepass"), np.uint8)
    cls = _CLASS[data]
    ends = np.append(np.flatnonzero(data == 32), len(data)) if len(words) > 1 else np.array([len(data)])
    lengths = np.diff(ends, prepend=-1) - 1
    n = -(-len(words) // PASSAGE)
    first = np.arange(n) * PASSAGE
    begin = np.concatenate([[0], ends[first[1:] - 1] + 1])
    size = np.diff(np.append(begin, len(data)))
    at = np.repeat(np.arange(n), size)
    pairs = at[1:] * (N_CLASS * N_CLASS) + cls[:-1].astype(np.int64) * N_CLASS + cls[1:]
    grams = np.bincount(pairs, minlength=n * N_CLASS * N_CLASS).reshape(n, -1) / np.maximum(size, 1)[:, None]
    counts = np.diff(np.append(first, len(words)))
    mean = np.add.reduceat(lengths, first) / counts
    square = np.add.reduceat(lengths * lengths, first) / counts
    long_ = np.add.reduceat((lengths > 20).astype(np.int64), first) / counts
    lines = np.full(n, text.count("\n") / len(words))
    distinct, fresh, seen = np.zeros(n), np.zeros(n), set()
    for k in range(n):
        own = set(words[k * PASSAGE : (k + 1) * PASSAGE])
        distinct[k], before = len(own) / counts[k], len(seen)
        seen |= own
        fresh[k] = (len(seen) - before) / len(own)
    return np.column_stack([np.sqrt(grams), np.log1p(mean), np.sqrt(np.maximum(square - mean * mean, 0)) / 4, long_, lines, distinct, fresh, np.log1p(counts) / 5, np.full(n, len(seen) / len(words))]).astype(np.float32)


@dataclass
class Model:
    p: dict[str, np.ndarray] | None
    base: float

    def score(self, bags: list[np.ndarray]) -> np.ndarray:
        if self.p is None or not bags:
            return np.full(len(bags), self.base)
        x = np.concatenate(bags)
        sizes = np.array([len(b) for b in bags])
        return _forward(self.p, (x - self.p["mean"]) / self.p["std"], np.cumsum(sizes) - sizes, sizes)["out"]


def _forward(p: dict, x: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> dict:
    """Encode, attend within each bag, score."""
    h = np.tanh(x @ p["We"] + p["be"])
    v, u = np.tanh(h @ p["Wv"]), sigmoid(h @ p["Wu"])
    e = (v * u) @ p["wa"]
    e = np.exp(e - np.repeat(np.maximum.reduceat(e, starts), sizes))
    a = e / np.repeat(np.add.reduceat(e, starts), sizes)
    z = np.add.reduceat(a[:, None] * h, starts, axis=0)
    return {"h": h, "v": v, "u": u, "a": a, "z": z, "out": sigmoid(z @ p["wo"] + p["bo"])}


def train(bags: list[np.ndarray], y: np.ndarray, epochs: int = EPOCHS, seed: int = 0) -> Model:
    """Gradient descent (Adam) on the documents' log loss, over whole bags."""
    base = float(y.mean()) if len(y) else 0.5
    if len(set(y.tolist())) < 2:
        return Model(None, base)
    rng = np.random.default_rng(seed)
    x = np.concatenate(bags).astype(np.float64)
    p = {"mean": x.mean(0), "std": x.std(0) + 1e-2}
    x = (x - p["mean"]) / p["std"]
    for name, shape in {"We": (N_FEATURES, HIDDEN), "Wv": (HIDDEN, ATTENTION), "Wu": (HIDDEN, ATTENTION), "wa": (ATTENTION,), "wo": (HIDDEN,)}.items():
        p[name] = rng.normal(0, 1 / math.sqrt(shape[0]), shape)
    p["be"], p["bo"] = np.zeros(HIDDEN), np.array(math.log(base / (1 - base)))
    learned = ["We", "be", "Wv", "Wu", "wa", "wo", "bo"]
    m, s, step = {k: np.zeros_like(p[k]) for k in learned}, {k: np.zeros_like(p[k]) for k in learned}, 0
    offsets = np.cumsum([0, *map(len, bags)])
    for _ in range(epochs):
        order = rng.permutation(len(bags))
        for part in np.array_split(order, max(1, len(bags) // 512)):
            rows = np.concatenate([np.arange(offsets[i], offsets[i + 1]) for i in part])
            sizes = np.array([len(bags[i]) for i in part])
            g = _gradient(p, x[rows], np.cumsum(sizes) - sizes, sizes, y[part])
            step += 1
            for k in learned:
                gk = g[k] + (1e-4 * p[k] if k[0].isupper() else 0)
                m[k] = 0.9 * m[k] + 0.1 * gk
                s[k] = 0.999 * s[k] + 0.001 * gk * gk
                p[k] = p[k] - 0.005 * (m[k] / (1 - 0.9**step)) / (np.sqrt(s[k] / (1 - 0.999**step)) + 1e-8)
    return Model(p, base)


def _gradient(p: dict, x: np.ndarray, starts: np.ndarray, sizes: np.ndarray, y: np.ndarray) -> dict:
    f = _forward(p, x, starts, sizes)
    d_out = (f["out"] - y) / len(y)
    d_z = np.repeat(d_out[:, None] * p["wo"], sizes, axis=0)
    d_a = (d_z * f["h"]).sum(1)
    d_e = f["a"] * (d_a - np.repeat(np.add.reduceat(f["a"] * d_a, starts), sizes))
    d_v = d_e[:, None] * p["wa"] * f["u"] * (1 - f["v"] ** 2)
    d_u = d_e[:, None] * p["wa"] * f["v"] * f["u"] * (1 - f["u"])
    d_h = (f["a"][:, None] * d_z + d_v @ p["Wv"].T + d_u @ p["Wu"].T) * (1 - f["h"] ** 2)
    return {"We": x.T @ d_h, "be": d_h.sum(0), "Wv": f["h"].T @ d_v, "Wu": f["h"].T @ d_u, "wa": (f["v"] * f["u"]).T @ d_e, "wo": f["z"].T @ d_out, "bo": d_out.sum()}


def _bags(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        bags = [passages_of(t).tobytes() for t in b.column("text").to_pylist()]
        yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("y"), pa.array(bags, pa.binary())], ["doc_id", "y", "bag"])


def fit(docs: DataFrame, labels: DataFrame, keep: F.Column, rows: int = TRAIN_ROWS, passages: int = TRAIN_PASSAGES) -> Model:
    """Learn from at most `rows` labelled documents that `keep` admits. Whole documents are taken in the order of
    their ids' hash as long as they fit into `passages`, so that the driver holds a bounded number; one that does not
    fit is passed over, and only the very first may be larger on its own."""
    tune(docs.sparkSession)
    drawn = sample(docs, labels, "quality", keep, rows)
    bags, y, total = [], [], 0
    for r in drawn.mapInArrow(_bags, "doc_id long, y int, bag binary").orderBy(F.xxhash64("doc_id"), "doc_id").toLocalIterator():
        bag = np.frombuffer(r.bag, np.float32).reshape(-1, N_FEATURES)
        if bags and total + len(bag) > passages:
            continue
        total += len(bag)
        bags.append(bag)
        y.append(r.y)
    return train(bags, np.array(y, float))


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, score."""
    tune(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            s = shared.value.score([passages_of(t) for t in b.column("text").to_pylist()])
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(s, pa.float64())], ["doc_id", "score"])

    return texts_of(docs).mapInArrow(run, "doc_id long, score double")


def teaches() -> F.Column:
    """The rows that labels may be learned from."""
    return fold("doc_id", 4) != 2


def op2_quality_attention(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    model = fit(docs, read(spark, sf_dir, "labels"), teaches())
    return score(docs, model).select("doc_id", (fold("doc_id", 4) == 2).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def good(docs: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of docs that reach the threshold."""
    tune(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def quality(texts: pd.Series) -> pd.Series:
        return pd.Series(shared.value.score([passages_of(t or "") for t in texts]))

    return docs.where(quality("text") >= threshold)
