"""Toxic passages by maximum-scoring segments.

Tokens get log-odds of toxic against other labelled documents under an informative Dirichlet prior (the labelled
tokens' own frequencies); only tokens whose log-odds stand out keep them, every other token costs a drift. A token is
counted once with each token before it, so that copies, shared passages and repetitions teach nothing twice; a word
that is not known itself counts as its stem, its first letters. A linear scan finds all maximal scoring segments of a
text. Their scores are judged against the extreme-value law of the best segment in clean text of the same length; the
evidence of all significant segments is summed and mapped to 0 to 1.

What counts as standing out, the prior's weight and the drift are a Setting; the best of GRID is chosen by
cross-validation within the labelled rows that may be learned from: each document is scored with the log-odds of the
other folds, which also fit the extreme-value law and the map to 0 to 1. No other row takes part in any choice.

Defined results: null and empty texts have no segment and get the score of no evidence; repeated rows each get a
row; without labels of both kinds there is nothing to learn, no segment is found, and every score is the share of
toxic labels (0 without any). Columns other than id and text are not read.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import product
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusmill.llm.common import read, texts_of, tune, write_cut
from corpusmill.llm.labelled import fold, logistic_fit, sample, sigmoid

#: At most so many labelled documents are learned from, half of them of each kind: bounds what a task holds.
TRAIN_ROWS = 10_000
#: Parts of the labelled sample: each is scored by what the others teach.
FOLDS = 4
#: Letters of a stem; longer words have one.
STEM = 5
THRESHOLD = 0.7


class Setting(NamedTuple):
    """Which tokens keep their log-odds, and what the others cost."""

    prior: float  # the prior's weight as a share of the labelled counts
    contexts: int  # least contexts in toxic documents
    z: float  # least z-score
    odds: float  # least log-odds
    drift: float  # of every other token, below 0


GRID = tuple(Setting(*x) for x in product((0.05, 0.3), (3, 5), (1.6, 2.3, 3.2), (2.0, 3.0), (-0.25, -0.5)))

_WORD = re.compile(r"[^\W\d_]+")


def tokens_of(text: str) -> list[str]:
    return _WORD.findall(text.lower())


def maximal_segments(scores: list[tuple[int, float]], n: int, drift: float) -> list[tuple[int, int, float]]:
    """(first, last, score) of every maximal scoring segment of n tokens, in linear time in the tokens that score.

    scores: (position, score > 0) in order; all other tokens score `drift`, below 0. A segment is maximal if no
    longer or shorter one around it scores higher. Each entry keeps the running total before and after it, and a link
    to the nearest earlier entry that starts lower; a new one is joined with that entry, as long as it ends higher.
    A link that is followed is never followed again: the new entry's own link passes over it."""
    firsts: list[int] = []
    lasts: list[int] = []
    befores: list[float] = []
    afters: list[float] = []
    links: list[int] = []
    total, at = 0.0, 0
    for position, score in scores:
        before = total + drift * (position - at)
        total, at = before + score, position + 1
        first, k = position, len(firsts) - 1
        while True:
            while k >= 0 and befores[k] >= before:
                k = links[k]
            if k < 0 or afters[k] >= total:
                break
            first, before, link = firsts[k], befores[k], links[k]
            del firsts[k:], lasts[k:], befores[k:], afters[k:], links[k:]
            k = link
        firsts.append(first)
        lasts.append(position)
        befores.append(before)
        afters.append(total)
        links.append(k)
    return [(a, z, after - before) for a, z, before, after in zip(firsts, lasts, befores, afters, strict=True)]


@dataclass
class Model:
    log_odds: dict[str, float] = field(default_factory=dict)
    drift: float = GRID[0].drift
    rate: float = 1.0  # the extreme-value law's decay, usually lambda
    size: float = 1.0  # its K
    weights: tuple[float, float] = (0.0, -30.0)

    def hits(self, text: str) -> tuple[int, list[tuple[int, float]]]:
        """How many tokens text has; position and log-odds of those that point to toxic."""
        tokens = tokens_of(text)
        get = self.log_odds.get
        scores = (get(t) or (get(t[:STEM] + "*") if len(t) > STEM else None) for t in tokens)
        return len(tokens), [(i, s) for i, s in enumerate(scores) if s is not None]

    def segments(self, text: str) -> tuple[int, list[tuple[int, int, float]]]:
        n, found = self.hits(text)
        return n, maximal_segments(found, n, self.drift) if found else []

    def evidence(self, n: int, segments: list[tuple[int, int, float]]) -> float:
        """Sum over segments of how far each exceeds chance: -log of its expected number in n clean tokens."""
        least = math.log(self.size * n) if n else 0.0
        return sum(max(0.0, self.rate * s - least) for *_, s in segments)

    def score(self, texts: list[str]) -> np.ndarray:
        e = np.array([self.evidence(*self.segments(t)) for t in texts])
        return sigmoid(self.weights[0] * np.log1p(e) + self.weights[1])


def log_odds(y1: np.ndarray, y0: np.ndarray, n1: np.ndarray, n0: np.ndarray, prior: float) -> tuple[np.ndarray, np.ndarray]:
    """(log-odds, z) of toxic against other contexts of tokens that y1 of n1 and y0 of n0 contexts hold."""
    alpha, weight = (y1 + y0) * prior + 1e-9, (n1 + n0) * prior + 1e-6
    odds = np.log((y1 + alpha) / (n1 + weight - y1 - alpha)) - np.log((y0 + alpha) / (n0 + weight - y0 - alpha))
    return odds, odds / np.sqrt(1 / (y1 + alpha) + 1 / (y0 + alpha))


def token_contexts(drawn: DataFrame) -> DataFrame:
    """drawn (text, y, part) -> token, y1, y0: arrays of the contexts that documents of each kind hold, without each
    part in turn and, last, without none. A stem ends with *."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            kinds: dict[tuple[str, str], int] = {}
            for text, y, part in zip(*(b.column(c).to_pylist() for c in ("text", "y", "part")), strict=True):
                tokens = tokens_of(text)
                for pair in set(zip(tokens, ["", *tokens], strict=False)):
                    kinds[pair] = kinds.get(pair, 0) | 1 << 2 * part + y
            columns = [[t for t, _ in kinds], [c for _, c in kinds]]
            yield pa.RecordBatch.from_arrays([*(pa.array(c, pa.string()) for c in columns), pa.array(kinds.values(), pa.int32())], ["token", "before", "kinds"])

    def counts(y: int) -> F.Column:
        masks = [sum(1 << 2 * part + y for part in range(FOLDS) if part != out) for out in range(FOLDS + 1)]
        return F.array(*[F.count_if(F.col("kinds").bitwiseAND(m) != 0) for m in masks])

    pairs = drawn.mapInArrow(run, "token string, before string, kinds int").groupBy("token", "before").agg(F.bit_or("kinds").alias("kinds"))
    names = F.when(F.length("token") > STEM, F.array("token", F.concat(F.substring("token", 1, STEM), F.lit("*")))).otherwise(F.array("token"))
    return pairs.select(F.explode(names).alias("token"), "kinds").groupBy("token").agg(counts(1).alias("y1"), counts(0).alias("y0"))


@dataclass
class Counts:
    """Contexts of the tokens that any setting may keep, and of all tokens; the last axis is the part left out."""

    at: dict[str, int]
    y1: np.ndarray
    y0: np.ndarray
    n1: np.ndarray
    n0: np.ndarray

    def kept(self, s: Setting) -> np.ndarray:
        """Log-odds of each token and part left out; nan where the setting does not keep the token."""
        odds, z = log_odds(self.y1, self.y0, self.n1, self.n0, s.prior)
        return np.where((self.y1 >= s.contexts) & (z >= s.z) & (odds >= s.odds), odds, np.nan)


def counted(contexts: DataFrame) -> Counts:
    """Only tokens that are likelier in toxic text come to the driver; the bounded sample of texts bounds them. Those
    that no setting keeps go there."""
    size = lambda c: [F.sum(F.col(c)[e]).alias(f"{c}{e}") for e in range(FOLDS + 1)]
    sums = contexts.agg(*size("y1"), *size("y0")).first()
    n1, n0 = (np.array([float(sums[f"{c}{e}"] or 0) for e in range(FOLDS + 1)]) for c in ("y1", "y0"))
    all1, all0 = F.col("y1")[FOLDS], F.col("y0")[FOLDS]
    rows = contexts.where((all1 >= min(s.contexts for s in GRID)) & (all1 * float(n0[FOLDS]) > all0 * float(n1[FOLDS]))).orderBy("token").collect()
    table = lambda c: np.array([r[c] for r in rows], float).reshape(-1, FOLDS + 1)
    found = Counts({}, table("y1"), table("y0"), n1, n0)
    some = np.zeros(len(rows), bool)
    for s in GRID:
        some |= (~np.isnan(found.kept(s))).any(axis=1)
    tokens = [rows[i].token for i in np.flatnonzero(some)]
    return Counts({t: i for i, t in enumerate(tokens)}, found.y1[some], found.y0[some], n1, n0)


def decay(score: float, frequency: float, drift: float) -> float:
    """The positive root of the mean of exp(rate * x) = 1 over clean tokens, of which `frequency` score `score` and the rest drift."""

    def mean(rate: float) -> float:
        return (1 - frequency) * math.exp(rate * drift) + frequency * math.exp(min(rate * score, 500)) - 1

    low, high = 1e-3, 1.0
    if mean(low) >= 0:
        return low
    while mean(high) < 0 and high < 64:
        high *= 2
    for _ in range(60):
        mid = (low + high) / 2
        low, high = (mid, high) if mean(mid) < 0 else (low, mid)
    return high


def measured(drawn: DataFrame, counts: Counts) -> DataFrame:
    """y, n, and for each setting of GRID the scores of a document's segments, by the log-odds of the other parts, and
    the number and sum of its tokens that score; a written table."""
    shared = drawn.sparkSession.sparkContext.broadcast(counts)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = shared.value
        tables = [np.append(c.kept(s), np.full((1, FOLDS + 1), np.nan), axis=0) for s in GRID]
        for b in batches:
            n, segments, hits, sums = [], [], [], []
            for text, part in zip(b.column("text").to_pylist(), b.column("part").to_pylist(), strict=True):
                tokens = tokens_of(text)
                pairs = ((i, c.at.get(t, -1), c.at.get(t[:STEM] + "*", -1) if len(t) > STEM else -1) for i, t in enumerate(tokens))
                places, words, stems = np.array([p for p in pairs if p[1] >= 0 or p[2] >= 0], np.int64).reshape(-1, 3).T
                found = []
                for table in tables:
                    own = table[:, part]
                    scores = np.where(np.isnan(own[words]), own[stems], own[words])
                    at = np.flatnonzero(~np.isnan(scores))
                    found.append((places[at].tolist(), scores[at].tolist()))
                n.append(len(tokens))
                hits.append([len(x) for x, _ in found])
                sums.append([sum(x) for _, x in found])
                segments.append([[x for *_, x in maximal_segments(list(zip(*f, strict=True)), len(tokens), s.drift)] for f, s in zip(found, GRID, strict=True)])
            types = (pa.int64(), pa.list_(pa.list_(pa.float64())), pa.list_(pa.int64()), pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("y"), *(pa.array(x, t) for x, t in zip((n, segments, hits, sums), types, strict=True))], ["doc_id", "y", "n", "segments", "hits", "sums"])

    return write_cut(drawn.select("doc_id", "text", "y", "part").mapInArrow(run, "doc_id long, y int, n long, segments array<array<double>>, hits array<long>, sums array<double>"), "segments")


def laws(rows: pd.DataFrame, means: list[float]) -> list[Model]:
    """The extreme-value law of each setting, from clean documents.

    rows: y, n, and for each setting the number and sum of tokens that score and the best segment."""
    clean = rows[rows.y == 0]
    n, out = clean.n.to_numpy(), []
    for k, (s, mean_score) in enumerate(zip(GRID, means, strict=True)):
        model = Model(drift=s.drift)
        # clean tokens that score, smoothed by one: how often, and how much on the whole
        tokens, hits = max(1, int(n.sum())), int(sum(x[k] for x in clean.hits))
        typical = (float(sum(x[k] for x in clean["sums"])) + mean_score) / (hits + 1)
        model.rate = decay(typical, min(0.5, (hits + 1) / (tokens + 1)), model.drift)
        best = np.array([x[k] for x in clean.best])
        model.size = max(len(clean) / max(float((n * np.exp(-model.rate * best)).sum()), 1e-9), 1e-9)
        out.append(model)
    return out


def evidence_of(found: DataFrame, models: list[Model]) -> DataFrame:
    """doc_id, y, e: for each setting what a document's segments say under its law, as Model.evidence."""

    def sum_of(k: int, m: Model) -> F.Column:
        least = F.when(F.col("n") > 0, F.log(F.col("n") * m.size)).otherwise(0.0)
        return F.aggregate(F.col("segments")[k], F.lit(0.0), lambda total, x: total + F.greatest(F.lit(0.0), x * m.rate - least))

    return found.select("doc_id", "y", F.array(*[sum_of(k, m) for k, m in enumerate(models)]).alias("e"))


def calibrated(model: Model, y: np.ndarray, evidence: np.ndarray, share: float) -> float:
    """Gives the model the map from evidence to a score; its log loss.

    share: of toxic labels among all that may be learned from; the sample's kinds are weighed to it."""
    e = np.log1p(evidence)
    weight = np.where(y == 1, share / max(y.mean(), 1e-9), (1 - share) / max(1 - y.mean(), 1e-9))
    slope, cut = logistic_fit(e[:, None], y, 0.1, weight)
    model.weights = (float(max(slope, 0.0)), float(cut))
    p = np.clip(sigmoid(model.weights[0] * e + model.weights[1]), 1e-9, 1 - 1e-9)
    return float(-(weight * (y * np.log(p) + (1 - y) * np.log(1 - p))).mean())


def fit(docs: DataFrame, labels: DataFrame, keep: F.Column, rows: int = TRAIN_ROWS) -> Model:
    """Learn from at most `rows` labelled documents that `keep` admits; only token counts and scores reach the driver."""
    tune(docs.sparkSession)
    drawn = sample(docs, labels, "toxic", keep, rows, balanced=True)
    known = labels.where(F.col("doc_id").isNotNull() & F.col("toxic").isin(0, 1) & keep).agg(F.avg("toxic")).first()[0]
    share = min(max(float(known or 0), 1e-9), 1 - 1e-9)
    if drawn.select("y").distinct().count() < 2:
        return Model(weights=(0.0, math.log(share / (1 - share))))
    drawn = drawn.withColumn("part", F.pmod(F.xxhash64("doc_id", F.lit(1)), F.lit(FOLDS)).cast("int"))
    counts = counted(write_cut(token_contexts(drawn.select("text", "y", "part")), "contexts"))
    found = measured(drawn, counts)
    # a row for each drawn document, and in it a number or two for each setting: segments stay where they are
    first = F.transform("segments", lambda x: F.coalesce(F.array_max(x), F.lit(0.0))).alias("best")
    rows_ = found.select("doc_id", "y", "n", "hits", "sums", first).toPandas().sort_values(["doc_id", "n"], ignore_index=True)
    kept = [counts.kept(s)[:, FOLDS] for s in GRID]
    models = laws(rows_, [float(np.nanmean(odds)) if (~np.isnan(odds)).any() else 1.0 for odds in kept])
    said = evidence_of(found, models).toPandas().assign(e=lambda t: t.e.map(tuple)).sort_values(["doc_id", "y", "e"], ignore_index=True)
    y, e = said.y.to_numpy(float), np.array(said.e.tolist(), float).reshape(-1, len(GRID))
    best, model, own = math.inf, Model(), np.zeros(0)
    for k, m in enumerate(models):
        loss = calibrated(m, y, e[:, k], share)
        if loss < best:
            best, model, own = loss, m, kept[k]
    model.log_odds = {t: float(own[i]) for t, i in counts.at.items() if not np.isnan(own[i])}
    return model


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, score, and the passages found: spans of token positions with their scores."""
    tune(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for b in batches:
            found = [m.segments(t) for t in b.column("text").to_pylist()]
            e = np.array([m.evidence(*f) for f in found])
            spans = pa.array([[{"first": a, "last": z, "score": s} for a, z, s in f if m.evidence(n, [(a, z, s)]) > 0] for n, f in found], pa.list_(_SPAN))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(sigmoid(m.weights[0] * np.log1p(e) + m.weights[1]), pa.float64()), spans], ["doc_id", "score", "passages"])

    return texts_of(docs).mapInArrow(run, "doc_id long, score double, passages array<struct<first: long, last: long, score: double>>")


_SPAN = pa.struct([("first", pa.int64()), ("last", pa.int64()), ("score", pa.float64())])


def teaches() -> F.Column:
    """The rows that labels may be learned from."""
    return fold("doc_id", 3) != 1


def op9_toxic_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    model = fit(docs, read(spark, sf_dir, "labels"), teaches())
    out = score(docs, model)
    return out.select("doc_id", (fold("doc_id", 3) == 1).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"), F.size("passages").cast("long").alias("passages"))


def clean(docs: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of docs that score under the threshold; only texts go to Python, and only scores come back."""
    tune(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def toxicity(texts: pd.Series) -> pd.Series:
        return pd.Series(shared.value.score([t or "" for t in texts]))

    return docs.where(toxicity("text") < threshold)
