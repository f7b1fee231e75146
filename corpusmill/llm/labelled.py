"""What the two learned operators share: a bounded sample of labelled rows, and a logistic fit."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusmill.llm.common import write_cut


def fold(column: str, n: int) -> F.Column:
    """crc32 of the id as text, modulo n; a null id counts as the empty text."""
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary")) % n


def sample(docs: DataFrame, labels: DataFrame, label: str, keep: F.Column, rows: int, balanced: bool = False) -> DataFrame:
    """(doc_id, y, text): at most `rows` labelled documents, those with the smallest hash of their ids; `balanced`: at
    most half as many of each kind, so that a rare kind is not drawn by its share alone.

    Every document may be drawn, and the bound does not grow with the corpus. Exact copies count once."""
    known = labels.where(F.col("doc_id").isNotNull() & F.col(label).isin(0, 1) & keep)
    each = known.groupBy("doc_id").agg(F.max(label).cast("int").alias("y"))
    first = lambda df, n: df.orderBy(F.xxhash64("doc_id"), "doc_id").limit(n)
    drawn = first(each.where("y = 1"), rows // 2).union(first(each.where("y = 0"), rows // 2)) if balanced else first(each, rows)
    texts = docs.select(F.col("doc_id").cast("long"), F.coalesce("text", F.lit("")).alias("text"))
    # at most `rows` pairs of an id and a label: the bound makes the broadcast safe at any size of the corpus
    both = texts.join(F.broadcast(drawn.select(F.col("doc_id").cast("long"), "y")), "doc_id")
    return write_cut(both.groupBy("text").agg(F.min("doc_id").alias("doc_id"), F.max("y").alias("y")).select("doc_id", "y", "text"), "labelled")


def logistic_fit(x: np.ndarray, y: np.ndarray, ridge: float = 1e-3, weight: np.ndarray | None = None) -> np.ndarray:
    """Weights of the columns of x, the last of which is an intercept, by Newton's method; rows count by `weight`."""
    x = np.column_stack([x, np.ones(len(x))])
    c = np.ones(len(x)) if weight is None else weight
    w = np.zeros(x.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        gradient = x.T @ (c * (p - y)) + ridge * w
        step = np.linalg.solve((x * (c * p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(w)), gradient)
        w -= step
        if np.abs(step).max() < 1e-9:
            break
    return w


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))
