"""The corpus pipeline: each stage takes (spark, docs, sf_dir) and returns a DataFrame, written and reread as the next
one's docs. Every stage works on all that the one before kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from corpusmill.llm import decontaminate, nearcopies, packing, quality, toxicity
from corpusmill.llm.common import read, write_cut


def toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score as toxic go. Learned from the labelled rows of docs that the operator may learn from."""
    model = toxicity.fit(docs, read(spark, sf_dir, "labels"), toxicity.teaches())
    return toxicity.clean(docs, model)


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents under the quality threshold go."""
    model = quality.fit(docs, read(spark, sf_dir, "labels"), quality.teaches())
    return quality.good(docs, model)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies the document with the smallest id stays."""
    return nearcopies.keep_one(docs)


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a passage of the benchmark go."""
    return decontaminate.without_leaks(docs, read(spark, sf_dir, "benchmark"))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents that are left, in sequences of at most 2048 tokens."""
    return packing.pack(docs, packing.default_vocabulary())


STAGES = [("toxicity", toxic), ("quality", good_quality), ("near-dedup", near_dedup), ("decontamination", decontaminated), ("packing", packed)]

#: The learned stages and the token packing have no SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each result but the last is written to the shared folder."""
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = write_cut(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
