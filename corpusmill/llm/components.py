"""Connected components as iterated joins: smallest label of the neighbours, then one pointer jump."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusmill.llm.common import write_cut


def connected_components(edges: DataFrame) -> DataFrame:
    """edges (a long, b long) -> (node, label): the smallest node that can be reached. Rows with a null end are no links.

    Each round is written to the shared folder. Joins meet a hub's rows on freshly shuffled sides, which adaptive
    execution may split; sums over a hub are combined before the shuffle. Labels at least halve their distance to
    the smallest node in most rounds, so rounds grow with the logarithm of a component's diameter."""
    links = edges.where("a IS NOT NULL AND b IS NOT NULL AND a <> b").select("a", "b")
    both = write_cut(links.union(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "links")
    labels = write_cut(
        both.groupBy(F.col("a").alias("node")).agg(F.least(F.first("a"), F.min("b")).alias("label")).withColumn("moved", F.lit(True)),
        "labels",
    )
    while not labels.where("moved").isEmpty():
        near = both.join(labels.select(F.col("node").alias("b"), "label"), "b").groupBy(F.col("a").alias("node")).agg(F.min("label").alias("near"))
        hooked = labels.select("node", F.col("label").alias("old")).join(near, "node").withColumn("label", F.least("old", "near"))
        jump = labels.select(F.col("node").alias("label"), F.col("label").alias("further"))
        moved = hooked.join(jump, "label").select("node", "old", F.least("label", "further").alias("label"))
        labels = write_cut(moved.select("node", "label", (F.col("label") < F.col("old")).alias("moved")), "labels")
    return labels.select("node", "label")
