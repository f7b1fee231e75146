"""Chains and closures of edges, with circles told apart; children and neighbours in order.

Pointers are doubled: each round a pointer stands for twice as many steps, so a chain of n takes log n rounds, each a join
that is written to the shared folder.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusmill.sources.tables import written


def chains(edges: DataFrame, node: str, following: str) -> DataFrame:
    """edges (node, following), a row for each node that has one after it -> node, end, steps, circular.

    end: the last one that can be reached; null for a node whose way runs into a circle, with no steps. Rows with a null on
    either side are no edges. A node with several following ones is refused by an error."""
    known = edges.where(F.col(node).isNotNull() & F.col(following).isNotNull()).select(F.col(node).alias("node"), F.col(following).alias("at"))
    several = known.groupBy("node").agg(F.count("*").alias("n"))
    ahead = written(known.join(several, "node").select("node", F.when(F.col("n") > 1, F.raise_error(F.lit("a node has several following ones")).cast(known.schema["at"].dataType)).otherwise(F.col("at")).alias("at"), F.lit(1).cast("long").alias("steps"), F.lit(True).alias("open")), "chain-links")
    total = ahead.count()
    reach = 1
    while reach <= total and not ahead.where("open").isEmpty():
        further = ahead.select(F.col("node").alias("at"), F.col("at").alias("_at"), F.col("steps").alias("_steps"), F.col("open").alias("_open"))
        jumped = ahead.where("open").join(further, "at", "left")
        moved = jumped.select("node", F.coalesce("_at", "at").alias("at"), (F.col("steps") + F.coalesce("_steps", F.lit(0))).alias("steps"), F.coalesce("_open", F.lit(False)).alias("open"))
        ahead = written(moved.unionByName(ahead.where("NOT open")), "chain-ends")
        reach *= 2
    # whoever is still on the way after more steps than there are nodes goes round
    return ahead.select(F.col("node").alias(node), F.when(~F.col("open"), F.col("at")).alias("end"), F.when(~F.col("open"), F.col("steps")).otherwise(0).alias("steps"), F.col("open").alias("circular"))


def closure(edges: DataFrame) -> DataFrame:
    """edges (a, b) -> a, b, steps: every pair of which b can be reached from a, by the fewest steps. A node on a circle
    reaches itself. Each round joins ways of up to 2^r steps with one another, until none is new or shorter."""
    ways = written(edges.where("a IS NOT NULL AND b IS NOT NULL").select("a", "b").distinct().withColumn("steps", F.lit(1).cast("long")), "ways")
    before = -1
    while True:
        left, right = ways.select("a", F.col("b").alias("m"), F.col("steps").alias("s1")), ways.select(F.col("a").alias("m"), "b", F.col("steps").alias("s2"))
        longer = left.join(right, "m").select("a", "b", (F.col("s1") + F.col("s2")).alias("steps"))
        ways = written(ways.unionByName(longer).groupBy("a", "b").agg(F.min("steps").alias("steps")), "ways")
        told = ways.agg(F.count("*").alias("n"), F.sum("steps").alias("s")).first()
        now = (told.n, told.s)
        if now == before:
            return ways
        before = now


def children(edges: DataFrame, parent: str, child: str, order: list[Column]) -> DataFrame:
    """parent, child, position: a parent's children in order, as rows, however many there are."""
    nth = F.row_number().over(Window.partitionBy(parent).orderBy(*order)).cast("long")
    return edges.where(F.col(parent).isNotNull()).select(parent, child, nth.alias("position"))


def detail(nodes: DataFrame, edges: DataFrame, source: str, target: str, kind: str) -> DataFrame:
    """nodes (node), a user's short list -> node, outgoing and incoming: arrays of (kind, other) in order. Edges whose other
    end is unknown keep a null there; nodes without edges have empty arrays."""
    asked = F.broadcast(nodes.select("node").distinct())
    told = lambda own, other, name: edges.join(asked, F.col(own) == F.col("node")).groupBy("node").agg(F.array_sort(F.collect_list(F.struct(F.col(kind).alias("kind"), F.col(other).alias("other")))).alias(name))
    none = F.array().cast("array<struct<kind:string,other:long>>")
    both = nodes.select("node").distinct().join(told(source, target, "outgoing"), "node", "left").join(told(target, source, "incoming"), "node", "left")
    return both.select("node", *[F.coalesce(F.col(c), none).alias(c) for c in ("outgoing", "incoming")])
