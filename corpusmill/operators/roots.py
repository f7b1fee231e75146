"""Roots that cover paths, links that lead from one to the next, and the first parts of paths that name a customer."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusmill.sources.tables import written

#: Stand in for the separator and for what comes right after it, so that all below a path sort right after it.
BELOW, PAST = "\x01", "\x02"
#: Paths that name a customer, at most, in order.
MOST_PATHS = 500


def covering(paths: DataFrame, path: str = "path") -> DataFrame:
    """The least set of given paths such that each one is in it or below one of it.

    A sweep over sorted intervals: a path spans all below it, and is covered if one before it reaches past its beginning.
    Paths are sorted by ranges; within a range the furthest end so far is a running maximum, and each range passes its
    own on to the next ones. Separators at the end do not count; null and empty paths are left out."""
    known = paths.select(F.regexp_replace(F.col(path), "/+$", "").alias("_path")).where("_path <> ''").distinct()
    begin = F.concat(F.translate("_path", "/", BELOW), F.lit(BELOW))
    spans = known.withColumn("_begin", begin).withColumn("_end", F.concat(F.translate("_path", "/", BELOW), F.lit(PAST)))
    place = F.monotonically_increasing_id()
    placed = written(spans.repartitionByRange("_begin").sortWithinPartitions("_begin").withColumn("_p", F.shiftright(place, 33)).withColumn("_i", place), "paths")
    last = placed.groupBy("_p").agg(F.max("_end").alias("_last"))  # a row for each range
    earlier = last.withColumn("_earlier", F.max("_last").over(Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1))).select("_p", "_earlier")
    own = F.max("_end").over(Window.partitionBy("_p").orderBy("_i").rowsBetween(Window.unboundedPreceding, -1))
    told = placed.withColumn("_own", own).join(F.broadcast(earlier), "_p")
    return told.where("coalesce(greatest(_own, _earlier), '') <= _begin").select(F.col("_path").alias(path))


def followed(links: DataFrame, directories: DataFrame, starts: DataFrame) -> DataFrame:
    """links (path, directory, target), directories (directory) that exist, starts (directory) -> path, status, level.

    Level by level: links in directories that have been reached lead to the next ones. missing: there is no such
    directory; loop: the target is the link's directory or lies above it; followed: the first link, by path, to a directory
    that no level before has reached; duplicate: the others to it; covered: it had been reached. Links in directories that
    are never reached have no row. A visited set ends every way round."""
    exists = directories.select("directory").distinct()
    known = links.where("path IS NOT NULL AND directory IS NOT NULL")
    reached = written(starts.select("directory").distinct().join(exists, "directory", "left_semi").withColumn("level", F.lit(0)), "reached")
    frontier, level, found = reached, 0, None
    loop = F.concat("directory", F.lit("/")).startswith(F.concat("target", F.lit("/")))
    while not frontier.isEmpty():
        there = exists.select(F.col("directory").alias("target"), F.lit(True).alias("_there"))
        seen = reached.select(F.col("directory").alias("target"), F.lit(True).alias("_seen"))
        here = known.join(frontier.select("directory"), "directory", "left_semi").join(there, "target", "left").join(seen, "target", "left")
        status = F.when(F.col("_there").isNull(), "missing").when(loop, "loop").when(F.col("_seen"), "covered").otherwise("new")
        told = written(here.select("path", "target", status.alias("status")), "links-met")
        first = told.where("status = 'new'").groupBy("target").agg(F.min("path").alias("_first"))
        level += 1
        named = told.join(first, "target", "left").select("path", F.when(F.col("status") != "new", F.col("status")).when(F.col("path") == F.col("_first"), "followed").otherwise("duplicate").alias("status"), F.lit(level).alias("level"))
        found = named if found is None else found.unionByName(named)
        frontier = written(first.select(F.col("target").alias("directory"), F.lit(level).alias("level")), "frontier")
        reached = written(reached.unionByName(frontier), "reached")
    return found if found is not None else known.select("path", F.lit("").alias("status"), F.lit(0).alias("level")).limit(0)


def customer_roots(subpaths: DataFrame, paths: DataFrame, identities: list[str], limit: int = MOST_PATHS) -> DataFrame:
    """subpaths and paths (path) -> root, position: the first parts of paths that hold an identity, whatever its case; those
    of subpaths first, then of the first `limit` paths that hold one anywhere; each once, in order. The result is short."""
    names = list(dict.fromkeys(i.strip().casefold() for i in identities if i.strip()))

    def holds(c: Column) -> Column:
        found = F.lit(False)
        for n in names:
            found = found | F.contains(F.lower(c), F.lit(n))
        return found

    root = F.split_part(F.translate("path", "\\", "/"), F.lit("/"), F.lit(1))
    some = lambda df, at: df.where(holds(F.col("path"))).select(root.alias("root"), F.struct(F.lit(at).alias("at"), F.col("path").alias("path")).alias("by"))
    both = some(subpaths, 0).unionByName(some(paths.where(holds(F.col("path"))).orderBy("path").limit(limit), 1)).where(holds(F.col("root")))
    first = both.groupBy("root").agg(F.min("by").alias("by"))
    return first.select("root", F.row_number().over(Window.orderBy("by")).cast("long").alias("position"))
