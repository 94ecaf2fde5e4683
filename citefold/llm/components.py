"""Connected components by alternating stars, as rounds of Spark jobs with a written table between rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from citefold.session import stage


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """One round: hang the larger (or the smaller and the node itself) neighbours of each node on its least one.

    Sums and minima are combined before they are shuffled; the join back to the edges spreads hot nodes by adaptive
    skew handling, so no task holds a whole star.
    """
    if large:
        pairs = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = pairs.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        return (pairs.filter("b > a").join(least, "a").select(F.col("b").alias("x"), "m")
                .filter("x <> m").select(F.col("x").alias("a"), F.col("m").alias("b")).distinct())
    down = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a <> b")
    least = down.groupBy("a").agg(F.min("b").alias("m"))
    kept = down.join(least, "a").select(F.col("b").alias("x"), "m").filter("x <> m")
    return kept.unionByName(least.select(F.col("a").alias("x"), "m")).select(
        F.col("x").alias("a"), F.col("m").alias("b")).distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, component) of every node that ``edges`` (a, b) names; component is the least node reachable.

    Loops are allowed and give components of one node; an empty table gives no rows.
    """
    loops = edges.filter("a = b").select(F.col("a").alias("node"))
    current = stage(edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(),
                    "edges")
    last = None
    while True:
        current = stage(_star(_star(current, True), False), "stars")
        seen = current.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if seen == last:
            break
        last = seen
    found = current.select(F.col("a").alias("node"), F.col("b").alias("component"))
    roots = current.select(F.col("b").alias("node"), F.col("b").alias("component"))
    lone = loops.select("node", F.col("node").alias("component"))
    return found.unionByName(roots).unionByName(lone).groupBy("node").agg(F.min("component").alias("component"))
