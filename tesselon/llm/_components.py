"""Connected components of an edge table by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tesselon.llm._shared import forget, store

MAX_ROUNDS = 60


def _pairs(edges: DataFrame) -> DataFrame:
    """Distinct edges from the larger to the smaller node."""
    return edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()


def _starred(edges: DataFrame) -> bool:
    """True if each node on a larger end has one partner, which is on no larger end itself."""
    high = edges.groupBy("a").agg(F.count(F.lit(1)).alias("n"))
    many = high.where("n > 1").limit(1).count()
    return not many and not edges.join(high.select(F.col("a").alias("h")), F.col("b") == F.col("h"), "left_semi").limit(1).count()


def components(edges: DataFrame) -> DataFrame:
    """(node, component) for every node of the edges (a, b); component is the smallest node reachable.

    Each step sends every edge to the smallest neighbour of one of its ends, found by an aggregation
    that combines on the map side and stored: beside a stored table a hub's edges are split by the
    adaptive skew join, or not dealt at all where the table is small, beside an aggregation they are
    not. What a round makes is written to the shared folder. Nodes without edges do not appear.
    """
    now = store(_pairs(edges))
    for _ in range(MAX_ROUNDS):
        if _starred(now):
            break
        both = now.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(now.select(F.col("b").alias("u"), F.col("a").alias("v")))
        near = store(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")))
        large = both.where("v > u").join(near, "u").select(F.col("v").alias("a"), F.col("m").alias("b"))
        large = store(_pairs(large))
        least = store(large.groupBy("a").agg(F.min("b").alias("m")))
        small = large.join(least, "a")
        after = store(_pairs(small.where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(least.select("a", F.col("m").alias("b")))))
        for done in (now, near, large, least):
            forget(done)
        now = after
    else:
        raise RuntimeError("components did not settle")
    return now.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(now.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
