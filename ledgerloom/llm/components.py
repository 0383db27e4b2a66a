"""Connected components of an edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.llm.shared import stored


def _digest(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)"))).first())


def components(edges: DataFrame) -> DataFrame:
    """(node, root): the smallest node reachable from each node of (a, b) edges.

    Large-star and small-star steps in turn: every node hangs its neighbours
    under the smallest one it knows, until the edges are stars. Each round is
    written to the shared folder; nothing but a count and a sum comes to the
    driver. Rounds grow with the logarithm of the longest path. The smallest
    neighbours are stored before they are joined, as only a join of two plain
    shuffles can split the many edges of a star's centre.
    """
    own = edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    own = stored(own, "edges")
    seen = _digest(own)
    while seen[0]:
        both = own.unionByName(own.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = stored(both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m")), "least")
        large = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = stored(large.where("a > b").distinct(), "edges")
        least = stored(large.groupBy("a").agg(F.min("b").alias("m")), "least")
        small = large.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(least.select("a", F.col("m").alias("b")))
        own = stored(small.where("a > b").distinct(), "edges")
        if (now := _digest(own)) == seen:
            break
        seen = now
    return own.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(own.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
