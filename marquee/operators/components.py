"""Connected components of a table of edges, by joins and aggregates alone."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from marquee.folders import checkpointed


def components(edges: DataFrame) -> DataFrame:
    """node, component (the smallest node it reaches) for the nodes of ``edges`` (a, b: long).

    Large-star and small-star rounds: each node's neighbours go to the smallest of them, first the larger ones, then
    the smaller; the number of rounds grows with the logarithm of the longest path.  A node with very
    many edges contributes a minimum, which is taken before the shuffle.
    """
    pairs = checkpointed(edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    while True:
        both = pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.join(least, "a").filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a")
        made = checkpointed(small.select("a", F.col("m").alias("b")).unionByName(small.filter("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))).distinct())
        # Stars: each node has one centre, and no centre has another.
        ends = made.select(F.col("a").alias("x"), F.lit(1).alias("child"), F.lit(0).alias("centre")).unionByName(made.select(F.col("b").alias("x"), F.lit(0).alias("child"), F.lit(1).alias("centre")))
        pairs = made
        if ends.groupBy("x").agg(F.sum("child").alias("child"), F.max("centre").alias("centre")).filter("child > 1 OR child = 1 AND centre = 1").isEmpty():
            break
    return pairs.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(pairs.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
