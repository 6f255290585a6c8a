"""Connected components of a graph given as a table of edges."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from marquee.llm.common import materialise

#: Edges that a task contracts together.
TOGETHER = 1_000_000


def contract(batches):
    """Edges (a, b) of a task, some TOGETHER at a time, as stars: each node with the smallest it is connected with."""
    parent: dict[int, int] = {}
    seen = 0

    def find(x: int) -> int:
        root = x
        while (up := parent.setdefault(root, root)) != root:
            root = up
        while parent[x] != root:
            parent[x], x = root, parent[x]
        return root

    def stars():
        nodes = [x for x, up in parent.items() if x != up]
        out = pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), pa.array(map(find, nodes), pa.int64())], ["a", "b"])
        parent.clear()
        return out

    for batch in batches:
        for a, b in zip(*(batch.column(k).to_pylist() for k in (0, 1)), strict=True):
            a, b = find(a), find(b)
            if a != b:
                parent[max(a, b)] = min(a, b)
        seen += batch.num_rows
        if seen >= TOGETHER:
            yield stars()
            seen = 0
    yield stars()


def _contracted(edges: DataFrame) -> DataFrame:
    return materialise(edges.select("a", "b").mapInArrow(contract, "a long, b long").distinct())


def _are_stars(pairs: DataFrame) -> bool:
    """If each node has one centre and no centre has another."""
    ends = pairs.select(F.col("a").alias("x"), F.lit(1).alias("child"), F.lit(0).alias("centre")).unionByName(pairs.select(F.col("b").alias("x"), F.lit(0).alias("child"), F.lit(1).alias("centre")))
    return ends.groupBy("x").agg(F.sum("child").alias("child"), F.max("centre").alias("centre")).filter("child > 1 OR child = 1 AND centre = 1").isEmpty()


def components(edges: DataFrame, contracted: bool = False) -> DataFrame:
    """node, component (the smallest node it reaches) for the nodes of ``edges`` (a, b: long).

    Tasks contract the edges that they have; then alternating large-star and small-star
    rounds, contracted again, until the edges are stars.  A node with very many edges
    contributes a minimum, which is taken before the shuffle, and Spark may split its join.
    With ``contracted``, the edges come from ``contract`` in the task's own Python worker,
    which a second step in the same task would double.
    """
    pairs = materialise(edges.select("a", "b").distinct()) if contracted else _contracted(edges.filter("a <> b"))
    while not _are_stars(pairs):
        both = pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.join(least, "a").filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a")
        pairs = _contracted(small.select("a", F.col("m").alias("b")).unionByName(small.filter("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))))
    return pairs.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(pairs.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
