"""Which texts contain which, within groups, without comparing all pairs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

#: Code points of a gram; shorter texts are grams as a whole.
GRAM = 3


def _runs(text: Column, n: int) -> Column:
    return F.when(F.length(text) >= n, F.transform(F.sequence(F.lit(1), F.length(text) - n + 1), lambda i: F.substring(text, i, F.lit(n)))).otherwise(F.array().cast("array<string>"))


def grams(text: Column) -> Column:
    """All that a shorter or equal text may be known by if this one contains it: runs of one to GRAM code points, and nothing."""
    return F.array_distinct(F.concat(F.array(F.lit("")), *[_runs(text, n) for n in range(1, GRAM + 1)]))


def probes(text: Column) -> Column:
    """What must be in any text that contains this one."""
    return F.when(F.length(text) <= GRAM, F.array(text)).otherwise(F.array_distinct(_runs(text, GRAM)))


def contained(needles: DataFrame, hays: DataFrame, keys: list[str]) -> DataFrame:
    """keys, needle, hay for all needles (keys, text) in hays (keys, text) of the same keys; both are taken as sets.

    Hays are indexed by their grams.  A needle looks up only its gram that the fewest hays of the keys have, so it meets
    those hays alone, each of which is then compared.
    """
    index = hays.select(*keys, F.col("text").alias("hay")).distinct().withColumn("gram", F.explode(grams(F.col("hay"))))
    counts = index.groupBy(*keys, "gram").agg(F.count(F.lit(1)).alias("n"))
    asked = needles.select(*keys, F.col("text").alias("needle")).distinct().withColumn("gram", F.explode(probes(F.col("needle"))))
    rare = asked.join(counts, [*keys, "gram"]).groupBy(*keys, "needle").agg(F.min_by("gram", F.struct("n", "gram")).alias("gram"))
    return rare.join(index, [*keys, "gram"]).filter(F.contains("hay", F.col("needle"))).select(*keys, "needle", "hay")
