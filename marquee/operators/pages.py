"""Pages far down a long list, without the rows before them."""

from __future__ import annotations

import json
import math

from pyspark.sql import DataFrame, SparkSession, Window, functions as F, types as T

from marquee.folders import create, read_text
from marquee.operators.listings import in_order, sort_key

RANGE_ROWS = 1_000_000


class Ranked:
    """Listings written once in page order, in ranges, and how many lie before each range.

    A page reads the ranges that it lies in, whatever its number.  Rows are dealt by sort key, date and id, so a day
    with very many rows is several ranges.  The directory has a row a range, a millionth of the rows.
    """

    def __init__(self, spark: SparkSession, folder: str, range_rows: int = RANGE_ROWS):
        self.spark, self.folder, self.range_rows = spark, folder, range_rows

    def build(self, listings: DataFrame) -> Ranked:
        """Writes the ranges of a list; one that has been built here before is an error."""
        keys = [F.col("_key"), F.col("date"), F.col("id")]
        ranges = max(1, math.ceil(listings.count() / self.range_rows))
        dealt = listings.withColumn("_key", sort_key()).repartitionByRange(ranges, *keys).withColumn("_range", F.spark_partition_id())
        dealt.sortWithinPartitions("_range", *keys).write.partitionBy("_range").parquet(f"{self.folder}/rows")
        # A list without rows has no files that would tell its columns.
        create(self.spark, f"{self.folder}/schema.json", dealt.schema.json())
        # The counts come from the files' footers.
        counts = self._rows().groupBy("_range").agg(F.count(F.lit(1)).alias("n"))
        before = F.sum("n").over(Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1))
        counts.withColumn("before", F.coalesce(before, F.lit(0))).coalesce(1).write.parquet(f"{self.folder}/directory")
        return self

    def _rows(self) -> DataFrame:
        return self.spark.read.schema(T.StructType.fromJson(json.loads(read_text(self.spark, f"{self.folder}/schema.json")))).parquet(f"{self.folder}/rows")

    def page(self, number: int = 1, size: int = 20) -> DataFrame:
        """A page in order, empty behind the last; numbers below 1 are an error."""
        if number < 1 or size < 1:
            raise ValueError("pages and their sizes start at 1")
        low, high = (number - 1) * size, number * size
        directory = self.spark.read.schema("_range int, n long, before long").parquet(f"{self.folder}/directory")
        hit = {r["_range"]: r["before"] for r in directory.filter((F.col("before") < high) & (F.col("before") + F.col("n") > low)).collect()}
        rows = self._rows().filter(F.col("_range").isin(list(hit)))
        place = F.row_number().over(Window.partitionBy("_range").orderBy("_key", "date", "id"))
        if hit:
            firsts = F.create_map(*(F.lit(x) for pair in hit.items() for x in pair))
            rows = rows.withColumn("_place", place + firsts[F.col("_range")]).filter((F.col("_place") > low) & (F.col("_place") <= high))
            return rows.orderBy("_place").drop("_place", "_key", "_range")
        return rows.drop("_key", "_range")

    def total(self) -> int:
        return self.spark.read.parquet(f"{self.folder}/directory").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]


def page_after(listings: DataFrame, date: str | None, id: str, size: int = 20) -> DataFrame:  # noqa: A002
    """The page behind a row, known by its date text and id: a top-k of one page, however far down it is."""
    if size < 1:
        raise ValueError("pages have a row at least")
    last = listings.sparkSession.createDataFrame([(date, id)], "date string, id string").select(sort_key(), "date", "id").first()
    parts = [(sort_key(), last[0]), (F.col("date"), last[1]), (F.col("id"), last[2])]
    behind = F.lit(False)
    for column, value in reversed(parts):
        # Nulls come first.
        more = column.isNotNull() if value is None else F.coalesce(column > value, F.lit(False))
        behind = more | (column.eqNullSafe(F.lit(value)) & behind)
    return in_order(listings.filter(behind)).limit(size)
