"""Which of a city's landed pages a crawl would have read, and what it would have kept.

Pages are rows (city, page, ok, ids, and what a rule needs), page from 1; a missing page ends its city.
A city has at most as many pages as a rule's limit, so its window is small however many cities there are.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F


def _up_to_stop(pages: DataFrame, stop: Column) -> DataFrame:
    """The pages up to the first that stops the city, without gaps."""
    order = Window.partitionBy("city").orderBy("page")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    marked = pages.withColumn("_stop", F.coalesce(stop, F.lit(False))).withColumn("_gap", F.row_number().over(order) != F.col("page"))
    return marked.filter("NOT _gap").withColumn("_over", F.coalesce(F.max("_stop").over(before), F.lit(False))).filter("NOT _over").drop("_stop", "_gap", "_over")


def pages_a(pages: DataFrame, size: int = 20, limit: int = 50) -> DataFrame:
    """city, page, id (new ones, in order of pages) of source A's pages, which also have ``cancelled``.

    A city ends with the second empty page in a row (failed ones between do not count), a page without a new id or with
    fewer than ``size``, the third failure in a row, or page ``limit``.  A city that is cancelled by then gives nothing.
    """
    pages = pages.filter(F.col("page").between(1, limit)).withColumn("ids", F.coalesce("ids", F.array().cast("array<string>")))
    good = F.coalesce("ok", F.lit(False))
    first = pages.filter(good).select("city", "page", F.explode("ids").alias("id")).groupBy("city", "id").agg(F.min("page").alias("page"))
    fresh = first.groupBy("city", "page").agg(F.count(F.lit(1)).alias("fresh"))
    rows = pages.join(fresh, ["city", "page"], "left").withColumns({"n": F.size("ids"), "good": good})
    order = Window.partitionBy("city").orderBy("page")
    empty = F.when(F.col("good"), F.col("n") == 0)
    empty_before = F.last(empty, ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, -1))
    failed = lambda back: ~F.lag("good", back).over(order)
    stop = (
        (F.col("good") & (F.col("n") == 0) & empty_before)
        | (F.col("good") & (F.col("n") > 0) & (F.coalesce("fresh", F.lit(0)) == 0))
        | (F.col("good") & (F.col("n") > 0) & (F.col("n") < size))
        | (~F.col("good") & failed(1) & failed(2))
    )
    read = _up_to_stop(rows, stop)
    cancelled = F.max(F.coalesce("cancelled", F.lit(False))).over(Window.partitionBy("city"))
    read = read.withColumn("_cancelled", cancelled).filter("NOT _cancelled")
    return read.select("city", "page").join(first, ["city", "page"]).select("city", "page", "id")


def pages_total(pages: DataFrame, size: int = 10, limit: int = 20) -> DataFrame:
    """city, page, id (every one) of pages that tell the ``total`` of their city's items, as source B's do.

    A city ends with a page that failed or is empty, when as many items have been asked for as there are, or with page ``limit``.
    """
    rows = pages.filter(F.col("page").between(1, limit)).withColumn("n", F.when(F.col("ok"), F.size(F.coalesce("ids", F.array().cast("array<string>")))).otherwise(0))
    read = _up_to_stop(rows, (F.col("n") == 0) | (F.col("page") * size >= F.coalesce("total", F.lit(0))))
    return read.filter("n > 0").select("city", "page", F.explode("ids").alias("id"))


def pages_short(pages: DataFrame, size: int = 20, limit: int = 6) -> DataFrame:
    """city, page, id (every one) of pages as source C's: a city, here a location, ends with a page that failed or has fewer than ``size``, or with page ``limit``."""
    rows = pages.filter(F.col("page").between(1, limit)).withColumn("n", F.when(F.col("ok"), F.size(F.coalesce("ids", F.array().cast("array<string>")))).otherwise(0))
    return _up_to_stop(rows, F.coalesce("n", F.lit(0)) < size).filter("n > 0").select("city", "page", F.explode("ids").alias("id"))
