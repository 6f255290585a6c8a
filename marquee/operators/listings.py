"""Reading the catalogue: scans, filters, search, order, pages, facets."""

from __future__ import annotations

from functools import reduce
from operator import and_, or_

from pyspark.sql import Column, DataFrame, Window, functions as F

from marquee.functions.text import contains_any, has, matches, or_else
from marquee.schema import CITY_BLACKLIST


def scan_month(listings: DataFrame, month: str) -> DataFrame:
    """Listings whose date text starts with ``yyyy-MM`` or ``yyyy.MM``; % and _ in ``month`` are wild."""
    dotted = month.replace("-", ".", 1)
    return listings.filter(F.col("date").like(f"{month}%") | F.col("date").like(f"{dotted}%"))


def city_contains(city: str) -> Column:
    return F.coalesce(F.contains(F.col("city"), F.lit(city)), F.lit(False))


def search(words: str, columns=("title", "venue", "city", "artist")) -> Column:
    """Any of the columns has the words, whatever their case; the facet view searches without the city."""
    return reduce(or_, (matches(c, words) for c in columns))


def facet(city: str | None = None, artist: str | None = None, words: str | None = None) -> Column:
    arms = []
    if city:
        arms.append(F.col("city").eqNullSafe(city))
    if artist:
        arms.append(F.col("artist").eqNullSafe(artist))
    if words:
        arms.append(search(words, ("title", "venue", "artist")))
    return reduce(and_, arms, F.lit(True))


def sort_key() -> Column:
    return or_else(F.split_part(F.col("date"), F.lit(" "), F.lit(1)), "9999.99.99")


def in_order(listings: DataFrame) -> DataFrame:
    """By date text up to its first blank, then the whole text; the id makes the order total."""
    return listings.orderBy(sort_key(), "date", "id")


def page(listings: DataFrame, number: int = 1, size: int = 20) -> DataFrame:
    """A page in order.  Spark plans it as a bounded top-k; numbers below 1 are an error."""
    if number < 1 or size < 1:
        raise ValueError("pages and their sizes start at 1")
    return in_order(listings).offset((number - 1) * size).limit(size)


def envelope(listings: DataFrame, number: int = 1, size: int = 20) -> DataFrame:
    return listings.agg(F.count(F.lit(1)).alias("total")).select(
        F.lit(True).alias("success"), "total", F.lit(number).alias("page"), F.lit(size).alias("page_size"), F.ceil(F.col("total") / size).cast("long").alias("total_pages")
    )


def counts(listings: DataFrame, column: str, ord_column: str = "ord") -> DataFrame:
    """Listings of each value, and the first place at which it appears."""
    return listings.groupBy(column).agg(F.count(F.lit(1)).alias("n"), F.min(ord_column).alias("first_ord")).orderBy(F.desc("n"), "first_ord")


def named_artists(listings: DataFrame) -> DataFrame:
    return listings.filter(has("artist") & (F.col("artist") != "Unknown"))


def not_blacklisted(listings: DataFrame, column: str = "city", terms=CITY_BLACKLIST) -> DataFrame:
    return listings.filter(~contains_any(F.col(column), terms))


def top_of_each(rows: DataFrame, key: str, order: list, n: int) -> DataFrame:
    """The first ``n`` rows of each key; Spark keeps the first n of each task before it shuffles."""
    place = F.row_number().over(Window.partitionBy(key).orderBy(*order))
    return rows.withColumn("_place", place).filter(F.col("_place") <= n).drop("_place")
