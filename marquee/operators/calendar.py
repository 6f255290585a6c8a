"""Listings as events, and the calendar's buckets."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from marquee.functions import dates
from marquee.schema import HOLIDAYS, LISTING


def events(listings: DataFrame, as_of: str) -> DataFrame:
    """id, title, start, end, all_day, is_fallback, resource; undated listings fall on ``as_of``."""
    day = dates.parsed_day(F.col("date"))
    start = dates.at(F.coalesce(day, F.lit(as_of).cast("date")), dates.minutes_of_day(F.col("date")))
    return listings.select(
        "id", "title", start.alias("start"), (start + F.expr("INTERVAL 180 MINUTES")).alias("end"), F.lit(False).alias("all_day"), day.isNull().alias("is_fallback"), F.struct(*LISTING.names).alias("resource")
    )


def holidays(spark: SparkSession) -> DataFrame:
    """date, type, name of the 39 special days."""
    spans = spark.createDataFrame(list(HOLIDAYS), "first string, last string, type string, name string")
    return spans.select(F.explode(F.sequence(F.col("first").cast("date"), F.col("last").cast("date"))).alias("date"), "type", "name")


def day_status(days: DataFrame, special: DataFrame) -> DataFrame:
    """day, type, name, is_special: the special day, else weekend or workday."""
    x = F.broadcast(special)  # 39 rows
    return days.join(x, days["day"] == x["date"], "left").select(
        "day",
        F.coalesce("type", F.when(F.dayofweek("day").isin(1, 7), "holiday").otherwise("workday")).alias("type"),
        "name",
        F.col("type").isNotNull().alias("is_special"),
    )


def week(spark: SparkSession, day: str) -> DataFrame:
    """The seven days from Monday on."""
    first = dates.monday(F.lit(day).cast("date"))
    return spark.range(1).select(F.explode(F.sequence(first, F.date_add(first, 6))).alias("day"))


def weeks(days: DataFrame) -> DataFrame:
    """week (its Monday), day for the seven days of each week that has any of ``days`` (day)."""
    mondays = days.select(dates.monday(F.col("day")).alias("week")).distinct()
    return mondays.select("week", F.explode(F.sequence(F.col("week"), F.date_add("week", 6))).alias("day"))


def month_grids(days: DataFrame) -> DataFrame:
    """month (its first day), day, off_range for the whole weeks around each month that has any of ``days`` (day)."""
    months = days.select(F.trunc("day", "month").alias("month")).distinct()
    view = F.sequence(dates.monday(F.col("month")), F.date_add(dates.monday(F.last_day("month")), 6))
    return months.select("month", F.explode(view).alias("day")).withColumn("off_range", F.trunc("day", "month") != F.col("month"))


def active_hours(events_: DataFrame, days: DataFrame) -> DataFrame:
    """Hours in which an event of these days starts."""
    here = events_.join(F.broadcast(days), F.to_date("start") == F.col("day"), "left_semi")  # a view has 1 to 42 days
    return here.select(F.hour("start").alias("hour")).distinct().orderBy("hour")


def grid(events_: DataFrame, days: DataFrame) -> DataFrame:
    """day, hour, n for each day of the view and each active hour of it.

    Events are read and their dates parsed once: the view's cells are appended with n = 0 and added up, as a
    join on parsed dates would make Spark parse each again in a filter that it infers.
    """
    frame = days.select("day", F.explode(F.sequence(F.lit(0), F.lit(23))).alias("hour"), F.lit(0).alias("n"), F.lit(1).alias("viewed"))
    cells = _counted(events_.select(F.to_date("start").alias("day"), F.hour("start").alias("hour"), F.lit(1).alias("n")), frame, ["day", "hour"])
    return cells.withColumn("active", F.sum("n").over(Window.partitionBy("hour"))).filter("active > 0").select("day", "hour", "n")


def _counted(rows: DataFrame, frame: DataFrame, keys: list[str]) -> DataFrame:
    """The keys of ``frame`` (keys, n = 0, viewed = 1) with the summed ``n`` of ``rows`` there."""
    both = rows.withColumn("viewed", F.lit(0)).unionByName(frame)
    return both.groupBy(*keys).agg(F.sum("n").alias("n"), F.max("viewed").alias("viewed")).filter("viewed = 1").drop("viewed")


def month_grid(spark: SparkSession, day: str) -> DataFrame:
    """day, off_range for the whole weeks (Monday first) around a month."""
    view = F.lit(day).cast("date")
    first, last = dates.monday(F.trunc(view, "month")), F.date_add(dates.monday(F.last_day(view)), 6)
    days = spark.range(1).select(F.explode(F.sequence(first, last)).alias("day"))
    return days.withColumn("off_range", (F.month("day") != F.month(view)) | (F.year("day") != F.year(view)))


def days_with_events(events_: DataFrame) -> DataFrame:
    return events_.select(F.to_date("start").alias("day")).distinct()


def navigation(days: DataFrame) -> DataFrame:
    """Neighbours of a day in each view, and the day moved to a month (``month_index``) of its year."""
    d = F.col("day")
    return days.select(
        "day", F.add_months(d, 1).alias("next_month"), F.add_months(d, -1).alias("prev_month"), F.date_add(d, 7).alias("next_week"), F.date_sub(d, 7).alias("prev_week"), F.date_add(d, 1).alias("next_day"), F.date_sub(d, 1).alias("prev_day"), dates.month_set(d, F.col("month_index")).alias("month_set")
    )


def day_flags(days: DataFrame, events_: DataFrame) -> DataFrame:
    """day, has_event of the days of a view."""
    frame = days.select("day", F.lit(0).alias("n"), F.lit(1).alias("viewed")).distinct()
    return _counted(events_.select(F.to_date("start").alias("day"), F.lit(1).alias("n")), frame, ["day"]).select("day", (F.col("n") > 0).alias("has_event"))


def month_flags(spark: SparkSession, events_: DataFrame, year: int) -> DataFrame:
    """month (1 to 12), has_event of a year."""
    frame = spark.range(1, 13).select(F.col("id").cast("int").alias("month"), F.lit(0).alias("n"), F.lit(1).alias("viewed"))
    months = events_.select(F.when(F.year("start") == year, F.month("start")).alias("month"), F.lit(1).alias("n"))
    return _counted(months, frame, ["month"]).select("month", (F.col("n") > 0).alias("has_event"))
