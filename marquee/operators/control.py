"""The control side of a sync as data: gate, progress, backoff, outcomes, transitions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from marquee.schema import BACKOFF, COOLDOWN_MS, PROGRESS_WEIGHTS, STALE_MS


def gate(jobs: DataFrame) -> DataFrame:
    """decision (conflict, skip, run) and minutes_left of jobs with status and age_ms."""
    running = (F.col("status") == "running") & (F.col("age_ms") <= STALE_MS)
    fresh = (F.col("status") == "completed") & (F.col("age_ms") < COOLDOWN_MS)
    return jobs.withColumns({"decision": F.when(running, "conflict").when(fresh, "skip").otherwise("run"), "minutes_left": F.when(fresh & ~running, F.ceil((F.lit(COOLDOWN_MS) - F.col("age_ms")) / 60000)).otherwise(0).cast("long")})


def progress(a: Column, b: Column, c: Column) -> Column:
    x, y, z = PROGRESS_WEIGHTS
    return F.floor(a * x + b * y + c * z).cast("long")


def backoff(attempt: Column, source: str) -> Column:
    """Wait in ms before the attempt (from 0), without jitter."""
    first, longest = BACKOFF[source]
    return F.least(F.lit(first) * F.pow(F.lit(2), attempt), F.lit(longest)).cast("long")


def batch_id(order: Window, size: int) -> Column:
    return F.floor((F.row_number().over(order) - 1) / size).cast("long")


def outcomes(results: DataFrame) -> DataFrame:
    """One message of the sources (ord, name, error) that timed out or failed."""
    late = F.col("error").contains("timed out")
    names = lambda cond: F.array_join(F.transform(F.array_sort(F.collect_list(F.when(cond, F.struct("ord", "name")))), lambda x: x["name"]), "、")
    both = results.filter("error IS NOT NULL").agg(names(late).alias("late"), names(~late).alias("failed"))
    part = lambda label, c: F.when(F.col(c) != "", F.concat(F.lit(label), F.col(c)))
    return both.select(F.concat_ws(" | ", part("超时: ", "late"), part("失败: ", "failed")).alias("message"))


def merge_status(current: DataFrame, patch: DataFrame, now_ms: int) -> DataFrame:
    """One status row with all fields of a patch row over it, null ones too, stamped; an empty patch only stamps."""
    p = patch.select(F.lit(True).alias("_given"), *[F.col(c).alias(f"_{c}") for c in patch.columns])
    merged = current.join(p, F.lit(True), "left")
    new = lambda c: F.lit(now_ms).cast("long") if c == "lastUpdated" else F.when(F.col("_given"), F.col(f"_{c}")).otherwise(F.col(c)) if c in patch.columns else F.col(c)
    return merged.select(*[new(c).alias(c) for c in current.columns])


def transitions(log: DataFrame, key: str) -> DataFrame:
    """Rows (key, seq, status) whose status differs from the one before."""
    before = F.lag("status").over(Window.partitionBy(key).orderBy("at", "seq"))
    return log.withColumn("before", before).filter(F.col("before").isNotNull() & (F.col("before") != F.col("status")))
