"""The status of a sync as JSON documents in a folder; the last one stands."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from marquee.folders import exists
from marquee.operators.control import merge_status
from marquee.schema import STATUS


def read_status(spark: SparkSession, folder: str, now_ms: int) -> DataFrame:
    """One row: the last document, or the idle status where there is none that can be read."""
    idle = spark.createDataFrame([("idle", 0, 0, 0, "", now_ms, None)], STATUS)
    if not exists(spark, folder):
        return idle
    found = spark.read.schema(STATUS).option("mode", "DROPMALFORMED").json(folder).filter("status IS NOT NULL")
    kept = found.select(F.lit(1).alias("rank"), "*").unionByName(idle.select(F.lit(0).alias("rank"), "*"))
    return kept.orderBy(F.desc("rank"), F.desc("lastUpdated")).limit(1).drop("rank")


def update_status(spark: SparkSession, folder: str, patch: DataFrame, now_ms: int) -> DataFrame:
    """The status with a patch over it, which is written as the next document.  Spark's committer writes it whole or not at all."""
    merged = spark.createDataFrame(merge_status(read_status(spark, folder, now_ms), patch, now_ms).collect(), STATUS)  # one row
    merged.coalesce(1).write.mode("append").option("ignoreNullFields", False).json(folder)
    return merged
