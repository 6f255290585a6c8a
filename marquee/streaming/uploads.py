"""Uploads as a stream: every micro-batch is one upsert of the catalogue."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T
from pyspark.sql.streaming import StreamingQuery

from marquee.functions.text import start_date
from marquee.operators.merge import as_list, merge, stored_order
from marquee.operators.store import Catalogue, keep_last, valid_upload, with_defaults
from marquee.schema import LISTING_JSON

REPORT = "success boolean, mode string, received long, refused long, total long, total_new long, message string"


def uploads(spark: SparkSession, folder: str, max_files: int | None = None) -> DataFrame:
    """Files of JSON lines with ord and the fields of a listing; a micro-batch takes ``max_files`` of them at most."""
    schema = T.StructType([*LISTING_JSON.fields, T.StructField("ord", T.LongType())])
    reader = spark.readStream.schema(schema)
    if max_files:
        reader = reader.option("maxFilesPerTrigger", max_files)
    return reader.json(folder).withColumnRenamed("updatedAt", "updated_at")


def upsert_stream(source: DataFrame, catalogue: Catalogue, checkpoint: str, smart: bool = False, quarantine: str | None = None, mode: str = "upsert", reports: str | None = None) -> StreamingQuery:
    """Runs through what has arrived.

    ``smart`` merges each batch into the stored rows of its dates, which are the primary list in the order
    of their dates: a row that matches one only enriches it, and a row with a stored id that matches none
    replaces that one; rows that the merge leaves alone are not written.  ``mode`` "replace" makes each batch the
    whole table; one without a good row is refused and leaves the table as it is.  Rows without id, title or date are written to ``quarantine``, a folder, if it is given.
    A batch that ran before, as far as to its version, changes nothing when it runs again; its bad rows replace those of then.

    ``reports``, a folder, gets one row for each batch (see ``read_reports``).  Rows of the table are counted from its files'
    footers before and after the batch, so what others write meanwhile counts, and a batch that runs again after it landed has nothing new.
    """
    if mode not in ("upsert", "replace") or (smart and mode == "replace"):
        raise ValueError(f"no such mode: {mode}")

    def one(batch: DataFrame, number: int) -> None:
        good, bad = valid_upload(batch)
        received, refused = batch.count(), bad.count()
        before = catalogue.read().count() if reports else 0
        if received > refused:
            land(good, number)
        if quarantine:
            bad.write.mode("overwrite").json(f"{quarantine}/batch={number}")
        if reports:
            total = catalogue.read().count()
            name = "merge" if smart else mode
            done = received > refused
            message = f"Saved {total} listings ({name} mode)" if done else "No listing data provided"
            row = (done, name, received, refused, total, total - (0 if mode == "replace" and done else before), message)
            batch.sparkSession.createDataFrame([row], REPORT).coalesce(1).write.mode("overwrite").json(f"{reports}/batch={number}")

    def land(good: DataFrame, number: int) -> None:
        if mode == "replace":
            catalogue.replace(with_defaults(keep_last(good, ["id"])))
        elif smart:
            catalogue.change(lambda stored: merged_upload(stored, good), batch=(checkpoint, number))
        else:
            catalogue.upsert(good, batch=(checkpoint, number))

    return source.writeStream.foreachBatch(one).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def read_reports(spark: SparkSession, folder: str) -> DataFrame:
    """batch and what became of it: success, mode, received and refused rows, total rows of the table after it, new ones (all, where it replaced the table), message."""
    return spark.read.schema(f"{REPORT}, batch long").json(folder)


def merged_upload(stored: DataFrame, good: DataFrame) -> DataFrame:
    """What an upload changes: its new rows, and the stored rows that it enriches."""
    days = good.select(start_date(F.col("date")).alias("day")).filter("day <> ''").distinct()
    near = stored.join(days, start_date(F.col("date")) == F.col("day"), "left_semi")
    merged = merge(stored_order(near), good).filter("action <> 'kept'")
    return as_list(merged).select(*good.columns)


def first_seen(source: DataFrame, keys: list[str], at: str, late: str = "1 day") -> DataFrame:
    """The first row of each key in a stream; the watermark bounds what is remembered."""
    return source.withWatermark(at, late).dropDuplicatesWithinWatermark(keys)
