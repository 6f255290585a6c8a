"""From raw documents to packed training sequences.

Five stages; each gets all that its predecessor kept, and its decisions take effect.  All but the
last return the columns of ``documents``.  SQL cannot express the first, third and fifth,
so there is none for the whole; tests hold the stages against brute force.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, functions as F

from marquee.folders import delete_folder, scratch
from marquee.llm.common import free_name, keyed, labels
from marquee.llm.exact_dedup import exact_dedup
from marquee.llm.mixing import mix_documents
from marquee.llm.ngram_join import near_duplicates
from marquee.llm.packing import pack
from marquee.llm.quality_model import importance_resample

#: Up to so many row keys are broadcast to take their rows out; more are joined by a shuffle.
BROADCAST_ROWS = 200_000
#: Up to so many files, their numbers are broadcast.
NUMBERED_FILES = 100_000
#: Rows of an Arrow batch at most, as a batch of texts is held by the JVM outside of its heap and by Python again.
ARROW_ROWS = 1_000


def _lean(spark: SparkSession) -> None:
    """Smaller Arrow batches in this session, for whoever runs what a stage returns."""
    rows = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(rows)) <= ARROW_ROWS:
        spark.conf.set(rows, ARROW_ROWS)


def _numbered(docs: DataFrame) -> tuple[DataFrame, str]:
    """The rows with a key of their own, and the name of that column.

    A stage's input is a Parquet table as it was read, where a row's file and its place there
    make a key that every read gives again.  What has no such place (rows made in memory,
    joins of tables of other formats), or very many files, is written with a key first.
    """
    key, path = free_name(docs, "_row"), free_name(docs, "_path")
    try:
        placed = docs.select("*", F.col("_metadata.file_path").alias(path), F.col("_metadata.row_index").alias(key))
    except AnalysisException:
        return keyed(docs)
    files = sorted(r[0] for r in placed.select(path).distinct().limit(NUMBERED_FILES + 1).collect())
    if len(files) > NUMBERED_FILES or "_metadata" in docs.columns:
        return keyed(docs)
    first = free_name(docs, "_first")
    # As an Arrow table, which no Python worker has to read: rows of a list would be, in further workers that every executor keeps.
    numbers = docs.sparkSession.createDataFrame(pa.table({path: pa.array(files, pa.string()), first: pa.array([k << 40 for k in range(len(files))], pa.int64())}))
    return placed.join(F.broadcast(numbers), path).withColumn(key, F.col(first) + F.col(key)).drop(path, first), key


def _without(rows: DataFrame, key: str, gone: DataFrame) -> DataFrame:
    """The rows whose keys are not in ``gone`` (row), without the key."""
    gone = gone.select(F.col("row").alias(key))
    few = gone.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
    return rows.join(F.broadcast(gone) if few else gone, key, "left_anti").drop(key)


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are drawn by importance resampling towards good labelled text.

    A null or empty text has weight 1 and stays; repeated rows stay or go alike; a null
    doc_id has no label.  An empty table gives none; columns of any name are kept.
    """
    _lean(spark)
    rows, key = _numbered(docs)
    judged = importance_resample(rows, labels(spark, sf_dir), row_col=key)
    return _without(rows, key, judged.filter("NOT kept").select(F.col(key).alias("row")))


def exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of texts equal but for white space the longest, then the one with the smallest doc_id; of repeated rows one.

    Null and empty texts are equal to each other, so one of them stays; a null doc_id loses
    ties.  An empty table gives none; columns of any name are kept.
    """
    _lean(spark)
    rows, key = _numbered(docs)
    return _without(rows, key, exact_dedup(rows, row_col=key).filter("NOT kept").select(F.col(key).alias("row")))


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group linked by near-equal sets of five-word shingles the document with the smallest doc_id.

    Rows are linked, with or without an id; a row without one stays only if its group has
    none with one, and of repeated rows one stays.  Null and empty texts are linked with nothing and
    all stay.  An empty table gives none; columns of any name are kept.
    """
    _lean(spark)
    rows, key = _numbered(docs)
    groups = near_duplicates(rows, id_col=key).select(F.col("doc_id").alias("row"), "component_id")
    ids = rows.select(F.col(key).alias("row"), F.col("doc_id").cast("long").alias("doc_id"))
    joined = groups.join(ids, "row")
    best = joined.groupBy("component_id").agg(F.min(F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", "row"))["row"].alias("row"))
    return _without(rows, key, joined.select("row").join(best, "row", "left_anti"))


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of sources takes them.

    A null source is one of its own; a document without words is taken like the others of
    its source.  Repeated rows and null ids are drawn one by one; an empty table gives none; columns of any
    name are kept.
    """
    _lean(spark)
    rows, key = _numbered(docs)
    return mix_documents(rows, row_col=key).drop(key)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents in sequences.

    A null or empty text is its end id alone; repeated rows and null ids are packed like any;
    an empty table gives none; further columns are left out, whatever their names.
    """
    _lean(spark)
    return pack(docs)


STAGES = [("quality_classifier", quality_classifier), ("exact_dedup", exact_copies), ("ngram_join", near_copies), ("mixing", mixing), ("packing", packing)]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; what passes between them is written as Parquet in the shared folder and deleted once it is read."""
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, stage in STAGES[:-1]:
        folder = scratch(spark, f"pipeline-{name}")
        stage(spark, docs, sf_dir).write.parquet(folder)
        if before:
            delete_folder(spark, before)
        docs, before = spark.read.parquet(folder), folder
    return STAGES[-1][1](spark, docs, sf_dir)
