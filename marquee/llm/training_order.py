"""Token ids written in training order.

Tasks tokenise their documents and cut the running ids into sequences of fixed length.
Sequence i of task p has the number p * span + i, where span is a bound on a task's
sequences from the bytes of its texts; a keyed Feistel permutation of all such numbers,
walked along its cycles until it is back in their range, gives its place.  Ranges of
places are shards.  A shard's sequences, sorted by place, are records of fixed stride in
one file, and the files in order are the training order: slot s lies in the last shard
whose first slot is not above s, at (s - first) * stride, so a run resumes anywhere with
one seek.  Beside it lies an index of the pieces of documents in each record.

Texts are tokenised once, and what is shuffled is ids.  Files are written by Spark's
committer, so tasks that are lost or run twice leave each record once.

    <folder>/kind=ids/shard=<n>/part-*.txt     records: ids little-endian, zero padded, then one newline byte
    <folder>/kind=index/shard=<n>/part-*.txt   a JSON line for each record
"""

from __future__ import annotations

import json
import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from marquee.llm import tokens
from marquee.llm.common import mix, slices, texts

#: Ids of a sequence; bytes of text that a shard stands for (its file is read whole); the id that ends a document; the key of the order.
LENGTH, SHARD_BYTES, END, KEY = 2048, 16 << 20, 1, 20_240_229
ROUNDS = 6
#: Sequences that a task sends on together.
TOGETHER = 128
#: Shards whose first slots are counted together.
SHARD_BLOCK = 4096

_INDEX = "place long, pieces array<struct<doc_id: long, start: long, length: long, offset: long, ids_crc32: long>>"


def feistel(numbers: np.ndarray, size: int, key: int = KEY) -> np.ndarray:
    """A keyed permutation of range(size)."""
    half = max(1, (max(size - 1, 1).bit_length() + 1) // 2)
    low, shift = np.uint64((1 << half) - 1), np.uint64(half)
    keys = mix(np.arange(1, ROUNDS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(key % (1 << 64)))

    def once(x: np.ndarray) -> np.ndarray:
        left, right = x >> shift, x & low
        for k in keys:
            left, right = right, left ^ (mix(right + k) & low)
        return (left << shift) | right

    out = once(numbers.astype(np.uint64))
    while (outside := out >= size).any():
        out[outside] = once(out[outside])
    return out.astype(np.int64)


def id_type(path: str) -> np.dtype:
    return np.dtype("<u2" if tokens.tokenizer(path).get_vocab_size() <= 1 << 16 else "<u4")


def write_training_order(docs: DataFrame, folder: str, id_col: str = "doc_id", text_col: str = "text", path: str | None = None, length: int = LENGTH, key: int = KEY, shard_bytes: int = SHARD_BYTES) -> None:
    """Writes the shards and their index under ``folder``.

    Null and empty texts are documents of the end id alone; repeated rows are written each;
    a null doc_id stays null in the index; an empty table writes no shard; extra columns
    are ignored.  Texts of any length run on from sequence to sequence.  The input must be
    the same in both of its reads: a task with more sequences than were counted for it, or
    one that was not counted at all, fails rather than write two records to one place.
    """
    path = path or tokens.default_path()
    kind = id_type(path)
    held = texts(docs, id_col, text_col)
    sizes = held.groupBy(F.spark_partition_id().alias("task")).agg(F.sum(F.octet_length("text") + 1).alias("bytes"))
    most, total, tasks = sizes.agg(F.max("bytes"), F.sum("bytes"), F.max("task")).first()
    span = (most or 0) // length + 2
    size = span * ((tasks or 0) + 1)
    shards = max(1, -(-(total or 0) // shard_bytes))

    def cut(batches):
        encoder, task = tokens.Encoder(path), TaskContext.get().partitionId()
        first = task * span
        ids, pieces, at, made = np.empty(length, kind), [], 0, 0
        ready: list[tuple[bytes, list]] = []

        def close():
            nonlocal ids, pieces, at
            ids[at:] = 0
            for p in pieces:
                p["ids_crc32"] = zlib.crc32(ids[p["offset"] : p["offset"] + p["length"]].astype("<u4").tobytes())
            ready.append((ids.tobytes(), pieces))
            pieces, at = [], 0

        def flush():
            nonlocal made
            numbers = np.arange(first + made, first + made + len(ready))
            made += len(ready)
            if made > span or task > (tasks or 0):
                raise RuntimeError("a task has more sequences than its texts have bytes for: the input changed between two reads")
            places = feistel(numbers, size, key)
            lines = [json.dumps({"place": int(p), "pieces": own}, separators=(",", ":")) for p, (_, own) in zip(places, ready, strict=True)]
            out = pa.RecordBatch.from_pydict({"shard": pa.array([int(p) * shards // size for p in places], pa.int64()), "place": pa.array(places), "ids": pa.array([b for b, _ in ready], pa.binary()), "index": pa.array(lines, pa.string())})
            ready.clear()
            return out

        for docs_, rows in slices(batches):
            for doc, text in zip(docs_, rows, strict=True):
                own = encoder.ids(text)
                own.append(END)
                own, start = np.frombuffer(own, np.uint32), 0
                while start < len(own):
                    n = min(length - at, len(own) - start)
                    ids[at : at + n] = own[start : start + n]
                    pieces.append({"doc_id": doc, "start": start, "length": n, "offset": at})
                    at, start = at + n, start + n
                    if at == length:
                        close()
                if len(ready) >= TOGETHER:
                    yield flush()
        if at:
            close()
        if ready:
            yield flush()

    rows = held.mapInArrow(cut, "shard long, place long, ids binary, index string").repartitionById(shards, F.col("shard").cast("int"))
    both = F.explode(F.array(F.struct(F.lit("ids").alias("kind"), F.col("ids").cast("string").alias("value")), F.struct(F.lit("index").alias("kind"), F.col("index").alias("value"))))
    placed = rows.select("shard", "place", both.alias("x")).select("x.kind", "shard", "place", "x.value")
    placed.sortWithinPartitions("kind", "shard", "place").select("kind", "shard", "value").write.mode("overwrite").partitionBy("kind", "shard").text(folder)


def _width(path: str | None) -> int:
    return id_type(path or tokens.default_path()).itemsize


def read_index(spark: SparkSession, folder: str, length: int = LENGTH, path: str | None = None) -> DataFrame:
    """slot, shard, record (place in the shard), byte_offset, pieces of every record.

    ``length`` and ``path`` (the tokenizer) are those that the shards were written with.
    Pieces with a null doc_id are those of documents without one.  Without any shard
    Spark's error for a missing path is raised.
    """
    stride = length * _width(path) + 1
    index = spark.read.schema(f"{_INDEX}, shard long").option("basePath", folder).json(f"{folder}/kind=index")
    counts = index.groupBy("shard").agg(F.count(F.lit(1)).alias("n")).withColumn("block", F.expr(f"shard div {SHARD_BLOCK}"))
    up_to = lambda w, *by: F.coalesce(F.sum("n").over(w.orderBy(*by).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    blocks = counts.groupBy("block").agg(F.sum("n").alias("n")).select("block", up_to(Window, "block").alias("base"))  # a row for each SHARD_BLOCK shards
    inside = counts.select("shard", "block", up_to(Window.partitionBy("block"), "shard").alias("first"))
    before = inside.join(blocks, "block").select(F.col("shard").alias("_shard"), (F.col("first") + F.col("base")).alias("first"))
    ranked = index.withColumn("record", F.row_number().over(Window.partitionBy("shard").orderBy("place")).cast("long") - 1)
    joined = ranked.join(before, ranked["shard"] == before["_shard"])
    return joined.select((F.col("first") + F.col("record")).alias("slot"), "shard", "record", (F.col("record") * stride).alias("byte_offset"), "pieces")


def _cut(data: Column, size: Column) -> Column:
    """Binary data in parts of ``size`` bytes."""
    return F.transform(F.sequence(F.lit(0), F.ceil(F.length(data) / size).cast("int") - 1), lambda i: F.substring(data, i * size + 1, size))


def read_records(spark: SparkSession, folder: str, length: int = LENGTH, path: str | None = None) -> DataFrame:
    """shard, record, ids (binary) of every record, cut from the files by the stride.

    A file of n records is cut into parts of about the square root of n records and these into
    records, as each cut copies what it cuts from.  Nothing leaves the JVM.  Arguments as for read_index.
    """
    stride = length * _width(path) + 1
    files = spark.read.format("binaryFile").option("basePath", folder).load(f"{folder}/kind=ids").filter(F.length("content") > 0)
    part = F.ceil(F.sqrt(F.length("content") / stride)).cast("int")
    parts = files.select(F.col("shard").cast("long").alias("shard"), part.alias("each"), F.posexplode(_cut(F.col("content"), part * stride)).alias("part", "data"))
    records = parts.select("shard", "each", "part", F.posexplode(_cut(F.col("data"), F.lit(stride))).alias("at", "data"))
    return records.select("shard", (F.col("part").cast("long") * F.col("each") + F.col("at")).alias("record"), F.substring("data", 1, stride - 1).alias("ids"))


def training_pieces(spark: SparkSession, folder: str, length: int = LENGTH, path: str | None = None) -> DataFrame:
    """One row per piece of a document, from the files: doc_id, start, length, ids_crc32, slot, offset, shard, byte_offset, record_crc32.

    Arguments, null ids and missing shards as for read_index.
    """
    index = read_index(spark, folder, length, path)
    sums = read_records(spark, folder, length, path).select("shard", "record", F.crc32("ids").alias("record_crc32"))
    rows = index.join(sums, ["shard", "record"])
    return rows.select(F.explode("pieces").alias("p"), "slot", "shard", "byte_offset", "record_crc32").select("p.doc_id", "p.start", "p.length", "p.ids_crc32", "slot", "p.offset", "shard", "byte_offset", "record_crc32")
