"""Shared pieces of the training-data operators.

Words are the maximal runs outside ``[\\x20\\x09-\\x0D]``.  On UTF-8 bytes that is
exactly ``bytes.split()``, which is what the Python stages use; JVM stages use
the regular expressions below.
"""

from __future__ import annotations

import numpy as np
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession, functions as F

from marquee.folders import scratch, shared_dir

WORD = r"[^\x20\x09-\x0D]+"
SPACE = r"[\x20\x09-\x0D]+"
#: Words whose hashes one Python worker remembers at most.
WORD_CACHE = 200_000
#: Bytes of a row group of a written table, which its writer holds.
ROW_GROUP = 16 << 20
#: Characters of text that a Python stage handles at once.
CHUNK_CHARS = 1_500_000


def materialise(df: DataFrame) -> DataFrame:
    """Cuts the lineage with a reliable checkpoint in the folder that the cluster names."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def written(df: DataFrame) -> DataFrame:
    """As materialise, but a compressed table, for what holds texts; it stays until ``clear_scratch``."""
    at = scratch(df.sparkSession, "table")
    df.write.option("parquet.block.size", ROW_GROUP).parquet(at)
    return df.sparkSession.read.schema(df.schema).parquet(at)


def free_name(df: DataFrame, name: str) -> str:
    """``name``, with more underscores before it as long as a column is called so."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def keyed(df: DataFrame) -> tuple[DataFrame, str]:
    """The rows with a key of their own in a table, so that every reader finds the same keys; and the name of that column."""
    key = free_name(df, "_row")
    return written(df.withColumn(key, F.monotonically_increasing_id())), key


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/labels.parquet")


def texts(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", *more: str) -> DataFrame:
    """The columns an operator reads, under its own names; a null text is empty."""
    return df.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"), *more)


def slices(batches, columns=("doc_id", "text")):
    """Arrow batches as lists of Python values, some CHUNK_CHARS of text at a time."""
    for batch in batches:
        start, chars = 0, 0
        sizes = pc.binary_length(batch.column("text")).to_pylist()
        for end, n in enumerate(sizes, 1):
            chars += n or 0
            if chars >= CHUNK_CHARS or end == len(sizes):
                part = batch.slice(start, end - start)
                yield [part.column(c).to_pylist() for c in columns]
                start, chars = end, 0


class WordHashes(dict):
    """64-bit hashes of words, remembered up to a bound."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= WORD_CACHE:
            self.clear()
        self[word] = h = xxhash.xxh3_64_intdigest(word)
        return h

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


_M1, _M2, _M3 = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB))
_S27, _S29, _S31 = np.uint64(27), np.uint64(29), np.uint64(31)


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values in which each input bit reaches all output bits."""
    h = (h ^ (h >> _S29)) * _M2
    h = (h ^ (h >> _S27)) * _M3
    return h ^ (h >> _S31)


def join_hashes(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    return mix(left * _M1 + (right ^ (right >> _S31)) * _M3 + _M2)


def window_hashes(words: np.ndarray, width: int) -> np.ndarray:
    """Hash of every run of ``width`` consecutive words: doubled spans, joined to the width."""
    if len(words) < width:
        return np.empty(0, np.uint64)
    spans = {1: words}
    size = 1
    while size * 2 <= width:
        spans[size * 2] = join_hashes(spans[size][:-size], spans[size][size:])
        size *= 2
    out, at = spans[size], size
    while at < width:
        size = max(s for s in spans if s <= width - at)
        n = len(words) - at - size + 1
        out, at = join_hashes(out[:n], spans[size][at : at + n]), at + size
    return out

