"""Exact deduplication with a heavy-hitter split.

A Misra-Gries summary of each task finds the digests that many rows share.  Their
exact winners, at most ``capacity`` rows, are broadcast, so those rows are settled
on the map side and no key with a large share of the rows is ever shuffled.  The
other digests go through an ordinary shuffle.
"""

from __future__ import annotations

import heapq
from collections import Counter

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from marquee.llm.common import SPACE, materialise, texts

#: Counters of a Misra-Gries summary, and the most rows that are broadcast.
CAPACITY = 1024


def misra_gries(capacity: int):
    """For mapInArrow over one column: a digest in over 1/(capacity + 1) of a task's rows is always among its rows out."""

    def summarise(batches):
        counts: Counter = Counter()
        for batch in batches:
            counts.update(batch.column(0).to_pylist())
            if len(counts) > capacity:
                cut = heapq.nlargest(capacity + 1, counts.values())[-1]
                counts = Counter({k: n - cut for k, n in counts.items() if n > cut})
        yield pa.RecordBatch.from_pydict({"text_sha256": pa.array(counts.keys(), pa.string()), "n": pa.array(counts.values(), pa.int64())})

    return summarise


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, row_col: str | None = None) -> DataFrame:
    """One row per input row: doc_id, keep_id, group_size, kept, text_sha256.

    Equal are texts that are identical without white space; the row with the most code
    points stays, then the smallest doc_id.  Null texts count as empty; empty texts are
    equal to each other.  A null doc_id loses ties; of rows alike in all of this any one,
    and only one, is kept.  An empty table gives an empty result.  Extra columns are ignored.
    With ``row_col``, a key of the rows, each row also has it.
    """
    base = texts(docs, id_col, text_col, *([row_col] if row_col else [])).select(
        (F.col(row_col) if row_col else F.monotonically_increasing_id()).alias("row"),
        "doc_id",
        F.length("text").alias("n_chars"),
        F.sha2(F.regexp_replace("text", SPACE, ""), 256).alias("text_sha256"),
    )
    base = materialise(base)
    frequent = (
        base.select("text_sha256")
        .mapInArrow(misra_gries(capacity), "text_sha256 string, n long")
        .groupBy("text_sha256")
        .agg(F.sum("n").alias("n"))
        .orderBy(F.desc("n"), "text_sha256")
        .limit(capacity)
        .select("text_sha256")
    )
    best = F.min(F.struct((-F.col("n_chars")).alias("less"), F.col("doc_id").isNull().alias("unnamed"), "doc_id", "row"))
    settle = (best.alias("best"), F.count(F.lit(1)).alias("group_size"))
    total = base.count()
    winners = base.join(F.broadcast(frequent), "text_sha256").groupBy("text_sha256").agg(*settle)
    winners = materialise(winners.filter(F.col("group_size") * (capacity + 1) > total).limit(capacity))
    head = base.join(F.broadcast(winners), "text_sha256")
    rest = base.join(F.broadcast(winners.select("text_sha256")), "text_sha256", "left_anti")
    tail = rest.join(rest.groupBy("text_sha256").agg(*settle), "text_sha256")
    return head.unionByName(tail).select(
        "doc_id",
        F.col("best.doc_id").alias("keep_id"),
        F.col("group_size").cast("long").alias("group_size"),
        (F.col("row") == F.col("best.row")).alias("kept"),
        "text_sha256",
        *([F.col("row").alias(row_col)] if row_col else []),
    )
