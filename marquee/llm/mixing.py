"""Mixing sources to target weights by systematic sampling, in DataFrame operations only.

Within a source every document is expected rate = target / size times.  Documents
are ordered by size; the running sum of their expected copies plus one offset of the
source is cut at the integers, and a document is taken once for each integer that it
crosses.  As neighbours are of like size, the words taken stay near the target.

The running sum needs a document's rank in its source, which no task may see whole: it
is the sum of the counts of larger sizes, of earlier id blocks of its size, and of
its place in its own block of at most BLOCK ids (rows that repeat one id share a block).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from marquee.llm.common import WORD, free_name, keyed, materialise

#: Weights of the sources in the order of their names, repeating; the most copies of a document.
WEIGHTS, MOST = (1, 2, 3), 3
BLOCK = 8_192
SEED = "mix-7"
#: Up to so many sources, their totals are broadcast; beyond, they are joined by a shuffle.
BROADCAST_SOURCES = 20_000


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST) -> DataFrame:
    """source, source_size -> also target: shares by weight, filled up to ``most`` times the source's size."""
    by_name = Window.orderBy(F.col("source").isNull(), "source")
    weight = F.element_at(F.array(*map(F.lit, weights)), ((F.row_number().over(by_name) - 1) % len(weights) + 1).cast("int"))
    ranked = sizes.withColumn("weight", weight.cast("long")).withColumn("cap", F.col("source_size") * most)
    all_of = Window.partitionBy()
    fill = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").isNull(), "source")
    wide = lambda c: F.col(c).cast("decimal(38,0)")
    filled = (
        ranked.withColumn("total", F.sum("source_size").over(all_of))
        .withColumn("below", F.coalesce(F.sum("cap").over(fill.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
        .withColumn("rest", F.sum("weight").over(fill.rowsBetween(0, Window.unboundedFollowing)))
        .withColumn("full", wide("cap").cast("double") * F.col("rest") <= F.col("weight").cast("double") * (F.col("total") - F.col("below")))
        .withColumn("given", F.sum(F.when(F.col("full"), F.col("cap")).otherwise(0)).over(all_of))
        .withColumn("open", F.sum(F.when(F.col("full"), 0).otherwise(F.col("weight"))).over(all_of))
    )
    share = F.col("weight").cast("double") * (F.col("total") - F.col("given")).cast("double") / F.col("open").cast("double")
    return filled.select("source", "source_size", F.when(F.col("full"), F.col("cap").cast("double")).otherwise(share).alias("target"))


def offset(seed: str):
    """The source's offset in [0, 1)."""
    return F.conv(F.substring(F.md5(F.concat(F.lit(seed + "|"), F.coalesce(F.col("source"), F.lit("")))), 1, 8), 16, 10).cast("double") / F.lit(2.0**32)


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", seed: str = SEED, most: int = MOST, row_col: str | None = None) -> DataFrame:
    """One row per input row: doc_id, size, source_size, target, taken, source, copies.

    Size is the number of words; a null text has none.  A null source is a source of its
    own, last in order.  Sources without words have target 0.  Documents are ordered by
    size, then doc_id (null last), then input order, so repeated rows are drawn one by
    one.  An empty table gives no row; extra columns are ignored.  Reruns agree.
    With ``row_col``, a key of the rows in input order, each row also has it.
    """
    base = docs.select(
        (F.col(row_col) if row_col else F.monotonically_increasing_id()).alias("row"),
        F.col(id_col).cast("long").alias("doc_id"),
        F.col(source_col).cast("string").alias("source"),
        F.coalesce(F.regexp_count(F.col(text_col), F.lit(WORD)), F.lit(0)).cast("long").alias("size"),
    )
    base = materialise(base)
    per_size = base.groupBy("source", "size").agg(F.count(F.lit(1)).alias("n"))
    per_size = materialise(per_size)
    sources = targets(per_size.groupBy("source").agg(F.sum(F.col("size") * F.col("n")).alias("source_size")), most=most)
    sources = materialise(sources)
    if sources.limit(BROADCAST_SOURCES + 1).count() <= BROADCAST_SOURCES:
        sources = F.broadcast(sources)
    down = Window.partitionBy("source").orderBy(F.desc("size")).rowsBetween(Window.unboundedPreceding, -1)
    larger = per_size.select("source", "size", F.coalesce(F.sum("n").over(down), F.lit(0)).alias("larger"))
    # Rows without an id come last, in blocks of their keys.
    block = F.struct(F.col("doc_id").isNull().alias("unnamed"), F.expr(f"coalesce(doc_id, row) div {BLOCK}").alias("at"))
    along = Window.partitionBy("source", "size").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = base.groupBy("source", "size", block.alias("block")).agg(F.count(F.lit(1)).alias("n"))
    blocks = blocks.select("source", "size", "block", F.coalesce(F.sum("n").over(along), F.lit(0)).alias("earlier"))
    same = lambda a, b, *keys: [a[k].eqNullSafe(b[k]) for k in keys]
    before = blocks.join(larger, same(blocks, larger, "source", "size")).select(
        blocks["source"], blocks["size"], blocks["block"], (F.col("earlier") + F.col("larger")).alias("before")
    )
    own = Window.partitionBy("source", "size", "block").orderBy(F.col("doc_id").asc_nulls_last(), "row")
    placed = base.withColumn("block", block).withColumn("place", F.row_number().over(own))
    ranked = placed.join(before, same(placed, before, "source", "size", "block")).select(
        placed["row"], placed["doc_id"], placed["source"], placed["size"], (F.col("before") + F.col("place")).alias("rank")
    )
    joined = ranked.join(sources, ranked["source"].eqNullSafe(sources["source"])).select(ranked["*"], "source_size", "target")
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size").cast("double")).otherwise(0.0)
    cut = lambda r: F.floor(r.cast("double") * F.col("rate") + F.col("shift"))
    copies = F.least(F.lit(most).cast("long"), cut(F.col("rank")) - cut(F.col("rank") - 1))
    return (
        joined.withColumn("rate", rate)
        .withColumn("shift", offset(seed))
        .withColumn("copies", copies)
        .select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"), "source", "copies", *([F.col("row").alias(row_col)] if row_col else []))
    )


def mix_documents(docs: DataFrame, id_col: str = "doc_id", row_col: str | None = None, **options) -> DataFrame:
    """The mixed documents themselves, each row as often as it is taken, with the input's columns.

    Rows are drawn by a key of their own, so null, repeated and clashing ids and columns of
    any name do no harm.  A document without words is taken like any other of its source; a
    source without words is not taken.  An empty table gives none.  With ``row_col``, a key
    of the rows that every read of them gives, no table with such a key is written.
    """
    rows, key = (docs, row_col) if row_col else keyed(docs)
    copies, copy = free_name(docs, "_copies"), free_name(docs, "_copy")
    drawn = mix(rows, id_col, row_col=key, **options).filter("copies > 0").select(F.col(key), F.col("copies").alias(copies))
    each = F.explode(F.sequence(F.lit(1).cast("long"), F.col(copies)))
    return rows.join(drawn, key).withColumn(copy, each).select(*map(_quoted, docs.columns))


def _quoted(column: str) -> str:
    return f"`{column.replace('`', '``')}`"
