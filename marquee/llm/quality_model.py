"""Quality by importance resampling of hashed n-grams.

Two generative models, of the target text (labelled good and not toxic) and of all raw
text, give each hashed feature the probability that a document has it.  Features are the
words, punctuation runs and word pairs of a document, and three of its shape: how often a
token repeats the one before, the share of its most frequent token, and how many of its
tokens are distinct.  A document's importance weight is the product of target / raw over
its features.  Counts are smoothed, and each log ratio is shrunk towards 0 by how much of
it chance explains (positive-part James-Stein), so rare features add little noise.

Log weights get keyed Gumbel noise and the k largest are drawn: Gumbel top-k sampling
without replacement.  k is given, or is the number of documents that reach the ``loss``
quantile of the labelled good ones, each of which is scored with its own counts left out.
"""

from __future__ import annotations

import math
import re
import zlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from marquee.llm.common import WordHashes, join_hashes, materialise, slices, texts

#: log2 of the buckets, half of them for words and shapes and half for pairs; blocks in which counts are added up.
BITS, BLOCKS = 20, 64
#: Labelled rows that are used at most (those with the smallest keyed hashes).
LABELLED = 100_000
#: A count is added to both sides of a ratio.
SMOOTH = 0.5
#: Deviations at and below which a log ratio shrinks to 0.  Pairs, which come in bulk with
#: every copied passage, need more evidence than words.
DEVIATIONS, PAIR_DEVIATIONS = 1.5, 20.0
#: Temperature of the log weights under the Gumbel noise; share of good documents given up.
TEMPERATURE, LOSS = 0.25, 0.003
SEED = 17

_TOKENS = re.compile(rb"[0-9a-z\x80-\xff]+|[!-/:-@\[-`{-~]+").findall
_CUT = np.uint64(65 - BITS)


def tokens_of(text: str) -> list[bytes]:
    return _TOKENS(text.lower().encode())


def shape(n: int, repeats: int, most: int, distinct: int) -> list[bytes]:
    """Names of the features of a document's shape, all in tenths; what is distinct depends on the length."""
    return [b"\0run %d" % -(-10 * repeats // max(n - 1, 1)), b"\0top %d" % (10 * most // n), b"\0distinct %d of %d" % (10 * distinct // n, (n.bit_length() - 1) // 2)]


def buckets(text: str, words: WordHashes) -> np.ndarray:
    """The distinct buckets of a text; one without tokens has none."""
    h = words.of(tokens_of(text))
    if not len(h):
        return np.empty(0, np.int64)
    counts = np.unique(h, return_counts=True)[1]
    named = shape(len(h), int((h[1:] == h[:-1]).sum()), int(counts.max()), len(counts))
    single = np.concatenate([h, np.array([xxhash.xxh3_64_intdigest(x) for x in named], np.uint64)]) >> _CUT
    both = (join_hashes(h[:-1], h[1:]) >> _CUT) + np.uint64(1 << (BITS - 1))
    return np.unique(np.concatenate([single, both]).astype(np.int64))


def _labelled(labels: DataFrame, most: int) -> DataFrame:
    """doc_id, good of at most ``most`` rows: a bounded sample."""
    one = labels.filter("doc_id IS NOT NULL AND quality IS NOT NULL").groupBy(F.col("doc_id").cast("long").alias("doc_id"))
    one = one.agg(F.min((F.col("quality") == 1) & (F.coalesce(F.col("toxic"), F.lit(0)) == 0)).alias("good"))
    return one.orderBy(F.xxhash64("doc_id", F.lit(SEED)), "doc_id").limit(most)


def _count(batches):
    """The task's counts of documents by bucket, of all rows and of the good ones."""
    words, n = WordHashes(), 1 << BITS
    raw, target = np.zeros(n, np.int32), np.zeros(n, np.int32)
    n_raw = n_target = 0
    for rows, goods in slices(batches, ("text", "good")):
        for text, good in zip(rows, goods, strict=True):
            own = buckets(text, words)
            raw[own] += 1
            n_raw += 1
            if good:
                target[own] += 1
                n_target += 1
    if n_raw:
        for block, (r, t) in enumerate(zip(np.split(raw, BLOCKS), np.split(target, BLOCKS), strict=True)):
            yield _counts([block], [zlib.compress(r.tobytes(), 1)], [zlib.compress(t.tobytes(), 1)], [n_raw], [n_target])


def _counts(block, raw, target, n_raw, n_target):
    return pa.RecordBatch.from_arrays([pa.array(block, pa.int32()), pa.array(raw, pa.binary()), pa.array(target, pa.binary()), pa.array(n_raw, pa.int64()), pa.array(n_target, pa.int64())], ["block", "raw", "target", "n_raw", "n_target"])


def _add(batches):
    """Adds the counts up, a block at a time as they stream by."""
    sums: dict = {}
    for batch in batches:
        for row in batch.to_pylist():
            own = sums.setdefault(row["block"], [np.zeros((1 << BITS) // BLOCKS, np.int64), np.zeros((1 << BITS) // BLOCKS, np.int64), 0, 0])
            own[0] += np.frombuffer(zlib.decompress(row["raw"]), np.int32)
            own[1] += np.frombuffer(zlib.decompress(row["target"]), np.int32)
            own[2] += row["n_raw"]
            own[3] += row["n_target"]
    for block, (raw, target, n_raw, n_target) in sums.items():
        yield _counts([block], [zlib.compress(raw.tobytes(), 1)], [zlib.compress(target.tobytes(), 1)], [n_raw], [n_target])


_COUNTS = "block int, raw binary, target binary, n_raw long, n_target long"


def log_ratios(raw: np.ndarray, target: np.ndarray, n_raw: int, n_target: int) -> np.ndarray:
    """log(target / raw) of every bucket, shrunk by the square of its deviations from what chance gives."""
    expected = raw * (n_target / max(n_raw, 1))
    log = np.log((target + SMOOTH) / (expected + SMOOTH))
    deviations = np.abs(target - expected) / np.sqrt(np.maximum(expected, target) + 1)
    least = np.repeat([DEVIATIONS, PAIR_DEVIATIONS], len(raw) // 2)
    return (log * np.maximum(0, 1 - (least / np.maximum(deviations, least)) ** 2)).astype(np.float32)


def fit(known: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """The log ratios, and those that a good document's own features have without it.

    Counts are taken over all of ``known`` (text, good), of which only 2 ** BITS sums reach the driver.
    """
    rows = known.select("text", "good").mapInArrow(_count, _COUNTS).repartition(BLOCKS, "block").mapInArrow(_add, _COUNTS).collect()
    raw, target = np.zeros(1 << BITS), np.zeros(1 << BITS)
    size = (1 << BITS) // BLOCKS
    for r in rows:
        at = slice(r.block * size, (r.block + 1) * size)
        raw[at], target[at] = (np.frombuffer(zlib.decompress(x), np.int64) for x in (r.raw, r.target))
    n_raw, n_target = next(((r.n_raw, r.n_target) for r in rows), (0, 0))
    if not n_target:
        return (np.zeros(1 << BITS, np.float32),) * 2
    less = lambda x: np.maximum(x - 1, 0)
    return log_ratios(raw, target, n_raw, n_target), log_ratios(less(raw), less(target), n_raw - 1, n_target - 1)


def gumbel(seed: int):
    """Keyed Gumbel noise of a document."""
    unit = (F.shiftrightunsigned(F.xxhash64(F.coalesce("doc_id", F.lit(-1)), "n_chars", F.lit(seed)), 11) + F.lit(0.5)) / F.lit(2.0**53)
    return -F.log(-F.log(unit))


def kth_largest(scores: DataFrame, k: int, column: str = "perturbed") -> float:
    """The k-th largest value exactly: the range is narrowed by bounded histograms, then the few values left are sorted."""
    low, high = scores.agg(F.min(column), F.max(column)).first()
    if low is None or k <= 0:
        return math.inf
    while low < high:
        here = scores.filter(F.col(column).between(low, high))
        if here.count() <= 1024:
            return here.orderBy(F.desc(column)).limit(k).agg(F.min(column)).first()[0]
        bins = F.least(F.floor((F.col(column) - low) / ((high - low) / 1024)), F.lit(1023))
        for row in here.groupBy(bins.alias("bin")).agg(F.count(F.lit(1)).alias("n"), F.min(column).alias("low"), F.max(column).alias("high")).orderBy(F.desc("bin")).collect():
            if row.n >= k:
                low, high = row.low, row.high
                break
            k -= row.n
        else:
            return low
    return low


def importance_resample(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int | None = None, loss: float = LOSS, labelled: int = LABELLED, seed: int = SEED, row_col: str | None = None) -> DataFrame:
    """One row per input row: doc_id, log_weight, perturbed, kept.

    ``labels`` has doc_id, quality and toxic; good is quality 1 and not toxic, by the worst
    of repeated labels; a null quality is no label, a null toxic is 0.  At most ``labelled``
    of them are used; the raw model counts every document.  Null and empty texts have weight
    1.  Without labelled good documents every factor is 1 and, unless ``k`` is given, all are
    kept.  Repeated rows get the same noise and decision, so ties at the k-th score are all
    kept; an empty table gives none; extra columns are ignored.  With ``row_col``, a key of
    the rows, each row also has it.
    """
    sample = materialise(_labelled(labels, labelled))
    more = [row_col] if row_col else []
    known = texts(docs, id_col, text_col, *more).join(F.broadcast(sample), "doc_id", "left")
    known = known.select("doc_id", "text", F.coalesce(F.col("good"), F.lit(False)).alias("good"), *more)
    ratios = docs.sparkSession.sparkContext.broadcast(fit(known))

    def weigh(batches):
        words, (whole, without) = WordHashes(), ratios.value
        for ids, rows, good, *keys in slices(batches, ("doc_id", "text", "good", *more)):
            weights = [float((without if g else whole)[buckets(t, words)].sum(dtype=np.float64)) for t, g in zip(rows, good, strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array([len(t) for t in rows], pa.int64()), pa.array(good, pa.bool_()), pa.array(weights, pa.float64()), *(pa.array(x, pa.int64()) for x in keys)], ["doc_id", "n_chars", "good", "log_weight", *more])

    scored = known.mapInArrow(weigh, "doc_id long, n_chars long, good boolean, log_weight double" + "".join(f", {c} long" for c in more))
    scored = materialise(scored.withColumn("perturbed", F.col("log_weight") / TEMPERATURE + gumbel(seed)))
    if k is None:
        least = scored.filter("good").agg(F.percentile("perturbed", F.lit(loss))).first()[0]
        k = scored.count() if least is None else scored.filter(F.col("perturbed") >= least).count()
    cut = kth_largest(scored, k)
    return scored.select("doc_id", "log_weight", "perturbed", (F.col("perturbed") >= F.lit(cut)).alias("kept"), *more)
