"""Quality rules with risk-controlled thresholds.

Each rule rejects documents whose signal exceeds a cutoff.  Cutoffs are chosen per stratum
(language) from all labelled documents, of which TUNE in OF propose and the others, the
holdout, certify:

1.  The proposing part fixes one nested sequence of rule sets.  Each step adds a rule or
    lowers a rule's cutoff, those that lose no good document first, and then, level by level,
    those that lose few; a step that catches no further bad document is left out.
2.  The holdout tests the sets in this order.  A set is certified if the exact binomial test
    rejects "it loses over RISK of the good documents" at level CONFIDENCE / strata, and the
    first that fails ends the stratum: fixed-sequence testing, so each stratum keeps its level
    whatever the number of steps, and Bonferroni over strata keeps CONFIDENCE for all.

A stratum whose holdout has too few good documents certifies nothing, and its rules stay off:
217 that lose none are needed with four strata.  Texts are read once; what follows is sums
over their signals, and no table of rows reaches the driver.
"""

from __future__ import annotations

import math
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from marquee.llm.common import materialise, slices, texts

#: Share of good documents that the rules may reject, and the chance that they reject more in any stratum.
RISK, CONFIDENCE = 0.02, 0.05
#: Levels of cutoffs for each rule: quantiles of good documents from their largest signal down to RISK / 2 from the top.
LEVELS = 8
#: Share of the labelled documents that propose.
TUNE, OF = 1, 6
#: A large holdout; tests hold the binomial test to one rule on both sides of it.
EXACT = 1_000_000
#: Up to so many strata, their cutoffs are broadcast; beyond, they are joined by a shuffle.
BROADCAST_STRATA = 20_000
#: The base rules.
LEAST_WORDS, MOST_REPEATED = 50, 50
RULES = ("symbols", "duplicate_lines", "repeated_words", "long_words", "short_words", "capitals", "marks", "bars")

_SYMBOLS, _SPACES, _CAPITALS, _MARKS = b"#*$%&|<>", b" \t\n\v\f\r", bytes(range(65, 91)), b"!?"
_WORDED = re.compile(r"[^\x20\x09-\x0D]").search
_COLUMNS = ("doc_id", "text", "stratum")
_BASE = ("doc_id", "stratum", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")


def repeated_words(words: list[bytes]) -> int:
    """Words in 3-word windows that occur twice or more."""
    n = len(words)
    if n < 4:
        return 0
    ids = dict(zip(dict.fromkeys(words), range(n)))  # noqa: B905
    w = np.fromiter(map(ids.__getitem__, words), np.int64, n)
    pairs = np.unique(w[:-1] * len(ids) + w[1:], return_inverse=True)[1]
    _, which, times = np.unique(pairs[:-1] * len(ids) + w[2:], return_inverse=True, return_counts=True)
    twice = times[which] >= 2
    covered = np.zeros(n, bool)
    for k in range(3):
        covered[k : n - 2 + k] |= twice
    return int(covered.sum())


def signals(text: str) -> tuple[tuple[int, int, int, int, int], list[float]]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words; and the rules' signals, of which more is worse."""
    raw = text.encode()
    words = raw.split()
    spaces = len(raw) - len(raw.translate(None, _SPACES))
    count = lambda chars: len(raw) - len(raw.translate(None, chars))
    lines = [x for x in text.split("\n") if _WORDED(x)]
    n, chars, symbols, dup, rep = len(words), len(text) - spaces, count(_SYMBOLS), len(lines) - len(set(lines)), repeated_words(words)
    per = max(n, 1)
    ratios = [symbols / per, dup / max(len(lines), 1), rep / per, chars / per, -chars / per, count(_CAPITALS) / max(chars, 1), count(_MARKS) / per, raw.count(b"|") / per]
    return (n, chars, symbols, dup, rep), ratios


def base_fails(n_words: int, n_repeat: int) -> bool:
    return n_words < LEAST_WORDS or 100 * n_repeat > MOST_REPEATED * n_words


def _stirling_error(n: int) -> float:
    """log n! less Stirling's formula for it."""
    if n < 16:
        return math.lgamma(n + 1) - (n + 0.5) * math.log(n) + n - 0.5 * math.log(2 * math.pi) if n else 0.0
    return (1 / 12 - (1 / 360 - (1 / 1260 - (1 / 1680) / n**2) / n**2) / n**2) / n


def _deviance(x: int, mean: float) -> float:
    """x log(x / mean) + mean - x."""
    d = (x - mean) / mean
    return mean * ((1 + d) * math.log1p(d) - d) if x else mean


def _binomial_term(k: int, n: int, p: float) -> float:
    """P(X = k), by Loader's saddle points, which lose no digits where n is large."""
    if k in (0, n):
        return math.exp(n * (math.log1p(-p) if k == 0 else math.log(p)))
    error = _stirling_error(n) - _stirling_error(k) - _stirling_error(n - k) - _deviance(k, n * p) - _deviance(n - k, n * (1 - p))
    return math.exp(error) * math.sqrt(n / (2 * math.pi * k * (n - k)))


def binomial_tail(k: int, n: int, p: float) -> float:
    """P(X <= k) of a binomial, by one rule for every n.

    The terms on the side of k that lies away from the mean fall off, so they are summed from k on until no more of them
    can count in a float: some multiple of the square root of n.
    """
    if k >= n:
        return 1.0
    lower = k <= n * p
    i = k if lower else k + 1
    total = term = _binomial_term(i, n, p)
    while term > total * 1e-18:
        term *= i * (1 - p) / ((n - i + 1) * p) if lower else (n - i) * p / ((i + 1) * (1 - p))
        i += -1 if lower else 1
        total += term
    return min(1.0, total) if lower else max(0.0, 1.0 - total)


def certified(n: int, lost: list[int], level: float, risk: float = RISK) -> int:
    """Steps of a fixed sequence that pass in order: ``lost`` has the holdout documents, of n, that each step loses in all."""
    for step, k in enumerate(lost):
        if binomial_tail(k, n, risk) > level:
            return step
    return len(lost)


def measured(docs: DataFrame) -> DataFrame:
    """doc_id, stratum, the base signals, base_failed and the rules' signals of each of ``docs`` (doc_id, text, stratum)."""

    def measure(batches):
        for ids, rows, strata in slices(batches, _COLUMNS):
            found = [signals(t) for t in rows]
            base = [pa.array([b[k] for b, _ in found], pa.int64()) for k in range(5)]
            failed = pa.array([base_fails(b[0], b[4]) for b, _ in found], pa.bool_())
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(strata, pa.string()), *base, failed, pa.array([x for _, x in found], pa.list_(pa.float64()))], [*_BASE, "signals"])

    return docs.mapInArrow(measure, "doc_id long, stratum string, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, signals array<double>")


def _small(df: DataFrame) -> DataFrame:
    """A table of strata, broadcast where their number allows it."""
    return F.broadcast(df) if df.limit(BROADCAST_STRATA + 1).count() <= BROADCAST_STRATA else df


def _steps(tune: DataFrame, risk: float, levels: int) -> DataFrame:
    """stratum, steps: the nested sequence (rule, cut) of each stratum that the proposing rows (stratum, good, signals) fix."""
    quantiles = [1 - risk / 2 * k / (levels - 1) for k in range(levels)]
    each = tune.select("stratum", "good", F.posexplode("signals").alias("rule", "signal"))
    cuts = each.filter("good").groupBy("stratum", "rule").agg(F.percentile_approx("signal", quantiles, 10_000).alias("cuts"))
    bad = each.filter("NOT good").join(F.broadcast(cuts) if cuts.limit(BROADCAST_STRATA + 1).count() <= BROADCAST_STRATA else cuts, ["stratum", "rule"])
    above = bad.select("stratum", "rule", "signal", F.posexplode("cuts").alias("level", "cut")).filter(F.col("signal") > F.col("cut"))
    caught = above.groupBy("stratum", "rule", "level", "cut").agg(F.count(F.lit(1)).alias("n"), F.min("signal").alias("next"))
    earlier = Window.partitionBy("stratum", "rule").orderBy("level")
    more = caught.withColumn("before", F.coalesce(F.lag("n").over(earlier), F.lit(0))).filter("n > before")
    # Halfway to the next bad document a cutoff catches the same ones and loses less.
    step = F.struct("level", (-F.col("n")).alias("less"), "rule", (F.col("cut") + (F.col("next") - F.col("cut")) / 2).alias("cut"))
    return more.groupBy("stratum").agg(F.array_sort(F.collect_list(step)).alias("steps"))


def thresholds(table: DataFrame, labels: DataFrame, risk: float = RISK, confidence: float = CONFIDENCE, levels: int = LEVELS) -> DataFrame:
    """stratum, cutoffs (one for each rule, infinite where it is off), n (good holdout documents), certified (steps) of the strata that have labels.

    ``table`` is that of ``measured``.
    """
    one = labels.filter("doc_id IS NOT NULL AND quality IS NOT NULL").groupBy(F.col("doc_id").cast("long").alias("doc_id"))
    one = one.agg(F.min((F.col("quality") == 1) & (F.coalesce(F.col("toxic"), F.lit(0)) == 0)).alias("good"), F.min("quality").alias("quality"))
    tune = F.pmod(F.xxhash64("doc_id", F.lit(23)), F.lit(OF)) < TUNE
    known = table.filter("NOT base_failed").select("doc_id", "stratum", "signals").join(one.filter("good OR quality = 0"), "doc_id")
    known = materialise(known.select("stratum", "signals", "good", tune.alias("tune")))
    steps = materialise(_steps(known.filter("tune"), risk, levels))
    strata = steps.count()
    held = known.filter("good AND NOT tune").join(_small(steps), "stratum")
    breaks = F.transform("steps", lambda x, at: F.when(F.element_at("signals", x["rule"] + 1) > x["cut"], at))
    firsts = held.select("stratum", F.coalesce(F.array_min(breaks), F.lit(-1)).alias("first")).groupBy("stratum", "first").agg(F.count(F.lit(1)).alias("n"))
    firsts = firsts.groupBy("stratum").agg(F.collect_list(F.struct("first", "n")).alias("firsts"))  # one row for each step at most

    def decide(batches):
        for batch in batches:
            rows = []
            for row in batch.to_pylist():
                lost = np.zeros(len(row["steps"]), np.int64)
                for x in row["firsts"]:
                    if x["first"] >= 0:
                        lost[x["first"] :] += x["n"]
                n = sum(x["n"] for x in row["firsts"])
                good = certified(n, lost.tolist(), confidence / strata, risk)
                cutoffs = [math.inf] * len(RULES)
                for x in row["steps"][:good]:
                    cutoffs[x["rule"]] = min(cutoffs[x["rule"]], x["cut"])
                rows.append({"stratum": row["stratum"], "cutoffs": cutoffs, "n": n, "certified": good})
            yield pa.RecordBatch.from_pylist(rows, pa.schema({"stratum": pa.string(), "cutoffs": pa.list_(pa.float64()), "n": pa.int64(), "certified": pa.int32()}))

    return materialise(steps.join(firsts, "stratum").mapInArrow(decide, "stratum string, cutoffs array<double>, n long, certified int"))


def _broken(signals_: Column, cutoffs: Column) -> Column:
    """Names of the rules whose cutoffs are exceeded; none without cutoffs."""
    named = F.zip_with(signals_, cutoffs, lambda s, c: s > c)
    return F.filter(F.transform(named, lambda hit, at: F.when(hit, F.element_at(F.array(*map(F.lit, RULES)), at + 1))), lambda name: name.isNotNull())


def quality_rules(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", stratum_col: str = "lang", risk: float = RISK, confidence: float = CONFIDENCE) -> DataFrame:
    """One row per input row: doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, reasons.

    Null texts have no words and fail the base rules, as do empty ones.  A null stratum is a
    stratum of its own.  Strata without labels have no rule but the base.  Good is
    quality 1 and not toxic, by the worst of repeated labels; toxic documents of good quality
    take no part, as no rule is about them.  Repeated rows are judged alike; an empty table
    gives none; extra columns are ignored.
    """
    table = materialise(measured(texts(docs, id_col, text_col, F.coalesce(F.concat(F.lit("="), F.col(stratum_col).cast("string")), F.lit("null")).alias("stratum"))))
    cutoffs = thresholds(table, labels, risk, confidence).select("stratum", "cutoffs")
    judged = table.join(_small(cutoffs), "stratum", "left").withColumn("reasons", F.coalesce(_broken(F.col("signals"), F.col("cutoffs")), F.array().cast("array<string>")))
    return judged.select("doc_id", *_BASE[2:], (~F.col("base_failed") & (F.size("reasons") == 0)).alias("kept"), "reasons")
