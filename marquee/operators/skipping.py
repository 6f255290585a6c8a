"""What each file of the stored table may hold, so that a search opens only files that can have a hit.

A file has a row: how many rows it has, the least and the greatest date text, and bitmaps of its cities, its
artists and the letter groups of its texts.  Bitmaps are those of ``bitmap_construct_agg``: 4 KB each, whatever a
file holds.  Values that share a bit cost a file that is read in vain; no hit is ever left out.
"""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, functions as F

BITS = 32768
#: Lengths of letter groups.  A search takes the longest that its words have, so words of one or two letters, as Chinese ones are, are found too.
GRAMS = (1, 2, 3)
TEXTS = ("title", "venue", "city", "artist")
#: Those that are also looked for as wholes.
FACETS = ("city", "artist")
PLACE = ("write", "bucket", "month", "file")
KINDS = (*FACETS, *(f"grams{n}" for n in GRAMS))
#: Columns of a summary but for the write.
SUMMARY = "bucket int, month string, file string, n long, least string, greatest string, " + ", ".join(f"{k} binary" for k in KINDS)


def _grams(text: Column, n: int) -> Column:
    """Groups of n letters next to each other, in small letters; both small sigmas are one, as which of them is written depends on the place."""
    letters = F.filter(F.split(F.translate(F.lower(text), "ς", "σ"), ""), lambda x: x != "")
    starts = lambda ls: F.when(F.size(ls) >= n, F.sequence(F.lit(1), F.size(ls) - n + 1)).otherwise(F.array().cast("array<int>"))
    # The letters are the variable of an outer step: a text is split once and not for each group.
    grams = F.flatten(F.transform(F.array(letters), lambda ls: F.transform(starts(ls), lambda i: F.array_join(F.slice(ls, i, n), ""))))
    return F.coalesce(grams, F.array().cast("array<string>"))


def _bits(kind: str, texts: Column) -> Column:
    """The bits of some values; null has none."""
    bits = F.transform(F.filter(texts, lambda x: x.isNotNull()), lambda x: F.pmod(F.xxhash64(x), F.lit(BITS)).cast("int"))
    return F.transform(F.array_distinct(bits), lambda b: F.struct(F.lit(kind).alias("kind"), b.alias("bit")))


def summarise(rows: DataFrame) -> DataFrame:
    """A row a file of rows with write, bucket, month and file.

    Texts and bits of a file are made distinct in the tasks first, so what repeats within a file is neither cut nor shuffled again.
    """
    texts = rows.select(*PLACE, F.explode(F.array(*(F.struct(F.lit(c).alias("column"), F.col(c).alias("text")) for c in TEXTS))).alias("t")).select(*PLACE, "t.*")
    # A text is cut once for a file, however many of its rows and columns have it.
    texts = texts.filter("text IS NOT NULL").groupBy(*PLACE, "text").agg(*(F.max(F.col("column") == c).alias(c) for c in FACETS))
    facets = F.filter(F.array(*(F.when(F.col(c), F.lit(c)) for c in FACETS)), lambda kind: kind.isNotNull())
    whole = F.transform(facets, lambda kind: F.struct(kind.alias("kind"), F.pmod(F.xxhash64("text"), F.lit(BITS)).cast("int").alias("bit")))
    bits = [whole, *(_bits(f"grams{n}", _grams(F.col("text"), n)) for n in GRAMS)]
    seen = texts.select(*PLACE, F.explode(F.concat(*bits)).alias("x")).select(*PLACE, "x.*").distinct()
    maps = seen.groupBy(*PLACE).agg(*(F.bitmap_construct_agg(F.when(F.col("kind") == k, F.col("bit"))).alias(k) for k in KINDS))
    zones = rows.groupBy(*PLACE).agg(F.count(F.lit(1)).alias("n"), F.min("date").alias("least"), F.max("date").alias("greatest"))
    return zones.join(maps, list(PLACE), "left")


def _has(bitmap: str, bit: Column) -> Column:
    byte = F.conv(F.hex(F.substring(F.col(bitmap), (F.floor(bit / 8) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
    return F.coalesce(F.getbit(byte, F.pmod(bit, F.lit(8))) == 1, F.lit(False))


def _has_value(bitmap: str, value: str) -> Column:
    return _has(bitmap, F.pmod(F.xxhash64(F.lit(value)), F.lit(BITS)).cast("int"))


def _has_words(words: str) -> Column:
    """If each letter group of the words is in the file; which text has it is not known, so any does."""
    arms = [(n, F.transform(_grams(F.lit(words), n), lambda g: F.pmod(F.xxhash64(g), F.lit(BITS)).cast("int"))) for n in GRAMS]
    fit = lambda n, bits: F.forall(bits, lambda b: _has(f"grams{n}", b))
    out = fit(*arms[0])
    for n, bits in arms[1:]:
        out = F.when(F.size(bits) > 0, fit(n, bits)).otherwise(out)
    return out


def _has_month(month: str) -> Column:
    """If the date texts of a file span some text that starts with the month, in either way to write it."""
    starts = {month, month.replace("-", ".", 1)}
    spans = [(F.substring("least", 1, len(s)) <= s) & (F.col("greatest") >= s) for s in sorted(starts)]
    return F.coalesce(reduce(lambda a, b: a | b, spans), F.lit(False))


def may_have(city: str | None = None, artist: str | None = None, words: str | None = None, month: str | None = None, city_part: str | None = None) -> Column:
    """A condition on summaries that holds for each file with a row of this city and artist, these words, month and part of a city's name."""
    arms = [_has_value("city", city)] if city else []
    if artist:
        arms.append(_has_value("artist", artist))
    arms += [_has_words(w) for w in (words, city_part) if w]
    if month and not set("%_\\") & set(month):
        arms.append(_has_month(month))
    return reduce(and_, arms, F.lit(True))
