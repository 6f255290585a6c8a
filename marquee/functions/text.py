"""Column expressions over the text of listings."""

from __future__ import annotations

from collections.abc import Iterable
from functools import reduce

from pyspark.sql import Column, functions as F

#: White space as browsers take it, which is neither Java's nor Python's \s (ranges of code points); and the words that say nothing.
BLANK_RANGES = ((0x09, 0x0D), (0x20, 0x20), (0xA0, 0xA0), (0x1680, 0x1680), (0x2000, 0x200A), (0x2028, 0x2029), (0x202F, 0x202F), (0x205F, 0x205F), (0x3000, 0x3000), (0xFEFF, 0xFEFF))
NOISE_WORDS = "演唱会|巡回|站|世界|live|tour|concert"
BLANKS = "[" + "".join(rf"\x{{{a:04X}}}-\x{{{b:04X}}}" for a, b in BLANK_RANGES) + "]"
#: What a normalised title leaves out, in turn.
TITLE_NOISE = (BLANKS + "+", "【.*?】", r"\[.*?\]", r"\(.*?\)", r"[0-9]{4}", NOISE_WORDS)
START = r"([0-9]{4}[.\-][0-9]{2}[.\-][0-9]{2})"


def or_else(column: Column | str, default) -> Column:
    """The default where a value is null or empty."""
    column = F.col(column) if isinstance(column, str) else column
    return F.coalesce(F.nullif(column, F.lit("")), default if isinstance(default, Column) else F.lit(default))


def has(column: Column | str) -> Column:
    column = F.col(column) if isinstance(column, str) else column
    return F.coalesce(column != "", F.lit(False))


def trimmed(column: Column) -> Column:
    return F.regexp_replace(column, f"^{BLANKS}+|{BLANKS}+$", "")


def contains_any(column: Column, terms: Iterable[str]) -> Column:
    """If any term is part of the value; a null has none."""
    return F.coalesce(F.exists(F.array(*map(F.lit, terms)), lambda t: F.contains(column, t)), F.lit(False))


def matches(column: Column | str, wanted: str) -> Column:
    """Case-insensitive substring search."""
    column = F.col(column) if isinstance(column, str) else column
    return F.coalesce(F.contains(F.lower(column), F.lower(F.lit(wanted))), F.lit(False))


def normalize_title(title: Column) -> Column:
    """Lower case without ``TITLE_NOISE``; texts without an opening bracket skip the patterns of brackets."""

    def without(text: Column, patterns: Iterable[str]) -> Column:
        return reduce(lambda out, noise: F.regexp_replace(out, noise, ""), patterns, text)

    plain = F.translate(F.lower(title), "".join(chr(c) for a, b in BLANK_RANGES for c in range(a, b + 1)), "")
    bracketed = reduce(Column.__or__, [F.contains(title, F.lit(b)) for b in "【[("])
    return without(F.when(bracketed, without(plain, TITLE_NOISE[1:4])).otherwise(plain), TITLE_NOISE[4:])


def start_date(date: Column) -> Column:
    """First yyyy.MM.dd or yyyy-MM-dd of a date text, dotted; '' without one."""
    return F.replace(F.regexp_extract(date, START, 1), F.lit("-"), F.lit("."))


def source_label(id_: Column) -> Column:
    return F.when(id_.startswith("mt_") | id_.startswith("mtglobal_"), "摩天轮").otherwise("大麦")


def with_artist(title: Column, artist: Column) -> Column:
    return F.when(title.startswith("【"), title).otherwise(F.concat(F.lit("【"), artist, F.lit("】"), title))


def card_title(title: Column, artist: Column) -> Column:
    """Without the artist's own prefix."""
    prefix = F.concat(F.lit("【"), artist, F.lit("】"))
    named = has(artist) & ~artist.isin("Unknown", "群星") & title.startswith(prefix)
    return F.when(named, title.substr(F.length(prefix) + 1, F.length(title))).otherwise(title)


def short_title(title: Column) -> Column:
    """Without any prefix in brackets."""
    return F.regexp_replace(title, "^【.*?】", "")
