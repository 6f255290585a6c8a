"""Dates and times of listings; all are wall-clock times without zone."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from marquee.schema import WEEKDAYS

DATE = r"([0-9]{4})[-./]([0-9]{1,2})[-./]([0-9]{1,2})"
TIME = r"([0-9]{2}):([0-9]{2})"


def _numbers(text: Column, pattern: str, apart: str) -> Column:
    """The numbers of a pattern's first match, which is looked for once; without one the array has an empty text."""
    return F.split(F.regexp_extract(text, pattern, 0), apart)


def _number(parts: Column, at: int) -> Column:
    """A part of digits alone, so the cast cannot fail."""
    return F.nullif(F.get(parts, at), F.lit("")).cast("int")


def rolled(year: Column, month: Column, day: Column) -> Column:
    """A date whose month and day may lie outside the calendar: they roll over."""
    first = F.make_date(year, F.lit(1), F.lit(1))
    return F.date_add(F.add_months(first, month - 1), day - 1)


def parsed_day(text: Column) -> Column:
    """First y-M-d, y.M.d or y/M/d anywhere in a text, or null."""
    parts = _numbers(text, DATE, "[-./]")
    return rolled(_number(parts, 0), _number(parts, 1), _number(parts, 2))


def minutes_of_day(text: Column) -> Column:
    """First HH:mm in minutes, which may pass midnight; 19:30 without one."""
    parts = _numbers(text, TIME, ":")
    return F.coalesce(_number(parts, 0) * 60 + _number(parts, 1), F.lit(19 * 60 + 30))


def at(day: Column, minutes: Column) -> Column:
    return day.cast("timestamp_ntz") + F.make_dt_interval(mins=minutes)


def monday(day: Column) -> Column:
    return F.date_trunc("week", day).cast("date")


def month_set(day: Column, index: Column) -> Column:
    """The day in another month of its year (0-based), rolling over the month's end."""
    return F.date_add(F.add_months(F.trunc(day, "year"), index), F.dayofmonth(day) - 1)


def weekday(day: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, WEEKDAYS)), F.dayofweek(day))


def long_label(day: Column) -> Column:
    return F.concat(F.date_format(day, "yyyy年M月d日 "), weekday(day))
