"""Calendar expressions. All are built-in functions, so they stay inside generated code."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

Day = dt.date | str


def to_day(value: Day) -> dt.date:
    if isinstance(value, dt.datetime):
        return value.date()
    return value if isinstance(value, dt.date) else dt.date.fromisoformat(value[:10])


def literal_like(df: DataFrame, column: str, value) -> Column:
    """A literal of the column's own type.

    Casting the literal, never the column, is what lets the comparison reach the file scan.
    """
    if isinstance(value, dt.datetime):
        value = value.isoformat()
    if isinstance(value, dt.date):
        value = value.isoformat()
    return F.lit(value).cast(df.schema[column].dataType)


def ts(column: Column | str) -> Column:
    """Timestamp without zone; unreadable text gives NULL."""
    column = F.col(column) if isinstance(column, str) else column
    return column.try_cast("timestamp_ntz")


def day_of(column: Column | str) -> Column:
    return ts(column).cast("date")


def iso_day(column: Column | str) -> Column:
    """The day as ``yyyy-MM-dd`` text; a plain cast, cheaper than formatting by pattern."""
    return day_of(column).cast("string")


def yearweek(column: Column | str) -> Column:
    """``year * 100 + ISO week``, a January day in a week >= 50 counted to the year before."""
    t = ts(column)
    key = F.year(t) * 100 + F.weekofyear(t)
    return F.when((F.weekofyear(t) >= 50) & (F.month(t) == 1), key - 100).otherwise(key)


def iso_yearweek(column: Column | str) -> Column:
    """ISO year and week; unlike ``yearweek`` also right for December days in week 1."""
    t = ts(column)
    return F.extract(F.lit("YEAROFWEEK"), t) * 100 + F.weekofyear(t)


def unpadded_yearweek(column: Column | str) -> Column:
    """Year and week as digits run together: week 9 of 2023 is 20239, and no January rule."""
    t = ts(column)
    week = F.weekofyear(t)
    return F.year(t) * F.when(week < 10, 10).otherwise(100) + week


def yearmonth(column: Column | str) -> Column:
    t = ts(column)
    return F.year(t) * 100 + F.month(t)


def strip_fraction(column: Column | str) -> Column:
    """Drop the fraction of a second that stands before a zone offset."""
    column = F.col(column) if isinstance(column, str) else column
    return F.regexp_replace(column, r"\.\d+([+\-]\d{2}:\d{2})$", "$1")


def offset_parts(name: str) -> list[Column]:
    """Date, local date-time and offset of an ISO text that carries a zone offset."""
    text = strip_fraction(name)
    local = F.substring(text, 1, 19)
    parsed = local.try_cast("timestamp_ntz")
    return [
        parsed.cast("date").alias(f"{name}_date"),
        F.date_format(parsed, "yyyy-MM-dd'T'HH:mm:ss").alias(f"{name}_datetime"),
        F.nullif(F.regexp_extract(text, r"([+\-]\d{2}:\d{2})$", 1), F.lit("")).alias(f"{name}_timezone"),
    ]


def parse_dmy(value: str) -> dt.date:
    """``dd.mm.yyyy`` as typed into the custom-range prompt."""
    return dt.datetime.strptime(value.strip(), "%d.%m.%Y").date()


def parse_dmy_range(text: str) -> tuple[dt.date, dt.date]:
    start, end = text.split("-")
    return parse_dmy(start), parse_dmy(end)
