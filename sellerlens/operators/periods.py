"""Period selectors.

Two kinds. A *dated* period is a plain comparison with constants derived from ``as_of``, so it
reaches the file scan and prunes date partitions. A *newest bucket* period looks at the data: it
keeps the rows of the newest (or second newest) week or month present. Its bounds come from an
aggregate over the date column alone, used as a scalar subquery: nothing is joined, one value
travels, and the lower date bound is pushed into the second scan at run time.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sellerlens.functions import dates
from sellerlens.functions.dates import Day, literal_like, to_day

Bucket = Callable[[Column], Column]


# --- dated -----------------------------------------------------------------------------------

def day_column(column: str) -> str:
    """Partition column of ``sinks.write_by_day`` by ``column``; its name tells which column's day it is."""
    return f"{column}_day"


def _by_day(df: DataFrame, column: str) -> str | None:
    """The partition column that bounds on ``column`` may use too, if the table has it."""
    day = day_column(column)
    return day if day in df.columns and df.schema[day].dataType == T.DateType() else None


def since(df: DataFrame, column: str, start: Day) -> DataFrame:
    """``column >= start``; on a table partitioned by day, only from the first such day."""
    if day := _by_day(df, column):
        df = df.where(F.col(day) >= F.lit(to_day(start)))
    return df.where(F.col(column) >= literal_like(df, column, start))


def between(df: DataFrame, column: str, start: Day, end: Day) -> DataFrame:
    """Half-open: ``start <= column < end``."""
    if day := _by_day(df, column):
        df = df.where((F.col(day) >= F.lit(to_day(start))) & (F.col(day) <= F.lit(to_day(end))))
    return df.where(
        (F.col(column) >= literal_like(df, column, start))
        & (F.col(column) < literal_like(df, column, end))
    )


def days(df: DataFrame, column: str, first: Day, last: Day) -> DataFrame:
    """Whole calendar days, both ends included."""
    return between(df, column, to_day(first), to_day(last) + dt.timedelta(days=1))


def add_months(day: dt.date, months: int) -> dt.date:
    """Same day of another month, or that month's last day."""
    index = day.year * 12 + day.month - 1 + months
    first = dt.date(index // 12, index % 12 + 1, 1)
    after = dt.date((index + 1) // 12, (index + 1) % 12 + 1, 1)
    return min(first + dt.timedelta(days=day.day - 1), after - dt.timedelta(days=1))


def calendar_bounds(name: str, as_of: dt.date) -> tuple[dt.date, dt.date]:
    """First day and day after the last of a calendar period."""
    monday = as_of - dt.timedelta(days=as_of.weekday())
    first = as_of.replace(day=1)
    week = dt.timedelta(days=7)
    bounds = {
        "this_week": (monday, monday + week),
        "prev_week": (monday - week, monday),
        "this_month": (first, add_months(first, 1)),
        "prev_month": (add_months(first, -1), first),
    }
    return bounds[name]


# --- newest bucket ---------------------------------------------------------------------------

def newest_bucket(df: DataFrame, column: str, bucket: Bucket, skip: int = 0, by: Sequence[str] = ()) -> DataFrame:
    """Rows of the newest bucket that occurs, or of the one ``skip`` occurring buckets earlier.

    With ``by`` every group (every seller, say) has its own newest bucket; see ``_in_buckets``.

    Two scalars come from one aggregate over the dates: the bucket, and the earliest date in it,
    whose plain comparison is the part the scan can use. Sorting by both columns keeps the two
    subqueries the same up to their last projection, so the aggregate runs once.
    """
    seen = _by_day(df, column) or column  # with day partitions their values are enough
    keyed = df.select(*by, F.col(seen).alias("d"), bucket(F.col(seen)).alias("b")).where("b IS NOT NULL")
    if by:
        place = F.row_number().over(Window.partitionBy(*by).orderBy(F.desc("b")))
        own = keyed.groupBy(*by, "b").agg(F.min("d").alias("d")).withColumn("nth", place).where(F.col("nth") == skip + 1)
        return _in_buckets(df, own.drop("nth"), by, seen, {"b": bucket(F.col(column))})
    found = (
        keyed.groupBy("b").agg(F.min("d").alias("d"))
        .orderBy(F.desc("b"), "d").offset(skip).limit(1)
    )
    first_day, newest = found.select("d").scalar(), found.select("b").scalar()
    return df.where((F.col(seen) >= first_day) & (bucket(F.col(column)) == newest))


def _in_buckets(df: DataFrame, own: DataFrame, by: Sequence[str], seen: str, keys: dict[str, Column]) -> DataFrame:
    """Rows whose group and bucket stand in ``own``, one row per group with its earliest date ``d``.

    The join is on group *and* bucket, so that a group with a large share of all rows is no key by
    itself; rows before the earliest date of any group's bucket are not read. Rows whose group is
    null belong to none.
    """
    earliest = own.agg(F.min("d").alias("d")).scalar()
    marked = df.where(F.col(seen) >= earliest).withColumns({f"__{k}": e for k, e in keys.items()})
    wanted = own.select(*by, *[F.col(k).alias(f"__{k}") for k in keys])
    return marked.join(wanted, [*by, *wanted.columns[len(by):]], "left_semi").select(*df.columns)


def separate_maxima(df: DataFrame, column: str, part: Bucket, shift: int = 0, by: Sequence[str] = ()) -> DataFrame:
    """Rows of the newest year whose week (or month) number is the highest of *any* year.

    ``shift=0`` keeps numbers at or above that maximum, ``shift=1`` exactly the one below. Early
    in a year this selects nothing, since an earlier year reached a higher number. The newest
    year enters as its first date, which the scan can use; one aggregate serves both scalars.
    With ``by`` every group has its own newest year and highest number.
    """
    seen = _by_day(df, column) or column
    keyed = df.select(
        *by, F.col(seen).alias("d"), F.year(dates.ts(seen)).alias("y"), part(F.col(seen)).alias("n")
    ).where("y IS NOT NULL")
    if by:
        fine = keyed.groupBy(*by, "y").agg(F.min("d").alias("d"), F.max("n").alias("n"))
        own = fine.groupBy(*by).agg(F.max("y").alias("y"), (F.max("n") - shift).alias("n"), F.max_by("d", "y").alias("d"))
        return _in_buckets(df, own, by, seen, {"y": F.year(dates.ts(column)), "n": part(F.col(column))})
    per_year = keyed.groupBy("y").agg(F.min("d").alias("d"), F.max("n").alias("n"))
    first_day = per_year.orderBy(F.desc("y"), "d", "n").limit(1).select("d").scalar()
    top_number = per_year.orderBy(F.desc("n"), "d", "y").limit(1).select("n").scalar()
    number = part(F.col(column))
    hit = number >= top_number if shift == 0 else number == top_number - shift
    return df.where((F.col(seen) >= first_day) & hit)


def week_number(column: Column) -> Column:
    return F.weekofyear(dates.ts(column))


def month_number(column: Column) -> Column:
    return F.month(dates.ts(column))


def one_bucket(df: DataFrame, column: str, bucket: Bucket, value: int) -> DataFrame:
    """Rows of one bucket ``year * 100 + number``.

    Its dates lie in that year or in the January after; the scan can use that much.
    """
    year = value // 100
    near = between(df, column, dt.date(year, 1, 1), dt.date(year + 1, 2, 1))
    return near.where(bucket(F.col(column)) == F.lit(value))


# --- names -----------------------------------------------------------------------------------

# Days back from as_of for the open-ended periods. Reports count 30 back (31 calendar days),
# series one less than the number in their name.
REPORT_DAYS_BACK = {"today": 0, "last_30": 30}
SERIES_DAYS_BACK = {"last_7": 6, "last_30": 29, "last_90": 89, "last_180": 179, "last_365": 364}

BUCKETED = ("this_week", "prev_week", "this_month", "prev_month")
REPORT_PERIODS = ("today", "yesterday", *BUCKETED, "last_30", "range", "all")
SERIES_PERIODS = (*SERIES_DAYS_BACK, "this_month", "months_3", "months_6", "year_to_date", "range", "all")
MODES = ("reference", "calendar")


def select_period(
    df: DataFrame,
    name: str,
    *,
    as_of: Day,
    feed: str,
    mode: str = "reference",
    column: str = "date",
    start: Day | None = None,
    end: Day | None = None,
    by: Sequence[str] = (),
) -> DataFrame:
    """Rows of a named period.

    ``feed`` is ``orders``, ``sales`` or ``series``, which read week and month names
    differently. ``mode="reference"`` finds them in the data as those feeds' reports do,
    ``mode="calendar"`` from ``as_of``. ``range`` takes ``start`` and ``end``, both included.
    ``by`` names columns, such as a seller's, whose groups each have their own newest buckets.
    """
    if mode not in MODES:
        raise ValueError(f"mode {mode!r}: expected one of {MODES}")
    as_of = to_day(as_of)
    allowed = SERIES_PERIODS if feed == "series" else REPORT_PERIODS
    if name not in allowed:
        raise ValueError(f"{feed} period {name!r}: expected one of {allowed}")

    if name == "all":
        return df
    if name == "range":
        if start is None or end is None:
            raise ValueError("period 'range' needs start and end")
        return days(df, column, start, end)
    if name == "yesterday":
        return between(df, column, as_of - dt.timedelta(days=1), as_of)
    if name == "year_to_date":
        return since(df, column, as_of.replace(month=1, day=1))
    if name.startswith("months_"):
        return since(df, column, add_months(as_of, -int(name.split("_")[1])))

    back = SERIES_DAYS_BACK if feed == "series" else REPORT_DAYS_BACK
    if name in back:
        return since(df, column, as_of - dt.timedelta(days=back[name]))

    if mode == "calendar":
        return between(df, column, *calendar_bounds(name, as_of))
    shift = 1 if name.startswith("prev_") else 0
    weekly = name.endswith("_week")
    if feed == "orders":
        return newest_bucket(df, column, dates.yearweek if weekly else dates.yearmonth, shift, by)
    return separate_maxima(df, column, week_number if weekly else month_number, shift, by)
