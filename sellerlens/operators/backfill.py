"""Back-fill planning: which windows cover a date range, which of them have not landed."""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sellerlens.functions.dates import Day, day_of, to_day
from sellerlens.operators import periods


def recent_start(start: Day, end: Day, days_back: int) -> dt.date:
    """Start of a quick load that only reaches ``days_back`` days before the end."""
    return max(to_day(end) - dt.timedelta(days=days_back), to_day(start))


def windows(start: Column, end: Column, span: int, whole: bool = True) -> Column:
    """Array of windows ``(from, to)`` of ``span`` days back to back, the last cut at ``end``.

    ``whole=False`` leaves out a last window of a single day, which the loop ``while from < to``
    never reaches.
    """
    last = end if whole else F.date_sub(end, 1)
    count = F.greatest(F.floor(F.datediff(last, start) / span) + 1, F.lit(0)).cast("int")
    indexes = F.slice(F.sequence(F.lit(0), F.greatest(count, F.lit(1)) - 1), 1, count)

    def window(i: Column) -> Column:
        first = F.date_add(start, i * span)
        return F.struct(
            i.cast("bigint").alias("window_id"),
            first.alias("date_from"),
            F.least(F.date_add(first, span - 1), end).alias("date_to"),
        )

    return F.transform(indexes, window)


def covering_windows(df: DataFrame, column: str, span: int, whole: bool = True) -> DataFrame:
    """The windows that cover all days present in a table."""
    day = day_of(column)
    bounds = df.agg(F.min(day).alias("lo"), F.max(day).alias("hi")).where("lo IS NOT NULL")
    return bounds.select(
        F.explode(windows(F.col("lo"), F.col("hi"), span, whole)).alias("w")
    ).select("w.*")


def window_index(column: str, start: Day, span: int) -> Column:
    """Which window a row falls in: arithmetic on the date, in place of a range join."""
    first = F.lit(to_day(start).isoformat()).cast("date")
    return F.floor(F.datediff(day_of(column), first) / span).cast("bigint")


def _within(df: DataFrame, column: str, first: dt.date, last: dt.date, span: int) -> DataFrame:
    """Rows of whole days ``first`` to ``last`` with their window.

    The bounds compare the column as it is stored, text or date, so that they reach the scan;
    text that is no date falls out by its missing window.
    """
    return (
        periods.days(df, column, first, last)
        .withColumn("window_id", window_index(column, first, span))
        .where("window_id IS NOT NULL")
    )


def rows_per_window(
    df: DataFrame, column: str, start: Day, end: Day, span: int, whole: bool = True
) -> DataFrame:
    """Row count of every window of the range, with its bounds. Windows without rows are absent."""
    first, last = to_day(start), to_day(end)
    upper = last
    if not whole and (last - first).days % span == 0:
        upper = last - dt.timedelta(days=1)
    lit = lambda d: F.lit(d.isoformat()).cast("date")
    counted = (
        _within(df, column, first, upper, span)
        .groupBy("window_id")
        .agg(F.count(F.lit(1)).alias("n"))
    )
    opened = F.date_add(lit(first), (F.col("window_id") * span).cast("int"))
    return counted.select(
        "window_id",
        opened.alias("date_from"),
        F.least(F.date_add(opened, span - 1), lit(last)).alias("date_to"),
        "n",
    )


def missing_slices(
    campaigns: DataFrame, landed: DataFrame, column: str, start: Day, end: Day, span: int,
    whole: bool = True, by: Sequence[str] = (),
) -> DataFrame:
    """(campaign, window) pairs of the range for which nothing has landed.

    With ``by`` a campaign is named by those columns and its id together.

    The full grid is never formed. What travels per campaign is the set of window numbers it
    has, at most as many as the range has windows; the gaps are an array difference.
    """
    first, last = to_day(start), to_day(end)
    lit = lambda d: F.lit(d.isoformat()).cast("date")
    key = [*by, "advertId"]
    present = (
        _within(landed, column, first, last, span)
        .select(*key, "window_id")
        .distinct()
        .groupBy(*key)
        .agg(F.collect_set("window_id").alias("present"))
    )
    n = (last - first).days // span + 1
    if not whole and (last - first).days % span == 0:
        n -= 1
    every = F.slice(F.sequence(F.lit(0).cast("bigint"), F.lit(max(n, 1) - 1).cast("bigint")), 1, max(n, 0))
    none = F.array().cast("array<bigint>")
    opened = F.date_add(lit(first), (F.col("window_id") * span).cast("int"))
    return (
        campaigns.select(*key).distinct()
        .join(present, key, "left")
        .select(
            *key,
            F.explode(F.array_except(every, F.coalesce("present", none))).alias("window_id"),
        )
        .select(
            *key,
            "window_id",
            opened.alias("date_from"),
            F.least(F.date_add(opened, span - 1), lit(last)).alias("date_to"),
        )
    )


# --- ranges of days --------------------------------------------------------------------------

def landed_ranges(landed: DataFrame, column: str, start: Day, end: Day, by: Sequence[str] = ("advertId",)) -> DataFrame:
    """``date_from, date_to, days``: unbroken runs of days for which anything has landed, per campaign.

    Days next to each other make one range, whatever windows they were fetched in. Windows run over a
    campaign's distinct days, at most as many as the range has.
    """
    days = periods.days(landed, column, start, end).select(*by, day_of(column).alias("day")).where("day IS NOT NULL").distinct()
    own = Window.partitionBy(*by).orderBy("day")
    opens = F.coalesce(F.datediff("day", F.lag("day").over(own)) > 1, F.lit(False)).cast("int")
    islands = days.withColumn("opens", opens).withColumn("island", F.sum("opens").over(own))
    return islands.groupBy(*by, "island").agg(
        F.min("day").alias("date_from"), F.max("day").alias("date_to"), F.count(F.lit(1)).alias("days")
    ).drop("island")


def missing_ranges(
    campaigns: DataFrame, landed: DataFrame, column: str, start: Day, end: Day, by: Sequence[str] = ("advertId",), span: int | None = None
) -> DataFrame:
    """``date_from, date_to``: the days still to fetch, per campaign, as the longest ranges; each cut into windows of ``span`` days if given.

    A campaign without any landed day has the whole range. Gaps are what lies between one landed range and the next; a mark behind
    the last day closes every campaign.
    """
    first, last = to_day(start), to_day(end)
    lit = lambda d: F.lit(d.isoformat()).cast("date")
    mark = campaigns.select(*by).distinct().withColumn("date_from", lit(last + dt.timedelta(days=1))).withColumn("date_to", lit(last))
    known = landed_ranges(landed, column, start, end, by).drop("days").join(campaigns.select(*by).distinct(), list(by), "left_semi")
    before = F.lag("date_to").over(Window.partitionBy(*by).orderBy("date_from"))
    gaps = known.unionByName(mark).select(
        *by, F.coalesce(F.date_add(before, 1), lit(first)).alias("date_from"), F.date_sub("date_from", 1).alias("date_to")
    ).where("date_from <= date_to")
    if span is None:
        return gaps
    return gaps.select(*by, F.explode(windows(F.col("date_from"), F.col("date_to"), span)).alias("w")).select(*by, "w.date_from", "w.date_to")
