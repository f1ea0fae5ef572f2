"""Daily partial aggregates: one small row per series and day, from which every longer report is added up.

Counts and sums add up exactly as counts and sums, distinct counts through sketches that can be merged. A new or
changed day is computed again by itself; no report reads the facts.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sellerlens.functions import dates
from sellerlens.functions.dates import Day, day_of
from sellerlens.operators import grouping, periods
from sellerlens.plans import series as plans
from sellerlens.plans.articles import AMOUNT, priced_orders, priced_sales
from sellerlens.sources import storage

SKETCH_BITS = 14   # log2 of a sketch's registers


# --- counts and sums ---

def _partials(priced: DataFrame, label: str, by: Sequence[str]) -> DataFrame:
    per_day = grouping.count_and_sum(priced.select(*by, day_of("date").alias("date"), AMOUNT), [*by, "date"], AMOUNT)
    return per_day.select(*by, F.lit(label).alias("series"), "date", "qty", AMOUNT)


def partials(orders: DataFrame, sales: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """``series, date, qty, <amount>`` per day of orders and of sales, cancelled and reversed rows counted as in the series."""
    return _partials(priced_orders(orders), "orders", by).unionByName(_partials(priced_sales(sales), "sales", by))


def _kept(partial: DataFrame, version: int) -> DataFrame:
    return partial.withColumn("version", F.lit(version).cast("bigint")).withColumn("month", F.date_trunc("month", "date").cast("date"))


def refresh(path: str, staged: str, partial: DataFrame, version: int, by: Sequence[str] = ()) -> None:
    """Days computed anew into the table of partials at ``path``: months with such days are written again, other days stay.

    ``partial`` is ``partials`` of the changed days alone; ``version`` rises from call to call, and ``staged`` is a folder of this
    call's own.
    """
    storage.merge(_kept(partial, version), path, staged, [*by, "series", "date"], "version", "month")


def changed(facts: DataFrame, days: Sequence) -> DataFrame:
    """Facts of the given days, read by their day partitions."""
    return facts.where(F.col(periods.day_column("date")).isin([d for d in days if d is not None]))


def series(daily: DataFrame, period: str, as_of: Day, grain: str | None = None, week_key: str = "padded",
           by: Sequence[str] = (), **pick) -> DataFrame:
    """``plans.series.orders_vs_sales`` from daily partials: the same rows, without reading any fact.

    Amounts are added up in another order, which shows in the last digits of a double at most.
    """
    grain = grain or ("day" if period in plans.DAILY else "week")
    bucket = plans.bucket_column(grain, week_key)
    parts = []
    for label in ("orders", "sales"):
        chosen = periods.select_period(daily.where(F.col("series") == label), period, as_of=as_of, feed="series", by=by, **pick)
        keyed = grouping.drop_null_keys(chosen.select(*by, "series", bucket.alias("bucket"), "qty", AMOUNT), *by, "bucket")
        parts.append(keyed.groupBy(*by, "series", "bucket").agg(F.sum("qty").alias("qty"), F.sum(AMOUNT).alias(AMOUNT)))
    both = parts[0].unionByName(parts[1])
    return both.withColumn("bucket", F.col("bucket").cast("string")) if grain == "day" else both


def months(daily: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """``series, month`` (year * 100 + month) with count and amount."""
    keyed = daily.select(*by, "series", dates.yearmonth("date").cast("bigint").alias("month"), "qty", AMOUNT)
    return keyed.groupBy(*by, "series", "month").agg(F.sum("qty").alias("qty"), F.sum(AMOUNT).alias(AMOUNT))


# --- distinct counts ---

def distinct_error(bits: int = SKETCH_BITS) -> float:
    """Bound on the relative error of a merged sketch's count: four standard errors, passed once in 15,000 times."""
    return 4 * 1.04 / 2 ** (bits / 2)


def distinct_partials(feed: DataFrame, key: str = "srid", bits: int = SKETCH_BITS, by: Sequence[str] = ()) -> DataFrame:
    """``date, sketch, with_null`` per day: a HyperLogLog sketch of the keys, and whether any key is null."""
    text = F.col(key).cast("string")
    return feed.groupBy(*by, day_of("date").alias("date")).agg(
        F.hll_sketch_agg(text, F.lit(bits)).alias("sketch"), F.max(text.isNull()).alias("with_null")
    )


def distinct_count(sketches: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """``n``: distinct keys over all given days, a null counting as one; sketches are merged, days that share a key don't count it twice."""
    union = sketches.groupBy(*by).agg(F.hll_union_agg("sketch").alias("sketch"), F.max("with_null").alias("with_null"))
    n = F.coalesce(F.hll_sketch_estimate("sketch"), F.lit(0)) + F.coalesce(F.col("with_null").cast("bigint"), F.lit(0))
    return union.select(*by, n.alias("n"))
