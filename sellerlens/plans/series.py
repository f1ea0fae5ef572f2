"""Orders and sales as two series over days or weeks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sellerlens.functions import dates
from sellerlens.functions.dates import Day
from sellerlens.operators import grouping, periods
from sellerlens.plans.articles import AMOUNT, priced_orders, priced_sales

DAILY = ("last_7", "last_30", "this_month")

WEEK_KEYS = {
    "padded": dates.yearweek,
    "unpadded": dates.unpadded_yearweek,
    "iso": dates.iso_yearweek,
}


def bucket_column(grain: str, week_key: str = "padded") -> Column:
    if grain == "day":
        return dates.day_of("date")
    return WEEK_KEYS[week_key]("date").cast("bigint")


def one_series(priced: DataFrame, label: str, bucket: Column, by: Sequence[str] = ()) -> DataFrame:
    per_bucket = grouping.count_and_sum(priced.select(*by, bucket.alias("bucket"), AMOUNT), [*by, "bucket"], AMOUNT)
    shown = F.col("bucket").cast("string") if dict(per_bucket.dtypes)["bucket"] == "date" else F.col("bucket")
    return per_bucket.select(*by, F.lit(label).alias("series"), shown.alias("bucket"), "qty", AMOUNT)


def orders_vs_sales(
    orders: DataFrame,
    sales: DataFrame,
    period: str,
    as_of: Day,
    grain: str | None = None,
    mode: str = "reference",
    week_key: str = "padded",
    start: Day | None = None,
    end: Day | None = None,
    by: Sequence[str] = (),
) -> DataFrame:
    """Both series in long form, a ``series`` label beside the bucket.

    Unlike the article reports, cancelled orders and reversed sales are counted here.
    ``week_key="unpadded"`` gives the week key without zero padding and January rule.
    ``by`` gives each group of those columns its own pair of series.
    """
    grain = grain or ("day" if period in DAILY else "week")
    bucket = bucket_column(grain, week_key)
    pick = dict(as_of=as_of, feed="series", mode=mode, start=start, end=end, by=by)
    return one_series(
        priced_orders(periods.select_period(orders, period, **pick)), "orders", bucket, by
    ).unionByName(
        one_series(priced_sales(periods.select_period(sales, period, **pick)), "sales", bucket, by)
    )


def in_order(series: DataFrame) -> DataFrame:
    return series.orderBy("series", F.asc_nulls_first("bucket"))


def wide(series: DataFrame) -> DataFrame:
    """One row per bucket with both series side by side."""
    def pick(label: str, column: str) -> Column:
        return F.max(F.when(F.col("series") == label, F.col(column)))

    return series.groupBy("bucket").agg(
        *[pick(s, c).alias(f"{s}_{c}") for s in ("orders", "sales") for c in ("qty", AMOUNT)]
    )


def series_totals(series: DataFrame) -> DataFrame:
    """Caption figures per series; a series without rows is reported as such, not left out."""
    sums = series.groupBy("series").agg(
        grouping.rounded_total(AMOUNT).alias("total_amount"), F.sum("qty").alias("total_qty")
    )
    labels = series.sparkSession.range(1).select(F.explode(F.array(F.lit("orders"), F.lit("sales"))).alias("series"))
    return labels.join(sums, "series", "left").select(
        "series",
        F.coalesce("total_amount", F.lit(0)).cast("bigint").alias("total_amount"),
        F.coalesce("total_qty", F.lit(0)).cast("bigint").alias("total_qty"),
        F.when(F.col("total_qty").isNull(), "no_data").otherwise("ok").alias("status"),
    )
