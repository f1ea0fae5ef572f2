"""Whole-table questions about orders."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sellerlens.functions.dates import Day
from sellerlens.operators import grouping, periods


def orders_per_product(orders: DataFrame, start: Day | None = None, end: Day | None = None) -> DataFrame:
    """Order sums per product and its first article, optionally for ``start <= date < end``."""
    if start is not None:
        orders = periods.between(orders, "date", start, end)
    return grouping.first_by_date(
        orders, "nmId", "supplierArticle", "date", ["finishedPrice", "priceWithDisc"]
    )


def by_price(per_product: DataFrame) -> DataFrame:
    return per_product.orderBy(F.desc("finishedPrice"), "nmId")


def realized_revenue_since(orders: DataFrame, start: Day) -> DataFrame:
    chosen = periods.since(orders, "date", start).where(F.col("isRealization"))
    return chosen.agg(grouping.total("priceWithDisc").alias("revenue"))


def count_in_range(orders: DataFrame, start: Day, end: Day) -> DataFrame:
    return periods.between(orders, "date", start, end).agg(F.count(F.lit(1)).alias("n"))


def distinct_orders(orders: DataFrame, approximate: bool = False) -> DataFrame:
    return grouping.distinct_count(orders, "srid", approximate)
