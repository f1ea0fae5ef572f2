"""Reports per seller article: orders, sales and stock."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sellerlens.functions.dates import Day
from sellerlens.functions.pricing import order_price, sale_price
from sellerlens.operators import grouping, periods, ranking
from sellerlens.sources.schemas import NOT_CANCELLED

ARTICLE = "supplierArticle"
AMOUNT = "PriceWithDiscount"

# Column heads of the exported tables.
EXPORT_NAMES = {
    "supplierArticle": "Артикул_поставщика",
    "qty": "Количество_в_шт",
    "PriceWithDiscount": "Сумма_в_рублях",
    "stock": "Остатки",
}


def export_names(report: DataFrame) -> DataFrame:
    return report.withColumnsRenamed({k: v for k, v in EXPORT_NAMES.items() if k in report.columns})


def not_cancelled(orders: DataFrame) -> DataFrame:
    return orders.where(F.col("cancel_dt") == F.lit(NOT_CANCELLED))


def priced_orders(orders: DataFrame) -> DataFrame:
    return orders.withColumn(AMOUNT, order_price())


def priced_sales(sales: DataFrame) -> DataFrame:
    return sales.withColumn(AMOUNT, sale_price())


def counted_sales(sales: DataFrame) -> DataFrame:
    """Priced sales without reversals and without lines of no value."""
    return priced_sales(sales).where((F.col("IsStorno") == 0) & (F.col(AMOUNT) > 0))


def stock_by_article(stocks: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    return grouping.sums(stocks, [*by, ARTICLE], ["quantity"]).withColumnRenamed("quantity", "stock")


def per_article(priced: DataFrame, catalogue: DataFrame | None = None, by: Sequence[str] = ()) -> DataFrame:
    """Count and sum of prices per article, within the groups of ``by``.

    A feed landed without the article brings its product instead, and ``catalogue`` (one row per
    ``nmId`` with its ``supplierArticle``) names it. Then the rows are added up per product
    first: a product holding a large share of all rows is combined inside each task, and what is
    joined is one row per product, never the feed.
    """
    if catalogue is None:
        return grouping.count_and_sum(priced, [*by, ARTICLE], AMOUNT)
    per_product = grouping.count_and_sum(priced, [*by, "nmId"], AMOUNT)
    named = per_product.join(catalogue.select("nmId", ARTICLE), "nmId")
    return (
        grouping.drop_null_keys(named, ARTICLE)
        .groupBy(*by, ARTICLE)
        .agg(F.sum("qty").alias("qty"), F.sum(AMOUNT).alias(AMOUNT))
    )


def orders_by_article(
    orders: DataFrame,
    stocks: DataFrame | None,
    period: str,
    as_of: Day,
    mode: str = "reference",
    start: Day | None = None,
    end: Day | None = None,
    catalogue: DataFrame | None = None,
    by: Sequence[str] = (),
) -> DataFrame:
    """Number and value of orders per article in a period, with the article's stock.

    The period is cut before cancelled orders go, so that a newest week holding only cancelled
    orders still counts as the newest week. Both sides of the stock join are grouped by its key
    already; it adds no shuffle of its own. An article without stock rows has stock NULL.
    ``by`` (a seller column, say) gives each group its own report; stocks need the column too, and
    ``catalogue`` names products whoever sells them.
    """
    chosen = periods.select_period(
        orders, period, as_of=as_of, feed="orders", mode=mode, start=start, end=end, by=by
    )
    report = per_article(not_cancelled(priced_orders(chosen)), catalogue, by)
    return report if stocks is None else with_stock(report, stocks, by)


def with_stock(report: DataFrame, stocks: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    return report.join(stock_by_article(stocks, by), [*by, ARTICLE], "left")


def sales_by_article(
    sales: DataFrame,
    period: str,
    as_of: Day,
    mode: str = "reference",
    start: Day | None = None,
    end: Day | None = None,
    catalogue: DataFrame | None = None,
    by: Sequence[str] = (),
) -> DataFrame:
    chosen = periods.select_period(
        sales, period, as_of=as_of, feed="sales", mode=mode, start=start, end=end, by=by
    )
    return per_article(counted_sales(chosen), catalogue, by)


def shown(report: DataFrame, k: int = ranking.SHOWN, by: Sequence[str] = ()) -> DataFrame:
    """The part of a report that is displayed: highest amounts first, ``k`` in each group of ``by``."""
    return ranking.top_per(report, by, AMOUNT, ARTICLE, k) if by else ranking.top(report, AMOUNT, ARTICLE, k)


def totals(report: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Totals over all articles, not only those displayed, and whether there was anything.

    Groups of ``by`` without any row have no total.
    """
    return report.groupBy(*by).agg(
        grouping.rounded_total(AMOUNT).alias("total_amount"),
        F.coalesce(F.sum("qty"), F.lit(0)).cast("bigint").alias("total_qty"),
        F.when(F.count(F.lit(1)) > 0, "ok").otherwise("no_data").alias("status"),
    )


def low_stock(stocks: DataFrame, k: int = ranking.SHOWN) -> DataFrame:
    """Articles closest to running out: smallest positive stock first."""
    return ranking.bottom(stock_by_article(stocks).where("stock > 0"), "stock", ARTICLE, k)


def stock_total(stocks: DataFrame) -> DataFrame:
    return stock_by_article(stocks).agg(
        F.coalesce(F.sum("stock"), F.lit(0)).cast("bigint").alias("total_stock")
    )


def revenue_for_week(orders: DataFrame, yearweek: int) -> DataFrame:
    """Value of all orders of one year-week, cancelled ones included."""
    from sellerlens.functions import dates

    chosen = periods.one_bucket(orders, "date", dates.yearweek, yearweek)
    return priced_orders(chosen).agg(grouping.total(AMOUNT).alias("revenue"))
