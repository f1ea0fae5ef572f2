"""Reports per seller: newest buckets, top-k, stock, labels and missing slices within each group."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from sellerlens.operators import backfill, grouping, nested, periods
from sellerlens.plans import ads, articles, series, settlement
from sellerlens.sources import sinks
from sellerlens.sources.schemas import NOT_CANCELLED
from tests.conftest import rows

BY = ["seller"]


@pytest.fixture
def orders(spark):
    data = [
        (1, "2024-05-20", "a", 10.0), (1, "2024-05-13", "b", 20.0), (1, "2024-04-30", "c", 30.0),
        (2, "2024-03-04", "a", 40.0), (2, "2024-03-05", "a", 5.0), (2, "2024-02-01", "d", 60.0),
        (None, "2024-05-21", "a", 70.0), (3, None, "a", 80.0)]
    return spark.createDataFrame(
        [(s, d, n, p, 0.0, NOT_CANCELLED) for s, d, n, p in data],
        "seller long, date string, supplierArticle string, totalPrice double, discountPercent double, cancel_dt string")


def test_each_seller_has_its_newest_week(orders):
    week = lambda period: rows(articles.orders_by_article(orders, None, period, "2024-05-21", by=BY))
    assert week("this_week") == [(1, "a", 1, 10.0), (2, "a", 2, 45.0)]
    assert week("prev_week") == [(1, "b", 1, 20.0), (2, "d", 1, 60.0)]
    assert week("this_month") == [(1, "a", 1, 10.0), (1, "b", 1, 20.0), (2, "a", 2, 45.0)]
    assert rows(articles.orders_by_article(orders.where("false"), None, "this_week", "2024-05-21", by=BY)) == []


def test_separate_maxima_per_seller(spark):
    sales = spark.createDataFrame(
        [(1, "2023-11-05"), (1, "2024-03-01"), (1, "2024-11-02"), (2, "2024-02-03"), (2, "2024-01-09"), (3, "2023-12-01"), (3, "2024-01-01")],
        "seller long, date string")
    pick = lambda period: rows(periods.select_period(sales, period, as_of="2024-12-01", feed="sales", by=BY))
    assert pick("this_month") == [(1, "2024-11-02"), (2, "2024-02-03")]  # seller 3 reached December the year before
    assert pick("prev_month") == [(2, "2024-01-09")]


def test_seller_is_never_the_only_join_key(spark, orders, tmp_path):
    sinks.write_by_day(orders.where("date IS NOT NULL"), str(tmp_path / "orders"))
    landed = spark.read.parquet(str(tmp_path / "orders"))
    report = articles.orders_by_article(landed, None, "this_week", "2024-05-21", by=BY)
    assert rows(report) == rows(articles.orders_by_article(orders, None, "this_week", "2024-05-21", by=BY))
    plan = report._jdf.queryExecution().executedPlan().toString()
    semi = [line for line in plan.splitlines() if "LeftSemi" in line and "Join" in line]
    assert semi and all("__b" in line for line in semi)
    assert "PartitionFilters: [isnotnull(date_day" in plan


def test_top_stock_and_totals_per_seller(spark, orders):
    stocks = spark.createDataFrame([(1, "a", 3), (2, "a", 4), (2, "a", 5)], "seller long, supplierArticle string, quantity long")
    report = articles.orders_by_article(orders, stocks, "all", "2024-05-21", by=BY)
    assert rows(report.select("seller", "supplierArticle", "stock")) == [
        (1, "a", 3), (1, "b", None), (1, "c", None), (2, "a", 9), (2, "d", None), (3, "a", None)]
    assert rows(articles.shown(report, 1, BY).select("seller", "supplierArticle")) == [(1, "c"), (2, "d"), (3, "a")]
    assert rows(articles.totals(report, BY).select("seller", "total_amount")) == [(1, 60), (2, 105), (3, 80)]
    assert articles.totals(report).first()["total_amount"] == 245


def test_series_order_and_sellers(orders):
    sales = orders.withColumns({"promoCodeDiscount": F.lit(0.0), "spp": F.lit(0.0)})
    both = series.orders_vs_sales(orders, sales, "all", "2024-05-21", grain="day")
    shown = [(r["series"], r["bucket"]) for r in series.in_order(both).collect()]
    assert shown == sorted(shown) and len(shown) == 14
    mine = series.orders_vs_sales(orders, sales, "all", "2024-05-21", grain="day", by=BY)
    assert mine.columns == ["seller", "series", "bucket", "qty", articles.AMOUNT]
    assert mine.where("seller = 2 AND series = 'orders'").count() == 3


def test_labels_per_seller(spark):
    day = lambda n: dt.date(2025, 1, n)
    lines = spark.createDataFrame(
        [(s, r, day(6), day(12)) for s, r in [(1, 11), (1, 11), (1, 12), (2, 11), (2, 12), (2, 12), (None, 11)]],
        "seller long, realizationreport_id long, date_from date, date_to date")
    assert rows(settlement.labels(lines, BY)) == [(1, 11, "ru"), (1, 12, "other"), (2, 11, "other"), (2, 12, "ru")]
    assert settlement.labelled_lines(lines, by=BY).count() == 6


def test_missing_slices_per_seller_and_last_day(spark):
    campaigns = spark.createDataFrame([(1, 7), (2, 7)], "seller long, advertId long")
    landed = spark.createDataFrame([(1, 7, "2024-01-01"), (2, 7, "2024-01-04"), (2, 7, "bad")], "seller long, advertId long, date string")
    gaps = lambda end, **kw: rows(backfill.missing_slices(campaigns, landed, "date", "2024-01-01", end, 3, by=BY, **kw), "seller", "window_id")
    assert gaps("2024-01-06") == [(1, 1), (2, 0)]
    assert gaps("2024-01-07") == [(1, 1), (1, 2), (2, 0), (2, 2)]
    assert gaps("2024-01-07", whole=False) == [(1, 1), (2, 0)]  # the last window would hold one day
    assert gaps("2024-01-01", whole=False) == []


def test_window_bounds_reach_the_scan(spark, tmp_path):
    spark.createDataFrame([("2024-01-02", 1), ("2024-01-09T10:00:00", 1), ("zz", 1)], "date string, n int").write.parquet(str(tmp_path / "t"))
    counted = backfill.rows_per_window(spark.read.parquet(str(tmp_path / "t")), "date", "2024-01-01", "2024-01-09", 7)
    assert rows(counted, "window_id", "n") == [(0, 1), (1, 1)]
    assert "GreaterThanOrEqual(date,2024-01-01)" in counted._jdf.queryExecution().executedPlan().toString()


def test_labels_from_a_written_index_leave_lines_unshuffled(spark, tmp_path):
    lines = spark.range(1000).select(
        F.col("id").alias("rrd_id"), (F.col("id") % 3).alias("realizationreport_id"),
        F.lit("2025-01-06").cast("date").alias("date_from"), F.lit("2025-01-12").cast("date").alias("date_to"))
    lines.write.parquet(str(tmp_path / "lines"))
    lines = spark.read.parquet(str(tmp_path / "lines"))
    labelled = settlement.labelled_lines(lines, sinks.write_index(lines, str(tmp_path / "index")))
    plan = labelled._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "hashpartitioning" not in plan
    assert rows(labelled) == rows(settlement.labelled_lines(lines))


def test_reconcile_with_missing_lists(spark):
    nm = "struct<nmId: bigint, name: string, views: bigint, clicks: bigint, sum: double, orders: bigint, sum_price: double>"
    days = f"array<struct<date: string, apps: array<struct<appType: int, nm: array<{nm}>>>>>"
    line = lambda n, s: (n, "x", 1, 1, s, 1, 1.0)
    chunks = spark.createDataFrame([
        (1, 1, 9.0, [("2024-01-01", [(1, [line(5, 2.0), line(6, None)]), (32, None)]), ("2024-01-02", None)]),
        (1, 2, 2.0, [("2024-01-01", [(1, [line(5, 3.0)])])]),
        (2, 3, None, None)], f"advertId bigint, chunk_seq bigint, sum double, days {days}")
    assert rows(ads.reconcile(chunks)) == [("deduplicated", 2.0), ("delivered", 11.0), ("flattened", 5.0)]


def test_unknown_order_of_campaigns(spark):
    campaigns = spark.createDataFrame([(1, "a", "b")], "advertId long, createTime string, changeTime string")
    for order, direction in (("name", "asc"), ("id", "down")):
        with pytest.raises(ValueError):
            nested.campaigns_ordered(campaigns, order, direction)


def test_keyword_stats_by_either_parent(spark):
    stat = "struct<{}: string, views: bigint, clicks: bigint, sum: double>"
    day = spark.createDataFrame([([("2024-01-01", [("shoe", 3, 1, 2.0)]), ("2024-01-02", None)],)],
                                f"keywords array<struct<date: string, stats: array<{stat.format('keyword')}>>>")
    word = spark.createDataFrame([([("shoe", [("2024-01-01", 3, 1, 2.0)])],)],
                                 f"keywords array<struct<keyword: string, stats: array<{stat.format('date')}>>>")
    columns = ("date", "keyword", "views", "clicks", "sum")
    line = ("2024-01-01", "shoe", 3, 1, 2.0)
    assert rows(nested.keyword_lines(day), *columns) == [line, ("2024-01-02", None, None, None, None)]
    assert rows(nested.keyword_lines(word), *columns) == [line]


def test_latest_row_per_key(spark):
    table = spark.createDataFrame([("a", 1, "x"), ("a", 3, "y"), ("a", 3, "z"), ("b", None, "w"), (None, 1, "n")], "user_id string, seq int, user_api string")
    assert rows(grouping.last_per_key(table, "user_id", "seq", ["user_api"])) == [("a", "z", 3), ("b", "w", None), (None, "n", 1)]
