import datetime as dt

import pandas as pd
import pytest
from pyspark.sql import functions as F

from sellerlens.functions import dates
from sellerlens.operators import periods
from sellerlens.plans import articles, series
from sellerlens.sources.schemas import NOT_CANCELLED
from tests.conftest import rows

CANCELLED = "2024-05-05T00:00:00"


def order(date, article="a", price=100.0, discount=10.0, cancel=NOT_CANCELLED):
    return {"date": date, "supplierArticle": article, "totalPrice": price, "discountPercent": discount, "cancel_dt": cancel}


def sale(date, article="a", price=100.0, storno=0, discount=10.0, promo=20.0, spp=50.0):
    return {"date": date, "supplierArticle": article, "totalPrice": price, "discountPercent": discount,
            "promoCodeDiscount": promo, "spp": spp, "IsStorno": storno}


@pytest.mark.parametrize("day, padded, iso, unpadded", [
    ("2022-12-31", 202252, 202252, 202252), ("2023-01-01", 202252, 202252, 202352),
    ("2024-12-30", 202401, 202501, 20241), ("2021-01-03", 202053, 202053, 202153),
    ("2023-03-01", 202309, 202309, 20239), (None, None, None, None), ("garbage", None, None, None)])
def test_week_keys(spark, day, padded, iso, unpadded):
    df = spark.createDataFrame([(day,)], "d string")
    got = df.select(dates.yearweek("d"), dates.iso_yearweek("d"), dates.unpadded_yearweek("d")).first()
    assert tuple(got) == (padded, iso, unpadded)


def pick(df, name, **kw):
    return [r[0] for r in rows(periods.select_period(df, name, **kw), "date")]


def test_dated_periods(land):
    days = ["2024-03-10T10:00:00", "2024-03-09T23:59:59", "2024-03-09T00:00:00", "2024-03-08T23:00:00",
            "2024-02-09T00:00:00", "2024-02-08T23:59:59", "2024-03-11T00:00:01", None]
    df = land("orders", [order(d) for d in days])
    kw = dict(as_of="2024-03-10", feed="orders")
    assert pick(df, "today", **kw) == ["2024-03-10T10:00:00", "2024-03-11T00:00:01"]
    assert pick(df, "yesterday", **kw) == ["2024-03-09T00:00:00", "2024-03-09T23:59:59"]
    assert pick(df, "last_30", **kw) == sorted(d for d in days if d and d >= "2024-02-09")
    assert pick(df, "range", start="2024-03-08", end=dt.date(2024, 3, 9), **kw) == [
        "2024-03-08T23:00:00", "2024-03-09T00:00:00", "2024-03-09T23:59:59"]
    assert len(pick(df, "all", **kw)) == len(days)
    assert pick(df, "last_7", as_of="2024-03-14", feed="series") == sorted(d for d in days if d and d >= "2024-03-08")


def test_newest_bucket_counts_cancelled_rows(land):
    orders = land("orders", [
        order("2024-05-20T00:00:00", cancel=CANCELLED), order("2024-05-13T00:00:00", "b"),
        order("2024-05-19T00:00:00", "b"), order("2024-04-30T00:00:00", "c"), order(None)])
    stocks = land("stocks", [{"supplierArticle": "b", "quantity": 3}, {"supplierArticle": "b", "quantity": 4}])
    report = lambda period: rows(articles.orders_by_article(orders, stocks, period, "2024-05-21"))
    assert report("this_week") == []
    assert report("prev_week") == [("b", 2, 180.0, 7)]
    assert report("this_month") == [("b", 2, 180.0, 7)]
    assert report("prev_month") == [("c", 1, 90.0, None)]


def test_previous_bucket_skips_gaps_and_may_be_missing(land):
    gap = land("orders", [order("2024-05-20"), order("2024-03-01", "b")])
    assert pick(gap, "prev_week", as_of="2024-05-21", feed="orders") == ["2024-03-01"]
    assert pick(gap, "prev_week", as_of="2024-05-21", feed="orders", mode="calendar") == []
    single = land("sales", [sale("2024-05-20"), sale("2024-05-21")])
    assert pick(single, "prev_week", as_of="2024-05-21", feed="orders") == []
    empty = single.where("false")
    for name in periods.BUCKETED:
        for feed in ("orders", "sales"):
            assert pick(empty, name, as_of="2024-05-21", feed=feed) == []


def test_december_days_of_week_one(land):
    # 2024-12-30 has key 202401, below every other week of 2024: the newest week is week 52.
    df = land("orders", [order("2024-12-30"), order("2024-12-28"), order("2024-12-23"), order("2024-12-20")])
    assert pick(df, "this_week", as_of="2024-12-31", feed="orders") == ["2024-12-23", "2024-12-28"]
    assert pick(df, "this_week", as_of="2024-12-31", feed="orders", mode="calendar") == ["2024-12-30"]


def test_separate_maxima(land):
    spread = land("sales", [sale("2023-12-20"), sale("2024-02-05"), sale("2024-01-10")])
    for name in periods.BUCKETED:
        assert pick(spread, name, as_of="2024-02-06", feed="sales") == []
    calm = land("sales", [sale("2023-01-04"), sale("2024-02-05"), sale("2024-02-01"), sale("2024-01-31")])
    kw = dict(as_of="2024-02-06", feed="sales")
    assert pick(calm, "this_week", **kw) == ["2024-02-05"]
    assert pick(calm, "prev_week", **kw) == ["2024-01-31", "2024-02-01"]
    assert pick(calm, "this_month", **kw) == ["2024-02-01", "2024-02-05"]
    assert pick(calm, "prev_month", **kw) == ["2024-01-31"]
    assert pick(calm, "this_month", as_of="2024-02-06", feed="series") == ["2024-02-01", "2024-02-05"]


def test_selectors_against_pandas(spark):
    """Every data-driven period over three years of days, against the definitions in pandas."""
    days = pd.date_range("2021-12-20", "2024-12-31", freq="D")
    for stop in ("2022-01-02", "2023-01-01", "2023-06-30", "2024-12-31"):
        pdf = pd.DataFrame({"date": days[days <= stop].strftime("%Y-%m-%dT%H:%M:%S")})
        t = pd.to_datetime(pdf["date"])
        iso = t.dt.isocalendar()
        week, month, year = iso.week.astype(int), t.dt.month, t.dt.year
        yw = year * 100 + week - 100 * ((week >= 50) & (month == 1))
        ym = year * 100 + month
        want = {
            ("orders", "this_week"): yw == yw.max(), ("orders", "this_month"): ym == ym.max(),
            ("orders", "prev_week"): yw == sorted(yw.unique())[-2], ("orders", "prev_month"): ym == sorted(ym.unique())[-2],
            ("sales", "this_week"): (week >= week.max()) & (year >= year.max()),
            ("sales", "prev_week"): (week == week.max() - 1) & (year >= year.max()),
            ("sales", "this_month"): (month >= month.max()) & (year >= year.max()),
            ("sales", "prev_month"): (month == month.max() - 1) & (year >= year.max()),
        }
        df = spark.createDataFrame(pdf)
        for (feed, name), mask in want.items():
            assert pick(df, name, as_of=stop, feed=feed) == sorted(pdf["date"][mask]), (stop, feed, name)


def test_calendar_bounds():
    assert periods.calendar_bounds("prev_month", dt.date(2024, 1, 31)) == (dt.date(2023, 12, 1), dt.date(2024, 1, 1))
    assert periods.calendar_bounds("this_week", dt.date(2024, 1, 7)) == (dt.date(2024, 1, 1), dt.date(2024, 1, 8))
    assert periods.add_months(dt.date(2024, 5, 31), -3) == dt.date(2024, 2, 29)
    assert periods.add_months(dt.date(2024, 12, 15), 1) == dt.date(2025, 1, 15)


def test_wrong_names(land):
    df = land("orders", [order("2024-01-01")])
    with pytest.raises(ValueError):
        periods.select_period(df, "last_7", as_of="2024-01-01", feed="orders")
    with pytest.raises(ValueError):
        periods.select_period(df, "range", as_of="2024-01-01", feed="orders")
    with pytest.raises(ValueError):
        periods.select_period(df, "today", as_of="2024-01-01", feed="orders", mode="other")


def test_sales_report_and_totals(land):
    sales = land("sales", [
        sale("2024-03-10"), sale("2024-03-10", price=50.0), sale("2024-03-10", storno=1), sale("2024-03-10", spp=100.0),
        sale("2024-03-10", article=None), sale("2024-03-01", "z")])
    report = articles.sales_by_article(sales, "today", "2024-03-10")
    got = rows(report)
    assert [(g[0], g[1]) for g in got] == [("a", 2)] and got[0][2] == pytest.approx(54.0)
    assert rows(articles.totals(report)) == [(54, 2, "ok")]
    assert rows(articles.totals(report.where("false"))) == [(0, 0, "no_data")]
    assert articles.export_names(report).columns == ["Артикул_поставщика", "Количество_в_шт", "Сумма_в_рублях"]


def test_stock(land):
    stocks = land("stocks", [{"supplierArticle": a, "quantity": q} for a, q in
                             [("a", 1), ("a", 2), ("b", 0), ("c", 1), (None, 9), ("d", None)]])
    assert rows(articles.stock_by_article(stocks)) == [("a", 3), ("b", 0), ("c", 1), ("d", 0)]
    assert [tuple(r) for r in articles.low_stock(stocks).collect()] == [("c", 1), ("a", 3)]
    assert rows(articles.stock_total(stocks)) == [(4,)]


def test_series(land):
    orders = land("orders", [order("2024-03-10T01:00:00", cancel=CANCELLED), order("2024-03-10T02:00:00", article=None),
                             order("2024-03-04T00:00:00"), order("2024-03-03T23:00:00")])
    sales = land("sales", [sale("2024-03-09T00:00:00", storno=1)])
    out = series.orders_vs_sales(orders, sales, "last_7", "2024-03-10")
    assert rows(out) == [("orders", "2024-03-04", 1, 90.0), ("orders", "2024-03-10", 2, 180.0), ("sales", "2024-03-09", 1, 36.0)]
    assert rows(series.wide(out)) == [
        ("2024-03-04", 1, 90.0, None, None), ("2024-03-09", None, None, 1, 36.0), ("2024-03-10", 2, 180.0, None, None)]
    assert rows(series.series_totals(out)) == [("orders", 270, 3, "ok"), ("sales", 36, 1, "ok")]
    none = series.orders_vs_sales(orders, sales.where("false"), "last_7", "2024-03-10")
    assert rows(series.series_totals(none))[1] == ("sales", 0, 0, "no_data")
    weekly = series.orders_vs_sales(orders, sales, "last_90", "2024-03-10")
    assert rows(weekly, "series", "bucket", "qty") == [("orders", 202409, 1), ("orders", 202410, 3), ("sales", 202410, 1)]
    unpadded = series.orders_vs_sales(orders, sales, "all", "2024-03-10", week_key="unpadded")
    assert rows(unpadded.where("series = 'orders'"), "bucket", "qty") == [(20249, 1), (202410, 3)]


def test_one_bucket(land):
    orders = land("orders", [order("2023-01-01"), order("2022-12-31"), order("2023-01-02")])
    assert rows(articles.revenue_for_week(orders, 202252)) == [(180.0,)]


def test_top_is_deterministic(land):
    orders = land("orders", [order("2024-03-10", a) for a in "dcab" for _ in range(2)])
    report = articles.orders_by_article(orders, None, "all", "2024-03-10")
    assert [r[0] for r in articles.shown(report, 3).collect()] == ["a", "b", "c"]


def test_date_bounds_reach_the_scan(spark, tmp_path):
    facts = spark.range(10000).select(
        F.expr("timestamp_ntz'2024-01-01 00:00:00' + make_dt_interval(cast(id / 100 as int))").alias("date"),
        F.lit(NOT_CANCELLED).alias("cancel_dt"), F.lit("a").alias("supplierArticle"), F.lit(1.0).alias("totalPrice"),
        F.lit(0.0).alias("discountPercent"), F.lit("wide").alias("unused"))
    facts.write.parquet(str(tmp_path / "facts"))
    orders = spark.read.parquet(str(tmp_path / "facts"))
    mode = spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted")
    for name in ("today", "last_30", "this_week", "prev_month"):
        df = articles.orders_by_article(orders, None, name, "2024-04-09")
        df.collect()
        plan = df._jdf.queryExecution().explainString(mode)
        assert "GreaterThanOrEqual(date," in plan and "unused" not in plan, name
        assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_catalogue_names_products(spark, land):
    """Adding up per product before naming it gives the report of a feed that carries the article."""
    catalogue = spark.createDataFrame([(1, "a"), (2, "a"), (3, "b"), (4, None), (9, "z")], "nmId bigint, supplierArticle string")
    names = {1: "a", 2: "a", 3: "b", 4: None, 5: None}
    feed = [order("2024-03-10", names[n], price, cancel=c) | {"nmId": n}
            for n in names for price in (10.0, 20.0, None) for c in (NOT_CANCELLED, CANCELLED)]
    orders = land("orders", feed)
    whole = articles.orders_by_article(orders, None, "today", "2024-03-10")
    bare = articles.orders_by_article(orders.drop("supplierArticle"), None, "today", "2024-03-10", catalogue=catalogue)
    assert rows(bare) == rows(whole) == [("a", 4, 54.0), ("b", 2, 27.0)]
    hot = orders.drop("supplierArticle").where("nmId = 3")
    plan = articles.orders_by_article(hot, None, "all", "2024-03-10", catalogue=catalogue)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.rindex("Aggregate [nmId") > plan.index("Join")  # below the join, on the feed's side
