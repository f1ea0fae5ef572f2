"""Orders, sales, stock and series queries."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from sellerlens.catalog import proxies as px
from sellerlens.catalog.registry import Registry
from sellerlens.catalog.views_sql import sql
from sellerlens.functions import dates
from sellerlens.operators import grouping, periods, ranking
from sellerlens.plans import articles, order_stats, series
from sellerlens.sources import feeds, schemas

AS_OF = px.LINES_AS_OF
DAY = dt.date.fromisoformat(AS_OF)
AMOUNT = articles.AMOUNT


def _day(back: int) -> str:
    return (DAY - dt.timedelta(days=back)).isoformat()


# Sums are compared after rounding. An order's value has 4 exact decimals and a sale's 8, so these
# digits keep true values clear of the rounding boundary, whatever the order of addition.
ORDER_DIGITS, SALES_DIGITS = 4, 2


def _rounded(df, digits: int = ORDER_DIGITS):
    return df.withColumn(AMOUNT, F.round(AMOUNT, digits))


def _rounded_series(df):
    amount = F.when(F.col("series") == "sales", F.round(AMOUNT, SALES_DIGITS)).otherwise(F.round(AMOUNT, ORDER_DIGITS))
    return df.withColumn(AMOUNT, amount)


# Conditions of the periods over v_orders / v_sales, written independently of the selectors.
ORDER_PERIODS = {
    "today": f"date >= DATE '{AS_OF}'",
    "yesterday": f"date >= DATE '{_day(1)}' AND date < DATE '{AS_OF}'",
    "this_week": "yearweek >= (SELECT MAX(yearweek) FROM v_orders)",
    "prev_week": "yearweek = (SELECT DISTINCT yearweek FROM v_orders ORDER BY 1 DESC LIMIT 1 OFFSET 1)",
    "this_month": "yearmonth >= (SELECT MAX(yearmonth) FROM v_orders)",
    "prev_month": "yearmonth = (SELECT DISTINCT yearmonth FROM v_orders ORDER BY 1 DESC LIMIT 1 OFFSET 1)",
    "last_30": f"date >= DATE '{_day(30)}'",
    "range": "date >= DATE '2001-03-05' AND date < DATE '2001-04-18'",
}
SALES_PERIODS = {
    "today": ORDER_PERIODS["today"],
    "yesterday": ORDER_PERIODS["yesterday"],
    "this_week": "week >= (SELECT MAX(week) FROM v_sales) AND year >= (SELECT MAX(year) FROM v_sales)",
    "prev_week": "week = (SELECT MAX(week)-1 FROM v_sales) AND year >= (SELECT MAX(year) FROM v_sales)",
    "this_month": "month >= (SELECT MAX(month) FROM v_sales) AND year >= (SELECT MAX(year) FROM v_sales)",
    "prev_month": "month = (SELECT MAX(month)-1 FROM v_sales) AND year >= (SELECT MAX(year) FROM v_sales)",
    "last_30": ORDER_PERIODS["last_30"],
    "range": ORDER_PERIODS["range"],
}
# Around 2001-10-31, a Wednesday.
CALENDAR_PERIODS = {
    "this_week": "date >= DATE '2001-10-29' AND date < DATE '2001-11-05'",
    "prev_week": "date >= DATE '2001-10-22' AND date < DATE '2001-10-29'",
    "this_month": "date >= DATE '2001-10-01' AND date < DATE '2001-11-01'",
    "prev_month": "date >= DATE '2001-09-01' AND date < DATE '2001-10-01'",
}
RANGE = dict(zip(("start", "end"), dates.parse_dmy_range("05.03.2001-17.04.2001")))

KEY_NAMES = {"last_30": "last30"}

LIVE = "cancel_dt = '0001-01-01T00:00:00'"
KEPT = "IsStorno = 0 AND price > 0"


def _report_sql(view: str, where: str) -> str:
    digits = SALES_DIGITS if view.startswith("v_sales") else ORDER_DIGITS
    return f"""
        SELECT supplierArticle, COUNT(price) AS qty, round(SUM(price), {digits}) AS "PriceWithDiscount"
        FROM {view} WHERE supplierArticle IS NOT NULL AND {where} GROUP BY 1
    """


def _orders(spark, folder, period, mode="reference", stocks=False):
    extra = RANGE if period == "range" else {}
    return articles.orders_by_article(
        px.orders(spark, folder, *px.PRICED),
        px.stocks(spark, folder) if stocks else None,
        period, AS_OF, mode, catalogue=px.catalogue(spark, folder), **extra,
    )


def _sales(spark, folder, period, mode="reference"):
    extra = RANGE if period == "range" else {}
    return articles.sales_by_article(
        px.sales(spark, folder, *px.SOLD), period, AS_OF, mode, catalogue=px.catalogue(spark, folder), **extra
    )


def _with_stock_sql(where: str) -> str:
    return f"""
        SELECT r.*, s.stock FROM ({_report_sql('v_orders', f'{LIVE} AND {where}')}) r
        LEFT JOIN v_stock s ON r.supplierArticle = s.supplierArticle
    """


def _add_reports(r: Registry) -> None:
    for period, where in ORDER_PERIODS.items():
        r.add(
            f"orders_by_article_{KEY_NAMES.get(period, period)}",
            lambda s, d, p=period: _rounded(_orders(s, d, p, stocks=True)),
            sql(_with_stock_sql(where), "v_orders", "v_stock"),
        )
    for period, where in SALES_PERIODS.items():
        r.add(
            f"sales_by_article_{KEY_NAMES.get(period, period)}",
            lambda s, d, p=period: _rounded(_sales(s, d, p), SALES_DIGITS),
            sql(_report_sql("v_sales", f"{KEPT} AND {where}"), "v_sales"),
        )
    for period, where in CALENDAR_PERIODS.items():
        r.add(
            f"orders_by_article_{period}_calendar",
            lambda s, d, p=period: _rounded(_orders(s, d, p, "calendar", stocks=True)),
            sql(_with_stock_sql(where), "v_orders", "v_stock"),
        )
        r.add(
            f"sales_by_article_{period}_calendar",
            lambda s, d, p=period: _rounded(_sales(s, d, p, "calendar"), SALES_DIGITS),
            sql(_report_sql("v_sales", f"{KEPT} AND {where}"), "v_sales"),
        )
    every = "TRUE"
    r.add("orders_with_stock", lambda s, d: _rounded(_orders(s, d, "all", stocks=True)),
          sql(_with_stock_sql(every), "v_orders", "v_stock"))
    r.add("orders_top50", lambda s, d: _rounded(articles.shown(_orders(s, d, "last_30", stocks=True))),
          sql(_with_stock_sql(ORDER_PERIODS["last_30"]) + ' ORDER BY "PriceWithDiscount" DESC NULLS FIRST, r.supplierArticle LIMIT 50',
              "v_orders", "v_stock"))
    r.add("sales_top50", lambda s, d: _rounded(articles.shown(_sales(s, d, "last_30")), SALES_DIGITS),
          sql(_report_sql("v_sales", f"{KEPT} AND {SALES_PERIODS['last_30']}")
              + ' ORDER BY "PriceWithDiscount" DESC NULLS FIRST, supplierArticle LIMIT 50', "v_sales"))
    totals_sql = """
        SELECT CAST(round_even(COALESCE(SUM(price),0), 0) AS BIGINT) AS total_amount,
               CAST(COUNT(price) AS BIGINT) AS total_qty,
               CASE WHEN COUNT(*) > 0 THEN 'ok' ELSE 'no_data' END AS status
        FROM {view} WHERE supplierArticle IS NOT NULL AND {where}
    """
    r.add("orders_totals", lambda s, d: articles.totals(_orders(s, d, "last_30")),
          sql(totals_sql.format(view="v_orders", where=f"{LIVE} AND {ORDER_PERIODS['last_30']}"), "v_orders"))
    r.add("sales_totals", lambda s, d: articles.totals(_sales(s, d, "last_30")),
          sql(totals_sql.format(view="v_sales", where=f"{KEPT} AND {SALES_PERIODS['last_30']}"), "v_sales"))
    r.add("report_export_names",
          lambda s, d: articles.export_names(_rounded(_orders(s, d, "last_30", stocks=True))),
          sql(f"""SELECT supplierArticle AS "Артикул_поставщика", qty AS "Количество_в_шт",
                  "PriceWithDiscount" AS "Сумма_в_рублях", stock AS "Остатки"
                  FROM ({_with_stock_sql(ORDER_PERIODS['last_30'])})""", "v_orders", "v_stock"))
    r.add("stock_by_article", lambda s, d: articles.stock_by_article(px.stocks(s, d)),
          sql("SELECT * FROM v_stock", "v_stock"))
    r.add("stock_low50", lambda s, d: articles.low_stock(px.stocks(s, d)),
          sql("SELECT * FROM v_stock WHERE stock > 0 ORDER BY stock NULLS FIRST, supplierArticle LIMIT 50", "v_stock"))
    r.add("stock_total", lambda s, d: articles.stock_total(px.stocks(s, d)),
          sql("SELECT CAST(COALESCE(SUM(stock),0) AS BIGINT) AS total_stock FROM v_stock", "v_stock"))
    r.add("revenue_for_week",
          lambda s, d: articles.revenue_for_week(px.orders(s, d, "date", "totalPrice", "discountPercent"), 200101)
          .select(F.round("revenue", 4).alias("revenue")),
          sql("SELECT round(COALESCE(SUM(price),0),4) AS revenue FROM v_orders WHERE yearweek = 200101", "v_orders"))


def _add_sellers(r: Registry) -> None:
    """The reports once per seller, each with its own newest week or month and its own top 50."""
    by = ["seller"]
    named = lambda s, d: px.catalogue(s, d)
    orders = lambda s, d, period: articles.orders_by_article(
        px.orders(s, d, *px.PRICED, "seller"), None, period, AS_OF, catalogue=named(s, d), by=by)
    sales = lambda s, d, period: articles.sales_by_article(
        px.sales(s, d, *px.SOLD, "seller"), period, AS_OF, catalogue=named(s, d), by=by)
    report = """SELECT seller, supplierArticle, COUNT(price) AS qty, round(SUM(price), {digits}) AS "PriceWithDiscount"
                FROM {view} v WHERE supplierArticle IS NOT NULL AND {where} GROUP BY 1, 2"""
    newest = "yearweek = (SELECT MAX(yearweek) FROM v_orders m WHERE m.seller = v.seller)"
    r.add("orders_by_article_this_week_by_seller", lambda s, d: _rounded(orders(s, d, "this_week")),
          sql(report.format(digits=ORDER_DIGITS, view="v_orders", where=f"{LIVE} AND {newest}"), "v_orders"))
    before = """month = (SELECT MAX(month) - 1 FROM v_sales m WHERE m.seller = v.seller)
                AND year = (SELECT MAX(year) FROM v_sales m WHERE m.seller = v.seller)"""
    r.add("sales_by_article_prev_month_by_seller", lambda s, d: _rounded(sales(s, d, "prev_month"), SALES_DIGITS),
          sql(report.format(digits=SALES_DIGITS, view="v_sales", where=f"{KEPT} AND {before}"), "v_sales"))
    r.add("orders_top50_by_seller", lambda s, d: articles.shown(_rounded(orders(s, d, "all")), by=by),
          sql(f"""SELECT * FROM ({report.format(digits=ORDER_DIGITS, view="v_orders", where=LIVE)})
                  QUALIFY row_number() OVER (PARTITION BY seller ORDER BY "PriceWithDiscount" DESC, supplierArticle) <= 50""", "v_orders"))
    r.add("series_all_by_seller",
          lambda s, d: _rounded_series(series.orders_vs_sales(
              px.orders(s, d, "date", "totalPrice", "discountPercent", "seller"),
              px.sales(s, d, "date", "totalPrice", "discountPercent", "promoCodeDiscount", "spp", "seller"), "all", AS_OF, by=by)),
          sql(" UNION ALL ".join(
              f"""SELECT seller, '{label}' AS series, {WEEK_KEY} AS bucket, COUNT(price) AS qty, round(SUM(price), {digits}) AS "PriceWithDiscount"
                  FROM {view} GROUP BY 1, 3"""
              for label, view, digits in (("orders", "v_orders", ORDER_DIGITS), ("sales", "v_sales", SALES_DIGITS))), "v_orders", "v_sales"))


def _add_year_end(r: Registry) -> None:
    """Weeks and months found by separate maxima, on a feed whose newest year holds them."""
    for period in ("this_week", "prev_week", "this_month"):
        where = SALES_PERIODS[period].replace("v_sales", "v_sales_late")
        r.add(f"sales_year_end_{period}",
              lambda s, d, p=period: _rounded(articles.sales_by_article(
                  px.at_year_end(px.sales(s, d, *px.SOLD)), p, "2004-12-31", catalogue=px.catalogue(s, d)), SALES_DIGITS),
              sql(_report_sql("v_sales_late", f"{KEPT} AND {where}"), "v_sales_late"))
    r.add("series_year_end_this_month",
          lambda s, d: _rounded_series(series.in_order(series.orders_vs_sales(
              px.at_year_end(px.orders(s, d, "date", "totalPrice", "discountPercent")),
              px.at_year_end(px.sales(s, d, "date", "totalPrice", "discountPercent", "promoCodeDiscount", "spp")),
              "this_month", "2004-12-31"))),
          sql(_series_sql(SERIES["this_month"][1], DAY_KEY).replace("FROM v_orders", "FROM v_orders_late").replace("FROM v_sales", "FROM v_sales_late"),
              "v_orders_late", "v_sales_late"))
    r.add("orders_by_article_direct",
          lambda s, d: _rounded(articles.orders_by_article(
              px.orders(s, d, *px.PRICED, "supplierArticle"), px.stocks(s, d), "all", AS_OF)),
          sql(_with_stock_sql("TRUE"), "v_orders", "v_stock"))


# Series: days back, inclusive of as_of.
SERIES = {
    "last7": ("last_7", f"date >= DATE '{_day(6)}'"),
    "last30": ("last_30", f"date >= DATE '{_day(29)}'"),
    "last90": ("last_90", f"date >= DATE '{_day(89)}'"),
    "last180": ("last_180", f"date >= DATE '{_day(179)}'"),
    "last365": ("last_365", f"date >= DATE '{_day(364)}'"),
    "all": ("all", "TRUE"),
    "3m": ("months_3", "date >= DATE '2001-07-31'"),
    "6m": ("months_6", "date >= DATE '2001-04-30'"),
    "ytd": ("year_to_date", "date >= DATE '2001-01-01'"),
    "this_month": (
        "this_month",
        "month(date) >= (SELECT MAX(month(date)) FROM {v}) AND year(date) >= (SELECT MAX(year(date)) FROM {v})",
    ),
}

DAY_KEY = "strftime(date, '%Y-%m-%d')"
WEEK_KEY = "CAST(yearweek AS BIGINT)"
UNPADDED_KEY = "CAST(CAST(year(date) AS VARCHAR) || CAST(week(date) AS VARCHAR) AS BIGINT)"
ISO_KEY = "CAST(isoyear(date)*100 + week(date) AS BIGINT)"


def _series_sql(where: str, bucket: str) -> str:
    one = """
        SELECT '{label}' AS series, {bucket} AS bucket, COUNT(price) AS qty, round(SUM(price), {digits}) AS "PriceWithDiscount"
        FROM {view} WHERE {where} GROUP BY 2
    """
    return " UNION ALL ".join(
        one.format(label=label, bucket=bucket, view=view, where=where.format(v=view), digits=digits)
        for label, view, digits in (("orders", "v_orders", ORDER_DIGITS), ("sales", "v_sales", SALES_DIGITS))
    )


def _series(spark, folder, period, **kw):
    return series.orders_vs_sales(
        px.orders(spark, folder, "date", "totalPrice", "discountPercent"),
        px.sales(spark, folder, "date", "totalPrice", "discountPercent", "promoCodeDiscount", "spp"),
        period, AS_OF, **kw,
    )


def _add_series(r: Registry) -> None:
    views = ("v_orders", "v_sales")
    for name, (period, where) in SERIES.items():
        bucket = DAY_KEY if period in series.DAILY else WEEK_KEY
        r.add(f"series_{name}", lambda s, d, p=period: _rounded_series(series.in_order(_series(s, d, p))),
              sql(_series_sql(where, bucket), *views))
    for name in ("last90", "all"):
        period, where = SERIES[name]
        r.add(f"series_{name}_unpadded",
              lambda s, d, p=period: _rounded_series(series.in_order(_series(s, d, p, week_key="unpadded"))),
              sql(_series_sql(where, UNPADDED_KEY), *views))
    r.add("series_all_iso", lambda s, d: _rounded_series(series.in_order(_series(s, d, "all", week_key="iso"))),
          sql(_series_sql("TRUE", ISO_KEY), *views))
    r.add("series_this_month_calendar",
          lambda s, d: _rounded_series(series.in_order(_series(s, d, "this_month", mode="calendar"))),
          sql(_series_sql(CALENDAR_PERIODS["this_month"], DAY_KEY), *views))
    r.add("series_wide",
          lambda s, d: series.wide(_rounded_series(_series(s, d, "last_365"))),
          sql(f"""
              SELECT bucket,
                     MAX(CASE WHEN series='orders' THEN qty END) AS orders_qty,
                     MAX(CASE WHEN series='orders' THEN "PriceWithDiscount" END) AS "orders_PriceWithDiscount",
                     MAX(CASE WHEN series='sales' THEN qty END) AS sales_qty,
                     MAX(CASE WHEN series='sales' THEN "PriceWithDiscount" END) AS "sales_PriceWithDiscount"
              FROM ({_series_sql(SERIES['last365'][1], WEEK_KEY)}) GROUP BY 1
          """, *views))
    r.add("series_totals", lambda s, d: series.series_totals(_series(s, d, "last_7")),
          sql(f"""
              SELECT l.series, CAST(round_even(COALESCE(a,0),0) AS BIGINT) AS total_amount,
                     CAST(COALESCE(q,0) AS BIGINT) AS total_qty, CASE WHEN q IS NULL THEN 'no_data' ELSE 'ok' END AS status
              FROM (VALUES ('orders'),('sales')) l(series) LEFT JOIN (
                SELECT 'orders' AS series, SUM(price) AS a, COUNT(price) AS q FROM v_orders WHERE {SERIES['last7'][1]} HAVING COUNT(*)>0
                UNION ALL SELECT 'sales', SUM(price), COUNT(price) FROM v_sales WHERE {SERIES['last7'][1]} HAVING COUNT(*)>0) t
              ON l.series = t.series
          """, *views))


def _iso(column: str):
    return dates.iso_day(column).alias(column)


def _add_feeds(r: Registry) -> None:
    """Feeds as loaded: raw bodies through the JSON decoder, or the column lists of the reports."""

    def body(df):
        return df.select(F.to_json(F.struct(*df.columns)).alias("payload"))

    def text_dates(df, *columns):
        return df.withColumns({c: F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss") for c in columns})

    stamp = "strftime(date, '%Y-%m-%dT%H:%M:%S') AS date"
    r.add("scan_stocks",
          lambda s, d: feeds.decode(body(px.stocks(s, d)), "stocks"),
          sql("SELECT supplierArticle, quantity FROM v_stocks", "v_stocks"))
    r.add("scan_settlement",
          lambda s, d: feeds.decode(body(text_dates(px.settlement(s, d), "date_from", "date_to")), "settlement")
          .select("rrd_id", "realizationreport_id", F.substring("date_from", 1, 10).alias("date_from"),
                  F.substring("date_to", 1, 10).alias("date_to"), "report_type", "supplier_oper_name", "ppvz_for_pay"),
          sql("""SELECT rrd_id, realizationreport_id, strftime(date_from,'%Y-%m-%d') AS date_from,
                 strftime(date_to,'%Y-%m-%d') AS date_to, report_type, supplier_oper_name, ppvz_for_pay FROM v_settlement""",
              "v_settlement"))
    income = schemas.row(incomeId=schemas.LONG, date=schemas.TEXT, nmId=schemas.LONG, totalPrice=schemas.DOUBLE)
    r.add("scan_incomes", lambda s, d: feeds.decode(px.income_bodies(s, d), "incomes", schema=income),
          """SELECT o_orderkey AS "incomeId", strftime(o_orderdate,'%Y-%m-%d') AS date, o_custkey AS "nmId",
             o_totalprice AS "totalPrice" FROM orders""")
    storage = schemas.row(nmId=schemas.LONG, brand=schemas.TEXT, warehousePrice=schemas.DOUBLE)
    r.add("scan_paid_storage", lambda s, d: feeds.decode_array(px.storage_bodies(s, d), storage),
          """SELECT p_partkey AS "nmId", p_brand AS brand, p_retailprice AS "warehousePrice" FROM part""")
    r.add("orders_since",
          lambda s, d: feeds.changed_since(px.orders(s, d, "srid", "lastChangeDate", "totalPrice"), "2001-09-15T00:00:00")
          .select("srid", _iso("lastChangeDate"), "totalPrice"),
          sql("""SELECT srid, strftime(date,'%Y-%m-%d') AS "lastChangeDate", totalPrice AS "totalPrice"
                 FROM v_orders WHERE date >= DATE '2001-09-15'""", "v_orders"))
    r.add("orders_on_date",
          lambda s, d: feeds.changed_on(px.orders(s, d, "srid", "lastChangeDate", "totalPrice"), "2001-09-15")
          .select("srid", _iso("lastChangeDate"), "totalPrice"),
          sql("""SELECT srid, strftime(date,'%Y-%m-%d') AS "lastChangeDate", totalPrice AS "totalPrice"
                 FROM v_orders WHERE CAST(date AS DATE) = DATE '2001-09-15'""", "v_orders"))
    r.add("union_chunks",
          lambda s, d: feeds.union_chunks(
              px.table(s, d, "customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"), "c_acctbal"),
              px.table(s, d, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("name"), "s_nationkey")),
          """SELECT c_custkey AS id, c_name AS name, c_acctbal, NULL::INT AS s_nationkey FROM customer
             UNION ALL SELECT s_suppkey, s_name, NULL, s_nationkey FROM supplier""")


def _add_order_stats(r: Registry) -> None:
    cols = ("date", "nmId", "supplierArticle", "finishedPrice", "priceWithDisc")

    def cents(df):
        return df.withColumns({"priceWithDisc": F.round("priceWithDisc", 4), "finishedPrice": F.round("finishedPrice", 6)})

    per_product = """
        SELECT nmId AS "nmId", round(SUM(finishedPrice),6) AS "finishedPrice", round(SUM(priceWithDisc),4) AS "priceWithDisc",
               arg_min(supplierArticle, date) AS "supplierArticle"
        FROM v_orders WHERE {where} GROUP BY 1
    """
    r.add("orders_per_product",
          lambda s, d: cents(order_stats.by_price(order_stats.orders_per_product(px.orders(s, d, *cols)))),
          sql(per_product.format(where="nmId IS NOT NULL"), "v_orders"))
    r.add("orders_per_product_range",
          lambda s, d: cents(order_stats.orders_per_product(px.orders(s, d, *cols), "2001-04-20", "2001-04-26")),
          sql(per_product.format(where="date >= DATE '2001-04-20' AND date < DATE '2001-04-26'"), "v_orders"))
    r.add("orders_in_range",
          lambda s, d: periods.between(px.orders(s, d, "srid", "date", "nmId"), "date", "2001-01-15", "2001-01-22")
          .select("srid", _iso("date"), "nmId"),
          sql("""SELECT srid, strftime(date,'%Y-%m-%d') AS date, nmId AS "nmId" FROM v_orders
                 WHERE date >= DATE '2001-01-15' AND date < DATE '2001-01-22'""", "v_orders"))
    r.add("orders_count_range",
          lambda s, d: order_stats.count_in_range(px.orders(s, d, "date"), "2001-01-15", "2001-01-22"),
          sql("SELECT COUNT(*) AS n FROM v_orders WHERE date >= DATE '2001-01-15' AND date < DATE '2001-01-22'", "v_orders"))
    r.add("realized_revenue_since",
          lambda s, d: order_stats.realized_revenue_since(px.orders(s, d, "date", "isRealization", "priceWithDisc"), "2001-01-01")
          .select(F.round("revenue", 4).alias("revenue")),
          sql("""SELECT round(COALESCE(SUM(priceWithDisc),0),4) AS revenue FROM v_orders
                 WHERE date >= DATE '2001-01-01' AND isRealization""", "v_orders"))
    r.add("distinct_orders", lambda s, d: order_stats.distinct_orders(px.orders(s, d, "srid")),
          sql("SELECT COUNT(DISTINCT srid) + CASE WHEN COUNT(*) > COUNT(srid) THEN 1 ELSE 0 END AS n FROM v_orders", "v_orders"))
    r.add("last_rows",
          lambda s, d: ranking.last_rows(px.table(s, d, "orders"), "o_orderkey").select("o_orderkey", "o_custkey", "o_totalprice"),
          "SELECT o_orderkey, o_custkey, o_totalprice FROM orders ORDER BY o_orderkey DESC LIMIT 5")


def _add_registry(r: Registry) -> None:
    r.add("registry_latest",
          lambda s, d: grouping.last_per_key(px.registry(s, d), "user_id", "seq", ["user_api"]).transform(feeds.all_strings),
          sql("""SELECT user_id, arg_max(user_api, seq) AS user_api, CAST(MAX(seq) AS VARCHAR) AS seq
                 FROM v_registry GROUP BY 1""", "v_registry"))
    r.add("registry_contains", lambda s, d: feeds.any_contains(px.registry(s, d), "user_id", "12"),
          sql("SELECT COUNT(*) > 0 AS found FROM v_registry WHERE contains(user_id, '12')", "v_registry"))


def add_to(r: Registry) -> None:
    _add_reports(r)
    _add_sellers(r)
    _add_year_end(r)
    _add_series(r)
    _add_feeds(r)
    _add_order_stats(r)
    _add_registry(r)
