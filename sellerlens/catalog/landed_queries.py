"""Queries over landed files: readers, resumed loads, merged tables, streams, and what is kept of them."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sellerlens.catalog import article_queries as articles
from sellerlens.catalog import proxies as px
from sellerlens.catalog.feed_queries import SLOT_RULE, SLOT_WHERE
from sellerlens.catalog.registry import Registry
from sellerlens.catalog.views_sql import sql
from sellerlens.functions import dates
from sellerlens.operators import backfill, ranking
from sellerlens.plans import daily, order_stats
from sellerlens.session import shared_dir
from sellerlens.sources import feeds, opaque, schemas, storage
from sellerlens.streaming import event_windows, loads, slot_alerts

WAIT = 3600  # seconds a query waits for its stream

_landed: dict[tuple[str, str, str], str] = {}


def landed(spark: SparkSession, folder: str, feed: str, make) -> str:
    """Path of a feed as JSON lines in files, written once a session from a test table."""
    key = (spark.sparkContext.applicationId, folder, feed)
    if key not in _landed or not storage.exists(spark, f"{_landed[key]}/_SUCCESS"):
        path = f"{shared_dir(spark)}/landing/{feed}/{uuid.uuid4().hex}"
        make().write.text(path)
        _landed[key] = path
    return _landed[key]


def _lines(df: DataFrame, *times: str) -> DataFrame:
    text = df.withColumns({c: F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss") for c in times})
    return text.select(F.to_json(F.struct(*text.columns)).alias("value"))


def _ended(query) -> None:
    if not query.awaitTermination(WAIT):
        query.stop()
        raise TimeoutError("the stream did not end within an hour")


def _iso(*columns: str):
    return [dates.iso_day(c).alias(c) for c in columns]


# --- feeds from files ------------------------------------------------------------------------

def _add_readers(r: Registry) -> None:
    stamp = "strftime(date, '%Y-%m-%dT%H:%M:%S') AS date"

    def orders(s, d):
        path = landed(s, d, "orders", lambda: _lines(px.orders(s, d, *schemas.ORDER_COLUMNS), "date"))
        return feeds.read_feed(s, "orders", path).select(*schemas.ORDER_COLUMNS).withColumn("discountPercent", F.round("discountPercent", 6))

    r.add("scan_orders", orders,
          sql(f"""SELECT {stamp}, supplierArticle, totalPrice AS "totalPrice", round(discountPercent,6) AS "discountPercent",
                  warehouseName AS "warehouseName", oblast, subject, category, cancel_dt FROM v_orders""", "v_orders"))

    def sales(s, d):
        path = landed(s, d, "sales", lambda: _lines(px.sales(s, d, "supplierArticle", *px.SOLD), "date"))
        return feeds.read_feed(s, "sales", path).select(
            "date", "supplierArticle", "totalPrice", F.round("discountPercent", 6).alias("discountPercent"), "spp", "IsStorno")

    r.add("scan_sales", sales,
          sql(f"""SELECT {stamp}, supplierArticle, totalPrice, round(discountPercent,6) AS discountPercent, spp, IsStorno
                  FROM v_sales""", "v_sales"))

    returned = schemas.row(orderId=schemas.LONG, nmId=schemas.LONG, returnDate=schemas.TEXT)

    def returns(s, d):
        path = landed(s, d, "goods_return", lambda: px.goods_return_bodies(s, d).withColumnRenamed("payload", "value"))
        return feeds.read_goods_return(s, schemas.row(report=schemas.many(returned)), path)

    r.add("scan_goods_return", returns,
          """SELECT l_orderkey AS "orderId", l_partkey AS "nmId", strftime(l_shipdate,'%Y-%m-%d') AS "returnDate" FROM lineitem""")

    def rejects(s, d):
        path = landed(s, d, "stocks", lambda: px.stock_bodies(s, d).withColumnRenamed("payload", "value"))
        return feeds.rejects(s.read.text(path).withColumnRenamed("value", "payload"), "stocks")

    r.add("scan_rejects", rejects,
          """SELECT '{"supplierArticle":"' || p_name || '","quantity":' || CASE WHEN p_partkey % 10 = 1 THEN '"x"}' ELSE '' END AS payload
             FROM part WHERE p_partkey % 10 < 2""")


# --- resumed loads ---------------------------------------------------------------------------

def _two_loads(spark: SparkSession, first: DataFrame, second: DataFrame, load) -> DataFrame:
    """What a table holds after a load and its resumption, each of newly landed files; ``load`` takes stream, path and checkpoint."""
    run = f"{shared_dir(spark)}/loads/{uuid.uuid4().hex}"
    for landing in (first, second):
        landing.write.mode("append").parquet(f"{run}/landing")
        stream = spark.readStream.schema(first.schema).parquet(f"{run}/landing")
        _ended(load(stream, f"{run}/table", f"{run}/checkpoint"))
    return spark.read.parquet(f"{run}/table")


def settlement_resumed(spark: SparkSession, folder: str) -> DataFrame:
    pages = px.settlement_pages(spark, folder)
    load = lambda stream, path, checkpoint: loads.load_settlement(stream, path, checkpoint, "landed")
    return _two_loads(spark, pages.where("landed = 1"), pages.where("landed = 2"), load)


def orders_merged(spark: SparkSession, folder: str) -> DataFrame:
    load = lambda stream, path, checkpoint: loads.load_changes(stream, path, checkpoint, keys=[*loads.DAY_KEY, "nmId"], grain="month")
    return _two_loads(spark, px.order_versions(spark, folder, 0), px.order_versions(spark, folder, 1), load)


def daily_partials(spark: SparkSession, folder: str) -> DataFrame:
    """The table of partials after a first load and after its newest days were computed again."""
    orders = px.orders(spark, folder, "date", "totalPrice", "discountPercent")
    sales = px.sales(spark, folder, "date", "totalPrice", "discountPercent", "promoCodeDiscount", "spp")
    run = f"{shared_dir(spark)}/daily/{uuid.uuid4().hex}"
    daily.refresh(f"{run}/table", f"{run}/stage-0", daily.partials(orders, sales), 0)
    newest = [df.where(F.col("date") >= F.lit("2001-10-01").cast("timestamp_ntz")) for df in (orders, sales)]
    daily.refresh(f"{run}/table", f"{run}/stage-1", daily.partials(*newest), 1)
    return spark.read.parquet(f"{run}/table")


def _add_loads(r: Registry) -> None:
    r.add("settlement_after_cursor",
          lambda s, d: feeds.after_cursor(px.settlement_pages(s, d), 5000, sequence="landed")
          .select("rrd_id", "realizationreport_id", "ppvz_for_pay"),
          sql("SELECT rrd_id, realizationreport_id, ppvz_for_pay FROM v_pages WHERE rrd_id > 5000", "v_pages"))
    r.add("settlement_resumed", lambda s, d: settlement_resumed(s, d).select("rrd_id", "realizationreport_id", "ppvz_for_pay"),
          sql("SELECT rrd_id, realizationreport_id, ppvz_for_pay FROM v_pages", "v_pages"))
    r.add("settlement_resumed_cursor", lambda s, d: feeds.cursor_of(settlement_resumed(s, d)),
          sql("SELECT COALESCE(MAX(rrd_id),0) AS cursor FROM v_settlement", "v_settlement"))
    changed = "CASE WHEN srid % 7 = 0 THEN {new} ELSE {old} END"
    r.add("orders_merged",
          lambda s, d: orders_merged(s, d).select("srid", *_iso("date", "lastChangeDate"), "totalPrice", "cancel_dt"),
          sql(f"""SELECT srid, strftime(date,'%Y-%m-%d') AS date, strftime({changed.format(new="date + INTERVAL 3 DAY", old="date")},'%Y-%m-%d') AS "lastChangeDate",
                  totalPrice AS "totalPrice", {changed.format(new="'2002-01-01T00:00:00'", old="cancel_dt")} AS cancel_dt FROM v_orders""", "v_orders"))
    r.add("series_from_daily",
          lambda s, d: articles._rounded_series(daily.series(daily_partials(s, d), "all", articles.AS_OF)),
          sql(articles._series_sql("TRUE", articles.WEEK_KEY), "v_orders", "v_sales"))
    r.add("series_last30_from_daily",
          lambda s, d: articles._rounded_series(daily.series(daily_partials(s, d), "last_30", articles.AS_OF)),
          sql(articles._series_sql(articles.SERIES["last30"][1], articles.DAY_KEY), "v_orders", "v_sales"))
    month = """SELECT '{label}' AS series, year(date)*100+month(date) AS month, COUNT(price) AS qty, round(SUM(price), {digits}) AS "PriceWithDiscount"
               FROM {view} GROUP BY 2"""
    r.add("months_from_daily",
          lambda s, d: articles._rounded_series(daily.months(daily_partials(s, d))),
          sql(" UNION ALL ".join(month.format(label=a, view=f"v_{a}", digits=n) for a, n in
                                 (("orders", articles.ORDER_DIGITS), ("sales", articles.SALES_DIGITS))), "v_orders", "v_sales"))

    def sketched(s, d):
        feed = px.orders(s, d, "srid", "date")
        guess = daily.distinct_count(daily.distinct_partials(feed)).select(F.col("n").alias("guess"))
        close = F.abs(F.col("guess") - F.col("n")) <= daily.distinct_error() * F.col("n")
        return order_stats.distinct_orders(feed).crossJoin(guess).select("n", close.alias("close"))  # one row beside one row

    r.add("distinct_orders_sketch", sketched, sql("SELECT COUNT(DISTINCT srid) AS n, TRUE AS close FROM v_orders", "v_orders"))
    r.add("products_most_ordered", lambda s, d: ranking.most_frequent(px.orders(s, d, "nmId"), "nmId"),
          sql('SELECT nmId AS "nmId", COUNT(*) AS n FROM v_orders WHERE nmId IS NOT NULL GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 50', "v_orders"))


# --- opaque feeds ----------------------------------------------------------------------------

def _add_opaque(r: Registry) -> None:
    incomes = lambda s, d: opaque.rows(opaque.bodies(px.income_bodies(s, d)))
    r.add("incomes_opaque",
          lambda s, d: opaque.columns(incomes(s, d), incomeId="bigint", date="string", nmId="bigint", totalPrice="double"),
          """SELECT o_orderkey AS "incomeId", strftime(o_orderdate,'%Y-%m-%d') AS date, o_custkey AS "nmId", o_totalprice AS "totalPrice" FROM orders""")
    r.add("storage_opaque",
          lambda s, d: opaque.columns(opaque.rows(opaque.bodies(px.storage_bodies(s, d))), nmId="bigint", brand="string", warehousePrice="double"),
          """SELECT p_partkey AS "nmId", p_brand AS brand, p_retailprice AS "warehousePrice" FROM part""")
    r.add("goods_return_fields", lambda s, d: opaque.fields(opaque.rows(opaque.bodies(px.goods_return_bodies(s, d)), "report")),
          """SELECT field, type, n FROM (SELECT COUNT(*) AS n FROM lineitem),
             (VALUES ('orderId', 'BIGINT'), ('nmId', 'BIGINT'), ('returnDate', 'STRING')) t(field, type)""")
    after = lambda s, d: opaque.rows(opaque.bodies(px.changed_income_bodies(s, d)))
    r.add("income_drift", lambda s, d: opaque.drift(opaque.fields(incomes(s, d)), opaque.fields(after(s, d))),
          """SELECT * FROM (VALUES ('date', 'STRING', 'gone'), ('totalPrice', 'STRING', 'added'), ('totalPrice', 'DECIMAL', 'dropped'),
                                   ('discount', 'OBJECT<rate: BIGINT>', 'new')) t(field, type, change)""")


# --- streams ---------------------------------------------------------------------------------

def alerts_once(spark: SparkSession, folder: str) -> DataFrame:
    """Every snapshot of the test table through the stream that alerts a slot once; the delay spans the table."""
    stream = spark.readStream.schema(px.TABLES["orders"]).parquet(f"{folder}/orders.parquet*")
    snapshots = px.slots(stream).withColumn("polled", event_windows.event_time(px.slots(stream), "date"))
    run = f"{shared_dir(spark)}/alerts-once/{uuid.uuid4().hex}"
    _ended(slot_alerts.start(snapshots, f"{run}/alerts", f"{run}/checkpoint", available_now=True, once="36500 days", **SLOT_RULE))
    return slot_alerts.read_alerts(spark, f"{run}/alerts").select("date", "warehouseName")


def series_stream(spark: SparkSession, folder: str) -> DataFrame:
    stream = spark.readStream.schema(px.TABLES["events"]).parquet(f"{folder}/events.parquet*")
    series = event_windows.windowed(stream, "ts", "value")
    run = f"{shared_dir(spark)}/series/{uuid.uuid4().hex}"
    _ended(event_windows.start(series, f"{run}/series", f"{run}/checkpoint"))
    return event_windows.closed(spark, f"{run}/series", series.schema)


def _add_streams(r: Registry) -> None:
    r.add("slot_alerts_once", alerts_once,
          sql(f"""SELECT DISTINCT strftime(date,'%d-%m-%Y') AS date, warehouseName AS "warehouseName" FROM v_slots WHERE {SLOT_WHERE}""", "v_slots"))
    r.add("series_stream",
          lambda s, d: series_stream(s, d).select(*_iso("first_day", "end_day"), "qty", F.round("amount", 2).alias("amount")),
          """SELECT strftime(f,'%Y-%m-%d') AS first_day, strftime(f + INTERVAL 7 DAY,'%Y-%m-%d') AS end_day, COUNT(value) AS qty,
                    round(COALESCE(SUM(value),0),2) AS amount
             FROM (SELECT date_trunc('day', ts) - to_days(CAST(k AS INT)) AS f, value FROM events, range(0, 7) t(k))
             WHERE f + INTERVAL 7 DAY <= (SELECT MAX(ts) - INTERVAL 1 DAY FROM events) GROUP BY f""")


# --- ranges ----------------------------------------------------------------------------------

def _add_ranges(r: Registry) -> None:
    first, last = "2023-12-20", "2024-02-10"
    have = "(SELECT DISTINCT user_id % 20 AS c, CAST(ts AS DATE) AS d FROM events WHERE user_id % 20 % 6 <> 5 AND (user_id % 20 * 7 + day(ts)) % 5 <> 0)"
    islands = """SELECT c AS "advertId", strftime(MIN(d),'%Y-%m-%d') AS date_from, strftime(MAX(d),'%Y-%m-%d') AS date_to{more}
                 FROM (SELECT c, d, d - CAST(row_number() OVER (PARTITION BY c ORDER BY d) AS INT) AS island FROM {days}) GROUP BY c, island"""
    r.add("landed_ranges", lambda s, d: backfill.landed_ranges(px.patchy_ads(s, d), "date_day", first, last).select("advertId", *_iso("date_from", "date_to"), "days"),
          islands.format(more=", COUNT(*) AS days", days=have))
    absent = f"""(SELECT c, d FROM (SELECT DISTINCT user_id % 20 AS c FROM events),
                  (SELECT CAST(unnest(generate_series(DATE '{first}', DATE '{last}', INTERVAL 1 DAY)) AS DATE) AS d)
                  EXCEPT SELECT c, d FROM {have})"""
    r.add("missing_ranges",
          lambda s, d: backfill.missing_ranges(px.campaign_names(s, d), px.patchy_ads(s, d), "date_day", first, last).select("advertId", *_iso("date_from", "date_to")),
          islands.format(more="", days=absent))


def add_to(r: Registry) -> None:
    _add_readers(r)
    _add_loads(r)
    _add_opaque(r)
    _add_streams(r)
    _add_ranges(r)
