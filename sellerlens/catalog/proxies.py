"""Feed-shaped views over the test tables.

Each gives the columns of one landed feed, computed from a given table row by row (nested lists
too: no row's lists are gathered from other rows). Look-up tables are joined only for columns
that are asked for, and with left joins, so that a question about dates alone never touches them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sellerlens.functions.dates import iso_day
from sellerlens.sources import schemas

LINES_AS_OF = "2001-10-31"
EVENTS_AS_OF = "2024-01-30"

col, lit = F.col, F.lit


LONG, INT, DOUBLE, TEXT, TIME = schemas.LONG, schemas.INT, schemas.DOUBLE, schemas.TEXT, T.TimestampNTZType()

# Given up front, a read starts no job to look into the files first.
TABLES = {
    "nation": schemas.row(n_nationkey=INT, n_name=TEXT, n_regionkey=INT),
    "customer": schemas.row(c_custkey=LONG, c_name=TEXT, c_nationkey=INT, c_acctbal=DOUBLE, c_mktsegment=TEXT),
    "supplier": schemas.row(s_suppkey=LONG, s_name=TEXT, s_nationkey=INT, s_acctbal=DOUBLE),
    "part": schemas.row(p_partkey=LONG, p_name=TEXT, p_brand=TEXT, p_type=TEXT, p_size=INT, p_retailprice=DOUBLE),
    "orders": schemas.row(
        o_orderkey=LONG, o_custkey=LONG, o_orderstatus=TEXT, o_totalprice=DOUBLE, o_orderdate=TIME, o_orderpriority=TEXT,
    ),
    "lineitem": schemas.row(
        l_orderkey=LONG, l_partkey=LONG, l_suppkey=LONG, l_linenumber=INT, l_quantity=DOUBLE, l_extendedprice=DOUBLE,
        l_discount=DOUBLE, l_tax=DOUBLE, l_returnflag=TEXT, l_linestatus=TEXT, l_shipdate=TIME,
    ),
    "events": schemas.row(event_id=LONG, ts=TIME, user_id=LONG, event_type=TEXT, value=DOUBLE, props=TEXT),
    "conversations": schemas.row(conv_id=LONG, turn=LONG, role=TEXT, text=TEXT),
}


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.schema(TABLES[name]).parquet(f"{folder}/{name}.parquet")


def _pick(df: DataFrame, formulas: dict[str, Column], columns: tuple[str, ...]) -> DataFrame:
    return df.select([formulas[c].alias(c) for c in columns or formulas])


def _dimensions(df: DataFrame, spark: SparkSession, folder: str, columns) -> DataFrame:
    """Left-join the look-up tables that the wanted columns come from."""
    wanted = set(columns)
    if wanted & {"supplierArticle", "subject", "category"}:
        part = table(spark, folder, "part").select("p_partkey", "p_name", "p_type", "p_brand")
        df = df.join(part, col("l_partkey") == col("p_partkey"), "left")
    if wanted & {"warehouseName", "oblast", "regionName"}:
        supplier = table(spark, folder, "supplier").select("s_suppkey", "s_name", "s_nationkey")
        df = df.join(supplier, col("l_suppkey") == col("s_suppkey"), "left")
    if wanted & {"oblast", "regionName"}:
        nation = table(spark, folder, "nation").select("n_nationkey", "n_name")
        df = df.join(nation, col("s_nationkey") == col("n_nationkey"), "left")
    return df


def orders(spark: SparkSession, folder: str, *columns: str) -> DataFrame:
    formulas = {
        "srid": (col("l_orderkey") * 10 + col("l_linenumber")).cast("bigint"),
        "date": col("l_shipdate"),
        "lastChangeDate": col("l_shipdate"),
        "supplierArticle": col("p_name"),
        "nmId": col("l_partkey"),
        "seller": col("l_suppkey") % 50,
        "totalPrice": col("l_extendedprice"),
        "discountPercent": col("l_discount") * 100,
        "warehouseName": col("s_name"),
        "oblast": col("n_name"),
        "subject": col("p_type"),
        "category": col("p_brand"),
        "priceWithDisc": col("l_extendedprice") * (1 - col("l_discount")),
        "finishedPrice": col("l_extendedprice") * (1 - col("l_discount")) * (1 + col("l_tax")),
        "isRealization": col("l_linestatus") == "F",
        "cancel_dt": F.when(col("l_returnflag") == "R", "1999-01-01T00:00:00").otherwise(schemas.NOT_CANCELLED),
    }
    lines = table(spark, folder, "lineitem")
    return _pick(_dimensions(lines, spark, folder, columns or formulas), formulas, columns)


PRICED = ("date", "nmId", "totalPrice", "discountPercent", "cancel_dt")


def sales(spark: SparkSession, folder: str, *columns: str) -> DataFrame:
    formulas = {
        "date": col("l_shipdate"),
        "lastChangeDate": col("l_shipdate"),
        "supplierArticle": col("p_name"),
        "nmId": col("l_partkey"),
        "seller": col("l_suppkey") % 50,
        "totalPrice": col("l_extendedprice"),
        "discountPercent": col("l_discount") * 100,
        "promoCodeDiscount": col("l_tax") * 100,
        "spp": col("l_linenumber").cast("double"),
        "warehouseName": col("s_name"),
        "subject": col("p_type"),
        "category": col("p_brand"),
        "regionName": col("n_name"),
        "forPay": col("l_extendedprice"),
        "finishedPrice": col("l_extendedprice"),
        "priceWithDisc": col("l_extendedprice") * (1 - col("l_discount")),
        "IsStorno": F.when(col("l_returnflag") == "R", 1).otherwise(0),
    }
    lines = table(spark, folder, "lineitem")
    return _pick(_dimensions(lines, spark, folder, columns or formulas), formulas, columns)


SOLD = (
    "date", "nmId", "totalPrice", "discountPercent", "promoCodeDiscount", "spp", "IsStorno",
)


# Days that move the last day of the lines to the end of a year whose last week is 53: only such a
# year holds the highest week and month of all years.
TO_YEAR_END = 1153


def at_year_end(feed: DataFrame) -> DataFrame:
    return feed.withColumn("date", col("date") + F.make_dt_interval(lit(TO_YEAR_END)))


def catalogue(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "part").select(
        col("p_partkey").alias("nmId"), col("p_name").alias("supplierArticle")
    )


def stocks(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "part").select(
        col("p_name").alias("supplierArticle"),
        col("p_partkey").alias("nmId"),
        col("p_size").cast("bigint").alias("quantity"),
        col("p_type").alias("warehouseName"),
    )


def _events(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "events")


def _when(kind: str, value: Column, otherwise=0) -> Column:
    return F.when(col("event_type") == kind, value).otherwise(otherwise)


def ads(spark: SparkSession, folder: str) -> DataFrame:
    """Ad lines that are flat already: one per campaign, day, device and product."""
    keys = [
        (col("user_id") % 20).alias("advertId"),
        iso_day("ts").alias("date_day"),
        F.when(col("event_type").isin("click", "purchase"), 1).otherwise(32).alias("appType_device"),
        col("user_id").alias("nmId_nm"),
    ]
    return _events(spark, folder).groupBy(*keys).agg(
        F.count(lit(1)).alias("views_nm"),
        F.sum(_when("click", lit(1))).alias("clicks_nm"),
        F.sum(_when("purchase", lit(1))).alias("orders_nm"),
        F.sum(_when("click", col("value"))).alias("sum_nm"),
        F.sum(_when("purchase", col("value"))).alias("sum_price_nm"),
    )


def boosters(spark: SparkSession, folder: str) -> DataFrame:
    return (
        _events(spark, folder)
        .where(col("event_type") == "view")
        .groupBy(
            (col("user_id") % 20).alias("advertId"),
            iso_day("ts").alias("date_booster"),
            col("user_id").alias("nm_booster"),
        )
        .agg(F.avg("value").alias("avg_position_booster"))
    )


def campaign_names(spark: SparkSession, folder: str) -> DataFrame:
    """Undeduplicated (campaign, name) rows; the first three campaigns occur under two names."""
    n = col("user_id") % 20
    half = F.when((n < 3) & (col("user_id") % 40 >= 20), "-b").otherwise("")
    return _events(spark, folder).select(
        n.alias("advertId"), F.concat(lit("campaign-"), n.cast("string"), half).alias("name")
    )


def fullstats(spark: SparkSession, folder: str) -> DataFrame:
    """Nested ad statistics, one chunk per event, lists empty for some kinds of event."""
    day = iso_day("ts")
    user, event = col("user_id"), col("event_id")

    def product(n: int) -> Column:
        return F.struct(
            (user + n).alias("nmId"),
            F.concat(lit("product-"), (user + n).cast("string")).alias("name"),
            (event % 50 + n).alias("views"),
            (event % 7).alias("clicks"),
            (col("value") * (n + 1)).alias("sum"),
            (event % 3).alias("orders"),
            (col("value") * 10).alias("sum_price"),
        )

    def device(app: int, products: Column) -> Column:
        return F.struct(
            lit(app).alias("appType"), (event % 11).alias("views"), (event % 5).alias("clicks"),
            col("value").alias("sum"), products.alias("nm"),
        )

    two, none = F.array(product(0), product(1)), F.slice(F.array(product(0)), 1, 0)
    phone = device(32, F.when(event % 3 == 0, none).otherwise(two))
    desk = device(1, F.array(product(0)))
    apps = (
        F.when(col("event_type") == "signup", F.slice(F.array(phone), 1, 0))
        .when(event % 2 == 0, F.array(phone))
        .otherwise(F.array(phone, desk))
    )
    entry = F.struct(
        F.concat(day, lit("T00:00:00+03:00")).alias("date"), (event % 50).alias("views"),
        (event % 7).alias("clicks"), col("value").alias("sum"), (event % 3).alias("orders"),
        (col("value") * 10).alias("sum_price"), apps.alias("apps"),
    )
    booster = F.struct(
        F.concat(day, lit("T00:00:00+03:00")).alias("date"), user.alias("nm"),
        col("value").alias("avg_position"),
    )
    return _events(spark, folder).select(
        event.alias("chunk_seq"),
        (user % 20).alias("advertId"),
        (event % 50 + 1).alias("views"),
        (event % 7).alias("clicks"),
        (event % 3).alias("orders"),
        (event % 4).alias("atbs"),
        (event % 2).alias("shks"),
        col("value").alias("sum"),
        (col("value") * 10).alias("sum_price"),
        F.struct(day.alias("begin"), day.alias("end")).alias("interval"),
        F.when(col("event_type") == "error", F.slice(F.array(entry), 1, 0)).otherwise(F.array(entry)).alias("days"),
        F.when(col("event_type") == "view", F.array(booster)).alias("boosterStats"),
    )


def keyword_stats(spark: SparkSession, folder: str) -> DataFrame:
    stat = F.struct(
        F.concat(col("event_type"), lit("-"), (col("user_id") % 40).cast("string")).alias("keyword"),
        F.when(col("event_type") == "error", 0).otherwise(1).cast("bigint").alias("views"),
        F.when(col("user_id") % 2 == 0, 1).otherwise(0).cast("bigint").alias("clicks"),
        col("value").alias("sum"),
    )
    stats = F.when(col("event_id") % 10 == 0, F.slice(F.array(stat), 1, 0)).when(
        col("event_id") % 10 != 1, F.array(stat)
    )
    return _events(spark, folder).select(
        F.array(F.struct(iso_day("ts").alias("date"), stats.alias("stats"))).alias("keywords")
    )


def settlement(spark: SparkSession, folder: str) -> DataFrame:
    """Two reports a week; an ISO week that spans two years puts one id into two periods."""
    week = F.trunc(col("o_orderdate").cast("date"), "week")
    status = col("o_orderstatus")
    return table(spark, folder, "orders").select(
        col("o_orderkey").alias("rrd_id"),
        (
            (F.year(week) * 100 + F.weekofyear("o_orderdate")) * 10
            + F.when(col("o_custkey") % 10 < 7, 0).otherwise(1)
        ).cast("bigint").alias("realizationreport_id"),
        week.alias("date_from"),
        F.date_add(week, 6).alias("date_to"),
        F.when(col("o_orderpriority") == "5-LOW", 2).otherwise(1).alias("report_type"),
        F.when(status == "F", "Продажа").when(status == "O", "Возврат").otherwise("Логистика").alias("supplier_oper_name"),
        col("o_totalprice").alias("ppvz_for_pay"),
        (col("o_custkey") % 7).alias("seller"),
    )


def settlement_pages(spark: SparkSession, folder: str) -> DataFrame:
    """The settlement feed as landed pages: every fifth line landed again with another amount."""
    lines = settlement(spark, folder)
    again = lines.where(col("rrd_id") % 5 == 0).withColumn("ppvz_for_pay", col("ppvz_for_pay") + 1)
    return lines.withColumn("landed", lit(1)).unionByName(again.withColumn("landed", lit(2)))


def slots(orders_table: DataFrame) -> DataFrame:
    """Takes the table, so that it serves a batch and a stream of it alike."""
    return orders_table.select(
        col("o_orderdate").alias("date"),
        (col("o_custkey") % 40).alias("warehouseID"),
        F.concat(lit("Warehouse-"), (col("o_custkey") % 40).cast("string")).alias("warehouseName"),
        F.substring("o_orderpriority", 1, 1).cast("int").alias("boxTypeID"),
        ((col("o_orderkey") % 40) - 1).cast("int").alias("coefficient"),
        col("o_totalprice").alias("deliveryBaseLiter"),
        (col("o_orderkey") % 7).cast("int").alias("deliveryCoef"),
    )


def warehouses(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "supplier").select(
        col("s_suppkey").alias("ID"), col("s_name").alias("name"),
        col("s_nationkey").cast("string").alias("address"),
        (col("s_acctbal") > 0).alias("acceptsQR"),
    )


def registry(spark: SparkSession, folder: str) -> DataFrame:
    return _events(spark, folder).where(col("event_type") == "signup").select(
        col("user_id").cast("string").alias("user_id"),
        F.concat(lit("key-"), col("event_id").cast("string")).alias("user_api"),
        col("event_id").alias("seq"),
    )


def remains(spark: SparkSession, folder: str) -> DataFrame:
    """Remains that are flat already: one row per product and warehouse."""
    lines = table(spark, folder, "lineitem").groupBy("l_partkey", "l_suppkey").agg(F.sum("l_quantity").alias("quantity"))
    part, supplier = table(spark, folder, "part"), table(spark, folder, "supplier")
    return (
        lines.join(part, col("l_partkey") == col("p_partkey"))
        .join(supplier, col("l_suppkey") == col("s_suppkey"))
        .select(
            col("p_brand").alias("brand"), col("p_type").alias("subjectName"),
            col("p_name").alias("vendorCode"), col("p_partkey").alias("nmId"),
            F.when(col("p_partkey") % 7 != 0, col("p_size") * 0.25).alias("volume"), col("s_name").alias("warehouseName"), "quantity",
        )
    )


def remains_nested(spark: SparkSession, folder: str) -> DataFrame:
    """Products with 0 to 3 warehouses each."""
    key = col("p_partkey")
    place = lambda i: F.struct(
        F.concat(lit("Warehouse-"), ((key + i) % 40).cast("string")).alias("warehouseName"),
        (col("p_size") + i).cast("bigint").alias("quantity"),
    )
    return table(spark, folder, "part").select(
        col("p_brand").alias("brand"), col("p_type").alias("subjectName"), col("p_name").alias("vendorCode"),
        key.alias("nmId"), F.concat(lit("b-"), key.cast("string")).alias("barcode"),
        lit("0").alias("techSize"), col("p_retailprice").alias("volume"),
        (key % 5).alias("inWayToClient"), (key % 3).alias("inWayFromClient"),
        col("p_size").cast("bigint").alias("quantityWarehousesFull"),
        F.slice(F.array(place(0), place(1), place(2)), lit(1), (key % 4).cast("int")).alias("warehouses"),
    )


def campaign_groups(spark: SparkSession, folder: str) -> DataFrame:
    """Campaign lists: each order one group with 0 to 2 campaigns, some of them listed twice."""
    key = col("o_orderkey")
    advert = lambda i: F.struct(
        (F.expr("o_orderkey div 3") * 2 + i).alias("advertId"), iso_day("o_orderdate").alias("changeTime")
    )
    group = F.struct(
        (8 + key % 2).cast("int").alias("type"), (key % 3 + 7).cast("int").alias("status"),
        (key % 3).alias("count"),
        F.slice(F.array(advert(0), advert(1)), lit(1), (key % 3).cast("int")).alias("advert_list"),
    )
    return table(spark, folder, "orders").select(F.array(group).alias("adverts"))


def campaigns(spark: SparkSession, folder: str) -> DataFrame:
    """Campaign details in all their shapes, chosen by the order's key."""
    k, c = col("o_orderkey"), col("o_custkey")
    null = lit(None)
    subject = F.when(k % 4 != 3, F.struct((c % 50).alias("id"), F.concat(lit("subject-"), (c % 50).cast("string")).alias("name")))
    bid = lambda nm, cpm: F.struct(nm.alias("nm"), lit(cpm).cast("bigint").alias("cpm"))
    bids = F.array(bid(c + 1, 5), bid(c + 2, 6), bid(c + 2, 8))
    auto = F.struct(
        (k % 500).alias("cpm"), subject.alias("subject"),
        F.when(k % 4 == 1, F.array().cast("array<bigint>")).when(k % 4 == 2, F.array(c)).when(k % 4 == 3, F.array(c, c + 1)).alias("nms"),
        F.when(k % 5 == 0, F.slice(bids, 1, 0)).otherwise(bids).alias("nmCPM"),
    )
    block = lambda nms: F.struct(
        (k % 70).alias("catalogCPM"), (k % 80).alias("searchCPM"), subject.alias("subject"), nms.alias("nms")
    )
    blocks = F.array(block(F.array(c, c + 1)), block(null.cast("array<bigint>")), block(F.array(c + 5)))
    stamp = lambda days: F.concat(
        F.date_add(col("o_orderdate").cast("date"), days).cast("string"), lit("T10:11:12.123456+03:00")
    )
    return table(spark, folder, "orders").select(
        k.alias("advertId"),
        F.concat(lit("campaign-"), (k % 100).cast("string")).alias("name"),
        F.when(k % 3 == 0, 8).otherwise(9).alias("type"),
        (k % 3 + 7).cast("int").alias("status"),
        col("o_totalprice").alias("dailyBudget"),
        col("o_orderpriority").alias("paymentType"),
        stamp(0).alias("createTime"), stamp(1).alias("changeTime"), stamp(2).alias("startTime"),
        F.when(k % 10 != 0, stamp(30)).alias("endTime"),
        F.when(k % 3 == 0, auto).alias("autoParams"),
        F.when(k % 3 == 1, F.when(k % 9 == 1, F.slice(blocks, 1, 0)).otherwise(blocks)).alias("unitedParams"),
        F.when(k % 5 == 2, F.array(
            F.struct(c.alias("nm"), (k % 90).alias("bid")), F.struct((c + 3).alias("nm"), (k % 91).alias("bid"))
        )).alias("auction_multibids"),
    )


def clusters(spark: SparkSession, folder: str) -> DataFrame:
    """Phrase clusters: a conversation turn and the words of its text; empty for turn 0."""
    words = F.split("text", " ", -1)
    cluster = F.struct(
        F.concat(col("role"), lit("-"), col("conv_id").cast("string")).alias("cluster"),
        col("turn").alias("count"),
        F.when(col("turn") == 0, F.slice(words, 1, 0)).otherwise(words).alias("keywords"),
    )
    return table(spark, folder, "conversations").select(F.array(cluster).alias("clusters"))


def search_words(spark: SparkSession, folder: str) -> DataFrame:
    words = F.split("text", " ", -1)
    return table(spark, folder, "conversations").select(
        F.struct((col("turn") > 0).alias("fixed"), words.alias("excluded"), F.array(col("role")).alias("phrase")).alias("words")
    )


def goods_return_bodies(spark: SparkSession, folder: str) -> DataFrame:
    """Raw goods-return response bodies, one per line."""
    row = F.struct(
        col("l_orderkey").alias("orderId"), col("l_partkey").alias("nmId"),
        iso_day("l_shipdate").alias("returnDate"),
    )
    return table(spark, folder, "lineitem").select(F.to_json(F.struct(F.array(row).alias("report"))).alias("payload"))


def income_bodies(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "orders").select(
        F.to_json(F.struct(
            col("o_orderkey").alias("incomeId"), iso_day("o_orderdate").alias("date"),
            col("o_custkey").alias("nmId"), col("o_totalprice").alias("totalPrice"),
        )).alias("payload")
    )


def storage_bodies(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "part").select(
        F.to_json(F.array(F.struct(
            col("p_partkey").alias("nmId"), col("p_brand").alias("brand"), col("p_retailprice").alias("warehousePrice"),
        ))).alias("payload")
    )


def changed_income_bodies(spark: SparkSession, folder: str) -> DataFrame:
    """The bodies of ``income_bodies`` after a change: the price as text, no date, and for some a field that is new."""
    key = col("o_orderkey")
    return table(spark, folder, "orders").select(
        F.to_json(F.struct(
            key.alias("incomeId"), col("o_custkey").alias("nmId"), col("o_totalprice").cast("string").alias("totalPrice"),
            F.when(key % 3 == 0, F.struct((key % 10).alias("rate"))).alias("discount"),
        )).alias("payload")
    )


def stock_bodies(spark: SparkSession, folder: str) -> DataFrame:
    """Stock bodies as they land, every tenth cut off and every tenth with text for a number."""
    key, name = col("p_partkey"), col("p_name")
    whole = F.concat(lit('{"supplierArticle":"'), name, lit('","quantity":'))
    return table(spark, folder, "part").select(
        F.when(key % 10 == 0, whole).when(key % 10 == 1, F.concat(whole, lit('"x"}')))
        .otherwise(F.concat(whole, col("p_size").cast("string"), lit("}"))).alias("payload")
    )


def order_versions(spark: SparkSession, folder: str, load: int) -> DataFrame:
    """Orders as two loads deliver them: first all, then later versions of some and stale versions of others."""
    rows = orders(spark, folder, "srid", "nmId", "date", "lastChangeDate", "totalPrice", "cancel_dt")
    if load == 0:
        return rows
    later = rows.where("srid % 7 = 0").withColumn("lastChangeDate", F.expr("lastChangeDate + INTERVAL 3 DAYS"))
    stale = rows.where("srid % 7 <> 0 AND srid % 11 = 0").withColumn("lastChangeDate", F.expr("lastChangeDate - INTERVAL 5 DAYS"))
    return later.withColumn("cancel_dt", lit("2002-01-01T00:00:00")).unionByName(stale.withColumn("totalPrice", col("totalPrice") - 1))


def patchy_ads(spark: SparkSession, folder: str) -> DataFrame:
    """Campaigns and days with statistics, where some days and some campaigns haven't landed."""
    day = F.dayofmonth("ts")
    number = col("user_id") % 20
    rows = _events(spark, folder).where((number % 6 != 5) & ((number * 7 + day) % 5 != 0))
    return rows.select(number.alias("advertId"), iso_day("ts").alias("date_day"))
