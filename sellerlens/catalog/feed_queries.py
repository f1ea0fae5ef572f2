"""Advertising, phrase, settlement, slot, remains and back-fill queries."""

from __future__ import annotations

import datetime as dt
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sellerlens.catalog import proxies as px
from sellerlens.catalog.registry import Registry
from sellerlens.catalog.views_sql import sql
from sellerlens.functions import dates, pricing, text
from sellerlens.operators import backfill, nested
from sellerlens.plans import ads, keywords, order_stats, remains, settlement, slots
from sellerlens.session import shared_dir
from sellerlens.sources import feeds, sinks
from sellerlens.streaming import slot_alerts

SLOT_RULE = dict(warehouse_ids=[3, 7, 11, 19, 23], box_types=[2], max_coefficient=20)
SLOT_WHERE = "warehouseID IN (3,7,11,19,23) AND boxTypeID IN (2) AND coefficient BETWEEN 0 AND 20"


def _r(df, **digits):
    return df.withColumns({c: F.round(c, n) for c, n in digits.items()})


# --- nested ----------------------------------------------------------------------------------

def _add_nested(r: Registry) -> None:
    r.add("campaign_list_flatten", lambda s, d: nested.campaign_list(px.campaign_groups(s, d)),
          """SELECT CAST(8 + o_orderkey % 2 AS INT) AS type, CAST(o_orderkey % 3 + 7 AS INT) AS status,
                    o_orderkey % 3 AS count, (o_orderkey // 3) * 2 + i AS "advertId", strftime(o_orderdate,'%Y-%m-%d') AS "changeTime"
             FROM orders JOIN (VALUES (0),(1)) t(i) ON i < o_orderkey % 3""")
    r.add("distinct_campaigns",
          lambda s, d: nested.campaign_list(px.campaign_groups(s, d)).select("advertId").distinct(),
          """SELECT DISTINCT (o_orderkey // 3) * 2 + i AS "advertId" FROM orders JOIN (VALUES (0),(1)) t(i) ON i < o_orderkey % 3""")
    base = """v.endTime AS "endTime", v.createTime AS "createTime", v.changeTime AS "changeTime", v.startTime AS "startTime",
              v.name, v.dailyBudget AS "dailyBudget", v.k AS "advertId", v.status, v.type, v.paymentType AS "paymentType" """
    item = ", ".join(f'CAST(i.{f} AS {"VARCHAR" if kind == "string" else "BIGINT"}) AS "{f}"' for f, kind in nested.ITEM_FIELDS.items())
    r.add("campaign_flatten", lambda s, d: nested.campaign_rows(px.campaigns(s, d)),
          sql(f"SELECT {base}, {item} FROM v_campaigns v LEFT JOIN v_items i ON v.k = i.k", "v_campaigns", "v_items"))
    r.add("campaign_extra_bids", lambda s, d: nested.extra_bids(px.campaigns(s, d)),
          sql("""SELECT k AS "advertId", c + nm AS nm, CAST(bid AS BIGINT) AS cpm FROM v_campaigns, (VALUES (1,5),(2,6),(2,8)) t(nm, bid)
                 WHERE k % 3 = 0 AND k % 5 <> 0 AND NOT (k % 4 = 3 AND nm = 1)""", "v_campaigns"))
    r.add("campaigns_filtered",
          lambda s, d: nested.campaigns_filtered(px.campaigns(s, d), status=7, type=8).select("advertId", "name", "status", "type"),
          sql('SELECT k AS "advertId", name, status, type FROM v_campaigns WHERE status = 7 AND type = 8', "v_campaigns"))
    r.add("campaigns_ordered",
          lambda s, d: nested.campaigns_ordered(px.campaigns(s, d)).select("advertId", "createTime", "changeTime"),
          sql('SELECT k AS "advertId", createTime AS "createTime", changeTime AS "changeTime" FROM v_campaigns', "v_campaigns"))
    r.add("campaign_times",
          lambda s, d: px.campaigns(s, d).select("advertId", *dates.offset_parts("createTime"))
          .withColumn("createTime_date", F.col("createTime_date").cast("string")),
          sql("""SELECT k AS "advertId", substring(createTime,1,10) AS "createTime_date", substring(createTime,1,19) AS "createTime_datetime",
                 '+03:00' AS "createTime_timezone" FROM v_campaigns""", "v_campaigns"))
    r.add("flatten_struct",
          lambda s, d: nested.flatten_struct(px.campaigns(s, d).select("advertId", "autoParams")).drop("autoParams_nms", "autoParams_nmCPM"),
          sql("""SELECT k AS "advertId", CASE WHEN k % 3 = 0 THEN k % 500 END AS "autoParams_cpm",
                 CASE WHEN k % 3 = 0 THEN sid END AS "autoParams_subject_id", CASE WHEN k % 3 = 0 THEN sname END AS "autoParams_subject_name"
                 FROM v_campaigns""", "v_campaigns"))
    r.add("nested_to_json", lambda s, d: nested.nested_to_json(px.campaign_groups(s, d), "adverts"),
          """SELECT '[{"type":' || (8 + o_orderkey % 2) || ',"status":' || (o_orderkey % 3 + 7) || ',"count":' || (o_orderkey % 3)
                    || ',"advert_list":[' || CASE o_orderkey % 3 WHEN 0 THEN '' WHEN 1 THEN a ELSE a || ',' || b END || ']}]' AS adverts
             FROM (SELECT *, '{"advertId":' || ((o_orderkey // 3)*2) || ',"changeTime":"' || strftime(o_orderdate,'%Y-%m-%d') || '"}' AS a,
                             '{"advertId":' || ((o_orderkey // 3)*2+1) || ',"changeTime":"' || strftime(o_orderdate,'%Y-%m-%d') || '"}' AS b FROM orders)""")
    cluster = "role || '-' || CAST(conv_id AS VARCHAR) AS cluster"
    r.add("cluster_counts", lambda s, d: nested.cluster_counts(px.clusters(s, d)),
          f"SELECT {cluster}, turn AS count FROM conversations")
    r.add("cluster_keywords", lambda s, d: nested.cluster_keywords(px.clusters(s, d)),
          f"""SELECT {cluster}, unnest(CASE WHEN turn = 0 THEN [NULL] ELSE string_split(text, ' ') END) AS keyword FROM conversations""")
    r.add("search_words_excluded", lambda s, d: nested.excluded_words(px.search_words(s, d)),
          "SELECT turn > 0 AS fixed, unnest(string_split(text, ' ')) AS excluded FROM conversations")
    r.add("keyword_stats_flatten", lambda s, d: nested.keyword_lines(px.keyword_stats(s, d)),
          sql("SELECT date, keyword, CAST(views AS BIGINT) AS views, CAST(clicks AS BIGINT) AS clicks, sum FROM v_keywords", "v_keywords"))
    r.add("remains_flatten", lambda s, d: nested.remains_rows(px.remains_nested(s, d)),
          """SELECT 'Warehouse-' || CAST((p_partkey + i) % 40 AS VARCHAR) AS "warehouseName", CAST(p_size + i AS BIGINT) AS quantity,
                    p_brand AS brand, p_type AS "subjectName", p_name AS "vendorCode", p_partkey AS "nmId",
                    'b-' || CAST(p_partkey AS VARCHAR) AS barcode, '0' AS "techSize", p_retailprice AS volume,
                    p_partkey % 5 AS "inWayToClient", p_partkey % 3 AS "inWayFromClient", CAST(p_size AS BIGINT) AS "quantityWarehousesFull"
             FROM part JOIN (VALUES (0),(1),(2)) t(i) ON i < p_partkey % 4""")


# --- ads -------------------------------------------------------------------------------------

LINE_COLUMNS = [
    "advertId", "chunk_seq", "date_day", "views_day", "clicks_day", "appType_device", "nmId_nm",
    "views_nm", "clicks_nm", "orders_nm", "sum_nm", "sum_price_nm",
]
LINE_SELECT = """
    l.advertId AS "advertId", l.chunk_seq, l.date_day, l.views_day, l.clicks_day,
    CAST(l.appType_device AS INT) AS "appType_device", l.nmId_nm AS "nmId_nm", l.views_nm, l.clicks_nm, l.orders_nm,
    round(l.sum_nm,2) AS sum_nm, round(l.sum_price_nm,2) AS sum_price_nm
"""


def _lines(df, *more):
    return _r(df.select(*LINE_COLUMNS, *more), sum_nm=2, sum_price_nm=2)


def _per_product(spark, folder):
    return order_stats.orders_per_product(
        px.orders(spark, folder, "date", "nmId", "supplierArticle", "finishedPrice", "priceWithDisc")
    )


def _positioned(spark, folder):
    return ads.positioned_lines(px.fullstats(spark, folder))


def _costs(spark, folder):
    return ads.costs_by_article(
        ads.by_product(ads.cost_lines(px.fullstats(spark, folder))), px.campaign_names(spark, folder), _per_product(spark, folder)
    )


PER_PRODUCT_SQL = """(SELECT nmId, SUM(finishedPrice) AS finishedPrice, SUM(priceWithDisc) AS priceWithDisc,
                      arg_min(supplierArticle, date) AS supplierArticle FROM v_orders GROUP BY 1)"""


def _by_product_sql(view: str) -> str:
    return f"""SELECT advertId, nmId_nm, SUM(sum_nm) AS sum_nm, CAST(SUM(views_nm) AS BIGINT) AS views_nm,
               CAST(SUM(clicks_nm) AS BIGINT) AS clicks_nm, CAST(SUM(orders_nm) AS BIGINT) AS orders_nm,
               SUM(sum_price_nm) AS sum_price_nm FROM {view} WHERE nmId_nm IS NOT NULL GROUP BY 1,2"""


COSTS_SQL = f"""
    SELECT nmId_nm, supplierArticle, SUM(sum_nm) AS sum_nm, SUM(views_nm) AS views_nm, SUM(clicks_nm) AS clicks_nm,
           SUM(orders_nm) AS orders_nm, SUM(sum_price_nm) AS sum_price_nm, SUM(priceWithDisc) AS priceWithDisc,
           first(name ORDER BY sum_nm DESC, c.advertId, name) AS name, first(c.advertId ORDER BY sum_nm DESC, c.advertId) AS advertId
    FROM ({_by_product_sql('v_dedup')}) c LEFT JOIN v_names n ON c.advertId = n.advertId
    LEFT JOIN {PER_PRODUCT_SQL} p ON c.nmId_nm = p.nmId
    WHERE supplierArticle IS NOT NULL GROUP BY 1,2
"""
COSTS_VIEWS = ("v_dedup", "v_names", "v_orders")


def _add_ads(r: Registry) -> None:
    r.add("ad_stats_flatten", lambda s, d: _lines(ads.ad_lines(px.fullstats(s, d))),
          sql(f"SELECT {LINE_SELECT} FROM v_lines l", "v_lines"))
    r.add("booster_flatten", lambda s, d: ads.booster_lines(px.fullstats(s, d)).drop("booster_pos"),
          """SELECT user_id % 20 AS "advertId", event_id AS chunk_seq, CASE WHEN event_type='view' THEN strftime(ts,'%Y-%m-%d') END AS date_booster,
             CASE WHEN event_type='view' THEN user_id END AS nm_booster, CASE WHEN event_type='view' THEN value END AS avg_position_booster FROM events""")
    r.add("ad_stats_dedup", lambda s, d: _lines(ads.dedup_lines(ads.ad_lines(px.fullstats(s, d)))),
          sql(f"SELECT {LINE_SELECT} FROM v_dedup l", "v_dedup"))
    joined = """LEFT JOIN v_first_booster b ON l.advertId = b.advertId AND l.date_day IS NOT DISTINCT FROM b.date_booster"""
    r.add("ad_stats_with_position", lambda s, d: _lines(_positioned(s, d), "avg_position_booster"),
          sql(f"SELECT {LINE_SELECT}, b.avg_position_booster FROM v_dedup l {joined}", "v_dedup", "v_first_booster"))
    r.add("daily_position_distinct", lambda s, d: ads.daily_positions(_positioned(s, d)),
          sql(f"""SELECT DISTINCT l.advertId AS "advertId", l.date_day, l.views_day, l.clicks_day, b.avg_position_booster
                  FROM v_dedup l {joined}""", "v_dedup", "v_first_booster"))
    rollup = """
        SELECT user_id % 20 AS "advertId", {views} AS views, CAST(SUM(event_id % 7) AS BIGINT) AS clicks,
               SUM(value) AS sum, CAST(SUM(event_id % 3) AS BIGINT) AS orders, SUM(value*10) AS sum_price,
               CAST(SUM(event_id % 4) AS BIGINT) AS atbs, CAST(SUM(event_id % 2) AS BIGINT) AS shks,
               CAST(SUM(CASE WHEN event_type='error' THEN 0 ELSE 1 END) AS BIGINT) AS days,
               CAST(SUM(CASE WHEN event_type='view' THEN 1 ELSE 0 END) AS BIGINT) AS "boosterStats",
               strftime(MIN(ts),'%Y-%m-%d') AS interval_begin, strftime(MAX(ts),'%Y-%m-%d') AS interval_end
        FROM events GROUP BY 1
    """
    least, added = "MIN(event_id % 50 + 1)", "CAST(SUM(event_id % 50 + 1) AS BIGINT)"
    rounded = "SELECT * REPLACE (round(sum,2) AS sum, round(sum_price,1) AS sum_price) FROM"
    r.add("campaign_rollup", lambda s, d: _r(ads.campaign_rollup(px.fullstats(s, d)), sum=2, sum_price=1),
          f"{rounded} ({rollup.format(views=least)})")
    r.add("campaign_rollup_summed_views", lambda s, d: _r(ads.campaign_rollup(px.fullstats(s, d), views="sum"), sum=2, sum_price=1),
          f"{rounded} ({rollup.format(views=added)})")
    r.add("campaign_metrics",
          lambda s, d: _r(ads.with_rates(ads.campaign_rollup(px.fullstats(s, d))).select("advertId", "ctr", "cpc", "cr"), ctr=6, cpc=6, cr=6),
          f"""SELECT "advertId", round(clicks/views*100,6) AS ctr, round(sum/NULLIF(clicks,0),6) AS cpc, round(orders/NULLIF(clicks,0)*100,6) AS cr
              FROM ({rollup.format(views=least)})""")
    counted, money, rates = ("views", "clicks", "orders", "atbs", "shks"), ("sum", "sum_price"), ("ctr", "cpc", "cr")
    figures = [f"{c}_campaign" for c in (*counted, *money, *rates)]
    shown = ", ".join(
        [f"c.{c} AS {c}_campaign" for c in counted] + [f"round(c.{c}, 1) AS {c}_campaign" for c in money]
        + [f"round(c.{c}, 4) AS {c}_campaign" for c in rates])
    r.add("ad_stats_with_campaign",
          lambda s, d: _r(_lines(ads.with_campaign(ads.ad_lines(px.fullstats(s, d)), px.fullstats(s, d)), *figures),
                          sum_campaign=1, sum_price_campaign=1, ctr_campaign=4, cpc_campaign=4, cr_campaign=4),
          sql(f"""SELECT {LINE_SELECT}, {shown} FROM v_lines l JOIN (
                    SELECT *, clicks/views*100 AS ctr, sum/NULLIF(clicks,0) AS cpc, orders/NULLIF(clicks,0)*100 AS cr
                    FROM ({rollup.format(views=least)})) c ON l.advertId = c."advertId" """, "v_lines"))
    r.add("ad_by_product", lambda s, d: _r(ads.by_spend(ads.by_product(px.ads(s, d))), sum_nm=2, sum_price_nm=2),
          sql(f"""SELECT advertId AS "advertId", nmId_nm AS "nmId_nm", round(sum_nm,2) AS sum_nm, views_nm, clicks_nm, orders_nm,
                  round(sum_price_nm,2) AS sum_price_nm FROM ({_by_product_sql('v_ads')})""", "v_ads"))
    r.add("ad_product_named",
          lambda s, d: ads.with_names(ads.by_product(px.ads(s, d)), px.campaign_names(s, d)).select("advertId", "nmId_nm", "name", "views_nm"),
          sql(f"""SELECT c.advertId AS "advertId", c.nmId_nm AS "nmId_nm", n.name, c.views_nm FROM ({_by_product_sql('v_ads')}) c
                  LEFT JOIN v_names n ON c.advertId = n.advertId""", "v_ads", "v_names"))
    r.add("ad_vs_orders",
          lambda s, d: _r(ads.by_product(px.ads(s, d)).join(_per_product(s, d), F.col("nmId_nm") == F.col("nmId"), "left")
                          .select("advertId", "nmId_nm", "sum_nm", "nmId", "supplierArticle", "priceWithDisc"), sum_nm=2, priceWithDisc=4),
          sql(f"""SELECT c.advertId AS "advertId", c.nmId_nm AS "nmId_nm", round(c.sum_nm,2) AS sum_nm, p.nmId AS "nmId",
                  p.supplierArticle AS "supplierArticle", round(p.priceWithDisc,4) AS "priceWithDisc"
                  FROM ({_by_product_sql('v_ads')}) c LEFT JOIN {PER_PRODUCT_SQL} p ON c.nmId_nm = p.nmId""", "v_ads", "v_orders"))
    r.add("ad_drr_by_article",
          lambda s, d: _r(ads.by_spend(_costs(s, d)), sum_nm=2, sum_price_nm=2, priceWithDisc=4, drr=6),
          sql(f"""SELECT nmId_nm AS "nmId_nm", supplierArticle AS "supplierArticle", round(sum_nm,2) AS sum_nm,
                  CAST(views_nm AS BIGINT) AS views_nm, CAST(clicks_nm AS BIGINT) AS clicks_nm, CAST(orders_nm AS BIGINT) AS orders_nm,
                  round(sum_price_nm,2) AS sum_price_nm, round(priceWithDisc,4) AS "priceWithDisc", name, advertId AS "advertId",
                  round(sum_nm/NULLIF(sum_price_nm,0)*100,6) AS drr FROM ({COSTS_SQL})""", *COSTS_VIEWS))
    totals = """SELECT round(COALESCE(SUM(sum_nm),0),2) AS spend, round(COALESCE(SUM(sum_price_nm),0),1) AS ordered FROM ({costs}) {where}"""
    r.add("spend_total", lambda s, d: _r(ads.spend_total(_costs(s, d)), spend=2, ordered=1),
          sql(totals.format(costs=COSTS_SQL, where=""), *COSTS_VIEWS))
    r.add("spend_for_article", lambda s, d: _r(ads.spend_total(_costs(s, d), article="small ring"), spend=2, ordered=1),
          sql(totals.format(costs=COSTS_SQL, where="WHERE supplierArticle = 'small ring'"), *COSTS_VIEWS))
    r.add("spend_except_article", lambda s, d: _r(ads.spend_total(_costs(s, d), other_than="small ring"), spend=2, ordered=1),
          sql(totals.format(costs=COSTS_SQL, where="WHERE supplierArticle IS DISTINCT FROM 'small ring'"), *COSTS_VIEWS))
    r.add("margin_estimate", lambda s, d: _r(ads.margin_estimate(ads.spend_total(_costs(s, d))), spend=2, ordered=1, margin=3),
          sql(f"""SELECT round(SUM(sum_nm),2) AS spend, round(SUM(sum_price_nm),1) AS ordered, round(SUM(sum_price_nm)*0.72*0.93*0.6,3) AS margin
                  FROM ({COSTS_SQL})""", *COSTS_VIEWS))
    outer = f"""
        SELECT nmId_nm AS "nmId_nm", round(sum_nm,2) AS sum_nm, round(sum_price_nm,2) AS sum_price_nm, nmId AS "nmId",
               round(finishedPrice,6) AS "finishedPrice", round(priceWithDisc,4) AS "priceWithDisc", supplierArticle AS "supplierArticle",
               round(sum_nm/NULLIF(sum_price_nm,0)*100,6) AS drr
        FROM (SELECT nmId_nm, SUM(sum_nm) AS sum_nm, SUM(sum_price_nm) AS sum_price_nm FROM v_ads GROUP BY 1) a
        FULL JOIN {PER_PRODUCT_SQL} p ON a.nmId_nm = p.nmId
    """
    both = lambda s, d: ads.spend_vs_orders(px.ads(s, d), _per_product(s, d))
    tidy = lambda df: _r(df, sum_nm=2, sum_price_nm=2, finishedPrice=6, priceWithDisc=4, drr=6)
    r.add("spend_orders_outer", lambda s, d: tidy(both(s, d)), sql(outer, "v_ads", "v_orders"))
    r.add("drr_top20", lambda s, d: tidy(ads.highest_drr(both(s, d))),
          sql(outer + " ORDER BY sum_nm/NULLIF(sum_price_nm,0) DESC NULLS LAST, nmId_nm NULLS LAST, nmId NULLS LAST LIMIT 20", "v_ads", "v_orders"))
    r.add("spend_top5", lambda s, d: _r(ads.top_spend(px.ads(s, d)), sum_nm=2),
          sql("""SELECT nmId_nm AS "nmId_nm", round(SUM(sum_nm),2) AS sum_nm FROM v_ads GROUP BY 1 ORDER BY SUM(sum_nm) DESC, nmId_nm LIMIT 5""", "v_ads"))
    r.add("spend_reconcile", lambda s, d: _r(ads.reconcile(px.fullstats(s, d)), spend=2),
          sql("""SELECT 'flattened' AS stage, round(SUM(sum_nm),2) AS spend FROM v_lines
                 UNION ALL SELECT 'delivered', round(SUM(value),2) FROM events
                 UNION ALL SELECT 'deduplicated', round(SUM(sum_nm),2) FROM v_dedup""", "v_lines", "v_dedup"))
    r.add("booster_first_positions", lambda s, d: _r(ads.first_positions(px.boosters(s, d)), avg_position_booster=6),
          sql("""SELECT advertId AS "advertId", date_booster, nm_booster, round(avg_position_booster,6) AS avg_position_booster
                 FROM v_booster QUALIFY row_number() OVER (PARTITION BY date_booster, advertId ORDER BY nm_booster) = 1""", "v_booster"))


# --- keywords --------------------------------------------------------------------------------

def _add_keywords(r: Registry) -> None:
    rated = """SELECT {key}, CAST(COALESCE(SUM(views),0) AS BIGINT) AS views, CAST(COALESCE(SUM(clicks),0) AS BIGINT) AS clicks,
                      round(COALESCE(SUM(sum),0),2) AS sum, round(SUM(clicks)/NULLIF(SUM(views),0)*100,6) AS ctr
               FROM v_keywords WHERE {key} IS NOT NULL GROUP BY 1"""
    lines = lambda s, d: nested.keyword_lines(px.keyword_stats(s, d))
    r.add("keyword_daily", lambda s, d: _r(keywords.daily(lines(s, d)), sum=2, ctr=6), sql(rated.format(key="date"), "v_keywords"))
    r.add("keyword_top", lambda s, d: _r(keywords.top_keywords(lines(s, d)), sum=2, ctr=6),
          sql(rated.format(key="keyword") + " ORDER BY views DESC, keyword LIMIT 30", "v_keywords"))


# --- settlement ------------------------------------------------------------------------------

def _iso(*columns):
    return [dates.iso_day(c).alias(c) for c in columns]


def _stored_index(spark: SparkSession, lines: DataFrame) -> DataFrame:
    return sinks.write_index(lines, f"{shared_dir(spark)}/report-index/{uuid.uuid4().hex}")


def _add_settlement(r: Registry) -> None:
    iso = "strftime(date_from,'%Y-%m-%d') AS date_from, strftime(date_to,'%Y-%m-%d') AS date_to"
    lines = lambda s, d: settlement.typed(px.settlement(s, d))
    r.add("settlement_cursor", lambda s, d: feeds.cursor_of(lines(s, d)),
          sql("SELECT COALESCE(MAX(rrd_id),0) AS cursor FROM v_settlement", "v_settlement"))
    r.add("settlement_report_counts",
          lambda s, d: settlement.report_counts(lines(s, d)).select(*_iso("date_from", "date_to"), "realizationreport_id", "n"),
          sql(f"SELECT {iso}, realizationreport_id, COUNT(*) AS n FROM v_settlement GROUP BY date_from, date_to, realizationreport_id", "v_settlement"))
    r.add("settlement_labels", lambda s, d: settlement.labels(lines(s, d)), sql("SELECT * FROM v_labels", "v_labels"))
    r.add("settlement_labelled",
          lambda s, d: settlement.labelled_lines(lines(s, d), _stored_index(s, lines(s, d))).select("rrd_id", "realizationreport_id", "region"),
          sql("SELECT rrd_id, s.realizationreport_id, region FROM v_settlement s JOIN v_labels l ON s.realizationreport_id = l.realizationreport_id", "v_labels"))
    r.add("settlement_labels_by_seller", lambda s, d: settlement.labels(lines(s, d), by=["seller"]),
          sql("SELECT * FROM v_labels_by_seller", "v_labels_by_seller"))
    r.add("settlement_report_index",
          lambda s, d: settlement.report_index(lines(s, d)).select("realizationreport_id", "region", *_iso("date_from", "date_to"), "report_name"),
          sql("""SELECT *, 'id_' || CAST(realizationreport_id AS VARCHAR) || '_from_' || date_from || '_to_' || date_to || '_reg_' || region AS report_name
                 FROM (SELECT s.realizationreport_id, region, strftime(MIN(date_from),'%Y-%m-%d') AS date_from, strftime(MAX(date_to),'%Y-%m-%d') AS date_to
                       FROM v_settlement s JOIN v_labels l ON s.realizationreport_id = l.realizationreport_id GROUP BY 1,2)""", "v_labels"))
    total = """SELECT round(COALESCE(SUM(ppvz_for_pay),0),2) AS amount FROM v_settlement WHERE report_type = 1 AND supplier_oper_name = '{op}'"""
    for key, op in (("settlement_sales", settlement.SALE), ("settlement_returns", settlement.RETURN)):
        r.add(key, lambda s, d, o=op: _r(settlement.operation_total(lines(s, d), o), amount=2), sql(total.format(op=op), "v_settlement"))
    pay = "SUM(CASE WHEN report_type=1 AND supplier_oper_name='{op}' THEN ppvz_for_pay ELSE 0 END)"
    sold, back = pay.format(op=settlement.SALE), pay.format(op=settlement.RETURN)
    r.add("settlement_net_tax",
          lambda s, d: _r(settlement.net_and_tax(lines(s, d)).withColumn("first_date", dates.iso_day("first_date")),
                          sales=2, returns=2, net=2, tax=4),
          sql(f"""SELECT round({sold},2) AS sales, round({back},2) AS returns, round({sold}-{back},2) AS net,
                  round(({sold}-{back})*0.06,4) AS tax, strftime(MIN(date_from),'%Y-%m-%d') AS first_date FROM v_settlement""", "v_settlement"))
    pages = lambda s, d: settlement.landed(settlement.typed(px.settlement_pages(s, d)), "landed")
    r.add("settlement_net_tax_overlap",
          lambda s, d: _r(settlement.net_and_tax(pages(s, d)).withColumn("first_date", dates.iso_day("first_date")),
                          sales=2, returns=2, net=2, tax=4),
          sql(f"""SELECT round({sold},2) AS sales, round({back},2) AS returns, round({sold}-{back},2) AS net,
                  round(({sold}-{back})*0.06,4) AS tax, strftime(MIN(date_from),'%Y-%m-%d') AS first_date FROM v_pages""", "v_pages"))
    r.add("settlement_labels_overlap", lambda s, d: settlement.labels(pages(s, d)), sql("SELECT * FROM v_labels", "v_labels"))
    r.add("settlement_first_date", lambda s, d: settlement.first_date(lines(s, d)).select(*_iso("first_date")),
          sql("SELECT strftime(MIN(date_from),'%Y-%m-%d') AS first_date FROM v_settlement", "v_settlement"))


# --- slots -----------------------------------------------------------------------------------

def _add_slots(r: Registry) -> None:
    found = lambda s, d: slots.slot_search(px.slots(px.table(s, d, "orders")), **SLOT_RULE)
    search = """SELECT strftime(date,'%d-%m-%Y') AS date, warehouseName AS "warehouseName", coefficient,
                       deliveryBaseLiter AS "deliveryBaseLiter", deliveryCoef AS "deliveryCoef" FROM v_slots WHERE {where}"""
    r.add("slot_search", found, sql(search.format(where=SLOT_WHERE), "v_slots"))
    r.add("slot_search_unfiltered",
          lambda s, d: slots.slot_search(px.slots(px.table(s, d, "orders")), warehouse_ids=[], box_types=None),
          sql(search.format(where="coefficient BETWEEN 0 AND 1000"), "v_slots"))
    pad = lambda column, n: f"{column} || repeat(' ', greatest({n} - length({column}), 0))"
    parts = [pad("d", 10), pad("k", 1), pad("w", 15), pad("c", 6), pad("b", 6)]
    line = " || ' | ' || ".join(f"({p})" for p in parts)
    line_sql = f"""SELECT {{part}} {line} AS line FROM (SELECT strftime(date,'%d-%m-%Y') AS d, CAST(coefficient AS VARCHAR) AS k,
                   substring(warehouseName,1,15) AS w, CAST(deliveryCoef AS VARCHAR) AS c, CAST(deliveryBaseLiter AS VARCHAR) AS b
                   FROM v_slots WHERE {SLOT_WHERE})"""
    r.add("slot_lines", lambda s, d: slots.slot_lines(found(s, d)), sql(line_sql.format(part=""), "v_slots"))
    r.add("slot_message", lambda s, d: slots.slot_message(found(s, d)),
          sql(f"""{line_sql.format(part='2 AS part,')} UNION ALL SELECT 0, '{text.slot_head()}' UNION ALL SELECT 1, '{text.slot_rule()}'""", "v_slots"))
    r.add("warehouse_lookup", lambda s, d: feeds.lookup(px.warehouses(s, d), "name", "Supplier#000000007"),
          """SELECT s_suppkey AS "ID", s_name AS name, CAST(s_nationkey AS VARCHAR) AS address, s_acctbal > 0 AS "acceptsQR"
             FROM supplier WHERE s_name = 'Supplier#000000007'""")
    r.add("slot_alerts_stream", alerts_over_table, sql(search.format(where=SLOT_WHERE), "v_slots"))


def alerts_over_table(spark: SparkSession, folder: str) -> DataFrame:
    """All snapshots of the test table through the stream, then the alerts it wrote."""
    # As a pattern the path may name one file as well as a folder of files.
    stream = spark.readStream.schema(px.TABLES["orders"]).option("maxFilesPerTrigger", 64).parquet(f"{folder}/orders.parquet*")
    run = f"{shared_dir(spark)}/slot-alerts/{uuid.uuid4().hex}"
    query = slot_alerts.start(
        px.slots(stream), f"{run}/alerts", f"{run}/checkpoint", f"{run}/metrics", available_now=True, **SLOT_RULE,
    )
    if not query.awaitTermination(3600):
        query.stop()
        raise TimeoutError("the slot stream did not end within an hour")
    return slot_alerts.read_alerts(spark, f"{run}/alerts").drop("run", "batch", "line")


# --- remains and back-fill -------------------------------------------------------------------

def _add_remains(r: Registry) -> None:
    flags = ("brand", "subject")
    r.add("remains_grouped", lambda s, d: remains.grouped(px.remains(s, d), *flags),
          sql("""SELECT brand, subjectName AS "subjectName", SUM(quantity) AS quantity FROM v_remains GROUP BY 1,2""", "v_remains"))
    r.add("remains_cube", lambda s, d: remains.cube(px.remains(s, d), "brand", "subject", "seller_article", "product"),
          sql("""SELECT brand, subjectName AS "subjectName", vendorCode AS "vendorCode", nmId AS "nmId", SUM(quantity) AS quantity,
                 CAST(GROUPING(brand)*8 + GROUPING(subjectName)*4 + GROUPING(vendorCode)*2 + GROUPING(nmId) AS BIGINT) AS mix
                 FROM v_remains GROUP BY CUBE (brand, subjectName, vendorCode, nmId)""", "v_remains"))
    r.add("remains_filtered", lambda s, d: remains.filtered(px.remains(s, d), remains.LARGE).select("nmId", "warehouseName", "quantity"),
          sql("""SELECT nmId AS "nmId", warehouseName AS "warehouseName", quantity FROM v_remains WHERE volume > 3""", "v_remains"))
    r.add("remains_without_volume", lambda s, d: remains.filtered(px.remains(s, d), remains.NO_VOLUME).select("nmId", "warehouseName", "quantity"),
          sql("""SELECT nmId AS "nmId", warehouseName AS "warehouseName", quantity FROM v_remains WHERE volume IS NULL""", "v_remains"))


def _add_backfill(r: Registry) -> None:
    def windows_sql(span: int, whole: bool) -> str:
        stop = "hi" if whole else "hi - INTERVAL 1 DAY"
        return f"""
            SELECT row_number() OVER (ORDER BY f) - 1 AS window_id, strftime(f,'%Y-%m-%d') AS date_from,
                   strftime(least(f + INTERVAL {span - 1} DAY, hi),'%Y-%m-%d') AS date_to
            FROM (SELECT hi, unnest(generate_series(lo, {stop}, INTERVAL {span} DAY)) AS f
                  FROM (SELECT CAST(MIN(l_shipdate) AS TIMESTAMP) AS lo, CAST(MAX(l_shipdate) AS TIMESTAMP) AS hi FROM lineitem))
        """
    dated = lambda df: df.withColumns({c: dates.iso_day(c) for c in ("date_from", "date_to")})
    for key, span, whole in (("backfill_windows", 32, True), ("backfill_windows_reference", 32, False),
                             ("backfill_windows_weekly", 7, True)):
        r.add(key, lambda s, d, n=span, w=whole: dated(backfill.covering_windows(px.orders(s, d, "date"), "date", n, w)),
              windows_sql(span, whole))
    first, last = dt.date(1995, 1, 2), dt.date(2001, 11, 4)
    r.add("rows_per_window",
          lambda s, d: dated(backfill.rows_per_window(px.orders(s, d, "date"), "date", first, last, 32)),
          f"""SELECT i AS window_id, strftime(f,'%Y-%m-%d') AS date_from,
                     strftime(least(f + INTERVAL 31 DAY, TIMESTAMP '{last}'),'%Y-%m-%d') AS date_to, COUNT(*) AS n
              FROM (SELECT i, TIMESTAMP '{first}' + to_days(CAST(i*32 AS INT)) AS f FROM range(0, 79) t(i))
              JOIN lineitem ON l_shipdate >= f AND l_shipdate < f + INTERVAL 32 DAY AND l_shipdate <= TIMESTAMP '{last}' GROUP BY i, f""")
    last_alone = first + dt.timedelta(days=64 * 32)  # the 65th window would hold this day only
    r.add("rows_per_window_reference",
          lambda s, d: dated(backfill.rows_per_window(px.orders(s, d, "date"), "date", first, last_alone, 32, whole=False)),
          f"""SELECT i AS window_id, strftime(f,'%Y-%m-%d') AS date_from, strftime(f + INTERVAL 31 DAY,'%Y-%m-%d') AS date_to, COUNT(*) AS n
              FROM (SELECT i, TIMESTAMP '{first}' + to_days(CAST(i*32 AS INT)) AS f FROM range(0, 64) t(i))
              JOIN lineitem ON l_shipdate >= f AND l_shipdate < f + INTERVAL 32 DAY GROUP BY i, f""")
    r.add("missing_slices",
          lambda s, d: dated(backfill.missing_slices(px.campaign_names(s, d), px.ads(s, d), "date_day", "2023-12-01", "2024-02-15", 7)),
          sql("""SELECT c.advertId AS "advertId", i AS window_id, strftime(TIMESTAMP '2023-12-01' + to_days(CAST(i*7 AS INT)),'%Y-%m-%d') AS date_from,
                        strftime(least(TIMESTAMP '2023-12-01' + to_days(CAST(i*7+6 AS INT)), TIMESTAMP '2024-02-15'),'%Y-%m-%d') AS date_to
                 FROM (SELECT DISTINCT advertId FROM v_names) c, range(0, 11) t(i)
                 WHERE NOT EXISTS (SELECT 1 FROM v_ads a WHERE a.advertId = c.advertId
                                   AND (CAST(a.date_day AS DATE) - DATE '2023-12-01') // 7 = i)""", "v_names", "v_ads"))


def add_to(r: Registry) -> None:
    _add_nested(r)
    _add_ads(r)
    _add_keywords(r)
    _add_settlement(r)
    _add_slots(r)
    _add_remains(r)
    _add_backfill(r)
