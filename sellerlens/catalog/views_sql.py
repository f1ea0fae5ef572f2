"""The proxies once more, as SQL for the independent engine the results are checked with."""

from __future__ import annotations

VIEWS = {
    "v_orders": """
        SELECT CAST(l_orderkey*10+l_linenumber AS BIGINT) AS srid, l_shipdate AS date, p_name AS supplierArticle,
               l_partkey AS nmId, l_suppkey % 50 AS seller, l_extendedprice AS totalPrice, l_discount*100 AS discountPercent,
               s_name AS warehouseName, n_name AS oblast, p_type AS subject, p_brand AS category,
               l_extendedprice*(1-l_discount) AS priceWithDisc,
               l_extendedprice*(1-l_discount)*(1+l_tax) AS finishedPrice, (l_linestatus='F') AS isRealization,
               CASE WHEN l_returnflag='R' THEN '1999-01-01T00:00:00' ELSE '0001-01-01T00:00:00' END AS cancel_dt,
               l_extendedprice*(1-l_discount*100/100) AS price,
               CASE WHEN week(l_shipdate)>=50 AND month(l_shipdate)=1
                    THEN year(l_shipdate)*100+week(l_shipdate)-100
                    ELSE year(l_shipdate)*100+week(l_shipdate) END AS yearweek,
               year(l_shipdate)*100+month(l_shipdate) AS yearmonth
        FROM lineitem LEFT JOIN part ON l_partkey=p_partkey LEFT JOIN supplier ON l_suppkey=s_suppkey
        LEFT JOIN nation ON s_nationkey=n_nationkey
    """,
    "v_sales": """
        SELECT l_shipdate AS date, p_name AS supplierArticle, l_suppkey % 50 AS seller, l_extendedprice AS totalPrice,
               l_discount*100 AS discountPercent, l_tax*100 AS promoCodeDiscount,
               CAST(l_linenumber AS DOUBLE) AS spp, CASE WHEN l_returnflag='R' THEN 1 ELSE 0 END AS IsStorno,
               l_extendedprice*((100-l_discount*100)/100)*((100-l_tax*100)/100)*((100-l_linenumber)/100) AS price,
               CASE WHEN week(l_shipdate)>=50 AND month(l_shipdate)=1
                    THEN year(l_shipdate)*100+week(l_shipdate)-100
                    ELSE year(l_shipdate)*100+week(l_shipdate) END AS yearweek,
               week(l_shipdate) AS week, month(l_shipdate) AS month, year(l_shipdate) AS year
        FROM lineitem LEFT JOIN part ON l_partkey=p_partkey
    """,
    "v_orders_late": "SELECT * REPLACE (date + INTERVAL 1153 DAY AS date) FROM v_orders",
    "v_sales_late": """
        SELECT * REPLACE (date + INTERVAL 1153 DAY AS date, week(date + INTERVAL 1153 DAY) AS week,
                          month(date + INTERVAL 1153 DAY) AS month, year(date + INTERVAL 1153 DAY) AS year) FROM v_sales
    """,
    "v_stocks": """
        SELECT p_name AS supplierArticle, p_partkey AS nmId, CAST(p_size AS BIGINT) AS quantity
        FROM part
    """,
    "v_stock": "SELECT supplierArticle, CAST(SUM(quantity) AS BIGINT) AS stock FROM v_stocks GROUP BY 1",
    "v_ads": """
        SELECT user_id % 20 AS advertId, strftime(ts,'%Y-%m-%d') AS date_day,
               CASE WHEN event_type IN ('click','purchase') THEN 1 ELSE 32 END AS appType_device, user_id AS nmId_nm,
               COUNT(*) AS views_nm, CAST(SUM(CASE WHEN event_type='click' THEN 1 ELSE 0 END) AS BIGINT) AS clicks_nm,
               CAST(SUM(CASE WHEN event_type='purchase' THEN 1 ELSE 0 END) AS BIGINT) AS orders_nm,
               SUM(CASE WHEN event_type='click' THEN value ELSE 0 END) AS sum_nm,
               SUM(CASE WHEN event_type='purchase' THEN value ELSE 0 END) AS sum_price_nm
        FROM events GROUP BY 1,2,3,4
    """,
    "v_booster": """
        SELECT user_id % 20 AS advertId, strftime(ts,'%Y-%m-%d') AS date_booster, user_id AS nm_booster,
               AVG(value) AS avg_position_booster
        FROM events WHERE event_type='view' GROUP BY 1,2,3
    """,
    "v_names": """
        SELECT DISTINCT user_id % 20 AS advertId, 'campaign-' || CAST(user_id % 20 AS VARCHAR)
               || CASE WHEN user_id % 20 < 3 AND user_id % 40 >= 20 THEN '-b' ELSE '' END AS name
        FROM events
    """,
    # The flat rows the nested chunks must come out as, formed here without any nesting.
    "v_lines": """
        SELECT e.event_id AS chunk_seq, user_id % 20 AS advertId, event_type<>'error' AS has_day,
               CASE WHEN event_type<>'error' THEN strftime(ts,'%Y-%m-%d') END AS date_day,
               CASE WHEN event_type<>'error' THEN event_id % 50 END AS views_day,
               CASE WHEN event_type<>'error' THEN event_id % 7 END AS clicks_day,
               CASE WHEN event_type<>'error' THEN 0 END AS day_pos,
               a.pos AS app_pos, a.app AS appType_device, n.pos AS nm_pos,
               user_id + n.pos AS nmId_nm, event_id % 50 + n.pos AS views_nm,
               CASE WHEN n.pos IS NOT NULL THEN event_id % 7 END AS clicks_nm,
               CASE WHEN n.pos IS NOT NULL THEN event_id % 3 END AS orders_nm,
               value * (n.pos + 1) AS sum_nm,
               CASE WHEN n.pos IS NOT NULL THEN value * 10 END AS sum_price_nm
        FROM events e
        LEFT JOIN (VALUES (0, 32), (1, 1)) a(pos, app)
               ON event_type NOT IN ('error','signup') AND (a.pos = 0 OR event_id % 2 <> 0)
        LEFT JOIN (VALUES (0), (1)) n(pos)
               ON (a.pos = 0 AND event_id % 3 <> 0) OR (a.pos = 1 AND n.pos = 0)
    """,
    "v_dedup": """
        SELECT * FROM v_lines QUALIFY row_number() OVER (
            PARTITION BY date_day, advertId, appType_device, nmId_nm
            ORDER BY chunk_seq, day_pos, app_pos, nm_pos) = 1
    """,
    "v_first_booster": """
        SELECT advertId, date_booster, nm_booster, avg_position_booster FROM (
            SELECT event_id, user_id % 20 AS advertId,
                   CASE WHEN event_type='view' THEN strftime(ts,'%Y-%m-%d') END AS date_booster,
                   CASE WHEN event_type='view' THEN user_id END AS nm_booster,
                   CASE WHEN event_type='view' THEN value END AS avg_position_booster FROM events)
        QUALIFY row_number() OVER (PARTITION BY advertId, date_booster ORDER BY event_id) = 1
    """,
    "v_keywords": """
        SELECT strftime(ts,'%Y-%m-%d') AS date,
               CASE WHEN event_id % 10 >= 2 THEN event_type || '-' || CAST(user_id % 40 AS VARCHAR) END AS keyword,
               CASE WHEN event_id % 10 >= 2 THEN CASE WHEN event_type='error' THEN 0 ELSE 1 END END AS views,
               CASE WHEN event_id % 10 >= 2 THEN CASE WHEN user_id % 2=0 THEN 1 ELSE 0 END END AS clicks,
               CASE WHEN event_id % 10 >= 2 THEN value END AS sum
        FROM events
    """,
    "v_settlement": """
        SELECT o_orderkey AS rrd_id, CAST(date_trunc('week',o_orderdate) AS DATE) AS date_from,
               CAST(date_trunc('week',o_orderdate)+INTERVAL 6 DAY AS DATE) AS date_to,
               CAST((year(date_trunc('week',o_orderdate))*100+weekofyear(o_orderdate))*10
                    + CASE WHEN o_custkey % 10 < 7 THEN 0 ELSE 1 END AS BIGINT) AS realizationreport_id,
               CASE WHEN o_orderpriority='5-LOW' THEN 2 ELSE 1 END AS report_type,
               CASE o_orderstatus WHEN 'F' THEN 'Продажа' WHEN 'O' THEN 'Возврат' ELSE 'Логистика' END AS supplier_oper_name,
               o_totalprice AS ppvz_for_pay, o_custkey % 7 AS seller
        FROM orders
    """,
    "v_pages": """
        SELECT * REPLACE (CASE WHEN rrd_id % 5 = 0 THEN ppvz_for_pay + 1 ELSE ppvz_for_pay END AS ppvz_for_pay) FROM v_settlement
    """,
    "v_labels": """
        SELECT realizationreport_id, CASE WHEN rn=1 THEN 'ru' ELSE 'other' END AS region FROM (
            SELECT *, row_number() OVER (PARTITION BY date_from, date_to ORDER BY n DESC, realizationreport_id) AS rn
            FROM (SELECT date_from, date_to, realizationreport_id, COUNT(*) AS n FROM v_settlement GROUP BY 1,2,3))
        QUALIFY row_number() OVER (PARTITION BY realizationreport_id ORDER BY date_from DESC, date_to DESC) = 1
    """,
    "v_labels_by_seller": """
        SELECT seller, realizationreport_id, CASE WHEN rn=1 THEN 'ru' ELSE 'other' END AS region FROM (
            SELECT *, row_number() OVER (PARTITION BY seller, date_from, date_to ORDER BY n DESC, realizationreport_id) AS rn
            FROM (SELECT seller, date_from, date_to, realizationreport_id, COUNT(*) AS n FROM v_settlement GROUP BY 1,2,3,4))
        QUALIFY row_number() OVER (PARTITION BY seller, realizationreport_id ORDER BY date_from DESC, date_to DESC) = 1
    """,
    "v_slots": """
        SELECT o_orderkey, o_orderdate AS date, CAST(o_custkey % 40 AS BIGINT) AS warehouseID,
               'Warehouse-' || CAST(o_custkey % 40 AS VARCHAR) AS warehouseName,
               CAST(substring(o_orderpriority,1,1) AS INT) AS boxTypeID, CAST(o_orderkey % 40 AS INT) - 1 AS coefficient,
               o_totalprice AS deliveryBaseLiter, CAST(o_orderkey % 7 AS INT) AS deliveryCoef
        FROM orders
    """,
    "v_registry": """
        SELECT CAST(user_id AS VARCHAR) AS user_id, 'key-' || CAST(event_id AS VARCHAR) AS user_api, event_id AS seq
        FROM events WHERE event_type='signup'
    """,
    "v_remains": """
        SELECT p_brand AS brand, p_type AS subjectName, p_name AS vendorCode, p_partkey AS nmId,
               CASE WHEN p_partkey % 7 <> 0 THEN p_size * 0.25 END AS volume, s_name AS warehouseName, SUM(l_quantity) AS quantity
        FROM lineitem JOIN part ON l_partkey=p_partkey JOIN supplier ON l_suppkey=s_suppkey
        GROUP BY 1,2,3,4,5,6
    """,
    "v_campaigns": """
        SELECT o_orderkey AS k, o_custkey AS c, 'campaign-' || CAST(o_orderkey % 100 AS VARCHAR) AS name,
               CASE WHEN o_orderkey % 3 = 0 THEN 8 ELSE 9 END AS type, CAST(o_orderkey % 3 + 7 AS INT) AS status,
               o_totalprice AS dailyBudget, o_orderpriority AS paymentType,
               strftime(o_orderdate,'%Y-%m-%d') || 'T10:11:12.123456+03:00' AS createTime,
               strftime(o_orderdate + INTERVAL 1 DAY,'%Y-%m-%d') || 'T10:11:12.123456+03:00' AS changeTime,
               strftime(o_orderdate + INTERVAL 2 DAY,'%Y-%m-%d') || 'T10:11:12.123456+03:00' AS startTime,
               CASE WHEN o_orderkey % 10 <> 0
                    THEN strftime(o_orderdate + INTERVAL 30 DAY,'%Y-%m-%d') || 'T10:11:12.123456+03:00' END AS endTime,
               CASE WHEN o_orderkey % 4 <> 3 THEN o_custkey % 50 END AS sid,
               CASE WHEN o_orderkey % 4 <> 3 THEN 'subject-' || CAST(o_custkey % 50 AS VARCHAR) END AS sname
        FROM orders
    """,
    # Each branch of the campaign shapes written out flat.
    "v_items": """
        SELECT k, c + i AS nms, CASE WHEN k % 5 <> 0 AND i = 1 THEN 5 END AS nmCPM, k % 500 AS cpm, sname AS subjectName,
               sid AS subjectId, NULL AS auction_nm, NULL AS auction_bid, NULL AS united_cpm, NULL AS united_searchCPM,
               NULL AS united_subjectName, NULL AS united_subjectId, NULL AS united_nms
        FROM v_campaigns JOIN (VALUES (0),(1)) t(i) ON (k % 4 = 2 AND i = 0) OR k % 4 = 3 WHERE k % 3 = 0
        UNION ALL
        SELECT k, c + nm, bid, k % 500, sname, sid, NULL, NULL, NULL, NULL, NULL, NULL, NULL
        FROM v_campaigns, (VALUES (1,5),(2,6),(2,8)) t(nm, bid)
        WHERE k % 3 = 0 AND k % 5 <> 0 AND NOT (k % 4 = 3 AND nm = 1)
        UNION ALL
        SELECT k, c + i, NULL, NULL, NULL, NULL, NULL, NULL, k % 70, k % 80, sname, sid,
               CASE WHEN i = 5 THEN CAST(c + 5 AS VARCHAR) ELSE CAST(c AS VARCHAR) || ', ' || CAST(c + 1 AS VARCHAR) END
        FROM v_campaigns, (VALUES (0),(1),(5)) t(i) WHERE k % 3 = 1 AND k % 9 <> 1
        UNION ALL
        SELECT k, NULL, NULL, NULL, NULL, NULL, c + i, CASE WHEN i = 0 THEN k % 90 ELSE k % 91 END,
               NULL, NULL, NULL, NULL, NULL
        FROM v_campaigns, (VALUES (0),(3)) t(i) WHERE k % 5 = 2
    """,
}

NEEDS = {
    "v_stock": ["v_stocks"],
    "v_dedup": ["v_lines"],
    "v_labels": ["v_settlement"],
    "v_labels_by_seller": ["v_settlement"],
    "v_orders_late": ["v_orders"],
    "v_sales_late": ["v_sales"],
    "v_pages": ["v_settlement"],
    "v_items": ["v_campaigns"],
}


def sql(select: str, *views: str) -> str:
    """A query over the named views, each given as a common table expression."""
    order: list[str] = []
    for view in views:
        for name in [*NEEDS.get(view, []), view]:
            if name not in order:
                order.append(name)
    ctes = ",\n".join(f"{name} AS ({VIEWS[name].strip()})" for name in order)
    return f"WITH {ctes}\n{select.strip()}" if order else select.strip()
