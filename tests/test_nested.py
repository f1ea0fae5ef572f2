import datetime as dt

from pyspark.sql import functions as F

from sellerlens.functions import dates
from sellerlens.operators import nested
from sellerlens.plans import ads, keywords
from tests.conftest import rows

CAMPAIGNS = [
    {"advertId": 1, "name": "one", "autoParams": {
        "cpm": 100, "subject": {"id": 5, "name": "hats"}, "nms": [10, 11],
        "nmCPM": [{"nm": 11, "cpm": 5}, {"nm": 12, "cpm": 6}, {"nm": 12, "cpm": 8}]}},
    {"advertId": 2, "name": "two",
     "unitedParams": [
         {"catalogCPM": 7, "searchCPM": 9, "subject": {"id": 6, "name": "bags"}, "nms": [20, 21]},
         {"catalogCPM": 1, "nms": None}, {"catalogCPM": 2, "nms": []}],
     "auction_multibids": [{"nm": 30, "bid": 44}]},
    {"advertId": 3, "name": "three"},
    {"advertId": 4, "name": "four", "autoParams": {"cpm": 1, "nms": None, "nmCPM": []}},
    {"advertId": 5, "name": "five", "autoParams": None, "unitedParams": None, "auction_multibids": []},
    {"advertId": 6, "name": "six", "autoParams": {"cpm": 3, "nms": [60, 60], "nmCPM": [{"nm": 60, "cpm": 1}, {"nm": 60, "cpm": 2}]}},
]


def test_campaign_rows(land):
    out = nested.campaign_rows(land("campaigns", CAMPAIGNS))
    assert len(out.columns) == 22
    got = rows(out, "advertId", "nms", "nmCPM", "cpm", "subjectName", "subjectId")
    assert [g for g in got if g[0] == 1] == [
        (1, 10, None, 100, "hats", 5), (1, 11, 5, 100, "hats", 5),
        (1, 12, 6, 100, "hats", 5), (1, 12, 8, 100, "hats", 5),
    ]
    united = rows(out.where("advertId = 2"), "nms", "united_cpm", "united_searchCPM", "united_subjectName", "united_nms", "auction_nm", "auction_bid")
    assert united == [
        (20, 7, 9, "bags", "20, 21", None, None), (21, 7, 9, "bags", "20, 21", None, None),
        (None, None, None, None, None, 30, 44),
    ]
    for bare in (3, 4, 5):
        only = out.where(F.col("advertId") == bare).collect()
        assert len(only) == 1 and only[0]["name"] is not None
        assert all(only[0][c] is None for c in nested.ITEM_FIELDS)
    # A product listed twice gives two rows, each with the later of its two bids.
    assert [g[1:3] for g in got if g[0] == 6] == [(60, 2), (60, 2)]
    assert {g[0] for g in got} == {c["advertId"] for c in CAMPAIGNS}


def test_extra_bids_and_listing(land):
    campaigns = land("campaigns", CAMPAIGNS)
    assert rows(nested.extra_bids(campaigns)) == [(1, 12, 6), (1, 12, 8)]
    by_id = nested.campaigns_ordered(campaigns, "id", "asc").select("advertId").collect()
    assert [r[0] for r in by_id] == [1, 2, 3, 4, 5, 6]


def test_campaign_list(land):
    groups = land("campaign_list", [{"adverts": [
        {"type": 8, "status": 7, "count": 2, "advert_list": [{"advertId": 1, "changeTime": "a"}, {"advertId": 2, "changeTime": "b"}]},
        {"type": 9, "status": 9, "count": 0, "advert_list": []}]}])
    assert rows(nested.campaign_list(groups)) == [(8, 7, 2, 1, "a"), (8, 7, 2, 2, "b")]


def test_offset_times(spark):
    df = spark.createDataFrame([("2024-05-06T07:08:09.123456+03:00",), ("2024-05-06T07:08:09+03:00",), ("bad",)], "t string")
    got = rows(df.select(dates.strip_fraction("t").alias("s"), *dates.offset_parts("t")))
    day = dt.date(2024, 5, 6)
    good = ("2024-05-06T07:08:09+03:00", day, "2024-05-06T07:08:09", "+03:00")
    assert got == [good, good, ("bad", None, None, None)]


def test_clusters_words_and_json(land):
    clusters = land("auto_stat_words", [{"clusters": [
        {"cluster": "a", "count": 3, "keywords": ["x", "y"]}, {"cluster": "b", "count": 1, "keywords": []}]}])
    assert rows(nested.cluster_counts(clusters)) == [("a", 3), ("b", 1)]
    assert rows(nested.cluster_keywords(clusters)) == [("a", "x"), ("a", "y"), ("b", None)]
    words = land("stat_words", [{"words": {"fixed": True, "excluded": ["p", "q"]}}])
    assert rows(nested.excluded_words(words)) == [(True, "p"), (True, "q")]
    assert nested.word_lists(words)[:2] == ["fixed", "excluded"]
    text = rows(nested.nested_to_json(words, "words"))
    assert text == [('{"fixed":true,"excluded":["p","q"]}',)]


def test_flatten_struct(land):
    flat = nested.flatten_struct(land("campaigns", CAMPAIGNS).select("advertId", "autoParams"))
    assert flat.columns == [
        "advertId", "autoParams_cpm", "autoParams_subject_id", "autoParams_subject_name", "autoParams_nms", "autoParams_nmCPM",
    ]
    assert rows(flat.where("advertId = 1"), "autoParams_subject_name") == [("hats",)]


def test_remains_without_warehouse_vanish(land):
    remains = land("warehouse_remains", [
        {"nmId": 1, "brand": "b", "warehouses": [{"warehouseName": "w1", "quantity": 2}, {"warehouseName": "w2", "quantity": 3}]},
        {"nmId": 2, "brand": "b", "warehouses": []}, {"nmId": 3, "brand": "b"}])
    assert rows(nested.remains_rows(remains), "nmId", "warehouseName", "quantity") == [(1, "w1", 2), (1, "w2", 3)]


def test_keywords(land):
    stats = land("keyword_stats", [{"keywords": [
        {"date": "2025-02-04", "stats": [{"keyword": "k1", "views": 10, "clicks": 1, "sum": 5.0}, {"keyword": "k2", "views": 0, "clicks": 0, "sum": 0.0}]},
        {"date": "2025-02-05", "stats": None},
        {"date": "2025-02-06", "stats": [{"keyword": "k1", "views": 30, "clicks": 3, "sum": 1.0}]}]}])
    lines = nested.keyword_lines(stats)
    assert ("2025-02-05", None, None, None, None) in rows(lines)
    assert rows(keywords.daily(lines)) == [
        ("2025-02-04", 10, 1, 5.0, 10.0), ("2025-02-05", 0, 0, 0.0, None), ("2025-02-06", 30, 3, 1.0, 10.0)]
    assert [r["keyword"] for r in keywords.top_keywords(lines).collect()] == ["k1", "k2"]
    assert rows(keywords.by_keyword(lines), "keyword", "ctr") == [("k1", 10.0), ("k2", None)]


def product(nm, spent, **more):
    return {"nmId": nm, "sum": spent, "views": 1, "clicks": 1, "orders": 0, "sum_price": 0.0, **more}


CHUNKS = [
    {"chunk_seq": 1, "advertId": 1, "views": 100, "clicks": 10, "orders": 2, "atbs": 1, "shks": 1, "sum": 30.0, "sum_price": 5.0,
     "interval": {"begin": "2025-02-04", "end": "2025-03-07"},
     "days": [
         {"date": "2025-02-04T00:00:00+03:00", "views": 9, "clicks": 2, "apps": [
             {"appType": 32, "nm": [product(7, 10.0), product(8, 5.0), product(7, 99.0)]},
             {"appType": 1, "nm": []}]},
         {"date": "2025-02-05T00:00:00+03:00", "views": 1, "clicks": 0, "apps": []}],
     "boosterStats": [
         {"date": "2025-02-04T00:00:00Z", "nm": 7, "avg_position": 3.0}, {"date": "2025-02-04T00:00:00Z", "nm": 8, "avg_position": 4.0}]},
    {"chunk_seq": 2, "advertId": 1, "views": 40, "clicks": 5, "orders": 1, "atbs": 2, "shks": 3, "sum": 20.0, "sum_price": 6.0,
     "interval": {"begin": "2025-03-08", "end": "2025-03-22"},
     "days": [{"date": "2025-02-04T00:00:00+03:00", "views": 8, "clicks": 1, "apps": [{"appType": 32, "nm": [product(7, 77.0)]}]}],
     "boosterStats": None},
    {"chunk_seq": 3, "advertId": 2, "views": 0, "clicks": 0, "orders": 0, "atbs": 0, "shks": 0, "sum": 0.0, "sum_price": 0.0,
     "interval": {"begin": "2025-02-04", "end": "2025-03-07"}, "days": [], "boosterStats": []},
]


def test_ad_lines(land):
    lines = ads.ad_lines(land("ad_fullstats", CHUNKS[:1], CHUNKS[1:]))
    assert rows(lines, "advertId", "date_day", "appType_device", "nmId_nm", "sum_nm") == [
        (1, "2025-02-04", 1, None, None), (1, "2025-02-04", 32, 7, 10.0), (1, "2025-02-04", 32, 7, 77.0),
        (1, "2025-02-04", 32, 7, 99.0), (1, "2025-02-04", 32, 8, 5.0), (1, "2025-02-05", None, None, None),
        (2, None, None, None, None)]
    kept = ads.dedup_lines(lines)
    assert rows(kept.where("nmId_nm = 7"), "sum_nm") == [(10.0,)]
    assert kept.count() == 5


def test_rollup(land):
    chunks = land("ad_fullstats", CHUNKS)
    got = rows(ads.with_rates(ads.campaign_rollup(chunks)),
               "advertId", "views", "clicks", "sum", "days", "boosterStats", "interval_begin", "interval_end", "ctr", "cpc")
    assert got == [
        (1, 40, 15, 50.0, 3, 2, "2025-02-04", "2025-03-22", 37.5, 50.0 / 15),
        (2, 0, 0, 0.0, 0, 0, "2025-02-04", "2025-03-07", None, None)]
    assert rows(ads.campaign_rollup(chunks, views="sum"), "advertId", "views") == [(1, 140), (2, 0)]


def test_positions_keep_first_and_match_null(land):
    got = rows(ads.positioned_lines(land("ad_fullstats", CHUNKS)), "advertId", "date_day", "nmId_nm", "avg_position_booster")
    assert got == [
        (1, "2025-02-04", 7, 3.0), (1, "2025-02-04", 8, 3.0), (1, "2025-02-04", None, 3.0),
        (1, "2025-02-05", None, None), (2, None, None, None)]


def test_null_dates_meet(spark):
    lines = spark.createDataFrame([(1, None, 5)], "advertId bigint, date_day string, nmId_nm bigint")
    boosters = spark.createDataFrame([(1, None, 9, 2.5), (1, "2025-01-01", 9, 1.5)], "advertId bigint, date_booster string, nm_booster bigint, avg_position_booster double")
    assert rows(ads.with_position(lines, boosters), "nmId_nm", "avg_position_booster") == [(5, 2.5)]


def test_spend_is_preserved(land):
    got = dict(rows(ads.reconcile(land("ad_fullstats", CHUNKS))))
    assert got == {"flattened": 191.0, "delivered": 50.0, "deduplicated": 15.0}
