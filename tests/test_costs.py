"""Advertising costs and order statistics against the same steps in pandas."""

import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from sellerlens.operators import grouping, ranking
from sellerlens.plans import ads, order_stats, remains
from tests.conftest import rows

SUMS = ads.NM_SUMS


@pytest.fixture(scope="module")
def data():
    random.seed(11)
    lines = pd.DataFrame([
        {"advertId": random.randint(1, 6), "nmId_nm": random.choice([None, *range(1, 16)]), "date_day": f"2025-01-{random.randint(1, 9):02d}",
         "appType_device": random.choice([1, 32]), "sum_nm": round(random.random() * 90, 2), "views_nm": random.randint(0, 50),
         "clicks_nm": random.randint(0, 9), "orders_nm": random.randint(0, 3), "sum_price_nm": random.choice([0.0, round(random.random() * 500, 2)])}
        for _ in range(400)]).drop_duplicates(["date_day", "advertId", "appType_device", "nmId_nm"])
    names = pd.DataFrame([(i, f"n{i}") for i in range(1, 6)] + [(2, "other-2"), (2, "n2"), (6, None)], columns=["advertId", "name"])
    orders = pd.DataFrame([
        {"srid": i, "date": f"2025-01-{random.randint(1, 28):02d}", "nmId": random.choice([None, *range(5, 25)]),
         "finishedPrice": float(random.randint(1, 99)), "priceWithDisc": float(random.randint(1, 99)), "isRealization": random.random() < .5}
        for i in range(300)])
    orders["supplierArticle"] = [None if pd.isna(n) or n == 7 else f"art-{int(n) % 9}" for n in orders["nmId"]]
    return lines, names, orders


def frames(spark, data):
    lines, names, orders = data
    def plain(column, v):
        if pd.isna(v):
            return None
        return int(v) if column.startswith("nmId") else v

    def clean(pdf):
        return [tuple(plain(c, v) for c, v in zip(pdf.columns, r)) for r in pdf.itertuples(index=False)]

    return (
        spark.createDataFrame(clean(lines), "advertId bigint, nmId_nm bigint, date_day string, appType_device int, sum_nm double, views_nm bigint, clicks_nm bigint, orders_nm bigint, sum_price_nm double"),
        spark.createDataFrame(clean(names), "advertId bigint, name string"),
        spark.createDataFrame(clean(orders), "srid bigint, date string, nmId bigint, finishedPrice double, priceWithDisc double, isRealization boolean, supplierArticle string"),
    )


def per_product(orders):
    ordered = orders.sort_values(["date", "supplierArticle"])
    return ordered.groupby("nmId").agg({"finishedPrice": "sum", "priceWithDisc": "sum", "supplierArticle": "first"}).reset_index()


def test_costs_by_article(spark, data):
    lines, names, orders = data
    base = lines.groupby(["advertId", "nmId_nm"])[SUMS].sum().reset_index().sort_values(["sum_nm", "advertId"], ascending=[False, True])
    merged = base.merge(names.drop_duplicates(), how="left", on="advertId").merge(per_product(orders), how="left", left_on="nmId_nm", right_on="nmId")
    merged = merged.sort_values(["sum_nm", "advertId", "name"], ascending=[False, True, True], kind="stable")
    want = merged.groupby(["nmId_nm", "supplierArticle"]).agg(
        {**{c: "sum" for c in SUMS}, "priceWithDisc": "sum", "name": "first", "advertId": "first"}).reset_index()
    s_lines, s_names, s_orders = frames(spark, data)
    got = ads.costs_by_article(ads.by_product(s_lines), s_names, order_stats.orders_per_product(s_orders)).toPandas()
    got = got.sort_values(["nmId_nm"]).reset_index(drop=True)
    want = want.sort_values(["nmId_nm"]).reset_index(drop=True)
    assert len(got) == len(want) > 5
    for c in [*SUMS, "priceWithDisc"]:
        assert np.allclose(got[c], want[c])
    assert [None if pd.isna(x) else x for x in got["name"]] == [None if pd.isna(x) else x for x in want["name"]]
    assert list(got["advertId"]) == list(want["advertId"])
    drr = want["sum_nm"] / want["sum_price_nm"].replace(0, np.nan) * 100
    assert np.allclose(got["drr"].astype(float), drr, equal_nan=True)


def test_spend_vs_orders_keeps_both_sides(spark, data):
    lines, _, orders = data
    want = lines.groupby("nmId_nm")[["sum_nm", "sum_price_nm"]].sum().reset_index().merge(
        per_product(orders), how="outer", left_on="nmId_nm", right_on="nmId")
    s_lines, _, s_orders = frames(spark, data)
    both = ads.spend_vs_orders(s_lines, order_stats.orders_per_product(s_orders))
    assert both.count() == len(want)
    top = ads.highest_drr(both).collect()
    assert len(top) == 20 and [r["drr"] for r in top if r["drr"] is not None] == sorted((r["drr"] for r in top if r["drr"] is not None), reverse=True)
    assert [r["nmId_nm"] for r in ads.top_spend(s_lines).collect()] == list(
        lines.groupby("nmId_nm")["sum_nm"].sum().sort_values(ascending=False).index[:5])


def test_spend_totals_split_by_article(spark):
    costs = spark.createDataFrame([("a", 1.0, 10.0), ("b", 2.0, 20.0), (None, 4.0, 40.0)], "supplierArticle string, sum_nm double, sum_price_nm double")
    assert rows(ads.spend_total(costs)) == [(7.0, 70.0)]
    assert rows(ads.spend_total(costs, article="a")) == [(1.0, 10.0)]
    assert rows(ads.spend_total(costs, other_than="a")) == [(6.0, 60.0)]
    assert ads.margin_estimate(ads.spend_total(costs)).first()["margin"] == pytest.approx(70 * 0.72 * 0.93 * 0.6)


def test_order_stats(spark, data):
    _, _, orders = data
    _, _, s_orders = frames(spark, data)
    assert rows(order_stats.count_in_range(s_orders, "2025-01-05", "2025-01-09")) == [(int(orders["date"].between("2025-01-05", "2025-01-08").sum()),)]
    realized = orders[(orders["date"] >= "2025-01-10") & orders["isRealization"]]["priceWithDisc"].sum()
    assert rows(order_stats.realized_revenue_since(s_orders, "2025-01-10")) == [(realized,)]
    dup = s_orders.union(s_orders).withColumn("srid", F.when(F.col("srid") != 3, F.col("srid")))
    assert rows(order_stats.distinct_orders(dup)) == [(300,)]
    assert abs(order_stats.distinct_orders(dup, approximate=True).first()[0] - 300) <= 15
    prices = [r["finishedPrice"] for r in order_stats.by_price(order_stats.orders_per_product(s_orders)).collect()]
    assert prices == sorted(prices, reverse=True)


def test_registry_last_wins(spark):
    df = spark.createDataFrame([("u", "old", 1), ("u", "new", 9), ("v", "x", 2)], "user_id string, user_api string, seq bigint")
    assert rows(grouping.last_per_key(df, "user_id", "seq", ["user_api"])) == [("u", "new", 9), ("v", "x", 2)]


def test_remains_grouping(spark):
    df = spark.createDataFrame(
        [("b1", "s1", "v1", 1, 4.0, 2), ("b1", "s2", "v2", 2, None, 3), ("b2", "s1", "v3", 3, 1.0, 5)],
        "brand string, subjectName string, vendorCode string, nmId bigint, volume double, quantity bigint")
    assert rows(remains.grouped(df, "brand")) == [("b1", 5), ("b2", 5)]
    assert rows(remains.grouped(df)) == [(10,)]
    cube = remains.cube(df, "brand", "subject")
    assert rows(cube.where("mix = 3"), "quantity") == [(10,)]
    assert rows(cube.where("mix = 1"), "brand", "quantity") == [("b1", 5), ("b2", 5)]
    for volume, ids in ((remains.ANY_VOLUME, [1, 2, 3]), (remains.NO_VOLUME, [2]), (remains.LARGE, [1])):
        assert [r[0] for r in rows(remains.filtered(df, volume), "nmId")] == ids


def test_hot_keys_are_reduced_before_the_shuffle(spark):
    """A third of all rows under one key: sums and keep-first shuffle a row per task, not the rows."""
    df = spark.range(90000).select(
        F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id")).alias("k"), (89999 - F.col("id")).alias("pos"), F.lit(1.0).alias("v"))
    kept = ranking.keep_first(df, ["k"], ["pos"])
    plan = kept._jdf.queryExecution().executedPlan().toString()
    assert plan.index("Exchange hashpartitioning") < plan.rindex("WindowGroupLimit")
    got = kept.where("k = 0").collect()
    assert len(got) == 1 and got[0]["pos"] == min(89999 - i for i in range(0, 90000, 3))
    assert kept.count() == 60001
    sums = grouping.sums(df, ["k"], ["v"])
    assert "partial_sum" in sums._jdf.queryExecution().executedPlan().toString()
    assert rows(sums.where("k = 0")) == [(0, 30000.0)]


def test_fan_out_is_never_formed(spark):
    """3000 lines and 3000 booster rows on one campaign and day: the join emits 3000 rows, not 9 million."""
    lines = spark.range(3000).select(F.lit(1).cast("bigint").alias("advertId"), F.lit("2025-01-01").alias("date_day"), F.col("id").alias("nmId_nm"))
    boosters = spark.range(3000).select(
        F.lit(1).cast("bigint").alias("advertId"), F.lit("2025-01-01").alias("date_booster"), F.col("id").alias("nm_booster"),
        F.col("id").cast("double").alias("avg_position_booster"))
    out = ads.with_position(lines, boosters)
    assert out.count() == 3000 and rows(out.select("avg_position_booster").distinct()) == [(0.0,)]
