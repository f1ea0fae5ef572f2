import json

import pytest
from pyspark.sql import functions as F

from sellerlens.operators import periods
from sellerlens.sources import feeds, schemas, sinks
from tests.conftest import rows


def test_unknown_fields_are_ignored_missing_are_null(land):
    df = land("stocks", [{"supplierArticle": "a", "quantity": 1, "new": 5}, {"supplierArticle": "b"}])
    assert df.columns == ["supplierArticle", "quantity"] and rows(df) == [("a", 1), ("b", None)]


def test_whole_body_files(spark, tmp_path):
    (tmp_path / "w.json").write_text(json.dumps([{"ID": 1, "name": "Казань"}, {"ID": 2, "name": "Тула"}], indent=1), encoding="utf-8")
    df = feeds.read_feed(spark, "warehouses", str(tmp_path / "w.json"), multiline=True)
    assert rows(feeds.lookup(df, "name", "Казань"), "ID") == [(1,)]


def test_several_chunks_and_formats(spark, tmp_path, land):
    stocks = land("stocks", [{"supplierArticle": "a", "quantity": 1}])
    stocks.write.parquet(str(tmp_path / "p1"))
    stocks.write.parquet(str(tmp_path / "p2"))
    assert feeds.read_feed(spark, "stocks", str(tmp_path / "p1"), str(tmp_path / "p2"), format="parquet").count() == 2


def test_unpinned_feed_needs_a_schema(spark, tmp_path):
    with pytest.raises(ValueError):
        feeds.read_feed(spark, "incomes", str(tmp_path))
    (tmp_path / "r.json").write_text('{"report": [{"nmId": 1, "status": "x"}, {"nmId": 2, "status": "y"}]}\n{"report": []}\n')
    schema = feeds.load_schema(feeds.pin_schema(spark, str(tmp_path / "r.json")))
    assert rows(feeds.read_goods_return(spark, schema, str(tmp_path / "r.json"))) == [(1, "x"), (2, "y")]


def test_decode_bodies(spark):
    raw = spark.createDataFrame([('{"supplierArticle":"a","quantity":2}',), ("broken",)], "payload string")
    assert rows(feeds.decode(raw, "stocks")) == [("a", 2), (None, None)]
    lists = spark.createDataFrame([('[{"supplierArticle":"a","quantity":2},{"supplierArticle":"b"}]',), ("[]",)], "payload string")
    assert rows(feeds.decode_array(lists, schemas.STOCKS)) == [("a", 2), ("b", None)]


def test_union_chunks_aligns_columns(spark):
    a = spark.createDataFrame([(1, "x")], "id int, name string")
    b = spark.createDataFrame([(2.5, 2)], "extra double, id int")
    assert rows(feeds.union_chunks(a, b)) == [(1, "x", None), (2, None, 2.5)]


def test_increments(land):
    df = land("orders", [{"srid": str(i), "lastChangeDate": d} for i, d in enumerate(
        ["2025-01-01T00:00:00", "2025-01-01T23:59:59", "2025-01-02T00:00:00", "2024-12-31T23:59:59"])])
    assert rows(feeds.changed_since(df, "2025-01-01T23:00:00"), "srid") == [("1",), ("2",)]
    assert rows(feeds.changed_on(df, "2025-01-01"), "srid") == [("0",), ("1",)]


def test_substring_match_spans_digits(spark):
    df = spark.createDataFrame([("9123",), (None,)], "user_id string")
    assert rows(feeds.any_contains(df, "user_id", "12")) == [(True,)]
    assert rows(feeds.any_contains(df, "user_id", "77")) == [(False,)]
    assert feeds.all_strings(spark.range(2)).dtypes == [("id", "string")]


def test_day_partitions_are_pruned(spark, tmp_path, land):
    orders = land("orders", [{"srid": str(i), "date": f"2025-01-{1 + i % 5:02d}T10:00:00"} for i in range(50)])
    out = str(tmp_path / "facts")
    sinks.write_by_day(orders, out)
    back = spark.read.parquet(out)
    one = periods.days(back, "date", "2025-01-03", "2025-01-03")
    assert one.count() == 10
    plan = one._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(date_day" in plan


def test_other_sinks(spark, tmp_path, land):
    stocks = land("stocks", [{"supplierArticle": "a", "quantity": 1}])
    for format in ("parquet", "csv", "json"):
        sinks.write_report(stocks, str(tmp_path / format), format)
        reader = spark.read.option("header", True).option("inferSchema", True) if format == "csv" else spark.read
        assert rows(reader.format(format).load(str(tmp_path / format)).select("supplierArticle", "quantity")) == [("a", 1)]
    nested = stocks.select(F.struct("*").alias("s"))
    sinks.write_json_lines(nested, "s", str(tmp_path / "text"))
    assert rows(spark.read.text(str(tmp_path / "text"))) == [('{"supplierArticle":"a","quantity":1}',)]
    registry = spark.createDataFrame([("u", "old", 1), ("u", "new", 2)], "user_id string, user_api string, seq bigint")
    sinks.write_registry(registry, str(tmp_path / "registry"))
    assert rows(spark.read.parquet(str(tmp_path / "registry"))) == [("u", "new", 2)]


def test_flags_as_numbers_or_booleans(land):
    sales = [{"supplierArticle": "a", "totalPrice": 10.0, "discountPercent": 0.0, "promoCodeDiscount": 0.0, "spp": 0.0, "IsStorno": v}
             for v in (0, False, 1, True, None)]
    from sellerlens.plans import articles

    table = land("sales", sales)
    assert dict(table.dtypes)["IsStorno"] == "int"
    assert articles.counted_sales(table).count() == 2


def test_rejects(spark):
    raw = spark.createDataFrame([('{"supplierArticle":"a","quantity":1}',), ("{broken",), ('{"quantity":"x"}',), ("",), (None,)], "payload string")
    assert sorted(r["payload"] for r in feeds.rejects(raw, "stocks").collect()) == ['{"quantity":"x"}', "{broken"]


def test_reports_prune_day_partitions(spark, tmp_path):
    from sellerlens.operators import periods
    from sellerlens.sources import sinks

    days = [f"2025-0{m}-{d:02d}" for m in (2, 3) for d in (1, 9, 20, 22)]
    facts = spark.createDataFrame([(d + "T10:00:00", i) for i, d in enumerate(days)], "date string, v int")
    sinks.write_by_day(facts, str(tmp_path / "facts"))
    stored = spark.read.parquet(str(tmp_path / "facts"))

    def plan(df):
        return df._jdf.queryExecution().executedPlan().toString()

    cases = [("orders", n, m) for n in ("today", "yesterday", "last_30", "this_week", "prev_week", "this_month", "prev_month")
             for m in ("reference", "calendar")] + [("sales", "prev_month", "reference"), ("series", "last_7", "reference")]
    for feed, name, mode in cases:
        pruned = periods.select_period(stored, name, as_of="2025-03-22", feed=feed, mode=mode)
        whole = periods.select_period(facts, name, as_of="2025-03-22", feed=feed, mode=mode)
        assert "PartitionFilters: [isnotnull(date_day" in plan(pruned) or "PartitionFilters: [(date_day" in plan(pruned), (feed, name, mode)
        assert sorted(r["v"] for r in pruned.collect()) == sorted(r["v"] for r in whole.collect()), (feed, name, mode)
