import os
import random

import pandas as pd
from pyspark.sql import functions as F

from sellerlens.plans import settlement
from sellerlens.sources import feeds, sinks
from tests.conftest import rows


def line(rrd, report, start, end, kind=1, operation=settlement.SALE, pay=10.0):
    return {"rrd_id": rrd, "realizationreport_id": report, "date_from": start, "date_to": end,
            "report_type": kind, "supplier_oper_name": operation, "ppvz_for_pay": pay}


W1, W2, W3 = ("2025-01-06", "2025-01-12"), ("2025-01-13", "2025-01-19"), ("2025-01-20", "2025-01-26")


def fixture():
    return [
        line(1, 11, *W1), line(2, 11, *W1), line(3, 12, *W1), line(4, 12, *W1),  # a tie
        line(5, 12, *W2), line(6, 13, *W2), line(7, 13, *W2),                    # 12 again, now the smaller
        line(8, 14, *W3),                                                        # alone
        line(9, 15, None, None), line(10, None, *W3), line(11, 14, None, "2025-02-01"),
    ]


def test_labels_and_index(land):
    lines = settlement.typed(land("settlement", fixture()))
    assert rows(settlement.labels(lines)) == [(11, "ru"), (12, "other"), (13, "ru"), (14, "ru")]
    assert rows(settlement.report_index(lines), "report_name") == [
        ("id_11_from_2025-01-06_to_2025-01-12_reg_ru",), ("id_12_from_2025-01-06_to_2025-01-19_reg_other",),
        ("id_13_from_2025-01-13_to_2025-01-19_reg_ru",), ("id_14_from_2025-01-20_to_2025-02-01_reg_ru",)]
    counts = rows(settlement.report_counts(lines).select("realizationreport_id", "n"))
    assert counts == [(11, 2), (12, 1), (12, 2), (13, 2), (14, 1)]


def test_labels_against_pandas(spark):
    random.seed(3)
    data = [(i, random.randint(1, 60), random.randint(0, 9)) for i in range(4000)]
    pdf = pd.DataFrame(data, columns=["rrd_id", "realizationreport_id", "w"])
    pdf["date_from"] = pd.Timestamp("2025-01-06") + pd.to_timedelta(pdf["w"] * 7, "D")
    pdf["date_to"] = pdf["date_from"] + pd.Timedelta(6, "D")
    want = {}
    for _, group in pdf.groupby(["date_from", "date_to"]):
        counts = group["realizationreport_id"].value_counts().sort_index()
        best = counts[counts == counts.max()].index.min()
        want.update({int(i): "ru" if i == best else "other" for i in counts.index})
    df = spark.createDataFrame(pdf).withColumns({c: F.col(c).cast("date") for c in ("date_from", "date_to")})
    assert dict(rows(settlement.labels(df))) == want


def test_one_ru_per_period(land):
    lines = settlement.typed(land("settlement", fixture()[:4] + fixture()[5:8]))
    labelled = settlement.labelled_lines(lines)
    ru = labelled.where("region = 'ru'").groupBy("date_from").agg(F.countDistinct("realizationreport_id"))
    assert {r[1] for r in ru.collect()} == {1}


def test_split_keeps_every_line(spark, land, tmp_path):
    lines = settlement.typed(land("settlement", fixture()))
    out = str(tmp_path / "split")
    sinks.write_split(lines, out)
    back = spark.read.parquet(out)
    assert rows(back.select("rrd_id")) == rows(settlement.labelled_lines(lines).select("rrd_id"))
    assert sorted(os.listdir(f"{out}/region=ru")) == [f"realizationreport_id={i}" for i in (11, 13, 14)]
    sinks.write_split(lines, out)
    assert spark.read.parquet(out).count() == settlement.labelled_lines(lines).count()


def test_net_and_tax(land):
    lines = land("settlement", [
        line(1, 1, *W1, pay=100.0), line(2, 1, *W1, pay=50.0, kind=2), line(3, 1, *W2, operation=settlement.RETURN, pay=30.0),
        line(4, 1, *W2, operation="Логистика", pay=7.0), line(5, 1, *W2, pay=None)])
    got = settlement.net_and_tax(lines).first().asDict()
    assert got == {"sales": 100.0, "returns": 30.0, "first_date": "2025-01-06", "net": 70.0, "tax": 4.2}
    assert settlement.net_and_tax(lines, tax_rate=0.5).first()["tax"] == 35.0
    assert rows(settlement.operation_total(lines, settlement.SALE, report_type=2)) == [(50.0,)]
    assert rows(settlement.operation_total(lines.where("false"), settlement.SALE)) == [(0.0,)]
    assert rows(settlement.first_date(lines)) == [("2025-01-06",)]


def test_paged_load(land):
    pages = land("settlement", [line(1, 1, *W1), line(2, 1, *W1)], [line(2, 1, *W1), line(3, 1, *W1)])
    assert rows(feeds.after_cursor(pages, 0), "rrd_id") == [(1,), (2,), (3,)]
    assert rows(feeds.after_cursor(pages, 2), "rrd_id") == [(3,)]
    assert rows(feeds.cursor_of(pages)) == [(3,)]
    assert rows(feeds.cursor_of(pages.where("false"))) == [(0,)]


def test_hot_report_is_split_over_files(spark, tmp_path):
    """A report holding most lines must not be written by a single task."""
    lines = spark.range(300000).select(
        F.col("id").alias("rrd_id"), F.when(F.col("id") % 3 == 0, F.col("id") % 5 + 1).otherwise(0).alias("realizationreport_id"),
        F.lit("2025-01-06").cast("date").alias("date_from"), F.lit("2025-01-12").cast("date").alias("date_to"),
        F.sha2(F.col("id").cast("string"), 256).alias("text"))
    lines.write.parquet(str(tmp_path / "lines"))
    lines = spark.read.parquet(str(tmp_path / "lines"))
    before = spark.conf.get("spark.sql.adaptive.advisoryPartitionSizeInBytes")
    spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", str(2 << 20))
    try:
        sinks.write_split(lines, str(tmp_path / "hot"))
    finally:
        spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", before)
    folder = tmp_path / "hot" / "region=ru" / "realizationreport_id=0"
    assert len(list(folder.glob("*.parquet"))) > 1
    assert spark.read.parquet(str(tmp_path / "hot")).count() == 300000


def test_latest_page_wins(spark):
    from sellerlens.plans import settlement

    lines = spark.createDataFrame([(1, 10.0, 1), (1, 12.0, 2), (2, 5.0, 1), (None, 3.0, 1), (None, 3.0, 1)], "rrd_id long, ppvz_for_pay double, landed int")
    assert sorted(r["ppvz_for_pay"] for r in settlement.landed(lines, "landed").collect()) == [3.0, 3.0, 5.0, 12.0]


def test_unknown_volume(spark):
    import pytest

    from sellerlens.plans import remains

    with pytest.raises(ValueError):
        remains.filtered(spark.createDataFrame([(1.0,)], "volume double"), 7)
