import json
import os

from sellerlens.functions import text
from sellerlens.plans import slots
from sellerlens.sources import feeds
from sellerlens.streaming import slot_alerts
from tests.conftest import rows


def slot(coefficient, warehouse=507, box=2, name="Коледино", date="2025-05-01T00:00:00Z", **more):
    return {"date": date, "coefficient": coefficient, "warehouseID": warehouse, "warehouseName": name, "boxTypeID": box,
            "boxTypeName": "Короба", "allowUnload": True, "isSortingCenter": False, "deliveryCoef": "160",
            "deliveryBaseLiter": "48", "deliveryAdditionalLiter": "11", "storageCoef": "1", "storageBaseLiter": "2",
            "storageAdditionalLiter": "3", **more}


SNAPSHOT = [slot(-1), slot(0), slot(20), slot(21), slot(5, warehouse=1), slot(5, box=5)]


def test_limits(land):
    table = land("slots", SNAPSHOT)
    rule = dict(warehouse_ids=[507], box_types=[2], max_coefficient=20)
    found = slots.slot_search(table, **rule)
    assert found.columns == ["date", "coefficient", "warehouseName", "deliveryCoef", "deliveryBaseLiter"]
    assert rows(found, "date", "coefficient") == [("01-05-2025", 0), ("01-05-2025", 20)]
    for nothing in ([], None):
        assert slots.slot_search(table, nothing, nothing).count() == 5


def test_message(land):
    table = land("slots", [slot(0, name="Очень длинное имя склада"), slot(1000)])
    got = [r["line"] for r in slots.slot_message(slots.slot_search(table, max_coefficient=20)).orderBy("part", "line").collect()]
    assert got == [
        "Дата       | k | Склад           | k дост | ₽ дост",
        "--------------------------------------------------",
        "01-05-2025 | 0 | Очень длинное и | 160    | 48    ",
    ]
    none = slots.slot_message(slots.slot_search(table.where("coefficient < 0")))
    assert [r["line"] for r in none.collect()] == [text.NO_SLOTS]


def _drop(folder, name, objects):
    staged = folder.parent / f"{name}.tmp"
    staged.write_text("\n".join(json.dumps(o, ensure_ascii=False) for o in objects), encoding="utf-8")
    landed = 1_700_000_000 + int(name[1:])  # files land in order of their number
    os.utime(staged, (landed, landed))
    staged.replace(folder / f"{name}.json")


def test_stream_equals_batch_and_repeats_nothing(spark, tmp_path):
    landing = tmp_path / "landing"
    landing.mkdir()
    rule = dict(warehouse_ids=[507], box_types=[2], max_coefficient=20)

    def poll():
        stream = feeds.stream_feed(spark, "slots", str(landing), files_per_trigger=1)
        query = slot_alerts.start(
            stream, str(tmp_path / "alerts"), str(tmp_path / "ckpt"), str(tmp_path / "metrics"), available_now=True, **rule)
        query.awaitTermination()
        return slot_alerts.read_alerts(spark, str(tmp_path / "alerts"))

    _drop(landing, "s1", SNAPSHOT)
    _drop(landing, "s2", [slot(-1)])
    _drop(landing, "s3", [slot(3)])
    columns = ["date", "coefficient", "warehouseName", "deliveryCoef", "deliveryBaseLiter"]
    batch = slots.slot_search(feeds.read_feed(spark, "slots", str(landing)), **rule)
    assert rows(poll(), *columns) == rows(batch, *columns)
    assert poll().count() == 3
    _drop(landing, "s4", [slot(3)])
    again = poll()
    # The same slot alerts again with the next snapshot; a snapshot without a match leaves nothing.
    assert again.count() == 4 and again.select("batch").distinct().count() == 3
    assert rows(spark.read.parquet(str(tmp_path / "metrics")), "polls", "matches") == [(0, 2)]


def test_second_checkpoint_keeps_earlier_alerts(spark, tmp_path):
    landing = tmp_path / "landing"
    landing.mkdir()
    alerts = str(tmp_path / "alerts")

    def poll(checkpoint):
        stream = feeds.stream_feed(spark, "slots", str(landing))
        slot_alerts.start(stream, alerts, str(tmp_path / checkpoint), available_now=True, max_coefficient=20).awaitTermination()
        return slot_alerts.read_alerts(spark, alerts)

    _drop(landing, "s0", [slot(30)])
    none = poll("one")
    assert none.count() == 0 and "line" in none.columns
    _drop(landing, "s1", [slot(3), slot(4)])
    assert poll("one").count() == 2
    assert poll("two").count() == 4  # a new checkpoint reads all again and overwrites nothing
    assert poll("two").where("coefficient = 3").select("line").distinct().count() == 1
