"""Resumed loads, merged tables, streams with state, daily partials, sketches, opaque feeds, ranges of days."""

import datetime as dt
import json
import os
import random
import shutil
import time
from collections import Counter

import pytest
from pyspark.sql import functions as F

from sellerlens.operators import backfill, nested, periods, ranking
from sellerlens.plans import articles, daily, series
from sellerlens.sources import feeds, opaque, sinks, storage
from sellerlens.streaming import event_windows, loads, slot_alerts
from tests.conftest import rows
from tests.test_slots import slot


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


# --- merged tables ---------------------------------------------------------------------------

VERSIONS = "rrd_id long, landed int, amount double, part long"


def test_merge_keeps_the_latest_and_touches_only_its_partitions(spark, tmp_path):
    path, stage = str(tmp_path / "table"), lambda n: str(tmp_path / f"stage-{n}")
    frame = lambda data: spark.createDataFrame(data, VERSIONS)
    assert storage.merge(frame([(1, 1, 1.0, 0), (2, 1, 2.0, 0), (11, 1, 3.0, 1), (None, 1, 9.0, 0)]), path, stage(0), ["rrd_id"], "landed", "part") in ([0, 1], [1, 0])
    untouched = {f: os.path.getmtime(f) for f in (tmp_path / "table" / "part=1").iterdir()}
    second = frame([(1, 2, 10.0, 0), (2, 0, 20.0, 0), (3, 2, 30.0, 0), (None, 1, 9.0, 0)])
    want = [(1, 2, 10.0, 0), (2, 1, 2.0, 0), (3, 2, 30.0, 0), (11, 1, 3.0, 1), (None, 1, 9.0, 0)]
    for n in (1, 1, 2):  # a batch replayed from its stage, then merged anew
        assert storage.merge(second, path, stage(n), ["rrd_id"], "landed", "part") == [0]
        assert rows(storage.read(spark, path, second.schema)) == want
    assert {f: os.path.getmtime(f) for f in (tmp_path / "table" / "part=1").iterdir()} == untouched


def test_a_stage_publishes_what_a_failure_took(spark, tmp_path):
    path, stage = str(tmp_path / "table"), str(tmp_path / "stage")
    data = spark.createDataFrame([(1, 1, 1.0, 0), (11, 1, 3.0, 1)], VERSIONS)
    storage.merge(data, path, stage, ["rrd_id"], "landed", "part")
    shutil.rmtree(tmp_path / "table" / "part=0")  # the publication broke off between two partitions
    storage.merge(data, path, stage, ["rrd_id"], "landed", "part")
    assert rows(storage.read(spark, path, data.schema)) == rows(data)


def _page(folder, name, lines):
    (folder / name).write_text("\n".join(json.dumps(x) for x in lines))


def test_settlement_load_goes_on_behind_its_checkpoint(spark, tmp_path):
    landing = tmp_path / "landing"
    landing.mkdir()
    kinds = "rrd_id long, landed int, amount double"

    def load(checkpoint="ckpt"):
        touched = []
        stream = spark.readStream.schema(kinds).option("maxFilesPerTrigger", 1).json(str(landing))
        query = loads.load_settlement(stream, str(tmp_path / "table"), str(tmp_path / checkpoint), "landed", after=lambda t, n: touched.append((sorted(t), n)))
        assert query.awaitTermination(120)
        return touched, rows(spark.read.parquet(str(tmp_path / "table")).select("rrd_id", "amount"))

    _page(landing, "a.json", [{"rrd_id": k, "landed": 1, "amount": 1.0} for k in (1, 2, 2_500_000)])
    assert load() == ([([0, 2], 0)], [(1, 1.0), (2, 1.0), (2_500_000, 1.0)])
    assert load() == ([], [(1, 1.0), (2, 1.0), (2_500_000, 1.0)])  # nothing new
    _page(landing, "b.json", [{"rrd_id": 2, "landed": 2, "amount": 5.0}, {"rrd_id": 3, "landed": 2, "amount": 6.0}])
    after = [(1, 1.0), (2, 5.0), (3, 6.0), (2_500_000, 1.0)]
    assert load() == ([([0], 1)], after)
    touched, again = load("another")  # from the beginning, in any order of pages: the later version stays
    assert [n for _, n in touched] == [0, 1] and again == after
    assert feeds.cursor_of(spark.read.parquet(str(tmp_path / "table"))).first()["cursor"] == 2_500_000


def test_after_cursor_keeps_the_latest_version(spark):
    lines = spark.createDataFrame([(1, 1, 1.0), (2, 1, 5.0), (2, 2, 3.0), (3, 1, 1.0), (3, 1, 1.0)], "rrd_id long, landed int, amount double")
    assert rows(feeds.after_cursor(lines, 1, sequence="landed"), "rrd_id", "amount") == [(2, 3.0), (3, 1.0)]
    assert rows(feeds.after_cursor(lines, 1), "rrd_id", "amount") == [(2, 5.0), (3, 1.0)]  # without one, the largest row


def test_changes_merge_into_their_days(spark, tmp_path):
    landing, path = tmp_path / "landing", str(tmp_path / "orders")
    landing.mkdir()
    kinds = "srid string, date string, lastChangeDate string, totalPrice double"
    rng = random.Random(3)
    versions = []

    def land(number, changes):
        versions.extend(changes)
        _page(landing, f"{number}.json", [dict(zip(("srid", "date", "lastChangeDate", "totalPrice"), c)) for c in changes])
        touched = []
        stream = spark.readStream.schema(kinds).json(str(landing))
        assert loads.load_changes(stream, path, str(tmp_path / "ckpt"), after=lambda t, n: touched.extend(t)).awaitTermination(120)
        return touched

    base = [(f"s{k}", f"2025-01-{k % 9 + 1:02d}T10:00:00", f"2025-01-{k % 9 + 1:02d}T11:00:00", float(k)) for k in range(90)]
    land(0, base)
    late = [(s, d, f"2025-02-{rng.randint(1, 9):02d}T00:00:00", p + 100) for s, d, _, p in base if d[8:10] in ("03", "05")]
    assert sorted(str(t) for t in land(1, late)) == ["2025-01-03", "2025-01-05"]
    table = spark.read.parquet(path)
    rebuilt = {}
    for s, d, c, p in versions:
        rebuilt[s, d] = max(rebuilt.get((s, d), ("", 0.0)), (c, p))
    assert rows(table.select("srid", "date", "lastChangeDate", "totalPrice")) == sorted((*k, *v) for k, v in rebuilt.items())
    assert "PartitionFilters: [isnotnull(date_day" in plan(periods.days(table, "date", "2025-01-03", "2025-01-04"))


def test_day_partitions_belong_to_their_column(spark, tmp_path):
    orders = spark.createDataFrame(
        [("a", "2025-01-10T08:00:00", "2025-01-10T08:00:00"), ("b", "2025-01-10T09:00:00", "2025-01-14T09:00:00")], "srid string, date string, lastChangeDate string")
    sinks.write_by_day(orders, str(tmp_path / "changed"), "lastChangeDate")
    table = spark.read.parquet(str(tmp_path / "changed"))
    assert rows(periods.days(table, "date", "2025-01-10", "2025-01-10"), "srid") == [("a",), ("b",)]
    for pick, want in ((feeds.changed_on(table, "2025-01-14"), ["b"]), (feeds.changed_since(table, "2025-01-11"), ["b"]), (feeds.changed_since(table, "2025-01-10"), ["a", "b"])):
        assert [r[0] for r in rows(pick, "srid")] == want and "PartitionFilters: [isnotnull(lastChangeDate_day" in plan(pick)
    assert periods.select_period(table, "this_month", as_of="2025-01-20", feed="orders").count() == 2


def test_registry_upsert_in_place(spark, tmp_path):
    path, kinds = str(tmp_path / "registry"), "user_id string, user_api string, seq bigint"
    sinks.upsert_registry(spark.createDataFrame([(f"u{k}", "old", 1) for k in range(50)], kinds), path, str(tmp_path / "s0"))
    sinks.upsert_registry(spark.createDataFrame([("u3", "new", 2), ("u4", "older", 0), ("u99", "first", 1)], kinds), path, str(tmp_path / "s1"))
    got = {r["user_id"]: r["user_api"] for r in spark.read.parquet(path).collect()}
    assert len(got) == 51 and (got["u3"], got["u4"], got["u99"], got["u5"]) == ("new", "old", "first", "old")


# --- daily partials and sketches -------------------------------------------------------------

@pytest.fixture(scope="module")
def facts(spark):
    rng = random.Random(11)
    days = [f"2024-{m:02d}-{d:02d}" for m in (1, 2, 3, 12) for d in (1, 2, 15, 28, 29)]
    data = [(i, rng.choice(days) + "T10:00:00", rng.choice([1, 2]), float(rng.randint(1, 400)), float(rng.choice([0, 10, 25])), 5.0, 2.0, 0, "x") for i in range(400)]
    data += [(400, None, 1, 5.0, 0.0, 0.0, 0.0, 0, "x"), (401, "no date", 1, 5.0, 0.0, 0.0, 0.0, 0, "x"), (402, "2024-03-01T00:00:00", 1, None, 0.0, 0.0, 0.0, 0, "x")]
    return spark.createDataFrame(data, "srid long, date string, seller long, totalPrice double, discountPercent double, promoCodeDiscount double, spp double, IsStorno int, x string")


def _close(df):
    return rows(df.withColumn(articles.AMOUNT, F.round(articles.AMOUNT, 4)))


def test_series_from_daily_reads_no_facts(spark, facts, tmp_path):
    path = str(tmp_path / "daily")
    daily.refresh(path, str(tmp_path / "s0"), daily.partials(facts, facts), 0)
    table = spark.read.parquet(path)
    cases = [("all", {}), ("all", {"week_key": "iso"}), ("all", {"grain": "day"}), ("last_7", {}), ("last_90", {}), ("this_month", {}), ("months_3", {}), ("year_to_date", {}),
             ("range", {"start": "2024-01-02", "end": "2024-02-15"}), ("this_month", {"mode": "calendar"})]
    for period, how in cases:
        got = daily.series(table, period, "2024-03-02", **how)
        want = series.orders_vs_sales(facts, facts, period, "2024-03-02", **how)
        assert sorted(got.columns) == sorted(want.columns) and _close(got.select(*want.columns)) == _close(want), (period, how)
    scans = [line for line in plan(daily.series(table, "all", "2024-03-02")).splitlines() if "Scan" in line]
    assert scans and all(str(tmp_path) in line for line in scans)
    assert rows(series.series_totals(daily.series(table, "all", "2024-03-02"))) == rows(series.series_totals(series.orders_vs_sales(facts, facts, "all", "2024-03-02")))


def test_changed_days_alone_are_computed_again(spark, facts, tmp_path):
    path, landed = str(tmp_path / "daily"), str(tmp_path / "facts")
    daily.refresh(path, str(tmp_path / "s0"), daily.partials(facts, facts, by=["seller"]), 0, by=["seller"])
    changed = facts.withColumn("totalPrice", F.when(F.col("date") == "2024-02-15T10:00:00", F.col("totalPrice") + 1).otherwise(F.col("totalPrice")))
    sinks.write_by_day(changed, landed)
    only = daily.changed(spark.read.parquet(landed), [dt.date(2024, 2, 15)])
    assert "PartitionFilters: [isnotnull(date_day" in plan(only)
    daily.refresh(path, str(tmp_path / "s1"), daily.partials(only, only, by=["seller"]), 1, by=["seller"])
    got = daily.series(spark.read.parquet(path), "all", "2024-03-02", by=["seller"])
    want = series.orders_vs_sales(changed, changed, "all", "2024-03-02", by=["seller"])
    assert _close(got.select(*want.columns)) == _close(want)
    assert Counter(r["version"] for r in spark.read.parquet(path).collect())[1] == 4  # two series of two sellers


def test_merged_sketches_count_keys_of_several_days_once(spark):
    keys = spark.range(60_000).select((F.col("id") % 20_000).alias("srid"), F.expr("date_add(DATE '2024-01-01', cast(id % 7 as int))").alias("date"))
    sketches = daily.distinct_partials(keys)
    assert sketches.count() == 7
    n = daily.distinct_count(sketches).first()["n"]
    assert abs(n - 20_000) <= daily.distinct_error() * 20_000 and daily.distinct_error() < 0.04
    two = daily.distinct_count(sketches.where("date < DATE '2024-01-03'")).first()["n"]
    exact = keys.where("date < DATE '2024-01-03'").select("srid").distinct().count()
    assert abs(two - exact) <= daily.distinct_error() * exact
    with_null = keys.limit(10).unionByName(spark.sql("SELECT CAST(NULL AS BIGINT) AS srid, DATE '2024-01-01' AS date"))
    assert daily.distinct_count(daily.distinct_partials(with_null)).first()["n"] == 11
    assert daily.distinct_count(daily.distinct_partials(keys.limit(0))).first()["n"] == 0


def test_most_frequent_is_exact(spark, monkeypatch):
    skewed = spark.range(200_000).select(F.expr("CASE WHEN id % 3 = 0 THEN 7 ELSE cast(sqrt(id) as bigint) END").alias("k"))
    even = spark.range(50_000).select((F.col("id") % 5_000).alias("k"))
    few = spark.createDataFrame([(1,), (1,), (2,), (None,), (None,), (None,)], "k long")
    hot = spark.range(100_000).select(F.expr("CASE WHEN id % 100 < 60 THEN id % 5 ELSE id END").alias("k"))
    jobs = []
    full = ranking.top
    monkeypatch.setattr(ranking, "top", lambda df, *a: jobs.append(1) or full(df, *a))
    for df, k, tracked, passes in ((skewed, 50, 10_000, 2), (even, 50, 100, 2), (few, 3, 100, 2), (few.limit(0), 3, 100, 1), (hot, 5, 1_000, 1)):
        jobs.clear()
        got = [tuple(r) for r in ranking.most_frequent(df, "k", k, tracked).collect()]
        counts = Counter(r["k"] for r in df.collect() if r["k"] is not None)
        assert got == sorted(counts.items(), key=lambda x: (-x[1], x[0]))[:k]
        assert len(jobs) <= passes  # one pass where the sketch proves the answer
    keys, bound = ranking.sketched(hot, "k", 5, 1_000)
    exact = Counter(r["k"] for r in hot.collect())
    assert max((n for k, n in exact.items() if k not in keys), default=0) <= bound


# --- opaque feeds ----------------------------------------------------------------------------

def test_opaque_bodies_lose_no_field(spark, tmp_path):
    raw = spark.createDataFrame([
        ('{"id":1,"price":2.5,"tags":["a"]}',), ('[{"id":2,"price":"3"},{"id":3,"new":{"x":1}},null]',), ("{broken",), ("",), (None,), ('{"odd key":true,"id":null}',)], "payload string")
    held = opaque.rows(opaque.bodies(raw))
    held.write.parquet(str(tmp_path / "held"))
    held = spark.read.parquet(str(tmp_path / "held"))
    assert rows(opaque.columns(held, id="bigint", price="double")) == [(1, 2.5), (2, 3.0), (3, None), (None, None)]
    assert rows(opaque.columns(held, **{"odd key": "boolean"}).where("`odd key`")) == [(True,)]
    found = {(r["field"], r["type"]): r["n"] for r in opaque.fields(held).collect()}
    assert found == {("id", "BIGINT"): 3, ("id", "VOID"): 1, ("price", "DECIMAL"): 1, ("price", "STRING"): 1, ("tags", "ARRAY<STRING>"): 1,
                     ("new", "OBJECT<x: BIGINT>"): 1, ("odd key", "BOOLEAN"): 1}
    assert rows(opaque.broken(raw)) == [("{broken",)]
    wrapped = spark.createDataFrame([('{"report":[{"a":1},{"a":2}],"b":1}',), ('{"b":1}',), ('{"report":[]}',)], "payload string")
    assert rows(opaque.columns(opaque.rows(opaque.bodies(wrapped), "report"), a="int")) == [(1,), (2,)]
    assert "id" in opaque.schema(held).first()["schema"]


def test_drift(spark):
    kinds = "field string, type string, n long"
    before = spark.createDataFrame([("a", "BIGINT", 3), ("b", "STRING", 3), ("c", "STRING", 1)], kinds)
    now = spark.createDataFrame([("a", "STRING", 3), ("b", "STRING", 9), ("d", "BIGINT", 1)], kinds)
    assert rows(opaque.drift(before, now)) == [("a", "BIGINT", "dropped"), ("a", "STRING", "added"), ("c", "STRING", "gone"), ("d", "BIGINT", "new")]
    assert opaque.drift(now, now).count() == 0


# --- bids ------------------------------------------------------------------------------------

def _campaign(nms, bids):
    return {"advertId": 1, "autoParams": {"cpm": 9, "subject": {"id": 4, "name": "s"}, "nms": nms, "nmCPM": [{"nm": n, "cpm": c} for n, c in bids]}}


@pytest.mark.parametrize("few", [0, 10**9])
def test_bids_of_both_ways_agree(land, monkeypatch, few):
    monkeypatch.setattr(nested, "FEW", few - 1)
    rng = random.Random(2)
    cases = [([], []), ([1, 2], []), ([], [(1, 5)]), ([3, 1, 3, None], [(3, 5), (2, 6), (2, 8), (3, 7), (None, 1)])]
    cases += [([rng.randint(0, 30) for _ in range(rng.randint(0, 40))], [(rng.randint(0, 40), rng.randint(1, 9)) for _ in range(rng.randint(0, 40))]) for _ in range(12)]
    table = land("campaigns", [_campaign(*c) | {"advertId": i} for i, c in enumerate(cases)])
    got, extra = Counter(), Counter()
    for r in nested.campaign_rows(table).collect():
        got[r["advertId"], r["nms"], r["nmCPM"]] += 1
    for r in nested.extra_bids(table).collect():
        extra[r["advertId"], r["nm"], r["cpm"]] += 1
    want, beyond = Counter(), Counter()
    for i, (nms, bids) in enumerate(cases):
        last = {n: c for n, c in bids if n is not None}
        beyond.update((i, n, c) for n, c in bids if n is not None and n not in nms)
        out = [(i, n, last.get(n)) for n in nms] + [(i, n, c) for n, c in bids if n is not None and n not in nms]
        want.update(out or [(i, None, None)])
    assert got == want and extra == beyond


def test_bids_take_linear_time(spark, tmp_path):
    def seconds(n):
        ids = F.sequence(F.lit(0).cast("bigint"), F.lit(n - 1).cast("bigint"))
        auto = F.struct(F.lit(1).cast("bigint").alias("cpm"), F.struct(F.lit(1).cast("bigint").alias("id"), F.lit("s").alias("name")).alias("subject"),
                        F.concat(ids, ids).alias("nms"), F.transform(ids, lambda i: F.struct((i + n // 2).alias("nm"), i.alias("cpm"))).alias("nmCPM"))
        path = str(tmp_path / str(n))
        spark.range(1).select(F.col("id").alias("advertId"), auto.alias("autoParams")).write.parquet(path)
        table = spark.read.parquet(path)
        began = time.perf_counter()
        assert nested._with_bids(table).select(F.size("__listed"), F.size("__extra")).first() == (2 * n, n // 2)
        return time.perf_counter() - began

    seconds(1_000)
    assert seconds(160_000) < 8 * seconds(40_000) + 2  # quadratic would be 16 times


# --- streams ---------------------------------------------------------------------------------

def _snapshot(folder, number, minutes, objects):
    """Snapshot ``number`` lands so many minutes after the first."""
    staged = folder.parent / f"{number}.tmp"
    staged.write_text("\n".join(json.dumps(o, ensure_ascii=False) for o in objects), encoding="utf-8")
    landed = 1_700_000_000 + 60 * minutes
    os.utime(staged, (landed, landed))
    staged.replace(folder / f"{number:03d}.json")


def test_a_slot_alerts_once(spark, tmp_path):
    landing = tmp_path / "landing"
    landing.mkdir()

    def poll():
        stream = feeds.stream_feed(spark, "slots", str(landing), files_per_trigger=1, stamped="polled")
        query = slot_alerts.start(stream, str(tmp_path / "alerts"), str(tmp_path / "ckpt"), str(tmp_path / "metrics"), available_now=True, once="60 minutes", max_coefficient=20)
        assert query.awaitTermination(300)
        return slot_alerts.read_alerts(spark, str(tmp_path / "alerts")).count()

    for k in range(6):
        _snapshot(landing, k, 2 * k, [slot(3 + k), slot(30, warehouse=9)])  # the coefficient moves, the slot is the same
    assert poll() == 1
    for k in range(6, 10):
        _snapshot(landing, k, 2 * k, [slot(5), slot(5, warehouse=1)])
    assert poll() == 2  # over a restart: only the new warehouse
    _snapshot(landing, 10, 90, [slot(30)])   # time goes on without a match
    _snapshot(landing, 11, 91, [slot(5)])
    assert poll() == 2  # the watermark is at 30 minutes
    _snapshot(landing, 12, 130, [slot(30)])
    assert poll() == 2  # the state forgets the slot when this batch is done
    _snapshot(landing, 13, 135, [slot(5)])   # past the first sighting and the delay
    assert poll() == 3
    _snapshot(landing, 14, 3, [slot(5, warehouse=77)])  # older than the watermark
    assert poll() == 3


def test_renewed_checkpoint_keeps_all_alerts(spark, tmp_path):
    landing, alerts = tmp_path / "landing", str(tmp_path / "alerts")
    landing.mkdir()

    def poll():
        query = slot_alerts.start(feeds.stream_feed(spark, "slots", str(landing)), alerts, str(tmp_path / "ckpt"), str(tmp_path / "metrics"), available_now=True, max_coefficient=20)
        assert query.awaitTermination(120)
        return slot_alerts.read_alerts(spark, alerts)

    _snapshot(landing, 0, 0, [slot(3)])
    poll()
    _snapshot(landing, 1, 1, [slot(4)])
    assert poll().count() == 2
    shutil.rmtree(tmp_path / "ckpt")
    for f in landing.iterdir():
        f.unlink()
    _snapshot(landing, 2, 2, [slot(5)])
    assert rows(poll(), "coefficient") == [(3,), (4,), (5,)]
    figures = spark.read.option("basePath", str(tmp_path / "metrics")).parquet(str(tmp_path / "metrics") + "/run=*")
    assert rows(figures.select("polls", "matches", "lowest")) == [(0, 1, 3), (0, 1, 5)]  # one row per run, each from its own pass
    slot_alerts.compact(spark, alerts, str(tmp_path / "compact"))
    assert rows(spark.read.parquet(str(tmp_path / "compact")), "coefficient") == [(3,), (4,), (5,)]


EVENTS = "seller long, ts string, value double"


def test_windows_close_behind_the_watermark(spark, tmp_path):
    landing = tmp_path / "landing"
    landing.mkdir()

    def land(number, objects):
        _snapshot(landing, number, number, objects)
        stream = spark.readStream.schema(EVENTS).json(str(landing))
        made = event_windows.windowed(stream, "ts", "value", by=["seller"])
        query = event_windows.start(made, str(tmp_path / "series"), str(tmp_path / "ckpt"))
        assert query.awaitTermination(300)
        return event_windows.closed(spark, str(tmp_path / "series"), made.schema), event_windows.late_rows(query)

    event = lambda day, value, seller=1: {"seller": seller, "ts": f"2024-01-{day:02d}T12:00:00Z", "value": value}
    first = [event(d, float(d), d % 2) for d in range(1, 13)] + [{"seller": 1, "ts": None, "value": 5.0}]
    one, late = land(0, first)
    assert late == 0 and one.count() > 0
    second = [event(20, 1.0), event(1, 100.0)]
    two, late = land(1, second)
    assert late > 0  # the event of the first day finds all its windows closed
    kept = spark.createDataFrame([(e["seller"], e["ts"], e["value"]) for e in first + second[:1]], EVENTS)
    batch = event_windows.windowed(kept, "ts", "value", by=["seller"]).where("end_day <= DATE '2024-01-19'")
    assert rows(two) == rows(batch) and two.count() == two.select("seller", "first_day").distinct().count()


def test_times_without_a_zone_are_utc(spark):
    times = spark.sql("SELECT TIMESTAMP_NTZ'2024-01-05 23:30:00' AS ts, 2.0D AS value UNION ALL SELECT NULL, 1.0D")
    old = spark.conf.get("spark.sql.session.timeZone")
    try:
        for zone in ("UTC", "Asia/Vladivostok", "America/New_York"):
            spark.conf.set("spark.sql.session.timeZone", zone)
            got = rows(event_windows.windowed(times, "ts", "value", span="1 day", step="1 day").select(F.col("first_day").cast("string"), "qty"))
            assert got == [("2024-01-05", 1)], zone
    finally:
        spark.conf.set("spark.sql.session.timeZone", old)


# --- ranges ----------------------------------------------------------------------------------

def test_ranges_and_missing_windows_agree(spark):
    rng = random.Random(6)
    days = [dt.date(2024, 1, 1) + dt.timedelta(days=k) for k in range(60)]
    have = {(c, d) for c in range(6) for d in days if c != 4 and rng.random() < (0.3 if c % 2 else 0.9)} | {(5, d) for d in days}
    landed = spark.createDataFrame([(c, d.isoformat()) for c, d in have for _ in range(2)] + [(0, "not a day"), (99, "2024-01-05")], "advertId long, date_day string")
    campaigns = spark.createDataFrame([(c,) for c in range(6)] * 2, "advertId long")
    start, end = "2024-01-03", "2024-02-20"
    inside = [d for d in days if dt.date(2024, 1, 3) <= d <= dt.date(2024, 2, 20)]
    expand = lambda df: sorted((r["advertId"], r["date_from"] + dt.timedelta(days=k)) for r in df.collect() for k in range((r["date_to"] - r["date_from"]).days + 1))
    present = backfill.landed_ranges(landed, "date_day", start, end)
    assert [x for x in expand(present) if x[0] != 99] == sorted((c, d) for c, d in have if d in inside)
    assert rows(present.where("advertId = 5")) == [(5, dt.date(2024, 1, 3), dt.date(2024, 2, 20), 49)]
    missing = backfill.missing_ranges(campaigns, landed, "date_day", start, end)
    gone = sorted((c, d) for c in range(6) for d in inside if (c, d) not in have)
    assert expand(missing) == gone
    ends = {(r["advertId"], r["date_to"]) for r in missing.collect()}
    assert not any((r["advertId"], r["date_from"] - dt.timedelta(days=1)) in ends for r in missing.collect())  # none touch
    cut = backfill.missing_ranges(campaigns, landed, "date_day", start, end, span=7)
    assert expand(cut) == gone and max((r["date_to"] - r["date_from"]).days for r in cut.collect()) == 6
    slices = backfill.missing_slices(campaigns, landed, "date_day", start, end, 7).collect()
    whole = lambda c, a, b: all((c, a + dt.timedelta(days=k)) in set(gone) for k in range((b - a).days + 1))
    grid = [(c, inside[k], min(inside[k] + dt.timedelta(days=6), inside[-1])) for c in range(6) for k in range(0, len(inside), 7)]
    assert sorted((r["advertId"], r["date_from"], r["date_to"]) for r in slices) == [g for g in grid if whole(*g)]
