import datetime as dt

import pytest
from pyspark.sql import functions as F

from sellerlens.operators import backfill
from tests.conftest import rows


def loop(start, end, span, whole):
    """The windows as a request loop would step through them."""
    out = []
    while start < end or (whole and start == end):
        stop = min(start + dt.timedelta(days=span - 1), end)
        out.append((start, stop))
        start = stop + dt.timedelta(days=1)
    return out


@pytest.mark.parametrize("whole", [True, False])
def test_windows(spark, whole):
    start = dt.date(2025, 1, 1)
    days = [0, 1, 6, 7, 8, 31, 32, 33, 63, 64, 100]
    df = spark.createDataFrame([(start, start + dt.timedelta(days=n)) for n in days], "a date, b date")
    spans = (7, 8, 32)
    out = df.select("a", "b", *[backfill.windows(F.col("a"), F.col("b"), n, whole).alias(f"w{n}") for n in spans])
    for row in out.collect():
        for n in spans:
            got = [(w["date_from"], w["date_to"]) for w in row[f"w{n}"]]
            assert got == loop(row["a"], row["b"], n, whole)
            if whole:
                covered = [a + dt.timedelta(days=i) for a, b in got for i in range((b - a).days + 1)]
                assert covered == [start + dt.timedelta(days=i) for i in range((row["b"] - start).days + 1)]


def test_rows_and_gaps(spark):
    start, end = dt.date(2025, 1, 1), dt.date(2025, 1, 22)
    days = [(1, start + dt.timedelta(days=i)) for i in (0, 6, 7, 21, 30)] + [(2, end), (3, None)]
    facts = spark.createDataFrame(days, "advertId bigint, day date")
    assert rows(backfill.rows_per_window(facts, "day", start, end, 7)) == [
        (0, start, dt.date(2025, 1, 7), 2), (1, dt.date(2025, 1, 8), dt.date(2025, 1, 14), 1), (3, end, end, 2)]
    assert [r[0] for r in rows(backfill.rows_per_window(facts, "day", start, end, 7, whole=False))] == [0, 1]
    campaigns = spark.createDataFrame([(1,), (2,), (2,), (4,)], "advertId bigint")
    got = rows(backfill.missing_slices(campaigns, facts, "day", start, end, 7), "advertId", "window_id")
    assert got == [(1, 2), (2, 0), (2, 1), (2, 2), (4, 0), (4, 1), (4, 2), (4, 3)]
    assert backfill.covering_windows(facts.where("false"), "day", 7).count() == 0


def test_recent_start():
    assert backfill.recent_start("2025-01-01", "2025-03-22", 31) == dt.date(2025, 2, 19)
    assert backfill.recent_start("2025-03-20", "2025-03-22", 31) == dt.date(2025, 3, 20)
