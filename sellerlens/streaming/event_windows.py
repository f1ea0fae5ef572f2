"""Series over event time as a stream: windows close behind a watermark and are written once."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

WEEK, STEP, LATE = "7 days", "1 day", "1 day"


def event_time(rows: DataFrame, column: str) -> Column:
    """A time as the type watermarks take. Times without a zone are read as UTC, whatever the session's zone."""
    if rows.schema[column].dataType != T.TimestampNTZType():
        return F.col(column).cast("timestamp")
    parts = [f(column) for f in (F.year, F.month, F.dayofmonth, F.hour, F.minute)]
    seconds = F.extract(F.lit("SECONDS"), F.col(column))
    return F.make_timestamp(*parts, seconds, F.lit("UTC"))


def _utc_day(time: Column) -> Column:
    return F.to_utc_timestamp(time, F.current_timezone()).cast("date")


def windowed(
    rows: DataFrame, time: str, amount: str, span: str = WEEK, step: str = STEP, late: str = LATE, by: Sequence[str] = ()
) -> DataFrame:
    """``first_day, end_day, qty, amount`` per window of ``span`` that begins every ``step``; ``end_day`` is the day after its last.

    The same for a table and a stream. In a stream a window is given out once, when the newest event is ``late`` past
    its end; an event that is later than that for all its windows is left out and counted, see ``late_rows``. Every window
    is kept as one row of count and sum, combined before the shuffle, so that the state holds the open windows only. Windows
    lie on whole steps from 1970-01-01 UTC; rows without a time belong to none.
    """
    timed = rows.select(*by, event_time(rows, time).alias("at"), F.col(amount).alias("amount"))
    windows = timed.withWatermark("at", late).groupBy(*by, F.window("at", span, step).alias("w"))
    return windows.agg(F.count("amount").alias("qty"), F.coalesce(F.sum("amount"), F.lit(0.0)).alias("amount")).select(
        *by, _utc_day(F.col("w.start")).alias("first_day"), _utc_day(F.col("w.end")).alias("end_day"), "qty", "amount"
    )


def start(series: DataFrame, path: str, checkpoint: str, poll: str | None = None) -> StreamingQuery:
    """Closed windows as files at ``path``. Without ``poll`` the run ends when all is read; open windows stay in the checkpoint."""
    writer = series.writeStream.outputMode("append").format("parquet").option("path", path).option("checkpointLocation", checkpoint)
    return writer.trigger(**({"processingTime": poll} if poll else {"availableNow": True})).start()


def late_rows(query: StreamingQuery) -> int:
    """Rows that the runs reported by ``query`` left out since all their windows were closed.

    Counted after rows of a batch and window are combined, as the state store sees them.
    """
    return sum(int(s["numRowsDroppedByWatermark"]) for p in query.recentProgress for s in p["stateOperators"])


def closed(spark: SparkSession, path: str, kinds) -> DataFrame:
    """Windows written so far; none is an empty table."""
    return spark.read.schema(kinds).parquet(path)
