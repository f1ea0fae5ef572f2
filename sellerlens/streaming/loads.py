"""Resumed loads: landed pages and changes as streams whose checkpoint is the cursor."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from sellerlens.functions.dates import day_of
from sellerlens.sources import storage

LINES_PER_PART = 1_000_000   # settlement line ids that share a partition
DAY_KEY = ["srid", "date"]


def resumed(
    stream: DataFrame,
    path: str,
    checkpoint: str,
    keys: Sequence[str],
    sequence: str,
    part: str,
    after: Callable[[list, int], None] | None = None,
    poll: str | None = None,
) -> StreamingQuery:
    """Merge what has landed since the last run into the table at ``path``, see ``storage.merge``.

    Files seen are kept in the checkpoint, which is the cursor: a load that is started again goes on behind it.
    Every batch is staged under the checkpoint's own id, so that a batch replayed after a failure publishes the same
    rows, and a checkpoint begun anew reads all again without taking an old stage for its own. ``after`` is
    called with the touched partitions and the batch's number. Without ``poll`` the load ends when all is read.
    """

    def write(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        stages = f"{path.rstrip('/')}-staged/{storage.checkpoint_id(spark, checkpoint)}"
        touched = storage.merge(batch, path, f"{stages}/{number}", keys, sequence, part)
        if after is not None:
            after(touched, number)
        storage.remove(spark, f"{stages}/{number - 1}")

    writer = stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return writer.trigger(**({"processingTime": poll} if poll else {"availableNow": True})).start()


def settlement_pages(pages: DataFrame, key: str = "rrd_id") -> DataFrame:
    """Pages with the partition their lines belong to: a run of neighbouring ids, so that a new page touches the last ones."""
    return pages.withColumn("part", F.floor(F.col(key) / LINES_PER_PART).cast("bigint"))


def load_settlement(pages: DataFrame, path: str, checkpoint: str, sequence: str, **how) -> StreamingQuery:
    """Settlement lines from a stream of pages: each line once, in its version of the highest ``sequence``."""
    return resumed(settlement_pages(pages), path, checkpoint, ["rrd_id"], sequence, "part", **how)


GRAINS = ("day", "month")


def by_order_date(feed: DataFrame, grain: str = "day") -> DataFrame:
    """An order or sales feed with its partition, the day or month of its ``date``; a changed row keeps its date.

    Days are what periods prune by (``date_day``); months suit a feed with few rows a day.
    """
    if grain not in GRAINS:
        raise ValueError(f"grain {grain!r}: expected one of {GRAINS}")
    return feed.withColumn(f"date_{grain}", F.date_trunc(grain, day_of("date")).cast("date"))


def load_changes(
    feed: DataFrame, path: str, checkpoint: str, keys: Sequence[str] = DAY_KEY, grain: str = "day", **how
) -> StreamingQuery:
    """Orders or sales from a stream of rows new or changed: the latest ``lastChangeDate`` of each, by the date of the order.

    Days (or months) without changes are neither read nor written.
    """
    return resumed(by_order_date(feed, grain), path, checkpoint, keys, "lastChangeDate", f"date_{grain}", **how)
