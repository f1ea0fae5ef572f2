"""Slot alerts: newly landed snapshots, searched and written as alert rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from sellerlens.functions import text
from sellerlens.plans import slots
from sellerlens.sources import storage

POLL = "12 seconds"
METRICS_EVERY = 25
SLOT_KEY = ["warehouseID", "boxTypeID", "date"]  # what makes two rows of two snapshots the same slot

METRICS = "polls bigint, matches bigint, warehouses bigint, lowest int, at timestamp"


def _write_batch(alerts: str, metrics: str | None, checkpoint: str):
    """Sink of one micro-batch.

    Each batch replaces its own partition, so a batch replayed after a failure leaves the same rows
    once. Partitions also carry the run, the id that Spark keeps inside the checkpoint: it is the same over
    restarts and another one if the checkpoint is begun anew, even at the same path, so that numbering batches anew never
    overwrites earlier alerts. A batch without a match writes no partition. The figures are observed
    while the alerts are written; the batch is computed once.
    """

    def write(found: DataFrame, batch: int) -> None:
        spark = found.sparkSession
        run = storage.checkpoint_id(spark, checkpoint)
        seen = Observation()
        watched = found.observe(
            seen, F.count(F.lit(1)).alias("matches"), F.approx_count_distinct("warehouseName").alias("warehouses"),
            F.min("coefficient").alias("lowest"),
        )
        (
            watched.withColumn("batch", F.lit(batch)).write.mode("overwrite")
            .option("partitionOverwriteMode", "dynamic").partitionBy("batch").parquet(f"{alerts}/run={run}")
        )
        if metrics and batch % METRICS_EVERY == 0:
            figures = seen.get
            row = spark.createDataFrame([(batch, figures["matches"], figures["warehouses"], figures["lowest"], None)], METRICS)
            row.withColumn("at", F.current_timestamp()).write.mode("overwrite").parquet(f"{metrics}/run={run}/batch={batch}")

    return write


def read_alerts(spark: SparkSession, alerts: str) -> DataFrame:
    """All alerts written so far, with the ``run`` and ``batch`` that wrote them; none is an empty table."""
    return spark.read.option("basePath", alerts).parquet(f"{alerts}/run=*")


def compact(spark: SparkSession, alerts: str, path: str) -> None:
    """All alerts once more at ``path``, in few files, by run; the table of a watch that goes on isn't touched."""
    read_alerts(spark, alerts).hint("rebalance", "run").write.mode("overwrite").partitionBy("run").parquet(path)


def start(
    snapshots: DataFrame,
    alerts: str,
    checkpoint: str,
    metrics: str | None = None,
    poll: str = POLL,
    available_now: bool = False,
    once: str | None = None,
    seen: str = "polled",
    **rule,
) -> StreamingQuery:
    """Watch a stream of slot snapshots; every snapshot with a match alerts again.

    Alerts carry their message line. An empty first batch makes the alerts readable before the first match.

    Without ``once`` the search is stateless. ``once``, a delay such as ``"6 hours"``, alerts a slot when it is first seen and
    then not again before the watermark of column ``seen`` (when the snapshot was taken, a timestamp), itself the delay
    behind the newest snapshot, has passed that time plus the delay. The state holds the slots of one delay and lives in the checkpoint, so that a
    restart repeats nothing; a snapshot that comes in later than the delay alerts nothing.
    """
    spark = snapshots.sparkSession
    if once is None:
        found = slots.slot_search(snapshots, **rule)
    else:
        # Both branches name the time, which holds the filter above the watermark: snapshots without a match move it too.
        never = F.col(seen) < F.lit("0001-01-01 00:00:00").cast("timestamp")
        wanted = F.when(slots.condition(**rule), F.col(seen).isNotNull()).otherwise(never)
        found = slots.shown(snapshots.withWatermark(seen, once).where(wanted).dropDuplicatesWithinWatermark(SLOT_KEY))
    found = found.withColumn("line", text.slot_line())
    empty = spark.createDataFrame([], found.schema)
    empty.write.mode("overwrite").parquet(f"{alerts}/run=none/batch=-1")
    writer = found.writeStream.foreachBatch(_write_batch(alerts, metrics, checkpoint)).option("checkpointLocation", checkpoint)
    trigger = {"availableNow": True} if available_now else {"processingTime": poll}
    return writer.trigger(**trigger).start()
