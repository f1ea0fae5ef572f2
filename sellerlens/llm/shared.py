"""Small helpers the corpus operators share."""

from __future__ import annotations

import os
import uuid
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sellerlens.session import shared_dir


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def stored(df: DataFrame, what: str) -> DataFrame:
    """``df`` written once to the folder all executors share, and read back.

    This cuts the lineage without tying any data to one executor, and it gives the planner the true
    size of the table, which is what decides between a broadcast and a shuffle later on.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/sellerlens-{what}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def ship_code(spark: SparkSession) -> None:
    """Let Python workers on this machine's folders import the library from where it lies.

    On a cluster without a shared code folder, submit the package with ``--py-files`` as usual.
    """
    root = str(Path(__file__).resolve().parents[2])
    environment = spark.sparkContext.environment
    paths = [p for p in environment.get("PYTHONPATH", "").split(os.pathsep) if p]
    if root not in paths:
        environment["PYTHONPATH"] = os.pathsep.join([root, *paths])


BATCH_BYTES = 64 << 20


def by_batches(spark: SparkSession, rows: int = 1000) -> None:
    """Hand at most ``rows`` rows and about ``BATCH_BYTES`` at a time to Python, so that long texts fit in a worker's memory.

    Both are settings of the session, lowered where they are higher and left so: Spark reads them when the returned
    table is computed, not when it is made.
    """
    ship_code(spark)
    for key, most in (("maxRecordsPerBatch", rows), ("maxBytesPerBatch", BATCH_BYTES)):
        now = spark.conf.get(f"spark.sql.execution.arrow.{key}").removesuffix("b")
        if not now.isdigit() or not 0 < int(now) <= most:
            spark.conf.set(f"spark.sql.execution.arrow.{key}", str(most))


def parts_for(amount: float, each: float, least: int = 1) -> int:
    """Number of partitions for ``amount`` if one is to hold about ``each``."""
    return max(least, int(-(-amount // each)))


def total(df: DataFrame, expression) -> float:
    """One sum over all rows (0 over none)."""
    return df.agg(F.coalesce(F.sum(expression), F.lit(0)).alias("s")).first()["s"]


FIRST = 32


def in_id_order(docs: DataFrame, id_column: str, text_column: str, chars_each: int = 16_000_000) -> DataFrame:
    """``id, text`` in ascending id over partitions of about ``chars_each`` characters, sorted inside.

    Null ids come first, null texts become empty, and rows that repeat an id follow in order of text. Partitions
    are cut by id and the first ``FIRST`` characters of the text, so that rows of one id, null among them, share a partition
    only if they begin alike.
    """
    narrow = docs.select(
        F.col(id_column).cast("long").alias("id"), F.coalesce(F.col(text_column).cast("string"), F.lit("")).alias("text")
    )
    parts = parts_for(total(narrow, F.length("text")), chars_each)
    return narrow.repartitionByRange(parts, F.col("id"), F.substring("text", 1, FIRST)).sortWithinPartitions("id", "text")


def before_each_part(sizes: DataFrame, part: str = "part", size: str = "size") -> DataFrame:
    """``(part, base)``: the sum of the sizes of all parts before it. One row per partition comes in."""
    return sizes.select(part, (F.sum(size).over(Window.orderBy(part)) - F.col(size)).alias("base"))
