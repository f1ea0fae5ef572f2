"""Tables that grow by merging: the latest version of every key, only touched partitions written again."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sellerlens.operators import ranking


def _at(spark: SparkSession, path: str):
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark._jsc.hadoopConfiguration()), place


def exists(spark: SparkSession, path: str) -> bool:
    files, place = _at(spark, path)
    return files.exists(place)


def remove(spark: SparkSession, path: str) -> None:
    files, place = _at(spark, path)
    files.delete(place, True)


def checkpoint_id(spark: SparkSession, checkpoint: str) -> str:
    """The id Spark keeps inside a stream's checkpoint: the same over restarts, another one if the checkpoint is begun anew."""
    line = spark.read.schema("id string").json(f"{checkpoint.rstrip('/')}/metadata").first()
    return line["id"]


def latest(rows: DataFrame, keys: Sequence[str], sequence: str) -> DataFrame:
    """One row per key: the one with the highest ``sequence``, the larger whole row on a tie.

    Rows with a null in their key can't be told apart by it; of these, equal rows are one.
    """
    known = F.lit(True)
    for k in keys:
        known = known & F.col(k).isNotNull()
    others = [c for c in sorted(rows.columns) if c not in (*keys, sequence)]
    order = [F.desc_nulls_last(c) for c in (sequence, *others)]
    return ranking.keep_first(rows.where(known), list(keys), order).unionByName(rows.where(~known).distinct())


def merge(changes: DataFrame, path: str, staged: str, keys: Sequence[str], sequence: str, part: str) -> list:
    """Merge ``changes`` into the table at ``path``, partitioned by their column ``part``; gives the partitions touched.

    A key has to keep its partition. Only partitions that occur in the changes are read and written again. The merged
    rows are staged first and then published by replacing whole partitions: repeated after a failure, a
    complete stage is published again, and an incomplete one is made again from a table that wasn't touched. Merging the same
    changes twice leaves the same table.
    """
    spark = changes.sparkSession
    kinds = changes.schema
    if not exists(spark, f"{staged}/_SUCCESS"):
        merged = changes
        if exists(spark, path):
            touched = [r[0] for r in changes.select(part).distinct().collect()]
            wanted = F.col(part).isin([t for t in touched if t is not None])
            if None in touched:
                wanted = wanted | F.col(part).isNull()
            merged = read(spark, path, kinds).where(wanted).unionByName(changes)
        latest(merged, keys, sequence).write.mode("overwrite").parquet(staged)
    whole = spark.read.schema(kinds).parquet(staged)
    parts = [r[0] for r in whole.select(part).distinct().collect()]
    # Rebalancing gathers a partition into few files, and splits one too large for a task.
    publish = whole.hint("rebalance", part).write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
    publish.partitionBy(part).parquet(path)
    return parts


def read(spark: SparkSession, path: str, kinds) -> DataFrame:
    """A merged table with the columns in the order of ``kinds``; the partition column has the type given there."""
    return spark.read.schema(kinds).parquet(path).select(*[F.col(f"`{c}`") for c in kinds.fieldNames()])
