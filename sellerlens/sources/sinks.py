"""Writing reports and split tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sellerlens.functions.dates import day_of
from sellerlens.operators import grouping, periods
from sellerlens.plans import settlement
from sellerlens.sources import storage


def write_report(report: DataFrame, path: str, format: str = "parquet", mode: str = "overwrite") -> None:
    """Full report table."""
    writer = report.write.mode(mode).format(format)
    if format == "csv":
        writer = writer.option("header", True)
    writer.save(path)


def write_index(lines: DataFrame, path: str, mode: str = "overwrite") -> DataFrame:
    """The report index of settlement lines, written and read back with its true size."""
    index = settlement.report_index(lines)
    index.write.mode(mode).parquet(path)
    return lines.sparkSession.read.schema(index.schema).parquet(path)


def write_split(lines: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Settlement lines, one folder per region and report, and the report index in ``<path>-index``.

    The index is written first and the labels are taken from it, see ``settlement.labelled_lines``.

    ``rebalance`` gathers each report into few files and, unlike a plain repartition by report,
    splits a report too big for one task over several.
    """
    index = write_index(lines, f"{path.rstrip('/')}-index", mode)
    (
        settlement.labelled_lines(lines, index)
        .hint("rebalance", "region", settlement.REPORT)
        .write.mode(mode)
        .partitionBy("region", settlement.REPORT)
        .parquet(path)
    )


def write_by_day(facts: DataFrame, path: str, column: str = "date", mode: str = "overwrite") -> None:
    """Landed facts partitioned by the day of ``column``, so that periods on that column read only their days.

    The partition column is called ``<column>_day``. Periods on another column of the table don't take it for theirs.
    """
    day = periods.day_column(column)
    (
        facts.withColumn(day, day_of(column))
        .hint("rebalance", day)
        .write.mode(mode)
        .partitionBy(day)
        .parquet(path)
    )


def write_registry(registry: DataFrame, path: str) -> None:
    """Latest entry per user. ``path`` must not be the table being read; ``upsert_registry`` adds to one."""
    grouping.last_per_key(registry, "user_id", "seq", ["user_api"]).write.mode("overwrite").parquet(path)


REGISTRY_PARTS = 64


def upsert_registry(entries: DataFrame, path: str, staged: str) -> None:
    """New entries into the registry at ``path`` in place: the last one per user stays, other users' are left alone.

    ``staged`` is a folder of this call's own, see ``storage.merge``.
    """
    part = F.pmod(F.xxhash64("user_id"), F.lit(REGISTRY_PARTS)).cast("int")
    storage.merge(entries.select("user_id", "user_api", "seq", part.alias("part")), path, staged, ["user_id"], "seq", "part")


def write_json_lines(df: DataFrame, column: str, path: str, mode: str = "overwrite") -> None:
    """One nested column as JSON text, one value per line."""
    df.select(F.to_json(F.col(column)).alias("value")).write.mode(mode).text(path)
