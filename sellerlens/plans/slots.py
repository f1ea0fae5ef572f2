"""Delivery-slot search, the same for a table and a stream of snapshots."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sellerlens.functions import text
from sellerlens.sources.feeds import in_or_all

# Columns of an alert, those of its message line.
SHOWN = ("date", "coefficient", "warehouseName", "deliveryCoef", "deliveryBaseLiter")


def condition(warehouse_ids=None, box_types=None, max_coefficient: int = 1000) -> Column:
    """Open slots (coefficient 0 and up) within the limits; an empty list is no limit."""
    limits = [in_or_all(F.col("warehouseID"), warehouse_ids), in_or_all(F.col("boxTypeID"), box_types)]
    return reduce(lambda a, b: a & b, [c for c in limits if c is not None], F.col("coefficient").between(0, max_coefficient))


def shown_date(slots: DataFrame) -> DataFrame:
    """The slot date as ``dd-MM-yyyy`` text."""
    if dict(slots.dtypes)["date"] == "string":
        day = F.to_timestamp_ntz(F.replace(F.col("date"), F.lit("Z"), F.lit("")))
    else:
        day = F.col("date")
    return slots.withColumn("date", F.date_format(day, "dd-MM-yyyy"))


def shown(found: DataFrame) -> DataFrame:
    return shown_date(found).select(*SHOWN)


def slot_search(slots: DataFrame, warehouse_ids=None, box_types=None, max_coefficient: int = 1000) -> DataFrame:
    return shown(slots.where(condition(warehouse_ids, box_types, max_coefficient)))


def slot_lines(found: DataFrame) -> DataFrame:
    """The alert's table lines, one per row."""
    return found.select(text.slot_line().alias("line"))


def slot_message(found: DataFrame) -> DataFrame:
    """Head, rule and lines as rows with a ``part`` to sort by; or the no-result text."""
    lines = slot_lines(found).select(F.lit(2).alias("part"), "line")
    any_found = found.limit(1).agg(F.count(F.lit(1)).alias("n"))
    frame = any_found.select(
        F.explode(
            F.when(
                F.col("n") > 0,
                F.array(
                    F.struct(F.lit(0).alias("part"), F.lit(text.slot_head()).alias("line")),
                    F.struct(F.lit(1).alias("part"), F.lit(text.slot_rule()).alias("line")),
                ),
            ).otherwise(F.array(F.struct(F.lit(0).alias("part"), F.lit(text.NO_SLOTS).alias("line"))))
        ).alias("f")
    ).select("f.part", "f.line")
    return frame.unionByName(lines)
