"""Warehouse remains: filters and free choice of grouping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sellerlens.operators import grouping

# Grouping flags of the report and the column each stands for.
GROUP_FLAGS = {
    "brand": "brand",
    "subject": "subjectName",
    "seller_article": "vendorCode",
    "product": "nmId",
    "barcode": "barcode",
    "size": "techSize",
}

# Fixed values of the volume filter: without dimensions, no filter, above three litres.
NO_VOLUME, ANY_VOLUME, LARGE = -1, 0, 3


def filtered(remains: DataFrame, volume: int = ANY_VOLUME) -> DataFrame:
    if volume == NO_VOLUME:
        return remains.where(F.col("volume").isNull())
    if volume == LARGE:
        return remains.where(F.col("volume") > 3)
    if volume != ANY_VOLUME:
        raise ValueError(f"volume {volume!r}: expected {NO_VOLUME}, {ANY_VOLUME} or {LARGE}")
    return remains


def grouped(remains: DataFrame, *flags: str) -> DataFrame:
    """Quantity per chosen mix of keys; without flags the grand total."""
    keys = [GROUP_FLAGS[f] for f in flags]
    return remains.groupBy(*keys).agg(F.coalesce(F.sum("quantity"), F.lit(0)).alias("quantity"))


def cube(remains: DataFrame, *flags: str) -> DataFrame:
    return grouping.all_mixes(remains, [GROUP_FLAGS[f] for f in flags], "quantity")
