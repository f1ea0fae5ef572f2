"""Text expressions of the slot alert."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The alert's column heads with their widths, and its texts.
SLOT_HEAD = (("Дата", 10), ("k", 1), ("Склад", 15), ("k дост", 6), ("₽ дост", 6))
SLOT_TITLE = "Найдены подходящие склады:"
NO_SLOTS = "Нет подходящих складов."

SEPARATOR = " | "


def slot_head() -> str:
    return SEPARATOR.join(name.ljust(width) for name, width in SLOT_HEAD)


def slot_rule() -> str:
    return "-" * len(slot_head())


def slot_line() -> Column:
    """One fixed-width line; longer values widen their cell, only the name is cut."""
    cells = [
        F.col("date"),
        F.col("coefficient"),
        F.substring(F.col("warehouseName"), 1, 15),
        F.col("deliveryCoef"),
        F.col("deliveryBaseLiter"),
    ]
    pattern = SEPARATOR.join(f"%-{width}s" for _, width in SLOT_HEAD)
    return F.format_string(pattern, *[c.cast("string") for c in cells])
