"""Money and ratio expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values of the margin estimate: share left after commission, after tax, after cost.
MARGIN_FACTORS = (0.72, 0.93, 0.6)
TAX_RATE = 0.06


def order_price() -> Column:
    return F.col("totalPrice") * (1 - F.col("discountPercent") / 100)


def sale_price() -> Column:
    """Sales carry two further discounts on top of the seller's own."""
    keep = [(100 - F.col(c)) / 100 for c in ("discountPercent", "promoCodeDiscount", "spp")]
    return F.col("totalPrice") * keep[0] * keep[1] * keep[2]


def ratio(top: Column | str, bottom: Column | str) -> Column:
    """NULL where the denominator is 0 or missing."""
    return F.try_divide(top, bottom)


def percent(top: Column | str, bottom: Column | str) -> Column:
    return ratio(top, bottom) * 100


def margin(amount: Column, factors=MARGIN_FACTORS) -> Column:
    for factor in factors:
        amount = amount * factor
    return amount
