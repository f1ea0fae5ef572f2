"""Search phrase performance."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sellerlens.functions.pricing import percent
from sellerlens.operators import grouping


def _rated(lines: DataFrame, key: str) -> DataFrame:
    sums = grouping.sums(lines, [key], ["views", "clicks", "sum"])
    return sums.withColumn("ctr", percent("clicks", "views"))


def daily(lines: DataFrame) -> DataFrame:
    return _rated(lines, "date")


def by_keyword(lines: DataFrame) -> DataFrame:
    return _rated(lines, "keyword").orderBy(F.desc("views"), "keyword")


def top_keywords(lines: DataFrame, k: int = 30) -> DataFrame:
    return by_keyword(lines).limit(k)
