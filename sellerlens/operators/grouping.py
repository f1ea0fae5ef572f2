"""Aggregations.

Null rules follow the data-frame convention the reports were defined with: a null group key
forms no group, and a sum over nothing is 0. Every aggregate here is split into a partial step
before the shuffle, so a key that holds a third of the rows costs one row per task.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sellerlens.operators import ranking


def drop_null_keys(df: DataFrame, *keys: str) -> DataFrame:
    return df.where(reduce(lambda a, b: a & b, [F.col(k).isNotNull() for k in keys]))


def sums(df: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """Sums per key; a group of nulls only gives 0."""
    totals = [F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in columns]
    return drop_null_keys(df, *keys).groupBy(*keys).agg(*totals)


def count_and_sum(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Both in one pass. Rows whose value is null count for nothing, as does a null key."""
    return (
        drop_null_keys(df, *keys)
        .groupBy(*keys)
        .agg(F.count(value).alias("qty"), F.coalesce(F.sum(value), F.lit(0.0)).alias(value))
    )


def total(column: str) -> Column:
    return F.coalesce(F.sum(column), F.lit(0.0))


def rounded_total(column: str) -> Column:
    """Total to whole units, halves to even."""
    return F.bround(total(column), 0).cast("bigint")


def distinct_count(df: DataFrame, column: str, approximate: bool = False) -> DataFrame:
    """Distinct values, a null counting as one of them.

    ``approximate=True`` trades exactness (about 2 %) for a constant-size sketch per task.
    """
    distinct = F.approx_count_distinct(column, 0.02) if approximate else F.count_distinct(column)
    has_null = F.max(F.col(column).isNull().cast("int"))
    return df.agg((distinct + F.coalesce(has_null, F.lit(0))).cast("bigint").alias("n"))


def first_by_date(df: DataFrame, key: str, label: str, when: str, amounts: list[str]) -> DataFrame:
    """Sums per key, with the key's earliest non-null label (ties: the smaller label).

    A label is nearly fixed per key, so it joins the grouping in a first pass whose state is
    numbers only and therefore stays a hash aggregate; picking the label then works on a few
    rows per key.
    """
    fine = (
        drop_null_keys(df, key)
        .groupBy(key, label)
        .agg(*[F.sum(c).alias(c) for c in amounts], F.min(when).alias("__when"))
    )
    order = F.when(F.col(label).isNotNull(), F.struct("__when", label))
    return fine.groupBy(key).agg(
        *[F.coalesce(F.sum(c), F.lit(0.0)).alias(c) for c in amounts],
        F.min_by(label, order).alias(label),
    )


def last_per_key(df: DataFrame, key: str, order: str, values: list[str]) -> DataFrame:
    """The row of each key with the highest ``order``: the latest registration wins.

    On a tie the larger values win; a key without any ``order`` keeps a row too.
    """
    latest = [F.desc(order), *[F.desc(v) for v in values]]
    return ranking.keep_first(df.select(key, *values, order), [key], latest)


def all_mixes(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """``value`` summed for every mix of the keys, absent keys NULL and flagged by ``mix``.

    The finest grouping is formed first: only its rows, not the input's, are multiplied by the
    number of mixes.
    """
    fine = df.groupBy(*keys).agg(F.sum(value).alias(value))
    return fine.cube(*keys).agg(
        F.coalesce(F.sum(value), F.lit(0)).alias(value), F.grouping_id().cast("bigint").alias("mix")
    )
