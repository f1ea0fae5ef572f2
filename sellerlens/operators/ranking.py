"""Sorting, top-k and keep-first.

``orderBy`` followed by ``limit`` runs as a per-task top-k and a merge of k rows per task. A
unique last sort column keeps the result the same from run to run.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SHOWN = 50


def top(df: DataFrame, by: str, tie: str, k: int = SHOWN) -> DataFrame:
    return df.orderBy(F.desc_nulls_first(by), F.asc(tie)).limit(k)


def top_per(df: DataFrame, keys: Sequence[str], by: str, tie: str, k: int = SHOWN) -> DataFrame:
    """``top`` within every group. Each task keeps k rows per group before the shuffle."""
    window = Window.partitionBy(*keys).orderBy(F.desc_nulls_first(by), F.asc(tie))
    return df.withColumn("__rn", F.row_number().over(window)).where(F.col("__rn") <= k).drop("__rn")


def bottom(df: DataFrame, by: str, tie: str, k: int = SHOWN) -> DataFrame:
    return df.orderBy(F.asc_nulls_first(by), F.asc(tie)).limit(k)


def last_rows(df: DataFrame, by: str, n: int = 5) -> DataFrame:
    return df.orderBy(F.desc(by)).limit(n)


def keep_first(df: DataFrame, keys: list[str], order: list[str | Column]) -> DataFrame:
    """One row per key: the first in ``order``. Null keys equal each other.

    With the filter on the row number directly above, each task drops all but its own first row
    per key before the shuffle, so copies of a hot key do not travel.
    """
    window = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("__rn", F.row_number().over(window)).where("__rn = 1").drop("__rn")


# --- heavy hitters ---------------------------------------------------------------------------

TRACKED = 10_000  # values a frequency sketch follows at most


def _map_size(tracked: int) -> int:
    """Entries of the sketch's map: a power of two with a quarter to spare."""
    size = 1
    while size * 0.75 < tracked:
        size *= 2
    return size


def sketched(df: DataFrame, key: str, k: int, tracked: int = TRACKED) -> tuple[list, float]:
    """Keys that may be among the ``k`` most frequent, and a count that no other key exceeds.

    A frequency sketch of ``tracked`` values is merged over all tasks; what it misses of any key is at most 3.5 / size
    of all rows. A key that isn't proposed has fewer rows than the last proposed one may have, or too few to be reported.
    """
    wanted = min(4 * k, tracked)
    found = df.where(F.col(key).isNotNull()).agg(
        F.expr(f"approx_top_k(`{key}`, {wanted}, {tracked})").alias("top"), F.count(F.lit(1)).alias("rows")
    ).first()
    missed = 3.5 / _map_size(tracked) * found["rows"]
    keys = [(r["item"], r["count"]) for r in found["top"] or []]
    least = keys[-1][1] + missed if len(keys) == wanted else 0.0
    return [v for v, _ in keys], max(least, 2 * missed)


def most_frequent(df: DataFrame, key: str, k: int = SHOWN, tracked: int = TRACKED) -> DataFrame:
    """``key, n``: the ``k`` keys with most rows, the smaller key first on a tie. Exact.

    A sketch proposes keys, and only their rows are counted; nothing is shuffled but those counts. If the
    ``k``-th count is above what any other key can have, these are the ones. Otherwise (counts too even, or
    fewer keys than ``k``) all keys are counted.
    """
    keys, bound = sketched(df, key, k, tracked)
    if keys:
        counted = df.where(F.col(key).isin(keys)).groupBy(key).agg(F.count(F.lit(1)).alias("n"))
        best = top(counted, "n", key, k).collect()
        if len(best) == k and best[-1]["n"] > bound:
            return df.sparkSession.createDataFrame(best, counted.schema)
    every = df.where(F.col(key).isNotNull()).groupBy(key).agg(F.count(F.lit(1)).alias("n"))
    return top(every, "n", key, k)
