"""What the operators on vectors share: which vectors count, and classes of equal ones."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def usable(table: DataFrame, id_column: str, vector_column: str) -> DataFrame:
    """``id, v, key`` of vectors without null, infinite or NaN components, with an id and not all zero.

    Vectors compare only with vectors of their own length; ``key`` is 128 bits of the components.
    """
    v = F.col(vector_column).cast("array<double>")
    rows = table.select(F.col(id_column).cast("long").alias("id"), v.alias("v")).where("id is not null and v is not null")
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) <= F.lit(float(np.finfo(np.float64).max))))
    clean = rows.where(finite & F.exists("v", lambda x: x != 0))
    return clean.select("id", F.transform("v", lambda x: x + 0.0).alias("v")).select(
        "id", "v", F.struct(F.xxhash64("v").alias("x"), F.xxhash64(F.lit("vector"), "v").alias("y")).alias("key")
    )


def matrix(column) -> np.ndarray:
    return np.stack([np.asarray(v, dtype=np.float64) for v in column]) if len(column) else np.zeros((0, 0))


def unit(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(axis=1, keepdims=True)  # no overflow of squares
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def k_means(x: np.ndarray, k: int, steps: int = 12, seed: int = 7) -> np.ndarray:
    """Centroids of ``x``; an empty cluster moves to the row farthest from its own centroid."""
    rng = np.random.default_rng(seed)
    centre = x[rng.permutation(len(x))[:k]].copy()
    for _ in range(steps):
        own, far = nearest(x, centre)
        sums = np.zeros_like(centre)
        np.add.at(sums, own, x)
        n = np.bincount(own, minlength=len(centre))
        centre = np.where(n[:, None] > 0, sums / np.maximum(n, 1)[:, None], centre)
        empty = np.flatnonzero(n == 0)
        centre[empty] = x[np.argsort(-far, kind="stable")[: len(empty)]]
    return centre


def squared(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    return np.maximum((x * x).sum(1)[:, None] - 2 * x @ y.T + (y * y).sum(1)[None, :], 0)


def nearest(x: np.ndarray, centre: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    own, far = np.empty(len(x), int), np.empty(len(x))
    for at in range(0, len(x), 4096):
        d = squared(x[at : at + 4096], centre)
        own[at : at + 4096] = d.argmin(axis=1)
        far[at : at + 4096] = d.min(axis=1)
    return own, far
