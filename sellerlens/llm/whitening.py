"""Whitening of vectors by the eigenvectors of their covariance, with mixed-precision refinement.

Components become integers, ``floor(64 * c) + 1000000``. Two passes add up, per dimension and then per pair of
dimensions, the values less a whole number next to the mean; these sums are integers and exact, whatever the order of
tasks and retries. The driver receives ``d * (d + 1) / 2`` of them for vectors of ``d`` components, as many as
a covariance has, and solves the eigenvalue problem: eigenvectors in single precision, then Ogita and Aishima's iteration,
which corrects all vectors at once by four matrix products a step, carried out in extended precision. For eigenvalues
that stand close together the step can't tell directions apart; there it only makes the vectors span the
right space, and a sub-solve of the covariance restricted to that space, shifted by the cluster's middle so that its
differences show, finds the vectors inside it in the same way. A third pass projects the vectors and measures the
covariance of the result against the identity.
"""

from __future__ import annotations

from collections import defaultdict
from dataclasses import dataclass
from fractions import Fraction

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sellerlens.llm.shared import by_batches

SCALE, SHIFT = 64, 1_000_000
COMPONENTS = 32
FINE = np.longdouble
LARGEST = 2.0**62        # entries whose integer would not fit are taken as not finite
DIGIT = 32               # sums travel in digits of so many bits, far from overflow


# --- eigenvectors ---

def _runs(values: np.ndarray, near: float) -> np.ndarray:
    """Number of the cluster of each of the falling eigenvalues; neighbours nearer than ``near`` share one."""
    return np.concatenate([[0], np.cumsum(values[:-1] - values[1:] > near)])


def refined(a: np.ndarray, x: np.ndarray, cluster: np.ndarray, steps: int = 10) -> tuple[np.ndarray, np.ndarray]:
    """One Ogita-Aishima step after the other: ``(X'AX, X)`` with clusters' spaces, and X'X, right in extended precision.

    With R = I - X'X, S = X'AX and l_i = s_ii / (1 - r_ii), X becomes X + XE, where e_ij is
    (s_ij + l_j r_ij) / (l_j - l_i) across clusters and r_ij / 2 inside. The error of a step is about the square of the
    one before.
    """
    one, across = np.eye(len(a), dtype=FINE), cluster[:, None] != cluster[None, :]
    enough = 4 * float(np.finfo(FINE).eps) * np.sqrt(len(a))
    last = np.inf
    for _ in range(steps):
        r, s = one - x.T @ x, x.T @ (a @ x)
        values = np.diag(s) / (1 - np.diag(r))
        apart = np.where(across, values[None, :] - values[:, None], 1)
        e = np.where(across, (s + values[None, :] * r) / np.where(apart == 0, 1, apart), r / 2)
        x = x + x @ e
        error = float(np.abs(e).max())
        if error < enough or (error < 1e-9 and error >= last / 4):
            break
        last = error
    return x.T @ (a @ x), x


def eigen(a: np.ndarray, noise: float | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Falling eigenvalues and unit eigenvectors of a symmetric matrix given in extended precision.

    Single-precision eigenvectors tell eigenvalues apart that differ by a good deal more than their rounding.
    Clusters nearer than that are solved again inside their space: the matrix there, less the cluster's middle, is as
    large as the cluster is wide, so that its own single-precision vectors tell more apart. A cluster that takes up the
    whole matrix, and is no narrower for the shift, starts from double precision. Eigenvalues that agree to all
    digits (``noise``) are left with any vectors of their space.
    """
    n = len(a)
    middle = np.trace(a) / n if n else FINE(0)
    moved = a - middle * np.eye(n, dtype=FINE)
    if noise is None:
        noise = 4 * np.sqrt(n) * float(np.finfo(FINE).eps) * float(np.abs(a).max(initial=0))
    size = float(np.abs(moved).max(initial=0))
    if n < 2 or size <= noise:
        return np.full(n, middle), np.eye(n, dtype=FINE)
    moved = moved / FINE(size)
    for kind in (np.float32, np.float64):
        values, x = np.linalg.eigh(moved.astype(kind))
        values, x = values[::-1], x[:, ::-1].astype(FINE)
        cluster = _runs(values, 40 * float(np.finfo(kind).eps) * np.sqrt(n))
        if cluster[-1] > 0:
            break
    s, x = refined(moved, x, cluster)
    values = np.diag(s).copy()
    if cluster[-1] > 0:
        for c in range(cluster[-1] + 1):
            at = np.flatnonzero(cluster == c)
            if len(at) > 1:
                inner = s[np.ix_(at, at)]
                values[at], turn = eigen((inner + inner.T) / 2, noise / size)
                x[:, at] = x[:, at] @ turn
    order = np.argsort(-values, kind="stable")
    return middle + values[order] * FINE(size), x[:, order]


# --- sums over the table ---

@dataclass(frozen=True)
class Fit:
    """What is known of the vectors of one length: their number and integer sums, and the chosen directions."""

    n: int
    sums: list[int]
    directions: np.ndarray | None = None   # dimensions x components, divided by the root of the eigenvalue
    explained: np.ndarray | None = None

    @property
    def middle(self) -> np.ndarray:
        return np.array([s // self.n for s in self.sums], dtype=np.int64)

    @property
    def rest(self) -> list[int]:
        return [s % self.n for s in self.sums]


def integers(vectors) -> np.ndarray:
    return np.floor(SCALE * np.stack([np.asarray(v, np.float64) for v in vectors])).astype(np.int64) + SHIFT


def _by_length(batch: pd.DataFrame):
    sizes = batch["v"].map(len)
    for d in sorted(sizes.unique()):
        where = np.flatnonzero(sizes == d)
        yield int(d), where, integers(batch["v"].iloc[where])


def _digits(total: int):
    """``(place, digit)`` of a whole number in base 2**DIGIT, digits with its sign, so that sums by place can't overflow."""
    sign, total, place = (-1 if total < 0 else 1), abs(total), 0
    while total:
        yield place, sign * (total & ((1 << DIGIT) - 1))
        total, place = total >> DIGIT, place + 1


SUMS = "d int, i int, j int, place int, digit long"


def _as_rows(sums) -> pd.DataFrame:
    """Exact sums ``(d, i, j, value)`` as rows of ``SUMS``."""
    return pd.DataFrame([(d, i, j, *p) for d, i, j, v in sums for p in _digits(int(v))], columns=["d", "i", "j", "place", "digit"])


def _first_sums(batches):
    sums: dict[int, list[int]] = {}
    for batch in batches:
        for d, where, x in _by_length(batch):
            held = sums.setdefault(d, [0] * (d + 1))
            high, low = (x >> 20).sum(axis=0), (x & 0xFFFFF).sum(axis=0)
            sums[d] = [held[0] + len(where), *[h + (int(a) << 20) + int(b) for h, a, b in zip(held[1:], high, low, strict=True)]]
    yield _as_rows((d, i, 0, v) for d, held in sums.items() for i, v in enumerate(held))


def _exact_products(y: np.ndarray) -> np.ndarray:
    """Sum of y'y as Python integers: numbers under 2**20 are multiplied in double precision, a few thousand rows at a time."""
    if int(np.abs(y).max(initial=0)) < 1 << 20:
        found = np.zeros((y.shape[1], y.shape[1]), dtype=object)
        for at in range(0, len(y), 4096):
            part = y[at : at + 4096].astype(np.float64)
            found += (part.T @ part).astype(np.int64).astype(object)
        return found
    wide = y.astype(object)
    return wide.T @ wide


def _second_sums(fits: dict[int, Fit]):
    def run(batches):
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for d, _, x in _by_length(batch):
                found = _exact_products(x - fits[d].middle)
                sums[d] = sums[d] + found if d in sums else found
        yield _as_rows((d, i, j, m[i, j]) for d, m in sums.items() for i in range(d) for j in range(i, d))

    return run


def _collected(rows: DataFrame) -> dict[int, dict[tuple[int, int], int]]:
    """Exact sums by length of vector; as many as the lengths' covariances have entries."""
    found: dict[int, dict[tuple[int, int], int]] = {}
    for r in rows.groupBy("d", "i", "j", "place").agg(F.sum("digit").alias("digit")).collect():
        sums = found.setdefault(r["d"], defaultdict(int))
        sums[r["i"], r["j"]] += int(r["digit"]) << DIGIT * r["place"]
    return found


def _fine(value: Fraction) -> np.longdouble:
    """A fraction rounded to extended precision."""
    whole, rest = divmod(value.numerator, value.denominator)
    high = whole >> 60 << 60
    return FINE(float(high)) + FINE(whole - high) + FINE(rest) / FINE(value.denominator) if abs(whole) < 1 << 110 else FINE(float(value))


def covariance(fit: Fit, products: dict[tuple[int, int], int]) -> np.ndarray:
    d, n, rest = len(fit.sums), fit.n, fit.rest
    v = np.zeros((d, d), dtype=FINE)
    for i in range(d):
        for j in range(i, d):
            v[i, j] = v[j, i] = _fine(Fraction(n * products.get((i, j), 0) - rest[i] * rest[j], n * n))
    return v


def _whitened(fit: Fit, x: np.ndarray) -> np.ndarray:
    centred = (x - fit.middle).astype(np.float64) - np.array([float(Fraction(r, fit.n)) for r in fit.rest])
    return centred @ fit.directions


def _third_sums(fits: dict[int, Fit]):
    def run(batches):
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for d, where, x in _by_length(batch):
                w = _whitened(fits[d], x)
                found = np.vstack([w.T @ w, w.sum(axis=0)])
                sums[d] = sums[d] + found if d in sums else found
        rows = [(d, i, j, float(m[i, j])) for d, m in sums.items() for i in range(m.shape[0]) for j in range(m.shape[1])]
        yield pd.DataFrame(rows, columns=["d", "i", "j", "value"])

    return run


def _deviations(fit: Fit, x: np.ndarray) -> list[int | None]:
    """Sum over dimensions of (n x - S)^2, exact; null beyond 64 bits."""
    rest = np.array(fit.rest, dtype=object)
    y = x - fit.middle
    bound = (int(np.abs(y).max(initial=0)) + 1) * fit.n
    if bound * bound * max(len(fit.sums), 1) < 1 << 63:
        away = y * np.int64(fit.n) - rest.astype(np.int64)
        return (away * away).sum(axis=1).tolist()
    found = [sum(int(a) ** 2 for a in row) for row in y.astype(object) * fit.n - rest]
    return [v if v < 1 << 63 else None for v in found]


def _projected(fits: dict[int, Fit], errors: dict[int, float]):
    def run(batches):
        for batch in batches:
            for d, where, x in _by_length(batch):
                fit = fits[d]
                k = fit.directions.shape[1]
                yield pd.DataFrame({
                    "id": batch["id"].iloc[where].astype("Int64").repeat(k).array, "component": np.tile(np.arange(1, k + 1, dtype=np.int32), len(where)),
                    "n": np.int64(fit.n), "deviation": pd.array(_deviations(fit, x), dtype="Int64").repeat(k),
                    "whitened": _whitened(fit, x).ravel(), "explained": np.tile(fit.explained, len(where)), "identity_error": errors[d],
                })

    return run


def fitted(vectors: DataFrame, components: int = COMPONENTS) -> dict[int, Fit]:
    """Fit of the vectors (column ``v``) of every length; directions without variance are left out."""
    fits = {}
    for d, found in _collected(vectors.mapInPandas(_first_sums, SUMS)).items():
        fits[d] = Fit(found[0, 0], [found[i, 0] for i in range(1, d + 1)])
    if not fits:
        return {}
    products = _collected(vectors.mapInPandas(_second_sums(fits), SUMS))
    for d in list(fits):
        v = covariance(fits[d], products.get(d, {}))
        values, x = eigen(v)
        trace = np.trace(v)
        k = int((values[:components] > trace * d * 2.0**-52).sum())
        x = x[:, :k] / np.sqrt((x[:, :k] ** 2).sum(axis=0))
        directions = (x / np.sqrt(values[:k])).astype(np.float64)
        explained = (values[:k] / trace).astype(np.float64) if trace > 0 else np.zeros(0)
        fits[d] = Fit(fits[d].n, fits[d].sums, directions, explained)
    return fits


def identity_errors(vectors: DataFrame, fits: dict[int, Fit]) -> dict[int, float]:
    """Largest entry, by length of vector, of the measured covariance of the whitened vectors less the identity."""
    found = vectors.mapInPandas(_third_sums(fits), "d int, i int, j int, value double").groupBy("d", "i", "j").agg(F.sum("value").alias("value")).collect()
    sums = {d: np.zeros((f.directions.shape[1] + 1, f.directions.shape[1])) for d, f in fits.items()}
    for r in found:
        sums[r["d"]][r["i"], r["j"]] = r["value"]
    errors = {}
    for d, m in sums.items():
        mean = m[-1] / fits[d].n
        errors[d] = float(np.abs(m[:-1] / fits[d].n - np.outer(mean, mean) - np.eye(m.shape[1])).max(initial=0))
    return errors


def finite(table: DataFrame, id_column: str, vector_column: str) -> DataFrame:
    """``id, v`` of the vectors without null or non-finite entries and with at least one; zero vectors count."""
    v = F.col(f"`{vector_column}`").cast("array<double>")
    rows = table.select(F.col(f"`{id_column}`").cast("long").alias("id"), v.alias("v")).where("v IS NOT NULL AND size(v) > 0")
    return rows.where(F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x * SCALE) < F.lit(LARGEST))))


def whiten(table: DataFrame, id_column: str = "vec_id", vector_column: str = "embedding", components: int = COMPONENTS) -> DataFrame:
    """``vec_id, component, n, deviation, whitened, explained, identity_error`` of every usable row.

    Vectors that are null, empty or hold null or non-finite entries are left out, and so are entries of over 2**62 / 64,
    whose integers don't exist. Vectors of each length are whitened among themselves. Components without variance
    (all, if vectors are equal) are left out, so that such rows have fewer components or none. Null and repeated ids give rows like any other,
    and repeated rows count as often as they occur. A deviation beyond 64 bits is null. An empty table gives no rows.
    """
    by_batches(table.sparkSession, 2000)
    vectors = finite(table, id_column, vector_column)
    kinds = "id long, component int, n long, deviation long, whitened double, explained double, identity_error double"
    fits = fitted(vectors, components)
    if not fits:
        return table.sparkSession.createDataFrame([], kinds).withColumnRenamed("id", "vec_id")
    errors = identity_errors(vectors, fits)
    return vectors.mapInPandas(_projected(fits, errors), kinds).withColumnRenamed("id", "vec_id")
