"""Near-duplicate vectors by product quantisation.

Unit vectors stand in inverted lists by their nearest coarse centroid, as codes of their residual:
the nearest of ``CODES`` code words in each of ``PARTS`` subspaces, with the length of what the code
misses. Every vector is a query to its own list and to others by the border test. Of two linked vectors in
different lists each is nearer to the border between the lists than they differ along the line between the
centroids. The whole of their distance could lie along that line, and ``exact=True`` probes every list
that near. By itself a difference has no preferred direction: along one line it is its length divided by the root
of the effective dimension of the residuals, on average, and a list is probed when the border is nearer than
``DEVIATIONS`` times that. Of the links at the threshold that cross a border, one in 700 is
then missed if differences are normal; nearer pairs are missed more rarely still. Two vectors see each other's lists
across the same border, so that it is enough to ask the list with the smaller number.
In a list, distances come from tables of the query's distances to the code words; a link can't be
farther by the table than its largest distance plus what the code misses, so that this filter loses
nothing. What passes is compared by exact cosine in double precision. Centroids nearer to each other
than half the largest distance of a link are one, so that a dense group isn't split into many lists.

Centroids and code words are fitted for each length of vector on ``SAMPLE`` distinct vectors at most, the first by a
hash; all vectors are indexed. Equal vectors are one class with a number of members. Lists, and queries from
other lists, are dealt out in blocks, and a task returns per vector a number of links and one vector it is connected
with, never the pairs: a group of thousands of near copies costs comparisons, but no rows.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sellerlens.llm.components import components
from sellerlens.llm.minhash import forest
from sellerlens.llm.shared import by_batches, stored
from sellerlens.llm.vectors import k_means, matrix, nearest, squared, unit, usable

COSINE = 0.9
SAMPLE = 20_000
LIST_ROWS = 512      # vectors in a list, on average
LISTS = 4096         # most lists
PARTS, CODES = 8, 64
DEVIATIONS = 3       # how far beyond the border a linked vector is looked for
BLOCK = 2048         # members of a list, and queries, that are compared in one task


def reach(cosine: float) -> float:
    """Largest distance between unit vectors that are linked."""
    return float(np.sqrt(2 - 2 * cosine)) + 1e-6


@dataclass(frozen=True)
class Quantiser:
    centre: np.ndarray          # lists x dimensions
    words: list[np.ndarray]     # per subspace: code words x its dimensions
    cosine: float
    between: np.ndarray         # distances between centroids
    border: float               # distance from a border up to which its other side is probed

    @property
    def reach(self) -> float:
        return reach(self.cosine)

    def subspaces(self, x: np.ndarray) -> list[np.ndarray]:
        ends = np.cumsum([w.shape[1] for w in self.words])
        return np.split(x, ends[:-1], axis=1)

    def encode(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """List, codes, and length of the residual that the codes miss, of unit vectors."""
        own, _ = nearest(x, self.centre)
        parts = [nearest(r, w) for r, w in zip(self.subspaces(x - self.centre[own]), self.words, strict=True)]
        return own, np.stack([c for c, _ in parts], axis=1).astype(np.uint8), np.sqrt(sum(d for _, d in parts)) + 1e-6

    def probes(self, x: np.ndarray, own: np.ndarray) -> list[np.ndarray]:
        """Lists with a smaller number than the own one that may hold a link."""
        far = squared(x, self.centre)
        mine = far[np.arange(len(x)), own]
        border = (far - mine[:, None]) / np.maximum(2 * self.between[own], 1e-12)
        possible = (border <= self.border) & (np.arange(len(self.centre)) < own[:, None])
        return [np.flatnonzero(p) for p in possible]

    def table_distances(self, x: np.ndarray, list_id: int, codes: np.ndarray) -> np.ndarray:
        """Squared distances of the coded members of a list (rows) to queries, looked up."""
        out = np.zeros((len(codes), len(x)))
        for k, (part, w) in enumerate(zip(self.subspaces(x - self.centre[list_id]), self.words, strict=True)):
            out += squared(w, part)[codes[:, k]]
        return out


def _apart(centre: np.ndarray, distance: float) -> np.ndarray:
    """Centroids without those that are as near as ``distance`` to one before them that stays."""
    left, kept = np.arange(len(centre)), []
    while len(left):
        kept.append(left[0])
        left = left[1:][squared(centre[left[1:]], centre[left[:1]])[:, 0] > distance**2]
    return centre[kept]


def fit(sample: np.ndarray, n: int, cosine: float, exact: bool = False) -> Quantiser:
    lists = int(min(max(1, -(-n // LIST_ROWS)), LISTS, len(sample)))
    centre = _apart(k_means(sample, lists), float(np.sqrt(2 - 2 * cosine)) / 2)
    residual = sample - centre[nearest(sample, centre)[0]]
    parts = np.array_split(residual, min(PARTS, sample.shape[1]), axis=1)
    spread = residual.T @ residual
    dimension = max(1.0, float(np.trace(spread) ** 2 / max((spread * spread).sum(), 1e-300)))
    border = reach(cosine) * (1.0 if exact else min(1.0, DEVIATIONS / dimension**0.5))
    words = [k_means(p, min(CODES, len(p))) for p in parts]
    return Quantiser(centre, words, cosine, np.sqrt(squared(centre, centre)), border)


class Quantisers:
    """One quantiser per length of vector; lists are numbered through."""

    def __init__(self, models: dict[int, Quantiser]) -> None:
        self.models = models
        ends = np.cumsum([len(m.centre) for m in models.values()])
        self.base = dict(zip(models, [0, *ends[:-1].tolist()], strict=True))

    def of_list(self, number: int) -> tuple[Quantiser, int]:
        d = max((d for d in self.models if self.base[d] <= number), key=self.base.get)
        return self.models[d], number - self.base[d]


def _indexed(models: Quantisers, kind: str):
    def run(batches):
        for batch in batches:
            lengths = batch["v"].map(len)
            for d in sorted(lengths.unique()):
                rows, model, base = batch[lengths == d], models.models[d], models.base[d]
                v = matrix(rows["v"])
                x = unit(v)
                own, codes, missed = model.encode(x)
                yield pd.DataFrame({
                    "node": rows["node"].array, "members": rows["members"].array, "v": [r.tobytes() for r in v.astype(kind)], "list": own + base,
                    "codes": [c.tobytes() for c in codes], "missed": missed, "probes": [p + base for p in model.probes(x, own)],
                })

    return run


def _compared(models: Quantisers, kind: str):
    """Links between one block of a list's members and one block of queries: of the list itself, or of others."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        members, queries = rows[rows["member"]], rows[rows["query"]]
        if not len(members) or not len(queries):
            return pd.DataFrame({"node": [], "links": [], "root": []})
        model, list_id = models.of_list(int(members["probed"].iloc[0]))
        x, q = (unit(np.frombuffer(b"".join(r["v"]), kind).reshape(len(r), -1).astype(np.float64)) for r in (members, queries))
        codes = np.frombuffer(b"".join(members["codes"]), np.uint8).reshape(len(members), -1)
        close = model.table_distances(q, list_id, codes)
        close = close <= ((model.reach + members["missed"].to_numpy()) ** 2)[:, None]
        m, n = members["node"].to_numpy(), queries["node"].to_numpy()
        if rows["inside"].iloc[0] and rows["i"].iloc[0] == rows["j"].iloc[0]:
            close &= n[None, :] < m[:, None]
        i, j = np.nonzero(close)
        linked = np.zeros(close.shape, bool)
        for at in range(0, len(i), 100_000):
            a, b = i[at : at + 100_000], j[at : at + 100_000]
            linked[a, b] = (x[a] * q[b]).sum(axis=1) >= model.cosine
        nodes, place = np.unique(np.concatenate([m, n]), return_inverse=True)
        pm, pn = place[: len(m)], place[len(m) :]
        links = np.zeros(len(nodes), np.int64)
        np.add.at(links, pm, linked @ queries["members"].to_numpy())
        np.add.at(links, pn, members["members"].to_numpy() @ linked)
        some = np.flatnonzero(links)
        spot = np.full(len(nodes), -1)
        spot[some] = np.arange(len(some))
        a, b = np.nonzero(linked)
        square = np.zeros((len(some), len(some)), bool)
        square[spot[pm[a]], spot[pn[b]]] = square[spot[pn[b]], spot[pm[a]]] = True
        return pd.DataFrame({"node": nodes[some], "links": links[some], "root": nodes[some][forest(square)]})

    return run


def _dealt(index: DataFrame) -> DataFrame:
    """Rows by ``probed, inside, i, j``: blocks ``i`` of a list's members with blocks ``j`` of its queries.

    Inside a list both are blocks of its members, and a row is on both sides where they are the same.
    """
    columns = [F.col(c) for c in ("probed", "node", "members", "v", "codes", "missed")]
    members = index.withColumn("probed", F.col("list"))
    queries = index.withColumn("probed", F.explode("probes"))
    sizes = members.groupBy("probed").agg(F.ceil(F.count("*") / BLOCK).alias("blocks")).join(
        queries.groupBy("probed").agg(F.ceil(F.count("*") / BLOCK).alias("asked")), "probed", "left"
    )
    sizes = stored(sizes.select("probed", "blocks", F.coalesce("asked", F.lit(0)).alias("asked")), "list-sizes")
    upto = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))
    block = lambda n: F.pmod(F.xxhash64("node"), F.col(n))
    members, queries = members.join(sizes, "probed"), queries.join(sizes, "probed")
    inside = members.withColumn("own", block("blocks")).withColumn("other", upto("blocks")).select(
        *columns, F.lit(True).alias("inside"), F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"),
        (F.col("own") <= F.col("other")).alias("member"), (F.col("own") >= F.col("other")).alias("query"),
    )
    sides = F.lit(True).alias("member"), F.lit(False).alias("query")
    asked = members.where("asked > 0").withColumn("j", upto("asked")).select(*columns, F.lit(False).alias("inside"), block("blocks").alias("i"), "j", *sides)
    sides = F.lit(False).alias("member"), F.lit(True).alias("query")
    asking = queries.withColumn("i", upto("blocks")).select(*columns, F.lit(False).alias("inside"), "i", block("asked").alias("j"), *sides)
    return inside.unionByName(asked).unionByName(asking)


def near_vectors(
    table: DataFrame, id_column: str = "vec_id", vector_column: str = "embedding", cosine: float = COSINE, exact: bool = False
) -> DataFrame:
    """One row per row of ``table``: ``vec_id, n_links, component_id, kept``.

    Vectors that are null, all zero or hold null or non-finite components, and vectors without an id,
    are linked with nothing. Only vectors of one length are compared; every length has an index of its own, so that the
    driver fits as many as there are lengths. Different ids with equal vectors are linked with each other. A row that
    repeats an id and its vector is the same vector and no link; an id with several vectors has the links of the one that has
    most, and the smallest component. No rows give no rows. Other columns are not looked at. ``exact`` finds every link, at the
    cost of probing nearly all lists in many dimensions.
    """
    spark = table.sparkSession
    by_batches(spark, 2000)
    every = usable(table, id_column, vector_column)
    ids = table.select(F.col(id_column).cast("long").alias("vec_id"))
    rows = stored(every, "vectors")
    classes = rows.select("key", "id").distinct().groupBy("key").agg(F.min("id").alias("node"), F.count("*").alias("members"))
    classes = stored(classes, "classes")
    first = rows.join(classes, "key").where("id = node").dropDuplicates(["key"]).select("key", "node", "members", "v")
    first = stored(first, "distinct")

    lengths = {r["d"]: r["count"] for r in first.groupBy(F.size("v").alias("d")).count().orderBy("d").collect()}
    if not lengths:
        return ids.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.lit(True).alias("kept"))
    models = {}
    for d, n in lengths.items():
        sample = first.where(F.size("v") == d).orderBy(F.xxhash64("key"), "node").limit(SAMPLE)
        models[d] = fit(unit(matrix(sample.toPandas()["v"])), n, cosine, exact)
    model = Quantisers(models)
    # Vectors travel in the type they came in, and are normalised where they are compared.
    single = isinstance(getattr(table.schema[vector_column].dataType, "elementType", None), T.FloatType)
    kind = "<f4" if single else "<f8"
    kinds = "node long, members long, v binary, list int, codes binary, missed double, probes array<int>"
    index = stored(first.select("node", "members", "v").mapInPandas(_indexed(model, kind), kinds), "index")
    dealt = _dealt(index).groupBy("probed", "inside", "i", "j")
    found = stored(dealt.applyInPandas(_compared(model, kind), "node long, links long, root long"), "found")

    roots = components(found.select(F.col("node").alias("a"), F.col("root").alias("b")))
    links = found.groupBy("node").agg(F.sum("links").alias("links"))
    # Roots are smallest nodes, and a node is its class's smallest id.
    named = classes.join(links, "node", "left").join(roots, "node", "left").select(
        "key", (F.coalesce("links", F.lit(0)) + F.col("members") - 1).alias("n_links"), F.coalesce("root", "node").alias("component_id")
    )
    named = rows.select("id", "key").join(named, "key").select("id", "n_links", "component_id").groupBy("id").agg(
        F.max("n_links").alias("n_links"), F.min("component_id").alias("component_id")
    )
    out = ids.join(named, ids["vec_id"] == named["id"], "left").select(
        "vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component_id", "vec_id").alias("component_id")
    )
    return out.select("*", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)).alias("kept"))
