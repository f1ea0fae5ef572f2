"""Nearest neighbours with a navigable small-world graph per shard.

Vectors lie in lists by their nearest coarse centroid, and a list is dealt by a hash into shards of about ``SHARD_BYTES``;
equal vectors are one node that carries their smallest ids. A shard's graph has layers, each with about one in ``FANOUT`` of
the nodes below. In a layer, a node's links are chosen among its nearest nodes of the layer and its nearest ones of the
layer above: nearest first, leaving out those that are nearer to a chosen one, then filled up; links go
both ways, and the nearest stay where there are too many. The graphs are written as flat neighbour
arrays, one row per shard. In a shard, queries descend with a narrow beam and end with a
beam of ``BEAM`` nodes in the lowest layer, all queries of a block at once. Results of the shards are
merged per query.

A query visits the shards of its own list first. The distance of the last neighbour found there bounds how far a nearer one can
lie, and the query visits those other lists whose border is nearer than that neighbour probably is off along one line:
``DEVIATIONS`` times that distance, divided by the root of the effective dimension of the residuals. Vectors with
clusters, or of few effective dimensions, leave few lists to visit; among directions without any structure most lists stay in
reach, whatever their number. A query that finds too few neighbours in its list visits all.

Centroids are fitted for each length of vector on ``SAMPLE`` distinct vectors at most, the first by a hash, and are ``LISTS``
at most; all vectors are indexed.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sellerlens.llm.shared import by_batches, parts_for, stored, total
from sellerlens.llm.vectors import k_means, matrix, nearest, squared, usable

NEIGHBOURS = 10
SHARD_BYTES = 8 << 20   # components and links of a shard
LEAST = 64              # nodes in a shard, whatever their bytes
SAMPLE = 20_000
LISTS = 1024            # most lists of a length of vector
DEVIATIONS = 2          # how far beyond the border a nearer neighbour is looked for
PARTITIONS = 20_000     # most partitions in which shards are built; a partition may hold several
FANOUT = 16
NEAREST = 32       # candidates from the layer, for links
ABOVE = 8          # candidates from the layer above
LINKS = 16         # links that a node chooses
MOST_LINKS = 32    # links that a node has with those from others
BEAM = 128
NARROW = 8
QUERIES = 1024     # queries in a block


def _closest(x: np.ndarray, rows: np.ndarray, among: np.ndarray, k: int) -> np.ndarray:
    """For each of ``rows``, its ``k`` nearest of ``among`` but itself, nearest first; -1 where there are none."""
    k = min(k, len(among))
    out = np.full((len(rows), k), -1)
    for at in range(0, len(rows), 1024):
        some = rows[at : at + 1024]
        d = squared(x[some], x[among])
        d[some[:, None] == among[None, :]] = np.inf
        best = np.argpartition(d, k - 1, axis=1)[:, :k] if k < len(among) else np.tile(np.arange(k), (len(some), 1))
        value = np.take_along_axis(d, best, 1)
        order = np.argsort(value, axis=1, kind="stable")
        best, value = np.take_along_axis(best, order, 1), np.take_along_axis(value, order, 1)
        out[at : at + 1024] = np.where(np.isfinite(value), among[best], -1)
    return out


def _diverse(x: np.ndarray, rows: np.ndarray, pool: np.ndarray) -> np.ndarray:
    """``LINKS`` of each row's candidates: those not nearer to a chosen one than to the row, then the nearest left."""
    out = np.full((len(rows), LINKS), -1)
    for at in range(0, len(rows), 512):
        own, c = rows[at : at + 512], pool[at : at + 512]
        v = x[np.maximum(c, 0)]
        far = ((v - x[own][:, None]) ** 2).sum(-1)
        far[c < 0] = np.inf
        order = np.argsort(far, axis=1, kind="stable")
        c, far = np.take_along_axis(c, order, 1), np.take_along_axis(far, order, 1)
        v = np.take_along_axis(v, order[:, :, None], 1)
        square = (v * v).sum(-1)
        between = square[:, :, None] + square[:, None, :] - 2 * v @ v.transpose(0, 2, 1)
        chosen = np.zeros(c.shape, bool)
        for r in range(c.shape[1]):
            shadowed = (chosen & (between[:, r] < far[:, r : r + 1])).any(axis=1)
            again = ((c[:, :r] == c[:, r : r + 1])).any(axis=1)
            chosen[:, r] = ~shadowed & ~again & (c[:, r] >= 0) & (chosen.sum(axis=1) < LINKS)
        dup = np.zeros(c.shape, bool)
        for r in range(1, c.shape[1]):
            dup[:, r] = (c[:, :r] == c[:, r : r + 1]).any(axis=1)
        rank = np.argsort(np.where(chosen, 0, 1) + np.where((c < 0) | dup, 2, 0), axis=1, kind="stable")[:, :LINKS]
        picked = np.take_along_axis(np.where(dup, -1, c), rank, 1)
        out[at : at + 512, : picked.shape[1]] = picked
    return out


def _layer(x: np.ndarray, nodes: np.ndarray, above: np.ndarray) -> np.ndarray:
    """Neighbours of a layer's nodes, ``MOST_LINKS`` columns of node numbers, -1 for none."""
    pool = _closest(x, nodes, nodes, NEAREST)
    if len(above):
        pool = np.concatenate([pool, _closest(x, nodes, above, ABOVE)], axis=1)
    chosen = _diverse(x, nodes, pool)
    a, b = np.repeat(nodes, LINKS), chosen.reshape(-1)
    a, b = a[b >= 0], b[b >= 0]
    pairs = np.unique(np.concatenate([np.stack([a, b], 1), np.stack([b, a], 1)]), axis=0)
    far = np.concatenate([((x[p[:, 0]] - x[p[:, 1]]) ** 2).sum(1) for p in np.array_split(pairs, max(1, len(pairs) // 20_000))])
    pairs = pairs[np.lexsort((pairs[:, 1], far, pairs[:, 0]))]
    place = np.arange(len(pairs)) - np.searchsorted(pairs[:, 0], pairs[:, 0])
    keep = place < MOST_LINKS
    spot = np.full(len(x), -1)
    spot[nodes] = np.arange(len(nodes))
    out = np.full((len(nodes), MOST_LINKS), -1, np.int32)
    out[spot[pairs[keep, 0]], place[keep]] = pairs[keep, 1]
    return out


def build(x: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """Layers from the top: their nodes (ascending) and the nodes' neighbours."""
    order = np.random.default_rng(len(x)).permutation(len(x))
    sizes = [len(x)]
    while sizes[-1] > 2 * FANOUT:
        sizes.append(max(1, sizes[-1] // FANOUT))
    layers, above = [], np.zeros(0, int)
    for size in sizes[::-1]:
        nodes = np.sort(order[:size])
        layers.append((nodes, _layer(x, nodes, above)))
        above = nodes
    return layers


def beam_search(x: np.ndarray, nodes: np.ndarray, links: np.ndarray, queries: np.ndarray, start: np.ndarray, width: int) -> np.ndarray:
    """The ``width`` nodes of a layer found nearest to each query from its ``start`` nodes; -1 for none."""
    spot = np.full(len(x), -1)
    spot[nodes] = np.arange(len(nodes))
    n = len(queries)
    visited = np.zeros((n, len(nodes) + 1), bool)
    visited[:, -1] = True  # stands for "no node"
    beam = np.full((n, width), len(nodes))
    far = np.full((n, width), np.inf)
    open_ = np.zeros((n, width), bool)

    def take(rows: np.ndarray, new: np.ndarray) -> None:
        new = np.sort(new, axis=1)
        new[:, 1:][new[:, 1:] == new[:, :-1]] = len(nodes)
        new[visited[rows[:, None], new]] = len(nodes)
        visited[rows[:, None], new] = True
        real = new < len(nodes)
        d = np.full(new.shape, np.inf)
        r, c = np.nonzero(real)
        d[r, c] = ((x[nodes[new[r, c]]] - queries[rows[r]]) ** 2).sum(1)
        every, dist = np.concatenate([beam[rows], new], 1), np.concatenate([far[rows], d], 1)
        fresh = np.concatenate([open_[rows], real], 1)
        best = np.argsort(dist, axis=1, kind="stable")[:, :width]
        beam[rows], far[rows], open_[rows] = (np.take_along_axis(a, best, 1) for a in (every, dist, fresh))

    take(np.arange(n), np.where(start >= 0, spot[np.maximum(start, 0)], len(nodes)))
    while True:
        rows = np.flatnonzero(open_.any(axis=1))
        if not len(rows):
            return np.where(beam < len(nodes), nodes[np.minimum(beam, len(nodes) - 1)], -1)
        at = open_[rows].argmax(axis=1)  # beams are sorted: the nearest node that isn't expanded
        open_[rows, at] = False
        near = links[beam[rows, at]]
        take(rows, np.where(near >= 0, spot[np.maximum(near, 0)], len(nodes)))


def search(x: np.ndarray, layers: list, queries: np.ndarray, width: int = BEAM) -> np.ndarray:
    start = np.tile(layers[0][0][:1], (len(queries), 1))
    for nodes, links in layers[:-1]:
        start = beam_search(x, nodes, links, queries, start, NARROW)
    return beam_search(x, *layers[-1], queries, start, width)


def nodes_in_shard(d: int) -> int:
    return max(LEAST, SHARD_BYTES // (8 * d + 4 * MOST_LINKS + 24))


@dataclass(frozen=True)
class Router:
    """Centroids of one length of vector, and how differences spread around them."""

    centre: np.ndarray
    between: np.ndarray     # distances between centroids
    dimension: float        # effective dimension of the residuals

    def own(self, x: np.ndarray) -> np.ndarray:
        return nearest(x, self.centre)[0]

    def others(self, x: np.ndarray, own: np.ndarray, reach: np.ndarray) -> list[np.ndarray]:
        """Lists but the own one whose border is in reach; where distances overflow, or the reach is infinite, all."""
        far = squared(x, self.centre)
        border = (far - far[np.arange(len(x)), own][:, None]) / np.maximum(2 * self.between[own], 1e-300)
        seen = ~(border > (reach * min(1.0, DEVIATIONS / self.dimension**0.5))[:, None])
        seen[np.arange(len(x)), own] = False
        return [np.flatnonzero(s) for s in seen]


def fit(sample: np.ndarray, n: int) -> Router:
    """Lists for ``n`` vectors from a sample of them."""
    sample = sample[(np.abs(sample) < 1e100).all(axis=1)]
    if not len(sample):
        return Router(np.zeros((1, sample.shape[1])), np.zeros((1, 1)), 1.0)
    centre = k_means(sample, min(parts_for(n, nodes_in_shard(sample.shape[1])), LISTS, len(sample)))
    residual = sample - centre[nearest(sample, centre)[0]]
    residual = residual / max(np.abs(residual).max(), 1e-300)
    spread = residual.T @ residual
    dimension = max(1.0, float(np.trace(spread) ** 2 / max((spread * spread).sum(), 1e-300)))
    return Router(centre, np.sqrt(squared(centre, centre)), dimension)


def _by_length(rows: pd.DataFrame):
    for d, some in rows.groupby("d", sort=True):
        yield some, int(d), matrix(some["v"])


def _placed(routers: dict[int, Router]):
    """Rows with their list. A length that no vector of the table has is in none."""

    def run(batches):
        for batch in batches:
            for some, d, x in _by_length(batch):
                if d in routers:
                    yield some.assign(list=routers[d].own(x))

    return run


def _elsewhere(routers: dict[int, Router]):
    """A row for each other list that a query has to visit."""

    def run(batches):
        for batch in batches:
            for some, d, x in _by_length(batch):
                lists = routers[d].others(x, some["list"].to_numpy(), some["reach"].to_numpy(dtype=float))
                times = [len(s) for s in lists]
                again = some.drop(columns="reach").iloc[np.repeat(np.arange(len(some)), times)]
                yield again.assign(list=np.concatenate(lists))

    return run


GRAPH = "list int, shard int, d int, vectors binary, owners binary, ids binary, layers array<int>, nodes binary, links binary"


def _indexed(rows: pd.DataFrame) -> pd.DataFrame:
    """A shard as one row of flat little-endian arrays.

    ``vectors`` (doubles) has the nodes' components; ``ids`` (longs) belong to the nodes ``owners`` (ints).
    ``layers`` are the layers' sizes from the top, ``nodes`` (ints) the nodes of one layer after the
    other, and ``links`` (ints) the ``MOST_LINKS`` neighbours of each of these.
    """
    rows = rows.sort_values("least", ignore_index=True)
    x = matrix(rows["v"])
    layers = build(x)
    flat = {
        "vectors": x.astype("<f8"), "owners": np.repeat(np.arange(len(x)), rows["ids"].map(len)).astype("<i4"),
        "ids": np.concatenate(list(rows["ids"])).astype("<i8"),
        "nodes": np.concatenate([n for n, _ in layers]).astype("<i4"), "links": np.concatenate([k for _, k in layers]).astype("<i4"),
    }
    return pd.DataFrame({
        **{name: [rows[name].iloc[0]] for name in ("list", "shard", "d")}, "layers": [[len(n) for n, _ in layers]],
        **{name: [values.tobytes()] for name, values in flat.items()},
    })


def _graph(row) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[tuple[np.ndarray, np.ndarray]]]:
    """Vectors, where each node's ids begin and end, ids, and layers, of a shard's row."""
    x = np.frombuffer(row.vectors, "<f8").reshape(-1, row.d)
    spans = np.searchsorted(np.frombuffer(row.owners, "<i4"), np.arange(len(x) + 1))
    ends = np.cumsum(row.layers)[:-1]
    nodes, links = np.frombuffer(row.nodes, "<i4"), np.frombuffer(row.links, "<i4").reshape(-1, MOST_LINKS)
    layers = list(zip(np.split(nodes.astype(int), ends), np.split(links, ends), strict=True))
    return x, spans, np.frombuffer(row.ids, "<i8"), layers


def _answers(k: int):
    def run(index: pd.DataFrame, queries: pd.DataFrame) -> pd.DataFrame:
        out: list[tuple] = []
        for row in index.itertuples() if len(queries) else ():
            x, spans, ids, layers = _graph(row)
            q = matrix(queries["v"])
            # A query's own node and k others, with k + 1 ids each at most, hold k ids but its own.
            for query, name, v, nodes in zip(queries["query"], queries["id"], q, search(x, layers, q, max(BEAM, k + 1)), strict=True):
                nodes = nodes[nodes >= 0]
                far = np.sqrt(((x[nodes] - v) ** 2).sum(1))
                near = sorted((d, i) for d, n in zip(far, nodes, strict=True) for i in ids[spans[n] : spans[n + 1]] if i != name)
                out += [(query, name, i, d) for d, i in near[:k]]
        return pd.DataFrame(out, columns=["query", "query_id", "vec_id", "score"])

    return run


def _found(index: DataFrame, sizes: DataFrame, visits: DataFrame, k: int) -> DataFrame:
    """``query, query_id, vec_id, score``: the nearest in each shard of the lists that queries visit.

    A shard that many queries visit goes to as many tasks as they have blocks, one that none visits to none.
    """
    asked = visits.groupBy("d", "list").agg(F.ceil(F.count("*") / QUERIES).cast("int").alias("blocks"))
    plan = stored(sizes.join(asked, ["d", "list"]), "visited")
    upto = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    queries = visits.join(plan, ["d", "list"]).withColumn("block", F.pmod(F.xxhash64("query", F.lit("block")), F.col("blocks")).cast("int"))
    queries = queries.withColumn("shard", upto("shards")).drop("blocks", "shards")
    graphs = index.join(plan, ["d", "list"]).withColumn("block", upto("blocks")).drop("blocks", "shards")
    keys = ["d", "list", "shard", "block"]
    return graphs.groupBy(*keys).cogroup(queries.groupBy(*keys)).applyInPandas(
        _answers(k), "query long, query_id long, vec_id long, score double"
    )


def neighbours(table: DataFrame, queries: DataFrame, id_column: str = "vec_id", vector_column: str = "embedding", k: int = NEIGHBOURS) -> DataFrame:
    """``query_id, rank, vec_id, score``: the ``k`` rows of ``table`` found nearest to each query.

    Scores are Euclidean distances in double precision, ties go to the smaller id, and a row with the
    query's id is never its answer. Rows of either table that are null, all zero or hold null or
    non-finite components, or have no id, take no part; vectors of different lengths aren't compared, and every length has
    centroids of its own, which the driver fits one after the other.
    A row so far off that its squared distance overflows is no answer. Repeated rows of an id count once, a query that is repeated with other components is answered by
    its nearest rows to any. Empty tables give no rows. Other columns are not looked at.
    """
    by_batches(table.sparkSession, 1000)
    rows = usable(table, id_column, vector_column).dropDuplicates(["id", "key"])
    # The smallest ids of equal vectors; the limit is applied before and after the shuffle.
    few = rows.withColumn("place", F.row_number().over(Window.partitionBy("key").orderBy("id"))).where(F.col("place") <= k + 1)
    nodes = few.groupBy("key").agg(F.sort_array(F.collect_list("id")).alias("ids"), F.min("id").alias("least"), F.min_by("v", "id").alias("v"))
    nodes = stored(nodes.withColumn("d", F.size("v")), "nodes")
    routers = {}
    for d, n in sorted((r["d"], r["count"]) for r in nodes.groupBy("d").count().collect()):
        sample = nodes.where(F.col("d") == d).orderBy(F.xxhash64("key"), "least").limit(SAMPLE)
        routers[d] = fit(matrix(sample.select("v").toPandas()["v"]), n)

    hashed = nodes.select("ids", "least", "v", "d", F.xxhash64("key", F.lit("shard")).alias("deal"))
    placed = stored(hashed.mapInPandas(_placed(routers), "ids array<long>, least long, v array<double>, d int, deal long, list int"), "placed")
    each = F.greatest(F.lit(LEAST), F.floor(F.lit(SHARD_BYTES) / (8 * F.col("d") + 4 * MOST_LINKS + 24)))
    sizes = stored(placed.groupBy("d", "list").agg(F.ceil(F.count("*") / F.first(each)).cast("int").alias("shards")), "sizes")
    parts = int(max(1, min(total(sizes, "shards"), PARTITIONS)))
    dealt = placed.join(sizes, ["d", "list"]).withColumn("shard", F.pmod("deal", "shards").cast("int")).drop("deal", "shards")
    keys = ["d", "list", "shard"]
    index = stored(dealt.repartition(parts, *keys).groupBy(*keys).applyInPandas(_indexed, GRAPH), "graphs")

    asked = usable(queries, id_column, vector_column).dropDuplicates(["id", "key"])
    asked = asked.select(F.monotonically_increasing_id().alias("query"), "id", "v", F.size("v").alias("d"))
    visit = "query long, id long, v array<double>, d int, list int"
    # Numbers of queries are fixed once the table is written.
    asked = stored(stored(asked, "queries").mapInPandas(_placed(routers), visit), "visits")
    near = stored(_found(index, sizes, asked, k), "found")
    by_distance = Window.partitionBy("query").orderBy("score", "vec_id")
    last = near.groupBy("query", "vec_id").agg(F.min("score").alias("score")).withColumn("rank", F.row_number().over(by_distance))
    last = last.where(F.col("rank") == k).select("query", F.col("score").alias("reach"))
    reached = asked.join(last, "query", "left").withColumn("reach", F.coalesce("reach", F.lit(float("inf"))))
    others = stored(reached.select("query", "id", "v", "d", "list", "reach").mapInPandas(_elsewhere(routers), visit), "visits")
    found = near.unionByName(_found(index, sizes, others, k))
    best = found.groupBy("query_id", "vec_id").agg(F.min("score").alias("score"))
    ranked = best.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy("score", "vec_id")))
    return ranked.where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
