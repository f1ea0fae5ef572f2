"""Connected components by alternating large-star and small-star steps.

Every step is a grouped minimum (combined before the shuffle) and a join on the node, which Spark can
split if one node has a large share of all edges. The number of edges never grows. A round's edges
are written to the shared folder, so that a lost executor costs one round at most.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sellerlens.llm.shared import stored


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """``(node, root)`` for every node that is on an edge; ``root`` is the smallest node reachable.

    Null ends and loops are ignored, repeated edges count once; without edges the result is empty.
    """
    links = stored(_downward(edges.select(F.col(a).alias("hi"), F.col(b).alias("lo"))), "links")
    before = None
    while True:
        now = links.agg(F.count("*").alias("n"), F.sum(F.xxhash64("hi", "lo").cast("decimal(38,0)")).alias("s")).first()
        if now == before or now["n"] == 0:
            break
        before = now
        links = stored(_small_star(_large_star(links)), "links")
    roots = links.select(F.col("lo").alias("node")).distinct().select("node", F.col("node").alias("root"))
    return links.select(F.col("hi").alias("node"), F.col("lo").alias("root")).unionByName(roots)


def _downward(pairs: DataFrame) -> DataFrame:
    return (
        pairs.where(F.col("hi") != F.col("lo"))
        .select(F.greatest("hi", "lo").alias("hi"), F.least("hi", "lo").alias("lo"))
        .distinct()
    )


def _large_star(links: DataFrame) -> DataFrame:
    """Larger neighbours of each node are tied to the smallest of its neighbourhood."""
    both = links.select(F.col("hi").alias("u"), F.col("lo").alias("v")).unionByName(
        links.select(F.col("lo").alias("u"), F.col("hi").alias("v"))
    )
    least = both.groupBy("u").agg(F.min(F.least("u", "v")).alias("m"))
    return (
        links.select(F.col("lo").alias("u"), F.col("hi").alias("v"))
        .join(least, "u")
        .select(F.col("v").alias("hi"), F.col("m").alias("lo"))
        .where("hi != lo")
        .distinct()
    )


def _small_star(links: DataFrame) -> DataFrame:
    """Smaller neighbours of each node, and the node itself, are tied to the smallest of them."""
    least = links.groupBy("hi").agg(F.min("lo").alias("m"))
    moved = links.join(least, "hi").where("lo != m").select(F.col("lo").alias("hi"), F.col("m").alias("lo"))
    return moved.unionByName(least.select("hi", F.col("m").alias("lo"))).distinct()
