"""Near-duplicate documents by bottom-k sketches from one hash function.

1. A document's 5-word shingles are hashed once; the sketch keeps the 64 smallest hashes.
2. Documents with the same shingle set form one class, and from here on only classes count.
3. Retained values generate candidates through inverted lists. Values that more than ``COMMON``
   classes retain (passages and lines shared by many) move behind all others in the order of
   values; any fixed order keeps the property that similar sets share their smallest values. A class
   is listed under its first rare values, and under its first common ones too if its rare values
   could all be unshared at the threshold with a probability over ``MISSED``.
4. In each list all classes are first compared with the list's first class only: sizes, then the
   similarity estimated from the sketch of the union, then exact Jaccard over the full sets. What is
   connected that way needs no further comparison.
5. What is left, pairs of one list in different components: short lists are compared pair by pair
   (at most ``COMMON`` partners a row), long lists in blocks of classes whose full sets are
   intersected at once inside a task. A task only returns a spanning forest of the links it finds,
   so that nothing of quadratic size is ever written or shuffled, and no pair is left out.

At the threshold a value of a set is unshared with a probability of 1 - t at most. So many rare values
are listed (``rare_keys``) that more of the ``LISTED`` ones are unshared with a probability under
``MISSED``; with fewer, so many common ones (``common_keys``) that all are with one under ``MISSED``.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sellerlens.llm.components import components
from sellerlens.llm.shared import by_batches, stored

WORDS = 5          # words in a shingle
PERCENT = 85       # documents are linked at this Jaccard similarity or more, if no other is given
SKETCH = 64        # hashes kept for the estimate
LISTED = 32        # of these, the ones that may become keys
MISSED = 1e-6      # probability that the keys of a set at the threshold are all unshared
COMMON = 50        # a value that more classes retain is common
SLACK = 4.7        # standard deviations of the estimate at the threshold that a pair may fall short
BLOCK = 512        # classes that are intersected at once

_M1, _M2, _M3 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xFF51AFD7ED558CCD), np.uint64(0xC4CEB9FE1A85EC53)


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(33))) * _M2
    h = (h ^ (h >> np.uint64(33))) * _M3
    return h ^ (h >> np.uint64(33))


def shingle_hashes(texts: list[str | None], words: int = WORDS) -> list[np.ndarray]:
    """Sorted distinct 64-bit hashes of each text's shingles.

    Only A-Z is lower-cased and only ASCII white space divides words, which is what the methods of
    ``bytes`` do. A text of fewer words is one shingle, one without words has none.
    """
    split = [(t or "").encode("utf-8", "surrogatepass").lower().split() for t in texts]
    lengths = [len(s) for s in split]
    flat = np.empty(sum(lengths), dtype=object)
    at = 0
    for s in split:
        flat[at : at + len(s)] = s
        at += len(s)
    hashes = pd.util.hash_array(flat, categorize=False) if len(flat) else np.zeros(0, np.uint64)
    out, at = [], 0
    for n in lengths:
        h, at = hashes[at : at + n], at + n
        width = min(n, words)
        if not n:
            out.append(np.zeros(0, np.int64))
            continue
        s = _mixed(h[: n - width + 1] + np.uint64(width))
        for k in range(1, width):
            s = _mixed(s * _M1 + h[k : n - width + 1 + k])
        out.append(np.unique(s.view(np.int64)))
    return out


def _class_of(hashes: np.ndarray) -> str | None:
    return hashlib.blake2b(hashes.tobytes(), digest_size=16).hexdigest() if len(hashes) else None


def _check_of(hashes: np.ndarray) -> int:
    """16 bits of a class, cheap to send along."""
    return int((_class_of(hashes) or "0")[-4:], 16)


def _sketches(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        sets = shingle_hashes(batch["text"].tolist())
        named = batch["id"].notna()
        yield pd.DataFrame({
            "id": batch["id"].astype("Int64"),
            "n": [len(s) for s in sets],
            "class": [_class_of(s) if known else None for s, known in zip(sets, named, strict=True)],
            "sketch": [s[:SKETCH] for s in sets],
        })


def _full_sets(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        out = pd.DataFrame({"node": batch["node"], "set": shingle_hashes(batch["text"].tolist())})
        yield out[out["set"].map(_check_of) == batch["check"]]  # an id may stand on several texts


def _estimate(s, t):
    """Share of the union's smallest hashes that both sketches hold."""
    union = F.slice(F.array_sort(F.array_union(s, t)), 1, SKETCH)
    return F.size(F.array_intersect(F.array_intersect(s, t), union)) / F.size(union)


def _near_in_size(m, n, percent: int):
    return F.least(m, n) * 100 >= F.greatest(m, n) * percent


def _least_estimate(percent: int) -> float:
    t = percent / 100
    return t - SLACK * (t * (1 - t) / SKETCH) ** 0.5


def _candidates(pairs: DataFrame, sketches: DataFrame, percent: int) -> DataFrame:
    """Pairs whose sizes and estimated similarity allow a link."""
    s = sketches.select(F.col("node").alias("a"), F.col("n").alias("na"), F.col("sketch").alias("sa"))
    t = sketches.select(F.col("node").alias("b"), F.col("n").alias("nb"), F.col("sketch").alias("sb"))
    return (
        pairs.distinct().join(s, "a").join(t, "b")
        .where(_near_in_size(F.col("na"), F.col("nb"), percent) & (_estimate(F.col("sa"), F.col("sb")) >= _least_estimate(percent)))
        .select("a", "b")
    )


def _verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    s = sets.select(F.col("node").alias("a"), F.col("set").alias("sa"))
    t = sets.select(F.col("node").alias("b"), F.col("set").alias("sb"))
    both = pairs.join(s, "a").join(t, "b").withColumn("i", F.size(F.array_intersect("sa", "sb")))
    return both.where(F.col("i") * 100 >= (F.size("sa") + F.size("sb") - F.col("i")) * percent).select("a", "b")


def forest(linked: np.ndarray) -> np.ndarray:
    """Smallest index each node of a symmetric boolean matrix is connected with."""
    n = len(linked)
    label = np.arange(n)
    while True:
        least = np.where(linked, label[None, :], n).min(axis=1, initial=n)
        new = np.minimum(label, least)
        new = np.minimum(new, new[new])
        if (new == label).all():
            return label
        label = new


def _block_links(rows: pd.DataFrame, percent: int) -> pd.DataFrame:
    """Links within one block, or between two, of a list; exact, from the full sets."""
    rows = rows.drop_duplicates("node").sort_values("node", ignore_index=True)
    sizes = rows["set"].map(len).to_numpy()
    owner = np.repeat(np.arange(len(rows)), sizes)
    _, column, holders = np.unique(np.concatenate(list(rows["set"])), return_inverse=True, return_counts=True)
    shared = np.flatnonzero(holders > 1)
    place = np.full(len(holders), -1)
    place[shared] = np.arange(len(shared))
    keep = place[column] >= 0
    owner, column = owner[keep], place[column][keep]
    common = np.zeros((len(rows), len(rows)), np.float32)
    order = np.argsort(column, kind="stable")
    owner, column = owner[order], column[order]
    for at in range(0, len(shared), 4096):
        lo, hi = np.searchsorted(column, (at, at + 4096))
        held = np.zeros((len(rows), min(4096, len(shared) - at)), np.float32)
        held[owner[lo:hi], column[lo:hi] - at] = 1
        common += held @ held.T
    linked = common * 100 >= (sizes[:, None] + sizes[None, :] - common) * percent
    label = forest(linked)
    found = np.flatnonzero(label != np.arange(len(rows)))
    names = rows["node"].to_numpy()
    return pd.DataFrame({"a": names[label[found]], "b": names[found]})


def rare_keys(percent: int) -> int:
    """Smallest number of values that are all unshared among ``LISTED`` with a probability under ``MISSED``."""
    t = percent / 100
    tail = lambda r: sum(math.comb(LISTED, k) * (1 - t) ** k * t ** (LISTED - k) for k in range(r, LISTED + 1))
    return next((r for r in range(LISTED + 1) if tail(r) < MISSED), LISTED + 1)


def common_keys(percent: int) -> int:
    return next((k for k in range(1, LISTED) if (1 - percent / 100) ** k < MISSED), LISTED)


def _keys(classes: DataFrame, percent: int) -> DataFrame:
    """``(node, v)``: the lists each class stands in."""
    retained = classes.select("node", F.explode(F.slice("sketch", 1, LISTED)).alias("v"))
    common = retained.groupBy("v").count().where(F.col("count") > COMMON).select("v", F.lit(True).alias("common"))
    marked = retained.join(stored(common, "common"), "v", "left")
    split = marked.groupBy("node").agg(
        F.sort_array(F.collect_list(F.when(F.col("common").isNull(), F.col("v")))).alias("rare"),
        F.sort_array(F.collect_list(F.when(F.col("common"), F.col("v")))).alias("often"),
    )
    rare = rare_keys(percent)
    few = F.size("rare") < rare
    return split.select("node", F.explode(F.concat(
        F.slice("rare", 1, rare), F.when(few, F.slice("often", 1, common_keys(percent))).otherwise(F.array().cast("array<bigint>"))
    )).alias("v"))


def _blocks(long: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links in long lists. A class goes to as many tasks as its list has blocks of ``BLOCK``."""
    n = F.ceil(F.col("listed") / BLOCK).cast("int")
    own = F.pmod(F.xxhash64("node"), n).cast("int")
    dealt = long.select("node", "v", n.alias("n"), own.alias("own")).select(
        "node", "v", "own", F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("other")
    )
    dealt = dealt.select("node", "v", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"))
    return dealt.join(sets, "node").groupBy("v", "i", "j").applyInPandas(
        lambda rows: _block_links(rows, percent), "a long, b long"
    )


def near_duplicates(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", percent: int = PERCENT) -> DataFrame:
    """One row per row of ``docs``: ``doc_id, n_shingles, component_id, kept``, linked at ``percent`` or more.

    Null or empty texts have no shingles and stay alone. Rows that repeat an id are judged by their
    own text each. Rows without an id are linked with nothing, have a null ``component_id`` and are
    kept. No rows give no rows. Other columns of ``docs`` are not looked at.
    """
    spark = docs.sparkSession
    by_batches(spark)
    narrow = docs.select(F.col(id_column).cast("long").alias("id"), F.col(text_column).cast("string").alias("text"))
    sketched = stored(narrow.mapInPandas(_sketches, "id long, n long, class string, sketch array<long>"), "sketches")
    classes = stored(_classes(sketched), "classes")

    listed = _keys(classes, percent)
    sizes = listed.groupBy("v").agg(F.count("*").alias("listed"), F.min("node").alias("first")).where("listed > 1")
    lists = stored(listed.join(sizes, "v"), "lists")
    star = lists.where("node != first").select(F.col("first").alias("a"), F.col("node").alias("b"))
    first = stored(_candidates(star, classes, percent), "first")
    long = lists.where(F.col("listed") > COMMON)

    sets = stored(_sets_of(narrow, classes, _ends(first).unionByName(long.select("node"))), "sets")
    links = stored(_verified(first, sets, percent), "links")
    roots = components(links)
    placed = lists.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    open_lists = placed.groupBy("v").agg(F.min("root").alias("r1"), F.max("root").alias("r2")).where("r1 != r2").select("v")
    placed = stored(placed.join(open_lists, "v"), "open")

    short = placed.where(F.col("listed") <= COMMON)
    other = short.select("v", F.col("node").alias("b"), F.col("root").alias("root_b"))
    pairs = short.join(other, "v").where((F.col("node") < F.col("b")) & (F.col("root") != F.col("root_b")))
    second = stored(_candidates(pairs.select(F.col("node").alias("a"), "b"), classes, percent), "second")
    more = stored(_sets_of(narrow, classes, _ends(second)), "sets")
    links = links.unionByName(_verified(second, more, percent)).unionByName(
        _blocks(placed.where(F.col("listed") > COMMON).select("node", "v", "listed"), sets, percent)
    )
    return _labelled(sketched, classes, components(stored(links, "links")))


def _classes(sketched: DataFrame) -> DataFrame:
    """Classes with a short number each, their smallest id, and the sketch of one of its rows."""
    least = sketched.where("class is not null").groupBy("class").agg(F.min("id").alias("least"))
    one = sketched.select("class", F.col("id").alias("least"), "n", "sketch")
    # Numbers follow the partitions' order of rows, and are fixed once the table is written.
    return least.join(one, ["class", "least"]).dropDuplicates(["class"]).withColumn("node", F.monotonically_increasing_id())


def _ends(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.col("a").alias("node")).unionByName(pairs.select(F.col("b").alias("node")))


def _sets_of(docs: DataFrame, classes: DataFrame, wanted: DataFrame) -> DataFrame:
    """``(node, set)`` for the wanted classes, from the text of one document of each.

    Rows that repeat an id give their set as often, which repeats links and changes nothing. The list
    of wanted documents is kept narrow, for where it is small Spark can send it to all tasks,
    and the texts aren't shuffled.
    """
    check = F.conv(F.substring("class", -4, 4), 16, 10).cast("int").alias("check")
    chosen = classes.join(wanted.distinct(), "node").select(F.col("least").alias("id"), "node", check)
    return docs.join(stored(chosen, "chosen"), "id").select("node", "check", "text").mapInPandas(
        _full_sets, "node long, set array<long>"
    )


def _labelled(sketched: DataFrame, classes: DataFrame, roots: DataFrame) -> DataFrame:
    rooted = classes.select("class", "node", "least").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    least = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    named = rooted.join(least, "root").select("class", "component_id")
    component = F.when(F.col("class").isNull(), F.col("id")).otherwise(F.col("component_id"))
    return sketched.select("id", "n", "class").join(named, "class", "left").select(
        F.col("id").alias("doc_id"), F.col("n").alias("n_shingles"), component.alias("component_id"),
        F.coalesce(F.col("id") == component, F.lit(True)).alias("kept"),
    )


def without_copies(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", percent: int = PERCENT) -> DataFrame:
    """``docs`` with one document of each group, the one with the smallest id; columns unchanged.

    Rows without an id stay, and so do all rows of an id that stands on several texts if one is kept.
    """
    labelled = near_duplicates(docs, id_column, text_column, percent)
    fate = labelled.groupBy(F.col("doc_id").alias("_gone")).agg(F.max("kept").alias("kept"))
    gone = stored(fate.where(~F.col("kept")).select("_gone"), "gone")
    return docs.join(gone, docs[id_column].cast("long") == gone["_gone"], "left_anti")
