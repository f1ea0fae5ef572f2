"""Packing documents into training sequences without changing their order.

The stream of all ids in ascending order of documents is cut into windows of at most ``WINDOW`` ids.
Windows may end at the end of a document, at the end of a sentence at a small cost, or, where a
sentence is very long, every ``STEP`` ids at a larger one. Dynamic programming finds the cuts with the
least total of padding and costs: with ``f(j)`` the best total up to candidate ``j`` at position ``p(j)``,

    f(j) = WINDOW - p(j) + cost(j) + min over i with p(j) - p(i) <= WINDOW of f(i) + p(i),

and the minimum over the sliding range of ``i`` comes from a monotone queue, so that a stream of n
candidates takes n steps. Every partition of the ordered documents is packed on its own and wastes one
part of a window at most; partitions hold some thousand windows.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sellerlens.llm import tokens
from sellerlens.llm.shared import before_each_part, by_batches, in_id_order, stored

WINDOW = 4096
SENTENCE_COST = 2    # in ids of padding
INSIDE_COST = 16
STEP = 32
SENTENCE_ENDS = (".", "!", "?", "。")


def candidates(ids: np.ndarray, ends: np.ndarray, stops: np.ndarray, step: int = STEP) -> tuple[np.ndarray, np.ndarray]:
    """Positions where a window may end, ascending from 0 to ``len(ids)``, and the cost of each."""
    kind = np.full(len(ids) + 1, -1, np.int64)
    kind[1:][np.isin(ids, stops)] = SENTENCE_COST
    kind[ends] = 0
    kind[0] = 0
    at = np.flatnonzero(kind >= 0)
    gaps = np.flatnonzero(np.diff(at) > step)
    for g in gaps:
        kind[np.arange(at[g] + step, at[g + 1], step)] = INSIDE_COST
    at = np.flatnonzero(kind >= 0)
    return at, kind[at]


def cuts(at: np.ndarray, cost: np.ndarray, window: int = WINDOW) -> np.ndarray:
    """Ends of the windows, the last one being the end of the stream."""
    place, price = at.tolist(), cost.tolist()
    back = [0] * len(place)
    reach = [0] * len(place)  # f(i) + p(i)
    queue: deque[int] = deque([0])
    for j in range(1, len(place)):
        p = place[j]
        while p - place[queue[0]] > window:
            queue.popleft()
        i = queue[0]
        back[j] = i
        reach[j] = best = reach[i] + window + price[j]
        while queue and reach[queue[-1]] > best:
            queue.pop()
        queue.append(j)
    found, j = [], len(place) - 1
    while j > 0:
        found.append(place[j])
        j = back[j]
    return np.array(found[::-1], dtype=np.int64)


def pieces(lengths: np.ndarray, ends: np.ndarray) -> pd.DataFrame:
    """The parts of documents that windows hold: document, start in it, length, window and offset in it."""
    doc_ends = np.cumsum(lengths)
    borders = np.union1d(doc_ends, ends)
    begins = np.concatenate([[0], borders[:-1]]) if len(borders) else borders
    doc = np.searchsorted(doc_ends, begins, side="right")
    window = np.searchsorted(ends, begins, side="right")
    return pd.DataFrame({
        "doc": doc, "begin": begins, "start": begins - (doc_ends - lengths)[doc], "length": borders - begins,
        "window": window, "offset": begins - np.concatenate([[0], ends])[window],
    })


def packed(
    docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", window: int = WINDOW,
    vocabulary: str | None = None, with_ids: bool = True,
) -> DataFrame:
    """One row per piece: ``doc_id, start, length, ids, ids_crc32, doc_tokens, sequence_id, offset``.

    Without ``with_ids`` the column ``ids`` is left out, and no id leaves the Python worker.

    A null text counts as empty (its piece is the end id), a null id sorts first, rows that repeat an
    id are documents of their own and follow in order of their text, texts of any length are cut, and
    no rows give no pieces. Other columns are not looked at.
    """
    by_batches(docs.sparkSession)
    path = vocabulary or tokens.vocabulary_path()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encoder, part = tokens.encoder(path), TaskContext.get().partitionId()
        stops = np.concatenate([encoder.encode(s)[:-1] for s in SENTENCE_ENDS])
        names, ids = [], []
        for batch in batches:
            names.append(batch["id"].astype("Int64"))
            ids += [encoder.encode(t) for t in batch["text"]]
        if not ids:
            return
        lengths = np.array([len(i) for i in ids])
        stream = np.concatenate(ids)
        del ids
        out = pieces(lengths, cuts(*candidates(stream, np.cumsum(lengths), stops), window))
        name = pd.concat(names, ignore_index=True)
        for at in range(0, len(out), 1000):  # a few sequences at a time go back to the JVM
            some = out.iloc[at : at + 1000]
            held = [stream[b : b + n] for b, n in zip(some["begin"], some["length"], strict=True)]
            rows = pd.DataFrame({
                "doc_id": name.iloc[some["doc"]].array, "start": some["start"].array, "length": some["length"].array,
                "ids_crc32": [tokens.crc(i) for i in held], "doc_tokens": lengths[some["doc"]],
                "part": part, "sequence_id": some["window"].array, "offset": some["offset"].array,
            })
            if with_ids:
                rows.insert(3, "ids", held)
            yield rows

    ids_kind = "ids array<long>, " if with_ids else ""
    kinds = f"doc_id long, start long, length long, {ids_kind}ids_crc32 long, doc_tokens long, part int, sequence_id long, offset long"
    return in_id_order(docs, id_column, text_column).mapInPandas(run, kinds)


def numbered(rows: DataFrame) -> DataFrame:
    """Sequence ids that go on from one part to the next, for the stored rows of ``packed``."""
    sizes = rows.groupBy("part").agg((F.max("sequence_id") + 1).alias("size"))
    out = rows.join(before_each_part(sizes), "part")
    return out.withColumn("sequence_id", F.col("sequence_id") + F.col("base")).drop("part", "base")


def pack_documents(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", with_ids: bool = True) -> DataFrame:
    """``packed`` with sequence ids over the whole corpus; ``ids`` only if asked for."""
    return numbered(stored(packed(docs, id_column, text_column, with_ids=with_ids), "pieces"))
