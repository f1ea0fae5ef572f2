"""Token ids in a compact binary table, and their way back.

File format. Ids are replaced with their frequency rank over the whole corpus (rank 0 is the most
frequent, ties by id), so that frequent ids need one byte. A document's ranks are written in
byte-aligned variable length: ``data`` holds 1 to 4 bytes for each rank, lowest byte first, and
``control`` holds the lengths less one, two bits each, four to a byte, lowest bits first. ``ids``, a
Parquet table of one row per document in ascending ``doc_id`` over its parts, has the two byte strings,
``n_tokens``, the number of the ``part`` and ``start``, the ids before the document within its part.
``ranks`` holds ``(rank, id)``; it has one row per id of the vocabulary that occurs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sellerlens.llm import tokens
from sellerlens.llm.shared import before_each_part, by_batches, parts_for, stored, total

TOKENS_EACH = 8_000_000  # ids in a partition of the written table

# Of each control byte, the four lengths and the bytes that they add up to.
LENGTHS = ((np.arange(256)[:, None] >> np.array([0, 2, 4, 6])) & 3) + 1


def pack(values: np.ndarray) -> tuple[bytes, bytes]:
    """Control and data bytes of unsigned 32-bit values."""
    values = np.asarray(values, dtype="<u4")
    lengths = 1 + (values > 0xFF).astype(np.uint8) + (values > 0xFFFF) + (values > 0xFFFFFF)
    codes = np.zeros(-(-len(values) // 4) * 4, np.uint8)
    codes[: len(values)] = lengths - 1
    control = (codes.reshape(-1, 4) << np.array([0, 2, 4, 6], np.uint8)).sum(axis=1).astype(np.uint8)
    taken = np.arange(4) < lengths[:, None]
    return control.tobytes(), values.view(np.uint8).reshape(-1, 4)[taken].tobytes()


def unpack(control: bytes, data: bytes, n: int) -> np.ndarray:
    """The ``n`` values behind control and data bytes, by looking lengths up in ``LENGTHS``."""
    lengths = LENGTHS[np.frombuffer(control, np.uint8)].reshape(-1)[:n]
    out = np.zeros((n, 4), np.uint8)
    out[np.arange(4) < lengths[:, None]] = np.frombuffer(data, np.uint8)
    return out.reshape(-1).view("<u4")


def write_ids(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", vocabulary: str | None = None) -> tuple[DataFrame, DataFrame]:
    """Write ``docs`` in the file format; the written ``ids`` and ``ranks`` tables.

    A null text counts as empty, a null id sorts first, rows that repeat an id follow in order of
    their encoded ids, and no rows give empty tables. Other columns are not looked at.
    """
    by_batches(docs.sparkSession)
    path = vocabulary or tokens.vocabulary_path()

    def encoded(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encode = tokens.encoder(path).encode
        for batch in batches:
            ids = [encode(t) for t in batch["text"]]
            yield pd.DataFrame({"id": batch["id"].astype("Int64"), "n": [len(i) for i in ids], "ids": [i.tobytes() for i in ids]})

    narrow = docs.select(F.col(id_column).cast("long").alias("id"), F.col(text_column).cast("string").alias("text"))
    raw = stored(narrow.mapInPandas(encoded, "id long, n long, ids binary"), "raw-ids")

    def counted(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen = np.zeros(0, np.int64)
        for batch in batches:
            more = np.bincount(np.frombuffer(b"".join(batch["ids"]), np.uint32))
            seen = np.pad(seen, (0, max(0, len(more) - len(seen))))
            seen[: len(more)] += more
        at = np.flatnonzero(seen)
        yield pd.DataFrame({"id": at, "n": seen[at]})

    often = raw.select("ids").mapInPandas(counted, "id long, n long").groupBy("id").agg(F.sum("n").alias("n"))
    ranks = stored(often.select((F.row_number().over(Window.orderBy(F.desc("n"), "id")) - 1).alias("rank"), "id"), "ranks")
    place = _as_array(ranks, "id", "rank")

    def ranked(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Packed rows with the number of their partition and the ids before each within it."""
        before, part = 0, TaskContext.get().partitionId()
        for batch in batches:
            packed = [pack(place[np.frombuffer(b, np.uint32)]) for b in batch["ids"]]
            ends = before + batch["n"].cumsum()
            yield pd.DataFrame({
                "part": part, "start": ends - batch["n"], "doc_id": batch["id"].astype("Int64"), "n_tokens": batch["n"],
                "control": [c for c, _ in packed], "data": [d for _, d in packed],
            })
            before = int(ends.iloc[-1]) if len(batch) else before

    # Ids are put in order before they are packed: ranges are sampled from the stored table, and packing runs once.
    parts = parts_for(total(raw, F.col("n")), TOKENS_EACH)
    ordered = raw.repartitionByRange(parts, F.col("id"), F.substring("ids", 1, 32)).sortWithinPartitions("id", "ids")
    kinds = "part int, start long, doc_id long, n_tokens long, control binary, data binary"
    return stored(ordered.mapInPandas(ranked, kinds), "ids"), ranks


def read_ids(ids: DataFrame, ranks: DataFrame) -> DataFrame:
    """``doc_id, start, n_tokens, ids`` of a written table; ``ids`` are the original ones again, as an
    array, and ``start`` counts the ids of all documents before it."""
    original = _as_array(ranks, "rank", "id")

    def decoded(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            ids = [original[unpack(c, d, n)] for c, d, n in zip(batch["control"], batch["data"], batch["n_tokens"], strict=True)]
            yield batch[["part", "start", "n_tokens"]].assign(doc_id=batch["doc_id"].astype("Int64"), ids=ids)

    return _from_start(ids, ids.mapInPandas(decoded, "part int, start long, n_tokens long, doc_id long, ids array<long>"))


def checksums(ids: DataFrame, ranks: DataFrame) -> DataFrame:
    """``doc_id, start, n_tokens, ids_crc32`` of a written table, decoded in the same way."""
    original = _as_array(ranks, "rank", "id")

    def decoded(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            crcs = [
                tokens.crc(original[unpack(c, d, n)])
                for c, d, n in zip(batch["control"], batch["data"], batch["n_tokens"], strict=True)
            ]
            yield batch[["part", "start", "n_tokens"]].assign(doc_id=batch["doc_id"].astype("Int64"), ids_crc32=crcs)

    return _from_start(ids, ids.mapInPandas(decoded, "part int, start long, n_tokens long, doc_id long, ids_crc32 long"))


def _from_start(ids: DataFrame, rows: DataFrame) -> DataFrame:
    bases = before_each_part(ids.groupBy("part").agg(F.sum("n_tokens").alias("size")))
    out = rows.join(bases, "part").withColumn("start", F.col("start") + F.col("base"))
    return out.select("doc_id", "start", "n_tokens", *[c for c in rows.columns if c.startswith("ids")])


def _as_array(ranks: DataFrame, key: str, value: str) -> np.ndarray:
    """The rank table as an array. It has a row for each id of the vocabulary at most, on any corpus."""
    rows = ranks.select(key, value).toPandas()
    out = np.zeros(int(rows[key].max()) + 1 if len(rows) else 1, np.uint32)
    out[rows[key]] = rows[value]
    return out
