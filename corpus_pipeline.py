"""Training sequences from documents, in five stages.

Each stage takes ``(spark, docs, sf_dir)`` and works on all that its predecessor kept, written as
Parquet and read again. The first four return the columns of ``documents``, the last one the pieces of
the packed sequences. SQL can't express the stages (a fitted grammar, similarity components, dynamic
programming), so that ``ORACLE_SQL`` is None; they are tested against brute force.

Every stage takes null ids, texts and sources, empty and very long texts, ties, repeated rows and tables without rows; extra
columns, whatever their names, pass through all stages but the last.
"""

from __future__ import annotations

import os
import sys

from pyspark.sql import DataFrame, SparkSession

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from sellerlens.llm import line_dedup, minhash, mixing, packing, toxicity  # noqa: E402
from sellerlens.llm.shared import stored, table  # noqa: E402

NEAR = 80  # per cent of shingles that near copies share; op6_minhash_near_dedup has a threshold of its own


def without_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that score under 0.5; a null or empty text scores as one without any match."""
    return toxicity.without_toxic(docs, table(spark, sf_dir, "labels"))


def without_boilerplate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All rows, without the lines that a large share of their source holds; a null text stays null, and one that loses every line becomes empty."""
    return line_dedup.without_boilerplate(docs, size="n_chars")


def without_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The row with the smallest id of each group of near copies; rows without id, words or text are copies of nothing and stay."""
    return minhash.without_copies(docs, percent=NEAR)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each row as often as the mixture takes it, up to ``mixing.REPEATS`` times; a null source is a source, and one without tokens is not taken."""
    return mixing.mixed(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the packed sequences; a null text is an empty one, null ids come first."""
    return packing.pack_documents(docs, with_ids=False)


STAGES = [
    ("toxicity", without_toxic),
    ("line_dedup", without_boilerplate),
    ("minhash_near_dedup", without_copies),
    ("source_mixing", mixed),
    ("packing", packed),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
