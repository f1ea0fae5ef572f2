"""Boilerplate lines of a site: lines that a large share of a host's pages hold.

Only DataFrame functions. A line is compared as its text without white space at the ends; empty lines
never count. Each page counts a line once. Counting shuffles two 64-bit hashes in place of a line, and
partial sums in place of rows, so that neither a host with a third of all pages nor a line on most
pages lands in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sellerlens.llm.shared import stored

RATIO = 0.1     # share of a host's pages beyond which a line is boilerplate
PAGES = 3       # on fewer pages a line is chance and never boilerplate, however small the host
WHITE = " \t\x0b\x0c\r"  # white space at a line's ends that doesn't tell lines apart


def _lines(text: Column) -> Column:
    return F.split(F.coalesce(text.cast("string"), F.lit("")), "\n")


def _key(line: Column) -> Column:
    """128 bits for a line; null for an empty one."""
    line = F.btrim(line, F.lit(WHITE))
    return F.when(line != "", F.struct(F.xxhash64(line).alias("x"), F.xxhash64(F.lit("line"), line).alias("y")))


def boilerplate(docs: DataFrame, host: str = "source", text: str = "text", ratio: float = RATIO, pages: int = PAGES) -> DataFrame:
    """``host, keys``: of each host that has any, the keys of its boilerplate lines.

    A host's pages together hold at most (their mean number of lines) / ``ratio`` such lines, so that
    the arrays stay short however many pages there are.
    """
    rows = docs.select(F.col(f"`{host}`").alias("host"), F.array_distinct(F.transform(_lines(F.col(f"`{text}`")), _key)).alias("keys"))
    lines = rows.select("host", F.explode("keys").alias("key")).where("key is not null")
    counts = lines.groupBy("host", "key").agg(F.count("*").alias("n")).where(F.col("n") >= pages)
    totals = rows.groupBy("host").agg(F.count("*").alias("total"))
    often = counts.join(totals, counts["host"].eqNullSafe(totals["host"])).where(F.col("n") > F.col("total") * ratio)
    return often.select(counts["host"], "key").groupBy("host").agg(F.collect_list("key").alias("keys"))


def without_boilerplate(docs: DataFrame, host: str = "source", text: str = "text", size: str | None = None, ratio: float = RATIO, pages: int = PAGES) -> DataFrame:
    """``docs`` with the same rows and columns; boilerplate lines are gone from ``text``.

    Other lines keep their order and their white space. ``size`` names a column of the text's length
    that is set anew where lines went. A row whose lines all go keeps an empty text; a null text stays
    null; a null host is a host of its own; repeated rows are pages each; no rows give no rows.
    """
    found = stored(boilerplate(docs, host, text, ratio, pages), "boilerplate")
    found = found.select(F.struct("host", "keys").alias("site"))
    row = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    joined = row.join(found, F.col(f"row.`{host}`").eqNullSafe(F.col("site.host")), "left")
    old = F.col(f"row.`{text}`")
    kept = F.filter(_lines(old), lambda line: ~F.coalesce(F.array_contains(F.col("site.keys"), _key(line)), F.lit(False)))
    new = F.when(old.isNull() | F.col("site").isNull(), old).otherwise(F.array_join(kept, "\n"))
    out = joined.select(F.struct("row", new.alias("new")).alias("both"))

    def column(name: str) -> Column:
        value = F.col(f"both.row.`{name}`")
        if name == text:
            value = F.col("both.new")
        elif name == size:
            changed = ~F.col("both.new").eqNullSafe(F.col(f"both.row.`{text}`"))
            value = F.when(changed, F.length("both.new").cast(docs.schema[name].dataType)).otherwise(value)
        return value.alias(name)

    return out.select(*[column(c) for c in docs.columns])
