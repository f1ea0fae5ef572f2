"""Feeds whose columns nobody names in advance, held as VARIANT values.

A body keeps all its fields, also those that come later; a column is taken out by its path when it is needed. What fields there
are, and how they change between loads, are tables themselves.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def bodies(raw: DataFrame, column: str = "payload") -> DataFrame:
    """``body`` beside the other columns: the parsed response. Null, blank and broken bodies are left out, see ``broken``."""
    parsed = raw.withColumn("body", F.try_parse_json(F.col(column)))
    return parsed.where("body IS NOT NULL").drop(column)


def broken(raw: DataFrame, column: str = "payload") -> DataFrame:
    """Bodies that aren't JSON."""
    return raw.where((F.trim(F.col(column)) != "") & F.try_parse_json(F.col(column)).isNull())


def rows(held: DataFrame, field: str | None = None) -> DataFrame:
    """``row`` for every object of a body: of the list under ``field``, of a body that is a list, or the body itself.

    A body without the list has no rows; elements that are null have none either.
    """
    body = F.col("body")
    if field is not None:
        listed = F.try_variant_get(body, f"$.{field}", "array<variant>")
        one = F.explode(listed)
    else:
        one = F.explode(F.coalesce(F.try_variant_get(body, "$", "array<variant>"), F.array(body)))
    return held.select(*[c for c in held.columns if c != "body"], one.alias("row")).where(~F.is_variant_null("row"))


def columns(held: DataFrame, **kinds: str) -> DataFrame:
    """Fields of ``row`` as columns of the given types; a field that is absent or of a type that can't be cast is null."""
    return held.select(*[F.try_variant_get("row", f"$['{name}']", kind).alias(name) for name, kind in kinds.items()])


def fields(held: DataFrame) -> DataFrame:
    """``field, type, n``: the fields the rows have, each with every type it occurs in and how often.

    Decimals of all sizes are one type. Combined before the shuffle: as many rows travel as there are fields.
    """
    entries = held.select(F.explode(F.try_variant_get("row", "$", "map<string,variant>")).alias("field", "value"))
    kind = F.regexp_replace(F.schema_of_variant("value"), r"DECIMAL\(\d+,\s*\d+\)", "DECIMAL")
    return entries.select("field", kind.alias("type")).groupBy("field", "type").agg(F.count("*").alias("n"))


def drift(before: DataFrame, now: DataFrame) -> DataFrame:
    """``field, type, change``: fields of ``fields`` tables that are ``new``, ``gone``, or have a type ``added`` or ``dropped``."""
    a, b = (t.select("field", "type").distinct().withColumn(side, F.lit(True)) for t, side in ((before, "was"), (now, "is")))
    both = a.join(b, ["field", "type"], "full_outer")
    known = both.groupBy("field").agg(F.max(F.coalesce("was", F.lit(False))).alias("old"), F.max(F.coalesce("is", F.lit(False))).alias("young"))
    change = (
        F.when(F.col("was").isNull() & ~F.col("old"), "new").when(F.col("was").isNull(), "added")
        .when(F.col("is").isNull() & ~F.col("young"), "gone").when(F.col("is").isNull(), "dropped")
    )
    return both.join(known, "field").select("field", "type", change.alias("change")).where("change IS NOT NULL")


def schema(held: DataFrame) -> DataFrame:
    """``schema``: one type that fits all rows, as text."""
    return held.agg(F.schema_of_variant_agg("row").alias("schema"))
