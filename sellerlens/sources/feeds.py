"""Landed feeds to DataFrames."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sellerlens.operators import periods
from sellerlens.sources import storage
from sellerlens.sources.schemas import FEEDS


def feed_schema(feed: str, schema: T.StructType | None = None) -> T.StructType:
    if schema is not None:
        return schema
    if feed not in FEEDS:
        raise ValueError(f"feed {feed!r} has no fixed schema; pass the pinned one")
    return FEEDS[feed]


# Flags that bodies hold as 0 and 1 or as booleans. They are read as text and made one type here.
FLAGS = {"sales": ("IsStorno",), "orders": ("isRealization",)}


def _text_flags(feed: str, schema: T.StructType) -> T.StructType:
    fields = [T.StructField(f.name, T.StringType() if f.name in FLAGS.get(feed, ()) else f.dataType) for f in schema]
    return T.StructType(fields)


def flag(column: str) -> Column:
    """1 and 0 from numbers or booleans held as text; anything else is NULL."""
    text = F.lower(F.trim(column))
    return F.when(text.isin("1", "true", "1.0"), 1).when(text.isin("0", "false", "0.0"), 0)


def _typed_flags(df: DataFrame, feed: str, schema: T.StructType) -> DataFrame:
    return df.withColumns({c: flag(c).cast(schema[c].dataType) for c in FLAGS.get(feed, ()) if c in schema.names})


def rejects(raw: DataFrame, feed: str, column: str = "payload", schema: T.StructType | None = None) -> DataFrame:
    """Bodies that ``decode`` can't read: text that isn't JSON, or a value of the wrong type.

    Null and blank bodies aren't rejects, they hold nothing.
    """
    kind = _text_flags(feed, feed_schema(feed, schema)).add("_corrupt_record", T.StringType())
    parsed = F.from_json(F.col(column), kind, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt_record"})
    return raw.where(F.trim(column) != "").where(parsed["_corrupt_record"].isNotNull())


def read_feed(
    spark: SparkSession,
    feed: str,
    *paths: str,
    format: str = "json",
    multiline: bool = False,
    schema: T.StructType | None = None,
) -> DataFrame:
    """Read the landed files of one feed, several paths (chunks) as one table.

    One JSON object per line is splittable and the form to land at scale. ``multiline=True``
    accepts a whole response body per file, where one file is one task.
    """
    kind = feed_schema(feed, schema)
    if format != "json":
        return spark.read.schema(kind).format(format).load(list(paths))
    reader = spark.read.schema(_text_flags(feed, kind)).option("multiLine", multiline)
    return _typed_flags(reader.format(format).load(list(paths)), feed, kind)


def stream_feed(
    spark: SparkSession,
    feed: str,
    path: str,
    format: str = "json",
    files_per_trigger: int | None = None,
    schema: T.StructType | None = None,
    stamped: str | None = None,
) -> DataFrame:
    """The same feed as a stream of newly landed files.

    ``stamped`` names a column for the time a row's file landed, the event time of feeds that have none.
    """
    reader = spark.readStream.schema(feed_schema(feed, schema)).format(format)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    stream = reader.load(path)
    return stream.select("*", F.col("_metadata.file_modification_time").alias(stamped)) if stamped else stream


def decode(raw: DataFrame, feed: str, column: str = "payload", schema: T.StructType | None = None) -> DataFrame:
    """Parse JSON response bodies held in a text column into the feed's columns.

    Works on any source that delivers raw bodies (text files, a queue); other columns are
    dropped, rows whose body is not valid JSON come out as all NULL like the file reader does.
    """
    kind = feed_schema(feed, schema)
    parsed = F.from_json(F.col(column), _text_flags(feed, kind)).alias("__row")
    return _typed_flags(raw.select(parsed).select("__row.*"), feed, kind)


def decode_array(
    raw: DataFrame, element: T.StructType, column: str = "payload", field: str | None = None
) -> DataFrame:
    """Parse bodies that are a JSON list, or an object with the list under ``field``."""
    rows = T.ArrayType(element)
    if field is None:
        items = F.from_json(F.col(column), rows)
    else:
        items = F.from_json(F.col(column), T.StructType([T.StructField(field, rows)])).getField(field)
    return raw.select(F.explode(items).alias("__row")).select("__row.*")


def pin_schema(spark: SparkSession, *paths: str, multiline: bool = False) -> str:
    """Infer the schema of an unpinned feed once; store the returned JSON and reuse it."""
    return spark.read.option("multiLine", multiline).json(list(paths)).schema.json()


def load_schema(pinned: str) -> T.StructType:
    import json

    return T.StructType.fromJson(json.loads(pinned))


def read_goods_return(spark: SparkSession, schema: T.StructType, *paths: str, multiline: bool = False) -> DataFrame:
    """Goods-return files wrap their rows in ``report``; give the rows."""
    files = read_feed(spark, "goods_return", *paths, schema=schema, multiline=multiline)
    return files.select(F.explode("report").alias("__row")).select("__row.*")


def union_chunks(*chunks: DataFrame) -> DataFrame:
    """All rows of all chunks, columns matched by name, absent ones NULL."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), chunks)


def all_strings(df: DataFrame) -> DataFrame:
    """Every column as text, the form in which the seller registry is kept."""
    return df.select([F.col(f"`{c}`").cast("string").alias(c) for c in df.columns])


def changed_since(df: DataFrame, since: str, column: str = "lastChangeDate") -> DataFrame:
    """Incremental slice: rows changed at or after ``since``.

    On a table written by ``sinks.write_by_day`` by that column only the days from then on are read.
    """
    return periods.since(df, column, since)


def changed_on(df: DataFrame, day: str, column: str = "lastChangeDate") -> DataFrame:
    """Rows changed on one calendar day, as a range on the stored column so files and day partitions can be skipped."""
    return periods.days(df, column, day, day)


def after_cursor(lines: DataFrame, cursor: int, key: str = "rrd_id", sequence: str | None = None) -> DataFrame:
    """Paged lines past a cursor, each line once even where two landed pages overlap.

    Of several versions the one with the highest ``sequence`` (when its page landed) stays; without one, and on a tie, the
    largest row, so that a repeated load gives the same rows.
    """
    wanted = lines.where(F.col(key) > F.lit(cursor))
    if sequence is None:
        return storage.latest(wanted.withColumn("__none", F.lit(0)), [key], "__none").drop("__none")
    return storage.latest(wanted, [key], sequence)


def cursor_of(lines: DataFrame, key: str = "rrd_id") -> DataFrame:
    """The resume point of the next load; 0 when nothing has landed yet."""
    return lines.agg(F.coalesce(F.max(key), F.lit(0)).cast("bigint").alias("cursor"))


def lookup(df: DataFrame, column: str, value) -> DataFrame:
    return df.where(F.col(column) == F.lit(value))


def any_contains(df: DataFrame, column: str, text: str) -> DataFrame:
    """One row ``found``: does any value hold ``text``. Each task stops at its first hit."""
    hit = df.where(F.col(column).contains(text)).limit(1)
    return hit.agg((F.count(F.lit(1)) > 0).alias("found"))


def in_or_all(column: Column, values) -> Column | None:
    """IN-list condition; None or an empty list means no filter."""
    return column.isin(list(values)) if values else None
