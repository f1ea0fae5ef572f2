"""Compare registered queries with their SQL on DuckDB, value by value."""

from __future__ import annotations

import datetime as dt
import math

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def connect(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{folder}/{name}.parquet'")
    return con


def _plain(value):
    if isinstance(value, float) and math.isnan(value):
        return None
    if isinstance(value, (dt.datetime, dt.date)):
        return value.isoformat()
    return value


def _sorted(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    out = [tuple(_plain(row[i]) for i in order) for row in rows]
    return sorted(out, key=lambda t: tuple((v is None, str(type(v)), v if v is not None else 0) for v in t))


def spark_rows(df):
    return sorted(df.columns), _sorted(df.columns, [tuple(r) for r in df.collect()])


def duck_rows(con, text):
    cur = con.execute(text)
    names = [c[0] for c in cur.description]
    kinds = {c[0]: str(c[1]) for c in cur.description}
    return sorted(names), _sorted(names, cur.fetchall()), kinds


FAMILIES = {
    "bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN",
}


def differences(df, con, text) -> list[str]:
    """Empty when columns, types, row count and all values agree exactly."""
    names, got = spark_rows(df)
    want_names, want, kinds = duck_rows(con, text)
    out = []
    if names != want_names:
        return [f"columns {names} != {want_names}"]
    for name, kind in df.dtypes:
        if FAMILIES.get(kind) != kinds[name]:
            out.append(f"type of {name}: {kind} != {kinds[name]}")
    if len(got) != len(want):
        out.append(f"rows {len(got)} != {len(want)}")
    bad = [(g, w) for g, w in zip(got, want) if g != w]
    if bad:
        out.append(f"{len(bad)} rows differ, first {bad[0][0]} != {bad[0][1]}")
    return out
