"""Named queries over the test tables, each with the SQL it is checked against where there is one."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]


@dataclass(frozen=True)
class Entry:
    run: Query
    sql: str | None


class Registry:
    def __init__(self) -> None:
        self.entries: dict[str, Entry] = {}

    def add(self, key: str, run: Query, sql: str | None = None) -> None:
        if key in self.entries:
            raise ValueError(f"query {key!r} registered twice")
        self.entries[key] = Entry(run, sql)
