"""Registry of runnable queries, each with its SQL twin where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]


@dataclass(frozen=True)
class Entry:
    name: str
    survey: tuple[str, ...]
    run: Query
    sql: str | None


ENTRIES: dict[str, Entry] = {}


def query(survey: str, sql: str | None = None) -> Callable[[Query], Query]:
    """Register a query under its function name."""

    def add(fn: Query) -> Query:
        if fn.__name__ in ENTRIES:
            raise ValueError(f"query {fn.__name__} is registered twice")
        ENTRIES[fn.__name__] = Entry(fn.__name__, tuple(survey.split()), fn, sql)
        return fn

    return add
