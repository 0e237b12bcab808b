"""Queries with the SQL that says the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]


class Registry:
    def __init__(self) -> None:
        self.queries: dict[str, Query] = {}
        self.sql: dict[str, str] = {}

    def __call__(self, sql: str | None = None) -> Callable[[Query], Query]:
        """Register a function under its name; without SQL it is compared by rows only."""

        def add(f: Query) -> Query:
            self.queries[f.__name__] = f
            if sql is not None:
                self.sql[f.__name__] = sql
            return f

        return add


#: SQL of event frames: ep, fi, t, us, event_id, event_type, value.
FRAMES = """f as (select user_id ep, row_number() over (partition by user_id order by ts, event_id) - 1 fi,
    (epoch_us(ts) - min(epoch_us(ts)) over (partition by user_id)) / 1e6 t, epoch_us(ts) us, event_id, event_type, value from events)"""
