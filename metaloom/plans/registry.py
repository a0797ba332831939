"""Registry of verification queries: one Spark builder and, where SQL can say it, one ANSI-SQL twin."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Builder = Callable[[SparkSession, str], DataFrame]


class Registry:
    def __init__(self) -> None:
        self.builders: dict[str, Builder] = {}
        self.sql: dict[str, str] = {}

    def query(self, name: str, sql: str | None = None) -> Callable[[Builder], Builder]:
        def add(fn: Builder) -> Builder:
            if name in self.builders:
                raise ValueError(f"duplicate query {name}")
            self.builders[name] = fn
            if sql:
                self.sql[name] = sql
            return fn

        return add
