"""Helpers of the query modules."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


class Area:
    """Collects the queries and SQL of one module."""

    def __init__(self) -> None:
        self.queries: dict[str, Callable] = {}
        self.sql: dict[str, str] = {}

    def query(self, name: str, sql: str | None = None):
        def add(f: Callable) -> Callable:
            self.queries[name] = f
            if sql is not None:
                self.sql[name] = sql
            return f

        return add


def once(df: DataFrame, *columns: str) -> DataFrame:
    """The columns, evaluated once a row: without the generator, filters above would repeat their expressions."""
    return df.select(F.inline(F.array(F.struct(*columns))))


def sql_list(values) -> str:
    return "[" + ", ".join("'" + v.replace("'", "''") + "'" for v in values) + "]"


def sql_in(values) -> str:
    return "(" + sql_list(values)[1:-1] + ")"
