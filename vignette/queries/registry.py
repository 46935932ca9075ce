"""Registration of queries: a Spark function and, where ANSI SQL can say the same, its text."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..sources.views import with_views

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None, views: tuple[str, ...] = (), more: str = "") -> Callable[[Query], Query]:
    """Registers the function under its name. views: those that the SQL reads; more: further WITH entries."""

    def register(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql is not None:
            head = with_views(*views) if views else ""
            if more:
                head = f"{head},\n{more}" if head else f"WITH {more}"
            ORACLES[f.__name__] = f"{head}\n{sql}".strip()
        return f

    return register


def cosine_sql(a: str, b: str) -> str:
    x, y = f"CAST({a} AS DOUBLE[])", f"CAST({b} AS DOUBLE[])"
    return f"round(list_inner_product({x}, {y}) / (sqrt(list_inner_product({x}, {x})) * sqrt(list_inner_product({y}, {y}))), 6)"
