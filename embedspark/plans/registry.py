"""Collects the registered queries of the plan modules."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    """Registers a query under a name; without SQL it is checked by tests on small fixtures."""

    def register(function: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")
        QUERIES[name] = function
        if sql is not None:
            ORACLES[name] = sql
        return function

    return register


def r6(value: Column | str, digits: int = 6) -> Column:
    """Rounded double, so that both engines print the same value."""
    column = F.col(value) if isinstance(value, str) else value
    return F.round(column.cast("double"), digits)


def s6(expression: str, digits: int = 6) -> str:
    """SQL twin of ``r6``; adding zero turns -0.0 into 0.0."""
    return f"(round(({expression})::DOUBLE, {digits}) + 0.0)"
