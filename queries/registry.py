"""Registration of queries with their optional SQL twin."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(fn: Query) -> Query:
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return register


def r(column: str | Column, digits: int = 6) -> Column:
    """A double rounded for comparison; zero without a sign."""
    c = F.col(column) if isinstance(column, str) else column
    out = F.round(c.cast("double"), digits) + 0.0
    return out.alias(column) if isinstance(column, str) else out


def score(name: str) -> Column:
    return F.col(name).cast("double").alias(name)


def big(name: str) -> Column:
    return F.col(name).cast("bigint").alias(name)
