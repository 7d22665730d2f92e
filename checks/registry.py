"""Where the queries put themselves."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str) -> Callable[[Query], Query]:
    """Register a query and its SQL under one name."""
    def put(fn: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"two queries named {name}")
        QUERIES[name] = fn
        ORACLES[name] = sql
        return fn
    return put


def num(c: str | Column, name: str | None = None) -> Column:
    """Decimals leave as doubles; sums were taken before, in decimal."""
    col = F.col(c) if isinstance(c, str) else c
    return col.cast("double").alias(name or c)


def text(c: str, name: str | None = None) -> Column:
    return F.col(c).cast("string").alias(name or c)
