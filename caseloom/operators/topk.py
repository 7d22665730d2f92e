"""Ranked tables. Ties are broken by name, so a table is the same on every run."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from caseloom.functions.numbers import thousands

# fixed values: rows per kind of table
TOP_VIOLATORS = 6
TOP_REPEATS = 24


def top(df: DataFrame, by: str, tie: str, n: int) -> DataFrame:
    """Largest first. Each task keeps n rows and one merges them; nothing is sorted as a whole."""
    return df.orderBy(F.desc_nulls_last(by), F.asc(tie)).limit(n)


def listing(df: DataFrame, *keys: str) -> DataFrame:
    """All rows in key order."""
    return df.orderBy(*[F.asc(k) for k in keys])


def preview(df: DataFrame, *keys: str, n: int) -> DataFrame:
    """The first rows in key order, for a printed page; exports take the whole listing."""
    return listing(df, *keys).limit(n)


def two_way(df: DataFrame, outer: str, inner: str, label: str, measures: list[str]) -> DataFrame:
    """A subtotalled table as it is printed: by outer key, its subtotal first, numbers with separators."""
    return formatted(df.orderBy(F.asc(outer), F.desc(F.col(inner) == label), F.asc(inner)), measures)


def formatted(df: DataFrame, columns: list[str]) -> DataFrame:
    return df.withColumns({c: thousands(c) for c in columns if c in df.columns})
