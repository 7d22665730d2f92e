"""Numbers that arrive as text, and numbers that leave as text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

MONEY = "decimal(18,2)"

# a plain or scientific number; Java would also take "12d" and "Infinity"
_NUMBER = r"^\s*[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?\s*$"


def clean_number(c: Column | str, to: str = "double") -> Column:
    """``$1,234.50`` -> 1234.50, ``(500)`` -> 500, a typographic minus is dropped, text -> 0."""
    c = F.col(c) if isinstance(c, str) else c
    text = F.translate(c.cast("string"), "−($,)", "--")
    value = F.when(text.rlike(_NUMBER), F.trim(text).try_cast(to))
    return F.abs(F.coalesce(value, F.lit(0).cast(to)))


def money(c: Column | str) -> Column:
    c = F.col(c) if isinstance(c, str) else c
    return c.cast(MONEY)


def thousands(c: Column | str) -> Column:
    """Thousands separators, no decimals, half to even."""
    return F.format_number(F.col(c) if isinstance(c, str) else c, 0)


def plugged_mean(mean: Column, ceiling: float, plug: float) -> Column:
    """A mean, or the plug where the mean is missing, zero or above the ceiling."""
    return F.when(mean.isNull() | (mean == 0) | (mean > ceiling), F.lit(plug)).otherwise(mean)
