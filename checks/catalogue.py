"""All queries. Importing a module registers what it defines."""

from __future__ import annotations

from checks import classifying, cleaning, duplicates, filtering, grouping, money, reporting  # noqa: F401
from checks.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
