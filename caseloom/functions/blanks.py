"""Missing values come in several spellings; each rule names the ones it honours."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# fixed values: spellings of "no value" per kind of column
KEY_BLANKS = ("", "nan", "NAN")
ZIP_BLANKS = ("", "0", "99999")
TEXT_BLANKS = ("", "0")


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def is_blank(c: Column | str, spellings: tuple[str, ...] = KEY_BLANKS) -> Column:
    """True for null and for each listed spelling; never null itself."""
    c = _col(c)
    return c.isNull() | F.coalesce(c.isin(*spellings), F.lit(False))


def is_blank_number(c: Column | str) -> Column:
    c = _col(c)
    return c.isNull() | F.coalesce(c == 0, F.lit(False))


def none_of(c: Column | str, values: tuple[str, ...]) -> Column:
    """NOT IN that keeps nulls."""
    return ~F.coalesce(_col(c).isin(*values), F.lit(False))


def first_filled(*cols: Column | str) -> Column:
    """First alternative that is neither null nor the empty string."""
    return F.coalesce(*[F.nullif(_col(c), F.lit("")) for c in cols])


def first_nonzero(*cols: Column | str) -> Column:
    """First alternative that is neither null nor zero, else zero."""
    return F.coalesce(*[F.nullif(_col(c), F.lit(0)) for c in cols], F.lit(0))


def largest(*cols: Column | str) -> Column:
    """Largest alternative; nulls are passed over."""
    picked = [_col(c) for c in cols]
    return F.greatest(*picked) if len(picked) > 1 else picked[0]


def all_of(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a & b, conditions, F.lit(True))


def any_of(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, conditions, F.lit(False))
