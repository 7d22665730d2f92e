"""Row filters. All are plain predicates, so Catalyst pushes them into the scan."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from caseloom.functions import text as T
from caseloom.functions.blanks import all_of, is_blank, none_of
from caseloom.functions.money import still_open
from caseloom.rules.closed import CLOSED

EVERYWHERE = "00000"


def date_window(start: str, end: str, first: Column, last: Column) -> Column:
    """Started in the window; or start unknown and ended in it; or both unknown."""
    s, e = F.col(start), F.col(end)
    return (s.between(first, last)
            | (s.isNull() & e.between(first, last))
            | (s.isNull() & e.isNull()))


def in_years(year: str, first: Column, last: Column) -> Column:
    """What a date window implies for a column of start years, zero standing for no date at all."""
    return F.col(year).between(F.year(first), F.year(last)) | (F.col(year) == 0)


def in_state(state_col: str, state: str) -> Column:
    """In the state, or with no state given."""
    c = F.col(state_col)
    return c.isNull() | c.isin(state, "")


def in_zips(df: DataFrame, zip_col: str, zips: DataFrame, with_generic: bool = True) -> DataFrame:
    """Rows whose zip is in ``zips(zip)``.

    The list carries no broadcast hint: Spark broadcasts it when it measures it as small.
    """
    wanted = zips.select(F.col("zip").alias(zip_col)).distinct()
    if not with_generic:
        wanted = wanted.where(~F.col(zip_col).contains("X"))
    return df.join(wanted, zip_col, "left_semi").select(*df.columns)


def in_region(df: DataFrame, zips: DataFrame | None, state_col: str = "st_cd", zip_col: str = "zip_cd",
              home_state: str | None = None, with_generic: bool = True) -> DataFrame:
    """A whole home state by its code, otherwise by zip list; no list means everywhere."""
    if home_state and state_col in df.columns:
        return df.where(in_state(state_col, home_state))
    return df if zips is None else in_zips(df, zip_col, zips, with_generic)


def label_in(label_col: str, labels: Iterable[str], code_col: str | None = None) -> Column:
    """Label equals one of the labels, whatever the case; with ``code_col``, a code must be present."""
    hit = F.upper(label_col).isin(*[x.upper() for x in labels])
    return hit & ~is_blank(code_col) if code_col else hit


def organisation(names: list[str], terms: str) -> Column:
    """Any name matches any of the ``|``-separated alternatives; no terms keep every row."""
    if not terms:
        return F.lit(True)
    hit = F.lit(False)
    for name in names:
        hit = hit | T.has_any(name, f"(?:{terms})")
    return hit


def not_from(source_col: str, switched_off: list[str]) -> Column:
    return none_of(source_col, tuple(switched_off)) if switched_off else F.lit(True)


def not_closed(columns: list[str], closed: dict[str, tuple[str, ...]] = CLOSED) -> Column:
    """No status column holds one of its closing values; unknown statuses stay."""
    return all_of([none_of(f"`{c}`", closed[c]) for c in columns if c in closed])


def open_cases(df: DataFrame, amount: str = "bw_amt", paid: str = "ee_pmt_recv",
               closed: dict[str, tuple[str, ...]] = CLOSED, gate: str = "Note") -> DataFrame:
    """Cases neither closed nor paid off. Statuses are only read if the ``gate`` column exists."""
    if gate in df.columns:
        df = df.where(not_closed([c for c in closed if c in df.columns], closed))
    return df.where(still_open(F.col(amount), F.col(paid)))


def masked(df: DataFrame, flag: str, columns: list[str], mask: str = "masked") -> DataFrame:
    """Identifying columns overwritten on flagged rows."""
    return df.withColumns({c: F.when(F.col(flag) == 1, mask).otherwise(F.col(c))
                           for c in columns if c in df.columns})


def significant(records: str = "records", amount: str = "bw_amt", min_records: int = 10,
                min_amount: int = 10000) -> Column:
    return (F.col(records) > min_records) | (F.col(amount) > min_amount)
