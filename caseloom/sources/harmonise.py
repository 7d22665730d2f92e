"""From a source's own headers to the canonical case table."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from caseloom.functions.blanks import TEXT_BLANKS, first_filled, first_nonzero, is_blank, largest
from caseloom.functions.numbers import clean_number
from caseloom.sources import layout as L

DATE_FORMATS = ("yyyy-MM-dd", "M/d/yyyy", "yyyy/M/d", "d-M-yyyy", "yyyy-MM-dd HH:mm:ss", "M/d/yy")
DAY_FIRST = ("yyyy-MM-dd", "d/M/yyyy", "M/d/yyyy", "yyyy/M/d", "d-M-yyyy", "yyyy-MM-dd HH:mm:ss")


def tagged(df: DataFrame, tag: str) -> DataFrame:
    """The source in a column nothing else writes to, and as first agency label."""
    return df.withColumns({L.SOURCE: F.lit(tag), "juris_or_proj_nm": F.lit(tag)})


def parse_date(c: Column | str, formats: tuple[str, ...] = DATE_FORMATS) -> Column:
    """First format that fits; a date that fits none is null."""
    c = F.col(c) if isinstance(c, str) else c
    return F.coalesce(*[F.try_to_timestamp(c, F.lit(f)) for f in formats]).cast("date")


def _present(df: DataFrame, headers: tuple[str, ...]) -> list[Column]:
    return [F.col(f"`{h}`") for h in headers if h in df.columns]


def harmonise(df: DataFrame, date_formats: tuple[str, ...] = DATE_FORMATS) -> DataFrame:
    """Rename, coalesce alternatives, add what is missing, and select the canonical columns.

    One projection: alternatives are resolved by expressions over the source's own columns.
    """
    df = df.drop(*[c for c in L.UNUSED if c in df.columns])
    df = df.withColumnsRenamed({old: new for old, new in L.RENAMED.items()
                                if old in df.columns and new not in df.columns})
    chosen: list[Column] = []
    for name, (kind, default) in L.COLUMNS.items():
        if name in L.LARGEST and (found := _present(df, L.LARGEST[name])):
            value = largest(*[clean_number(c, kind.simpleString()) for c in found])
        elif name in L.NONZERO and (found := _present(df, L.NONZERO[name])):
            value = first_nonzero(*[clean_number(c, kind.simpleString()) for c in found])
        elif name in L.FILLED and (found := _present(df, L.FILLED[name])):
            value = first_filled(*[c.cast("string") for c in found])
            value = parse_date(value, date_formats) if default is None else F.coalesce(value, F.lit(default))
        elif name in df.columns and name in L.MEASURED:
            value = clean_number(f"`{name}`", kind.simpleString())
        elif name in df.columns:
            value = F.col(f"`{name}`").try_cast(kind)
        else:
            value = F.lit(default)
        # a blank cell and a column the source lacks mean the same, or keys would not meet
        value = value.cast(kind)
        chosen.append((value if default is None else F.coalesce(value, F.lit(default).cast(kind))).alias(name))
    keep = [F.col(c) for c in (L.SOURCE, L.ROW, *L.PLACE) if c in df.columns]
    return home_state(df.select(*chosen, *keep))


def home_state(df: DataFrame, source: str = L.SOURCE, state: str = "st_cd") -> DataFrame:
    """State sources hold cases of their own state, whether they say so or not."""
    if source not in df.columns:
        return df
    missing = F.col(source).isin(*L.HOME_SOURCES) & is_blank(state, ("",))
    return df.withColumn(state, F.when(missing, L.HOME_STATE).otherwise(F.col(state)))


def stack(tables: list[DataFrame]) -> DataFrame:
    """Union by name; a column a table lacks is null."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), tables)


def fill_status(df: DataFrame, end: str = "findings_end_date", status: str = "Case Status",
                filler: str = "APPEARS OPEN: NO END + NO STATUS") -> DataFrame:
    """Cases with neither an end nor a status are taken to be open."""
    no_end = F.col(end).isNull() | F.col(end).cast("string").isin(*TEXT_BLANKS)
    return df.withColumn(status, F.when(no_end & is_blank(f"`{status}`", TEXT_BLANKS), filler).otherwise(F.col(f"`{status}`")))
