"""The three combined steps: clean, infer, shape."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from caseloom.functions import text as T
from caseloom.functions.address import clean_address
from caseloom.functions.business import clean_names
from caseloom.functions.money import wages_owed
from caseloom.functions.numbers import clean_number
from caseloom.operators.agency import infer_agency
from caseloom.operators.classify import infer_detail, infer_industry
from caseloom.operators.dedup import drop_duplicates, drop_shared_duplicates, flag_groups, mark_shared
from caseloom.operators.filters import date_window, in_region, in_state, in_years, label_in, open_cases
from caseloom.operators.flags import infer_signatories, prevailing_flag
from caseloom.operators.impute import count_violations, fill_penalties, fill_wages, owed_amounts, wage_means
from caseloom.operators.places import Place, infer_zip
from caseloom.rules.book import Rule
from caseloom.rules.industries import all_details, detail_names
from caseloom.sources import layout as L

NAMES = ["legal_nm", "trade_nm"]
ORDER = [L.ROW]
SORTED_BY = ["bw_amt", "interest_owed"]

# fixed values: keys of the diagnostic duplicate flags
GROUP_FLAGS = {
    "_Case_X": ["case_id_1", "violation", "bw_amt"],
    "_T_NM_X": ["case_id_1", "trade_nm", "street_addr", "violation", "bw_amt"],
    "_L-NM_X": ["case_id_1", "legal_nm", "street_addr", "violation", "bw_amt"],
}
AMOUNT_FLAGS = {
    "_DUP_BW": ["case_id_1", "legal_nm", "violation", "bw_amt"],
    "_DUP_PMT_REC": ["case_id_1", "legal_nm", "violation", "ee_pmt_recv"],
    "_DUP_PMT_DUE": ["case_id_1", "legal_nm", "bw_amt"],
}


def clean_measures(df: DataFrame, columns: list[str], to: str = "double") -> DataFrame:
    """Measures as absolute numbers; a measure the table lacks becomes zero."""
    return df.withColumns({c: clean_number(c, to) if c in df.columns else F.lit(0).cast(to) for c in columns})


def one_line_texts(df: DataFrame) -> DataFrame:
    texts = [f.name for f in df.schema.fields if f.dataType.simpleString() == "string"]
    return df.withColumns({c: T.one_line(f"`{c}`") for c in texts})


def clean_texts(df: DataFrame, loose: bool = False) -> DataFrame:
    """Address, city, then names with their legal forms."""
    df = clean_address(df, "street_addr", whole_words=not loose)
    df = df.withColumn("cty_nm", T.city_punctuation("cty_nm"))
    return clean_names(df, NAMES, loose=loose)


def typed(df: DataFrame, upper: list[str], zip_col: str = "zip_cd", numbers: dict[str, str] | None = None) -> DataFrame:
    """Zips of five characters, names in capitals, texts that hold numbers parsed or null."""
    zip5 = F.substring(zip_col, 1, 5)
    return df.withColumns({
        zip_col: F.coalesce(F.when(zip5.contains("nan"), F.replace(zip5, F.lit("nan"), F.lit("0"))).otherwise(zip5), F.lit("0")),
        **{c: F.upper(c) for c in upper if c in df.columns},
        **{c: F.replace(F.col(c).cast("string"), F.lit(","), F.lit("")).try_cast(kind) for c, kind in (numbers or {}).items()},
    })


DEDUP = ("case_id_1", "violation", SORTED_BY, "Businesstype", ORDER)
SHARED, YEAR, DETAIL, DELETED = "shared", "start_year", "industry_detail", "_DELETED_DUP"


CROSS = ["case_id_1", "violation"]


def clean_step(df: DataFrame, loose: bool = False, flag_only: bool = False) -> DataFrame:
    """Texts on one line and cleaned, types settled, duplicates within each source dropped.

    With ``flag_only`` every row stays: ``_DELETED_DUP`` marks those that would go, and six further
    flags name the keys they share with other rows.
    """
    return settle_duplicates(clean_values(df, loose), flag_only)


def clean_values(df: DataFrame, loose: bool = False) -> DataFrame:
    """The half of the cleaning that looks at one row at a time."""
    df = clean_texts(one_line_texts(df), loose=loose)
    return typed(df, ["legal_nm", "trade_nm", "street_addr", "cty_nm", "st_cd"])


def settle_duplicates(df: DataFrame, flag_only: bool = False, split: bool = False) -> DataFrame:
    """The half that compares rows. ``split`` shuffles only rows that have a rival, for cleaned rows read from files."""
    return with_duplicate_flags(df) if flag_only else drop_duplicates(df, *DEDUP, within=[L.SOURCE], split=split)


def mark_cross_source(df: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """Which cases several sources report, settled once per refresh: whether one of them has to go depends on the
    sources a report uses, but which ones might does not. 1 or 0, since a folder name cannot be read back as a boolean."""
    return mark_shared(df, CROSS, ORDER, SHARED, known).withColumn(SHARED, F.col(SHARED).cast("int"))


def across_sources(df: DataFrame, wanted: Column | None = None) -> DataFrame:
    """Duplicates across sources dropped; a marked snapshot shuffles only what several sources report. With ``wanted``
    only rows for which it holds are left."""
    if SHARED in df.columns:
        return drop_shared_duplicates(df, SHARED, *DEDUP, wanted=wanted)
    return drop_duplicates(df, *DEDUP, wanted=wanted)


def with_duplicate_flags(df: DataFrame) -> DataFrame:
    """Diagnostic columns: one per key that several rows share, and which rows a cleaning would drop."""
    flags = {**GROUP_FLAGS, **AMOUNT_FLAGS}
    case, violation, amounts, form, order = DEDUP
    df = df.withColumn(case, F.trim(case))
    return flag_groups(df, flags, L.ROW, DELETED, [L.SOURCE, case, violation], amounts, form, order, apart=True)


def infer_step(df: DataFrame, places: list[Place], industries: list[Rule], with_zips: bool = True) -> DataFrame:
    """Zip, industry, agency, prevailing flag and wages owed: expressions only, no shuffle."""
    if with_zips and places:
        df = infer_zip(df, places)
    df = infer_industry(df, industries, NAMES, "naics_desc", "naic_cd")
    df = infer_detail(df, all_details(), NAMES, "naics_desc", "naic_cd")
    df = infer_agency(df)
    df = prevailing_flag(df, ["Reason For Closing", "`Closure Disposition - Other Reason`"],
                         ["violation_code", "violation", "Note"], ["legal_nm"])
    return df.withColumn("wages_owed", wages_owed())


def scope_step(df: DataFrame, zips: DataFrame | None, labels: list[str] | None, first: Column, last: Column,
               signatories: list[Rule], home_state: str | None = None, with_generic: bool = True,
               by_code_only: bool = False) -> DataFrame:
    """The rows one report is about: duplicates across sources, date, region, industry, flags.

    A case outside the window, the state or the industry still displaces its duplicates, but only its key and rank
    take part in that.
    """
    wanted = date_window("findings_start_date", "findings_end_date", first, last)
    if YEAR in df.columns:
        # adds nothing to the window, but names a folder of the snapshot
        wanted = wanted & in_years(YEAR, first, last)
    by_state = bool(home_state) and "st_cd" in df.columns
    if by_state:
        wanted = wanted & in_state("st_cd", home_state)
    if labels:
        code = "naic_cd" if by_code_only else None
        labelled = label_in("industry", labels, code)
        if DETAIL in df.columns and any(x in detail_names() for x in labels):
            labelled = labelled | F.coalesce(label_in(DETAIL, labels, code), F.lit(False))
        wanted = wanted & labelled
    df = across_sources(df, wanted)
    return infer_signatories(df if by_state else in_region(df, zips, with_generic=with_generic), signatories, NAMES)


def fill_step(df: DataFrame, as_of: Column, assume: bool = True, open_only: bool = False) -> DataFrame:
    """Counts and amounts filled in from the scoped rows, and open cases if asked for.

    One aggregate over ``df`` and otherwise expressions; ``df`` is best materialised.
    """
    if assume:
        df = count_violations(df)
        means = wage_means(df)
        df = owed_amounts(fill_penalties(fill_wages(df, means), means), as_of)
    return open_cases(df) if open_only else df
