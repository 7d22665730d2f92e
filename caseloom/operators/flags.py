"""Flags from name lists and text marks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from caseloom.functions import text as T
from caseloom.functions.address import clean_address
from caseloom.functions.blanks import any_of
from caseloom.functions.business import clean_names
from caseloom.operators.classify import matches
from caseloom.rules import prevailing as P
from caseloom.rules.book import Rule
from caseloom.rules.industries import UNDEFINED


def _either(names: list[str], rule: Rule) -> Column:
    return any_of([matches(n, rule) for n in names])


def signatory_flag(df: DataFrame, lists: list[Rule], names: list[str], flag: str = "Signatory") -> DataFrame:
    """1 where a name is on any list and not excluded by that list; an earlier 1 stays."""
    hit = any_of([_either(names, rule) for rule in lists])
    before = F.col(flag) if flag in df.columns else F.lit(0)
    return df.withColumn(flag, F.when(hit, 1).otherwise(F.coalesce(before.cast("int"), F.lit(0))))


def signatory_industry(df: DataFrame, lists: list[Rule], names: list[str], flag: str = "Signatory",
                       industry: str = "industry", target: str = "signatory_industry") -> DataFrame:
    """The list's industry, by name, or by flag and industry; the later list wins."""
    picks = [F.when(_either(names, r) | ((F.col(flag) == 1) & (F.col(industry) == r.label)), r.label)
             for r in reversed(lists)]
    before = F.col(target) if target in df.columns else F.lit(None).cast("string")
    given = F.when(F.trim(before) != "", before)
    return df.withColumn(target, F.coalesce(*picks, given, F.lit(UNDEFINED)))


def infer_signatories(df: DataFrame, lists: list[Rule], names: list[str]) -> DataFrame:
    if not lists:
        return df.withColumns({"Signatory": F.lit(0), "signatory_industry": F.lit(UNDEFINED)})
    return signatory_industry(signatory_flag(df, lists, names), lists, names)


def flag_by_address(df: DataFrame, addresses: str, address: str = "street_addr", flag: str = "Signatory",
                    names: list[str] | None = None, name_pattern: str | None = None) -> DataFrame:
    """1 where the address is listed; with a name pattern, where a name is listed as well."""
    hit = T.has_any(address, f"(?:{addresses})")
    if name_pattern:
        hit = hit & any_of([T.has_any(n, f"(?:{name_pattern})") for n in names or []])
    before = F.col(flag) if flag in df.columns else F.lit(0)
    return df.withColumn(flag, F.when(hit, 1).otherwise(before))


def clean_list(listed: DataFrame, name: str = "legal_nm", address: str = "street_addr",
               zip_col: str = "zip_cd", loose: bool = False) -> DataFrame:
    """A list table put through the cleaning the cases get, so that names compare equal."""
    out = listed.withColumns({c: F.upper(c) for c in (name, address, "cty_nm", "st_cd") if c in listed.columns})
    out = clean_names(out, [name], loose=loose)
    if address in out.columns:
        out = clean_address(out, address, whole_words=not loose)
    return out.withColumn(zip_col, F.substring(zip_col, 1, 5)) if zip_col in out.columns else out


def listed(df: DataFrame, listed_names: DataFrame, name: str, flag: str = "Signatory") -> DataFrame:
    """1 where the cleaned name is in the cleaned list.

    The list is made unique first, so a plain left join neither repeats cases nor gathers
    them: Spark broadcasts a small list and splits a skewed name when it has to shuffle.
    """
    known = listed_names.select(F.col(name)).where(F.col(name) != "").distinct().withColumn("_listed", F.lit(1))
    return (df.join(known, name, "left")
            .select(*[df[c] for c in df.columns], F.coalesce("_listed", F.lit(0)).alias(flag)))


def prevailing_flag(df: DataFrame, reasons: list[str], sections: list[str], employers: list[str],
                    industry: str = "industry", federal: str | None = "dbra_cl_violtn_cnt",
                    code: str = "violation_code", flag: str = "Prevailing",
                    terms: str | None = None, section_pattern: str | None = None,
                    bodies: str | None = None, industries: tuple[str, ...] = P.INDUSTRIES) -> DataFrame:
    """1 for public-works marks in a relevant industry, and for federal public-works findings."""
    marks = any_of([T.has_any(c, terms or P.any_of(P.TERMS)) for c in reasons]
                   + [T.has_any(c, section_pattern or P.section_pattern()) for c in sections]
                   + [T.has_any(c, bodies or P.any_of(P.PUBLIC_BODIES)) for c in employers])
    hit = marks & F.coalesce(F.col(industry).isin(*industries), F.lit(False))
    before = F.coalesce(F.col(flag).try_cast("int"), F.lit(0)) if flag in df.columns else F.lit(0)
    if federal and federal in df.columns:
        found = F.coalesce(F.col(federal) > 0, F.lit(False))
        return df.withColumns({flag: F.when(hit | found, 1).otherwise(before),
                               code: F.when(found, P.FEDERAL_CODE).otherwise(F.col(code))})
    return df.withColumn(flag, F.when(hit, 1).otherwise(before))
