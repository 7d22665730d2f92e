"""Headline figures. Each is one aggregate, or aggregates of an aggregate."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from caseloom.functions.money import DAYS_PER_YEAR
from caseloom.operators.group import total
from caseloom.rules.penalties import PENALTY_SHARE

# fixed values: yearly total the sample is set against, labels, cut-offs
YEARLY_TOTAL = 22e9
SHORT_LABEL = "<Not Defined>"
LEAST_ZIP_AMOUNT = 3000
NEAR = 0.05


def dollars(c: Column) -> Column:
    return c.cast("double")


def totals(df: DataFrame, measures: dict[str, str]) -> DataFrame:
    """One row of sums; ``measures`` maps column to output name."""
    return df.agg(*[dollars(total(c)).alias(name) for c, name in measures.items()])


def overview(df: DataFrame, amount: str = "bw_amt", paid: str = "ee_pmt_recv", count: str = "violtn_cnt",
             ee: str = "ee_violtd_cnt") -> DataFrame:
    return df.agg(F.count(F.lit(1)).alias("cases"), dollars(total(count)).alias("violations"),
                  dollars(total(ee)).alias("employees"), dollars(total(amount)).alias("back_wages"),
                  dollars(total(paid)).alias("returned"))


def coverage(df: DataFrame, amount: str = "bw_amt", start: str = "findings_start_date",
             yearly_total: float = YEARLY_TOTAL) -> DataFrame:
    """Date range, and the yearly amount as a percentage of an estimated yearly total."""
    one = df.agg(F.min(start).alias("first"), F.max(start).alias("last"), dollars(total(amount)).alias("amount"))
    years = F.datediff("last", "first") / F.lit(float(DAYS_PER_YEAR))
    percent = F.try_divide(F.try_divide(F.col("amount"), years), F.lit(yearly_total)) * 100
    return one.select("first", "last", "amount", percent.alias("percent_of_total"))


ROLLED = ("violtn_cnt", "ee_violtd_cnt", "bw_amt", "ee_pmt_recv")


def roll_up(df: DataFrame, by: list[str]) -> DataFrame:
    """Counts, sums and first and last dates per group. Roll-ups of parts of a table add up to that of the whole."""
    return df.groupBy(*by).agg(F.count(F.lit(1)).alias("cases"), *[total(m).alias(m) for m in ROLLED],
                               F.min("findings_start_date").alias("first"), F.max("findings_start_date").alias("last"))


def merged(rolled: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Roll-ups added up, per group or to one row."""
    return rolled.groupBy(*(by or [])).agg(total("cases").cast("bigint").alias("cases"), *[total(m).alias(m) for m in ROLLED],
                                           F.min("first").alias("first"), F.max("last").alias("last"))


def overview_and_coverage(df: DataFrame, keep: Callable[[DataFrame], DataFrame] = lambda one: one) -> tuple[DataFrame, DataFrame]:
    """Both tables from one pass over the columns they need; ``keep`` holds on to its one row."""
    return overview_and_coverage_of(roll_up(df.select(*ROLLED, "findings_start_date"), []), keep)


def overview_and_coverage_of(rolled: DataFrame, keep: Callable[[DataFrame], DataFrame] = lambda one: one) -> tuple[DataFrame, DataFrame]:
    """The same from roll-ups."""
    one = keep(merged(rolled).select("cases", dollars(F.col("violtn_cnt")).alias("violations"), dollars(F.col("ee_violtd_cnt")).alias("employees"),
                                     dollars(F.col("bw_amt")).alias("back_wages"), dollars(F.col("ee_pmt_recv")).alias("returned"), "first", "last"))
    years = F.datediff("last", "first") / F.lit(float(DAYS_PER_YEAR))
    percent = F.try_divide(F.try_divide(F.col("back_wages"), years), F.lit(YEARLY_TOTAL)) * 100
    return (one.select("cases", "violations", "employees", "back_wages", "returned"),
            one.select("first", "last", F.col("back_wages").alias("amount"), percent.alias("percent_of_total")))


def status_shares(df: DataFrame, status: str) -> DataFrame:
    """Cases per status and their share of all cases, unknown statuses counting in the whole only."""
    everything = df.agg(F.count(F.lit(1))).scalar()
    counted = df.where(F.col(status).isNotNull()).groupBy(status).agg(F.count(F.lit(1)).alias("cases"))
    return counted.where("cases > 1").select(
        F.when(F.length(status) < 3, SHORT_LABEL).otherwise(F.col(status)).alias("status"), "cases",
        (F.col("cases") / everything).alias("share"))


def report_summary(df: DataFrame, employers: DataFrame, multi: DataFrame, amount: str = "bw_amt",
                   owed: str = "backwage_owed", ee: str = "ee_violtd_cnt", count: str = "violtn_cnt") -> DataFrame:
    """One row for the whole report. ``employers`` are grouped cases, ``multi`` multi-agency ones."""
    base = df.agg(F.count(F.lit(1)).alias("cases"), dollars(total(amount)).alias("back_wages"),
                  dollars(total(owed)).alias("total_owed"), dollars(total(ee)).alias("employees"),
                  dollars(total(count)).alias("violations"))
    per_head = F.floor(F.try_divide(F.col("back_wages"), F.col("employees"))).cast("double")
    grouped = employers.agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("records") > 1).alias("repeat"))
    both = grouped.select(F.struct("n", "repeat")).scalar()
    return base.select(
        "cases", "back_wages", per_head.alias("wage_per_employee"),
        (per_head * PENALTY_SHARE).alias("penalty_per_employee"), "total_owed", "employees", "violations",
        F.floor(F.try_divide(F.col("violations"), F.col("employees"))).cast("double").alias("violations_per_employee"),
        both["n"].alias("employers"), both["repeat"].alias("repeat_employers"),
        multi.agg(F.count(F.lit(1))).scalar().alias("multi_agency_employers"))


def headline(df: DataFrame, amount: str = "bw_amt") -> DataFrame:
    return df.agg(F.count(F.lit(1)).alias("cases"), dollars(total(amount)).alias("back_wages"))


def city_summary(by_employer: DataFrame, multi: DataFrame, city: str = "cty_nm", employer: str = "legal_nm",
                 owed: str = "backwage_owed") -> DataFrame:
    """Per city: totals, employers, multi-agency employers, and who owes most.

    ``by_employer`` has one row per (city, employer); ``multi`` one per (city, multi-agency
    employer). The top employer is an aggregate, ties going to the first name.
    """
    top = F.min_by(employer, F.struct((-F.col(owed)).alias("owed"), F.col(employer)))
    per_city = by_employer.groupBy(city).agg(
        F.sum("records").alias("cases"), dollars(total("bw_amt")).alias("stolen"),
        dollars(total("ee_pmt_recv")).alias("returned"), dollars(total("violtn_cnt")).alias("violations"),
        dollars(total("ee_violtd_cnt")).alias("workers"), F.count(F.lit(1)).alias("employers"),
        top.alias("top_employer"), dollars(F.max(owed)).alias("top_owed"))
    counted = multi.groupBy(city).agg(F.count(F.lit(1)).alias("multi_agency_employers"))
    return per_city.join(counted, city, "left").withColumn(
        "multi_agency_employers", F.coalesce("multi_agency_employers", F.lit(0)))


def largest_per(df: DataFrame, within: str, amount: str, tie: str, n: int = 3) -> DataFrame:
    """The n largest rows of each group, ranked; Spark keeps n per group and task before it shuffles."""
    ranked = F.row_number().over(W.partitionBy(within).orderBy(F.desc_nulls_last(amount), F.asc(tie)))
    return df.withColumn("place", ranked).where(F.col("place") <= n)


def zip_summary(fine: DataFrame, several_industries: bool, city: str = "cty_nm", zip_col: str = "zip_cd",
                industry: str = "industry", least: int = LEAST_ZIP_AMOUNT) -> DataFrame:
    """Per zip of a city: workers, amount, leading industry, and whether it rivals the largest line.

    ``fine`` has one row per (city, zip, industry, employer).
    """
    peak = fine.agg(F.max(dollars(F.col("bw_amt")))).scalar()
    per_industry = fine.groupBy(city, zip_col, industry).agg(
        F.sum("bw_amt").alias("bw_amt"), F.sum("ee_violtd_cnt").alias("ee"))
    top = F.min_by(industry, F.struct((-F.col("bw_amt")).alias("amount"), F.col(industry)))
    zips = per_industry.groupBy(city, zip_col).agg(
        dollars(total("ee")).alias("workers"), dollars(total("bw_amt")).alias("stolen"),
        (top if several_industries else F.lit(None).cast("string")).alias("top_industry"))
    near = F.abs(F.col("stolen") - peak) <= F.lit(NEAR) * F.greatest(F.abs("stolen"), F.abs(peak))
    return zips.where(F.col("stolen") >= least).withColumn("near_highest", near)


def signatory_share(df: DataFrame, owed: str = "backwage_owed", industry: str = "industry",
                    listed: str = "signatory_industry", build: str = "Construction",
                    hospitals: str = "Health_care",
                    care: tuple[str, ...] = ("Carehome", "Health_care", "Residential_carehome"),
                    detail: str = "industry_detail") -> DataFrame:
    """What listed employers owe, out of what their industries owe."""
    def owing(condition: Column) -> Column:
        return dollars(F.coalesce(F.sum(F.when(condition, F.col(owed))), F.lit(0)))

    labelled = F.col(industry).isin(*care)
    if detail in df.columns:
        labelled = labelled | F.coalesce(F.col(detail).isin(*care), F.lit(False))
    one = df.agg(dollars(total(owed)).alias("all_owed"),
                 owing(F.col(listed) == build).alias("build_listed"),
                 owing(F.col(industry) == build).alias("build_all"),
                 owing(F.col(listed) == hospitals).alias("care_listed"),
                 owing(labelled).alias("care_all"))
    return one.select("*", F.try_divide("build_listed", "build_all").alias("build_share"),
                      F.try_divide("care_listed", "care_all").alias("care_share"))
