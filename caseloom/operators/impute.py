"""Gaps in counts and amounts, filled from the filtered set as a whole.

Every figure an imputation needs (mean back wage before and after filling, violations per
employee) comes out of one aggregate over the set, read as a scalar subquery: the second
mean is worked out from the sums instead of from a second pass over filled rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from caseloom.functions.blanks import is_blank_number
from caseloom.functions.money import floor_zero, interest_owed, total_owed, wages_owed
from caseloom.functions.numbers import money, plugged_mean
from caseloom.operators.lookup import term_amount
from caseloom.rules.penalties import MEAN_CEILING, MEAN_PLUG, PENALTIES, PENALTY_SHARE

ISSUE = "Issue"


def employees(c: Column | str = "ee_violtd_cnt") -> Column:
    """At least one employee."""
    c = F.col(c) if isinstance(c, str) else c
    return F.when(is_blank_number(c), F.lit(1)).otherwise(c)


def violations(count: str = "violtn_cnt", text: str = "violation", ee: str = "ee_violtd_cnt",
               word: str = ISSUE) -> Column:
    """The count given, else how often the word occurs in the text, else the employees."""
    given = F.when(~is_blank_number(count), F.col(count))
    named = F.nullif(F.regexp_count(F.coalesce(F.col(text), F.lit("")), F.lit(word)), F.lit(0))
    return F.coalesce(given, named, employees(ee))


def count_violations(df: DataFrame, count: str = "violtn_cnt", text: str = "violation",
                     ee: str = "ee_violtd_cnt", word: str = ISSUE) -> DataFrame:
    return df.withColumns({count: violations(count, text, ee, word), ee: employees(ee)})


def violations_per_employee(df: DataFrame, count: str = "violtn_cnt", ee: str = "ee_violtd_cnt") -> Column:
    """Whole violations per employee over the set, at least one."""
    most = F.greatest(F.sum(count), F.sum(ee))
    return df.agg(F.greatest(F.floor(F.try_divide(most, F.sum(ee))), F.lit(1))).scalar()


def fill_counts(df: DataFrame, per_employee: Column, count: str = "violtn_cnt") -> DataFrame:
    """Counts still missing get the set's violations per employee."""
    return df.withColumn(count, F.when(is_blank_number(count), per_employee).otherwise(F.col(count)))


def wage_means(df: DataFrame, amount: str = "bw_amt", ee: str = "ee_violtd_cnt") -> Column:
    """Struct of the mean back wage before filling gaps and after, each plugged if implausible."""
    gap = is_blank_number(amount)
    sums = df.agg(
        F.sum(money(amount)).alias("given"), F.count(amount).alias("present"),
        F.sum(F.when(gap, employees(ee)).cast("decimal(18,2)")).alias("gap_employees"),
        F.count(F.lit(1)).alias("rows"))
    before = plugged_mean(F.try_divide(F.col("given").cast("double"), F.col("present")), MEAN_CEILING, MEAN_PLUG)
    after = F.try_divide(
        F.coalesce(F.col("given"), F.lit(0)).cast("double")
        + F.coalesce(F.col("gap_employees"), F.lit(0)).cast("double") * F.col("before"), F.col("rows"))
    return (sums.withColumn("before", before)
            .select(F.struct("before", plugged_mean(after, MEAN_CEILING, MEAN_PLUG).alias("after")))
            .scalar())


def fill_wages(df: DataFrame, means: Column, amount: str = "bw_amt", ee: str = "ee_violtd_cnt",
               count: str = "violtn_cnt", assumed: str = "assumed_backwage") -> DataFrame:
    """A missing amount is the mean back wage per employee, and says that it was assumed."""
    gap = is_blank_number(amount)
    before = F.col(assumed) if assumed in df.columns else F.lit("NO")
    return df.withColumns({
        assumed: F.when(gap, "YES").otherwise(before),
        amount: F.when(gap, money(employees(ee) * means["before"])).otherwise(money(amount)),
        count: F.when(is_blank_number(count), employees(ee)).otherwise(F.col(count)),
        ee: employees(ee),
    })


def penalty_terms(mean: Column) -> list[tuple[str, Column]]:
    return [(term, mean if amount is None else F.lit(float(amount))) for term, amount in PENALTIES]


def fill_penalties(df: DataFrame, means: Column, penalty: str = "cmp_assd_cnt", text: str = "violation",
                   ee: str = "ee_violtd_cnt", assumed: str | None = None) -> DataFrame:
    """Missing penalties are a share of the mean back wage.

    Where the ``assumed`` column says YES, the penalty is looked up by violation instead and
    multiplied by the employees.
    """
    generic = means["after"] * F.lit(PENALTY_SHARE)
    own = F.col(penalty) if penalty in df.columns else F.lit(None)
    if assumed:
        looked_up = term_amount(text, penalty_terms(means["after"]), generic) * F.col(ee)
        own = F.when(F.col(assumed) == "YES", looked_up).otherwise(own)
    return df.withColumn(penalty, money(F.when(is_blank_number(own), generic).otherwise(own)))


def owed_amounts(df: DataFrame, as_of: Column, amount: str = "bw_amt", paid: str = "ee_pmt_recv",
                 penalty: str = "cmp_assd_cnt", interest_paid: str = "Interest_Payments_Recd",
                 start: str = "findings_start_date", end: str = "findings_end_date") -> DataFrame:
    """Wages, interest to date, and the two with the penalty."""
    df = df.withColumn("wages_owed", wages_owed(amount, paid))
    days = F.datediff(as_of, F.coalesce(F.col(start), F.col(end)))
    interest = interest_owed(F.col("wages_owed"), days, floor_zero(F.col(interest_paid)))
    df = df.withColumn("interest_owed", interest)
    return df.withColumn("backwage_owed", money(total_owed(F.col("wages_owed"), money(penalty), F.col("interest_owed"))))
