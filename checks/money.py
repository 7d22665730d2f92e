"""Imputed counts and amounts, wages and interest owed."""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from caseloom.operators import impute as I
from checks.cases import ORDER, cases, cases_sql, table
from checks.classifying import _terms_sql
from checks.registry import num, query

AS_OF = date(2003, 6, 30)
MONEY = "CAST({} AS DECIMAL(18,2))"
OWED = {"penalty": ("", "case when l_linenumber = 2 then null else cast(l_tax * 1000 as decimal(18,2)) end")}
GROWTH_SQL = "pow(1 + 0.07 / 365, date_diff('day', coalesce(findings_start_date, findings_end_date), DATE '2003-06-30'))"


def owed_sql(source: str, amount: str, penalty: str, interest: str = "interest_paid") -> str:
    """Wages, then interest on them, then the sum with the penalty, as chained expressions."""
    return f"""w AS (SELECT *, CASE WHEN {MONEY.format(amount)} - {MONEY.format('ee_pmt_recv')} < 0 THEN 0
    ELSE {MONEY.format(amount)} - {MONEY.format('ee_pmt_recv')} END AS wages FROM {source}),
  i AS (SELECT *, CAST(wages AS DOUBLE) * {GROWTH_SQL} - CAST(wages AS DOUBLE) - CAST({interest} AS DOUBLE) AS accrued FROM w),
  owed AS (SELECT *, CAST(CASE WHEN accrued < 0 THEN 0 ELSE accrued END AS DECIMAL(18,2)) AS interest,
    wages + CAST({penalty} AS DECIMAL(18,2)) + CAST(CASE WHEN accrued < 0 THEN 0 ELSE accrued END AS DECIMAL(18,2)) AS owed FROM i)"""


@query("wages_interest_owed", f"""WITH {cases_sql(OWED)}, {owed_sql('cases', 'bw_amt', 'penalty')}
SELECT ord1, ord2, ord3, CAST(wages AS DOUBLE) AS wages_owed, CAST(interest AS DOUBLE) AS interest_owed,
  CAST(owed AS DOUBLE) AS backwage_owed FROM owed""")
def wages_interest_owed(spark: SparkSession, sf: str) -> DataFrame:
    df = cases(spark, sf, [*ORDER, "bw_amt", "ee_pmt_recv", "interest_paid", "findings_start_date", "findings_end_date"], OWED)
    owed = I.owed_amounts(df, F.lit(AS_OF), penalty="penalty", interest_paid="interest_paid")
    return owed.select(*ORDER, num("wages_owed"), num("interest_owed"), num("backwage_owed"))


COUNTED_SQL = """CASE WHEN ee_violtd_cnt IS NULL OR ee_violtd_cnt = 0 THEN 1 ELSE ee_violtd_cnt END"""


@query("violation_counts", f"""WITH {cases_sql()}
SELECT ord1, ord2, ord3, CAST(coalesce(nullif(violtn_cnt, 0), nullif(len(regexp_extract_all(violation, 'Issue')), 0), {COUNTED_SQL}) AS DOUBLE)
  AS violtn_cnt, CAST({COUNTED_SQL} AS DOUBLE) AS ee_violtd_cnt FROM cases""")
def violation_counts(spark: SparkSession, sf: str) -> DataFrame:
    df = I.count_violations(cases(spark, sf, [*ORDER, "violtn_cnt", "violation", "ee_violtd_cnt"]))
    return df.select(*ORDER, num("violtn_cnt"), num("ee_violtd_cnt"))


@query("document_word_counts", """SELECT doc_id, CAST(coalesce(nullif(len(regexp_extract_all(text, 'the')), 0), 1) AS DOUBLE) AS hits
FROM documents""")
def document_word_counts(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents").select("doc_id", "text").withColumns({"given": F.lit(0), "ee": F.lit(None).cast("int")})
    return docs.select("doc_id", num(I.violations("given", "text", "ee", "the"), "hits"))


@query("violations_per_employee", f"""WITH {cases_sql()}, per AS (SELECT greatest(floor(greatest(sum(violtn_cnt), sum(ee_violtd_cnt))
  / sum(ee_violtd_cnt)), 1) AS each FROM cases)
SELECT ord1, ord2, ord3, CAST(CASE WHEN violtn_cnt = 0 THEN each ELSE violtn_cnt END AS DOUBLE) AS violtn_cnt FROM cases, per""")
def violations_per_employee(spark: SparkSession, sf: str) -> DataFrame:
    df = cases(spark, sf, [*ORDER, "violtn_cnt", "ee_violtd_cnt"])
    filled = I.fill_counts(df, I.violations_per_employee(df))
    return filled.select(*ORDER, num("violtn_cnt"))


# amounts small enough for the mean to be taken at face value, and large ones for the plug
SMALL = {"bw_amt": ("", "case when l_partkey % 10 = 0 then null when l_partkey % 10 = 1 then 0 else cast(l_extendedprice / 37 as decimal(18,2)) end"),
         "penalty": ("", "case when l_linenumber <= 3 then 0 when l_linenumber = 4 then null else cast(25 as decimal(18,2)) end")}
LARGE = {**SMALL, "bw_amt": ("", "case when l_partkey % 10 = 0 then null else cast(l_extendedprice as decimal(18,2)) end")}


def imputed_sql(source: str) -> str:
    """Gaps filled step by step: the second mean is taken over the filled amounts before rounding."""
    plug = "CASE WHEN {m} IS NULL OR {m} = 0 OR {m} > 4000 THEN 3368 ELSE {m} END"
    return f"""m1 AS (SELECT {plug.format(m='(CAST(sum(bw_amt) AS DOUBLE) / count(bw_amt))')} AS mean FROM {source}),
  g AS (SELECT s.*, m1.mean, {COUNTED_SQL} AS ee, (bw_amt IS NULL OR bw_amt = 0) AS gap FROM {source} s, m1),
  f AS (SELECT *, CASE WHEN gap THEN CAST(ee * mean AS DECIMAL(18,2)) ELSE bw_amt END AS filled,
    CASE WHEN gap THEN 'YES' ELSE 'NO' END AS assumed, CASE WHEN violtn_cnt IS NULL OR violtn_cnt = 0 THEN ee ELSE violtn_cnt END AS violations FROM g),
  m2 AS (SELECT {plug.format(m='mm')} AS after FROM (SELECT (CAST(sum(bw_amt) AS DOUBLE)
    + CAST(sum(CASE WHEN gap THEN ee ELSE 0 END) AS DOUBLE) * max(mean)) / count(*) AS mm FROM f)),
  imputed AS (SELECT f.*, after FROM f, m2)"""


IMPUTED = [*ORDER, "bw_amt", "violtn_cnt", "ee_violtd_cnt"]


def _imputed(spark: SparkSession, sf: str, extra: dict) -> DataFrame:
    df = cases(spark, sf, IMPUTED, extra)
    means = I.wage_means(df)
    df = I.fill_penalties(I.fill_wages(df, means), means, "penalty")
    return df.select(*ORDER, num("bw_amt"), F.col("assumed_backwage").alias("assumed"), num("ee_violtd_cnt"),
                     num("violtn_cnt"), num("penalty"))


def _imputed_query(extra: dict) -> str:
    return f"""WITH {cases_sql(extra)}, {imputed_sql('cases')}
SELECT ord1, ord2, ord3, CAST(filled AS DOUBLE) AS bw_amt, assumed, CAST(ee AS DOUBLE) AS ee_violtd_cnt,
  CAST(violations AS DOUBLE) AS violtn_cnt, CAST(CAST(CASE WHEN penalty IS NULL OR penalty = 0 THEN after * 0.125 ELSE penalty END
  AS DECIMAL(18,2)) AS DOUBLE) AS penalty FROM imputed"""


@query("impute_amounts", _imputed_query(SMALL))
def impute_amounts(spark: SparkSession, sf: str) -> DataFrame:
    return _imputed(spark, sf, SMALL)


@query("impute_amounts_plugged", _imputed_query(LARGE))
def impute_amounts_plugged(spark: SparkSession, sf: str) -> DataFrame:
    return _imputed(spark, sf, LARGE)


ASSUMED = {**SMALL, "assumed_cmp": ("", "case when l_linenumber <= 4 then 'YES' else 'NO' end"),
           "violation": ("", "concat('Issue ', case l_returnflag when 'A' then 'overtime' when 'N' then 'rest period premium wages' else 'none' end)")}


@query("penalty_by_violation", f"""WITH {cases_sql(ASSUMED)}, {imputed_sql('cases')},
p AS (SELECT *, CASE WHEN assumed_cmp = 'YES' THEN {_terms_sql('violation', 'after', '(after * 0.125)')} * ee ELSE penalty END AS own FROM imputed)
SELECT ord1, ord2, ord3, CAST(CAST(CASE WHEN own IS NULL OR own = 0 THEN after * 0.125 ELSE own END AS DECIMAL(18,2)) AS DOUBLE) AS penalty FROM p""")
def penalty_by_violation(spark: SparkSession, sf: str) -> DataFrame:
    df = cases(spark, sf, IMPUTED, ASSUMED)
    means = I.wage_means(df)
    df = I.fill_penalties(I.fill_wages(df, means), means, "penalty", assumed="assumed_cmp")
    return df.select(*ORDER, num("penalty"))
