"""Headline figures and the report from end to end."""

from __future__ import annotations

from dataclasses import replace
from datetime import date

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from caseloom.operators import group as G
from caseloom.operators import summary as S
from caseloom.operators.filters import significant
from caseloom.plans.report import Lookups, ReportOptions, filled_rows, presented, report_tables, scoped_rows
from caseloom.rules.book import name_rule
from caseloom.sources import layout as L
from checks.cases import ORDER, cases, cases_sql
from checks.filtering import DIMS_SQL, dims
from checks.grouping import FOUR, SUMS, _multi_sql, employers, multi
from checks.money import AS_OF, COUNTED_SQL, imputed_sql, owed_sql
from checks.registry import num, query, text

OVERVIEW_SQL = """count(*) AS cases, CAST(sum(violtn_cnt) AS DOUBLE) AS violations, CAST(sum(ee_violtd_cnt) AS DOUBLE) AS employees,
  CAST(sum(bw_amt) AS DOUBLE) AS back_wages"""


@query("overview", f"WITH {cases_sql()} SELECT {OVERVIEW_SQL}, CAST(sum(ee_pmt_recv) AS DOUBLE) AS returned FROM cases")
def overview(spark: SparkSession, sf: str) -> DataFrame:
    return S.overview(cases(spark, sf, list(SUMS)))


@query("totals", f"""WITH {cases_sql()} SELECT CAST(sum(ee_violtd_cnt) AS DOUBLE) AS employees, CAST(sum(bw_amt) AS DOUBLE) AS back_wages,
  CAST(sum(violtn_cnt) AS DOUBLE) AS violations FROM cases""")
def totals(spark: SparkSession, sf: str) -> DataFrame:
    return S.totals(cases(spark, sf, list(SUMS)), {"ee_violtd_cnt": "employees", "bw_amt": "back_wages", "violtn_cnt": "violations"})


@query("headline", f"""WITH {cases_sql()} SELECT count(*) AS cases, CAST(sum(bw_amt) AS DOUBLE) AS back_wages FROM (
  SELECT sum(bw_amt) AS bw_amt FROM cases WHERE trade_nm <> '' GROUP BY upper(trade_nm) HAVING count(*) > 1)""")
def headline(spark: SparkSession, sf: str) -> DataFrame:
    return S.headline(G.repeat_groups(cases(spark, sf, ["bw_amt", "trade_nm"]), "trade_nm", [], ("bw_amt",), []))


@query("overview_of_rollups", f"WITH {cases_sql()} SELECT {OVERVIEW_SQL}, CAST(sum(ee_pmt_recv) AS DOUBLE) AS returned FROM cases")
def overview_of_rollups(spark: SparkSession, sf: str) -> DataFrame:
    """Each source and year rolled up, sources merged per year, then all."""
    df = cases(spark, sf, [*SUMS, "source", "findings_start_date"]).withColumn("year", F.year("findings_start_date"))
    return S.overview_and_coverage_of(S.merged(S.roll_up(df, ["source", "year"]), ["year"]))[0]


@query("coverage", f"""WITH {cases_sql()}, one AS (SELECT min(findings_start_date) AS first, max(findings_start_date) AS last,
  CAST(sum(bw_amt) AS DOUBLE) AS amount FROM cases)
SELECT CAST(first AS VARCHAR) AS first, CAST(last AS VARCHAR) AS last, amount,
  amount / (date_diff('day', first, last) / 365.0) / 22e9 * 100 AS percent_of_total FROM one""")
def coverage(spark: SparkSession, sf: str) -> DataFrame:
    got = S.coverage(cases(spark, sf, ["bw_amt", "findings_start_date"]))
    return got.select(text("first"), text("last"), "amount", "percent_of_total")


@query("date_range", f"""WITH {cases_sql()} SELECT CAST(min(findings_start_date) AS VARCHAR) AS first,
  CAST(max(findings_start_date) AS VARCHAR) AS last FROM cases""")
def date_range(spark: SparkSession, sf: str) -> DataFrame:
    got = S.coverage(cases(spark, sf, ["bw_amt", "findings_start_date"]))
    return got.select(text("first"), text("last"))


@query("status_distribution", f"""WITH {cases_sql()} SELECT CASE WHEN length(case_status) < 3 THEN '<Not Defined>' ELSE case_status END AS status,
  count(*) AS cases, count(*) / (SELECT CAST(count(*) AS DOUBLE) FROM cases) AS share FROM cases WHERE case_status IS NOT NULL
GROUP BY case_status HAVING count(*) > 1""")
def status_distribution(spark: SparkSession, sf: str) -> DataFrame:
    return S.status_shares(cases(spark, sf, ["case_status"]), "case_status")


@query("report_summary", f"""WITH {cases_sql()}, {_multi_sql()},
t AS (SELECT {OVERVIEW_SQL}, CAST(sum(ee_pmt_recv) AS DOUBLE) AS total_owed FROM cases),
e AS (SELECT count(*) AS employers, count(*) FILTER (WHERE n > 1) AS repeat_employers FROM (SELECT count(*) AS n FROM cases GROUP BY upper(legal_nm)))
SELECT cases, back_wages, floor(back_wages / employees) AS wage_per_employee, floor(back_wages / employees) * 0.125 AS penalty_per_employee,
  total_owed, employees, violations, floor(violations / employees) AS violations_per_employee, employers, repeat_employers,
  (SELECT count(*) FROM multi) AS multi_agency_employers FROM t, e""")
def report_summary(spark: SparkSession, sf: str) -> DataFrame:
    df = cases(spark, sf, [*SUMS, "legal_nm"])
    grouped = G.group_by_key(df, "legal_nm", [], ("bw_amt",), [])
    return S.report_summary(df, grouped, multi(spark, sf), owed="ee_pmt_recv")


FINE_SQL = f"""fine AS (SELECT {', '.join(FOUR)}, count(*) AS records, coalesce(sum(bw_amt), 0) AS bw_amt, sum(violtn_cnt) AS violtn_cnt,
  coalesce(sum(ee_violtd_cnt), 0) AS ee_violtd_cnt, sum(ee_pmt_recv) AS ee_pmt_recv FROM cases WHERE cty_nm IS NOT NULL GROUP BY {', '.join(FOUR)})"""


def fine(spark: SparkSession, sf: str) -> DataFrame:
    df = cases(spark, sf, [*FOUR, *SUMS]).withColumn("records", F.lit(1))
    return G.sums_by(df, FOUR, ["records", *SUMS]).fillna(0, list(SUMS))


@query("city_summary", f"""WITH {cases_sql()}, {_multi_sql('cty_nm')}, {FINE_SQL},
by_employer AS (SELECT cty_nm, legal_nm, sum(records) AS records, sum(bw_amt) AS bw_amt, sum(violtn_cnt) AS violtn_cnt,
  sum(ee_violtd_cnt) AS ee_violtd_cnt, sum(ee_pmt_recv) AS ee_pmt_recv FROM fine GROUP BY ALL),
m AS (SELECT cty_nm, count(*) AS n FROM multi WHERE cty_nm IS NOT NULL GROUP BY cty_nm)
SELECT b.cty_nm, CAST(sum(records) AS BIGINT) AS cases, CAST(sum(bw_amt) AS DOUBLE) AS stolen, CAST(sum(ee_pmt_recv) AS DOUBLE) AS returned,
  CAST(sum(violtn_cnt) AS DOUBLE) AS violations, CAST(sum(ee_violtd_cnt) AS DOUBLE) AS workers, count(*) AS employers,
  arg_min(legal_nm, (-ee_pmt_recv, legal_nm)) AS top_employer, CAST(max(ee_pmt_recv) AS DOUBLE) AS top_owed,
  coalesce(max(m.n), 0) AS multi_agency_employers FROM by_employer b LEFT JOIN m ON b.cty_nm = m.cty_nm
GROUP BY b.cty_nm HAVING sum(records) > 10 OR sum(bw_amt) > 10000""")
def city_summary(spark: SparkSession, sf: str) -> DataFrame:
    by_employer = G.sums_by(fine(spark, sf), ["cty_nm", "legal_nm"], ["records", *SUMS])
    cities = S.city_summary(by_employer, multi(spark, sf, ["cty_nm"]), owed="ee_pmt_recv")
    return cities.where(significant("cases", "stolen"))


@query("zip_summary", f"""WITH {cases_sql()}, {FINE_SQL}, peak AS (SELECT CAST(max(bw_amt) AS DOUBLE) AS peak FROM fine),
per AS (SELECT cty_nm, zip_cd, industry, sum(bw_amt) AS bw_amt, sum(ee_violtd_cnt) AS ee FROM fine GROUP BY ALL),
z AS (SELECT cty_nm, zip_cd, CAST(sum(ee) AS DOUBLE) AS workers, CAST(sum(bw_amt) AS DOUBLE) AS stolen,
  arg_min(industry, (-bw_amt, industry)) AS top_industry FROM per GROUP BY cty_nm, zip_cd)
SELECT z.*, abs(stolen - peak) <= 0.05 * greatest(abs(stolen), abs(peak)) AS near_highest FROM z, peak WHERE stolen >= 3000""")
def zip_summary(spark: SparkSession, sf: str) -> DataFrame:
    return S.zip_summary(fine(spark, sf), several_industries=True)


LISTED = {"listed": ("customer", "case when l_suppkey % 10 = 3 then 'BUILDING' when l_suppkey % 10 = 4 then 'FURNITURE' else 'Undefined' end")}


@query("signatory_share", f"""WITH {cases_sql(LISTED)}, one AS (SELECT CAST(sum(ee_pmt_recv) AS DOUBLE) AS all_owed,
  CAST(sum(ee_pmt_recv) FILTER (WHERE listed = 'BUILDING') AS DOUBLE) AS build_listed,
  CAST(sum(ee_pmt_recv) FILTER (WHERE industry = 'BUILDING') AS DOUBLE) AS build_all,
  CAST(sum(ee_pmt_recv) FILTER (WHERE listed = 'FURNITURE') AS DOUBLE) AS care_listed,
  CAST(sum(ee_pmt_recv) FILTER (WHERE industry IN ('FURNITURE', 'HOUSEHOLD')) AS DOUBLE) AS care_all FROM cases)
SELECT *, build_listed / build_all AS build_share, care_listed / care_all AS care_share FROM one""")
def signatory_share(spark: SparkSession, sf: str) -> DataFrame:
    return S.signatory_share(cases(spark, sf, ["ee_pmt_recv", "industry"], LISTED), owed="ee_pmt_recv", listed="listed",
                             build="BUILDING", hospitals="FURNITURE", care=("FURNITURE", "HOUSEHOLD"))


# the case table under the names the report reads
CANONICAL = {
    "_row": ("", "(cast(l_orderkey as bigint) * 8 + l_linenumber) * 100000000 + cast(cast(l_extendedprice as decimal(18,2)) * 100 as bigint)"),
    "Businesstype": ("", "case when l_suppkey % 3 = 0 then 'Corporation' else 'Individual' end"),
    "Case Status": ("orders", "case when o_orderkey % 17 = 0 then null when o_orderstatus = 'F' then 'Closed' "
                              "when o_orderstatus = 'O' then 'Open' else 'P' end"),
    "Note": ("", "case when l_linenumber = 7 then 'Vacated' else '' end"),
    "cmp_assd_cnt": ("", "cast(case when l_linenumber = 1 then 50 else 0 end as decimal(18,2))"),
    "interest_owed": ("", "cast(l_extendedprice * 0 as decimal(18,2))"),
    "Interest_Payments_Recd": ("", "cast(cast(l_extendedprice as decimal(18,2)) * cast(l_tax as decimal(4,2)) as decimal(18,2))"),
    "Prevailing": ("", "case when l_returnflag = 'R' then 1 else 0 end"),
    "Jurisdiction_region_or_General_Contractor": ("region", "r_name"),
}
REPORT_COLUMNS = ["case_id_1", "source", "juris_or_proj_nm", "legal_nm", "trade_nm", "street_addr", "cty_nm", "st_cd", "zip_cd", "naic_cd",
                  "naics_desc", "industry", "violation", "violtn_cnt", "ee_violtd_cnt", "bw_amt", "ee_pmt_recv",
                  "findings_start_date", "findings_end_date"]
LOOKUPS = Lookups(signatories=[name_rule("FURNITURE", ["Customer#00000001"])])
OPTIONS = ReportOptions(target_industry="Furniture", year_start=date(1996, 1, 1), year_end=date(1999, 12, 31), open_cases_only=True,
                        include_tables=True, include_summaries=True, prevailing_wage_report=True, infer_by_naics=True, infer_zip=True)


def shaped(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame, ReportOptions]:
    """Shaped rows, the cases they come from, and the options."""
    df = cases(spark, sf, REPORT_COLUMNS, CANONICAL)
    chosen = OPTIONS.normalise(AS_OF)
    return filled_rows(scoped_rows(df, chosen, LOOKUPS), chosen, AS_OF), df, chosen


REPORT_SQL = f"""{cases_sql(CANONICAL)},
best AS (SELECT * FROM cases QUALIFY row_number() OVER (PARTITION BY case_id_1, violation
  ORDER BY (bw_amt + interest_owed) DESC NULLS LAST, "Businesstype" DESC, _row) = 1),
scoped AS (SELECT * FROM best WHERE ((findings_start_date BETWEEN DATE '1996-01-01' AND DATE '1999-12-31')
    OR (findings_start_date IS NULL AND findings_end_date BETWEEN DATE '1996-01-01' AND DATE '1999-12-31')
    OR (findings_start_date IS NULL AND findings_end_date IS NULL))
  AND (st_cd = 'CA' OR st_cd IS NULL OR st_cd = '') AND upper(industry) = 'FURNITURE'),
counted AS (SELECT * REPLACE (coalesce(nullif(violtn_cnt, 0), 2) AS violtn_cnt, {COUNTED_SQL} AS ee_violtd_cnt) FROM scoped),
{imputed_sql('counted')},
filled_in AS (SELECT * REPLACE (filled AS bw_amt, CASE WHEN cmp_assd_cnt = 0 THEN CAST(after * 0.125 AS DECIMAL(18,2)) ELSE cmp_assd_cnt END AS cmp_assd_cnt)
  FROM imputed),
{owed_sql('filled_in', 'bw_amt', 'cmp_assd_cnt', '"Interest_Payments_Recd"')},
opened AS (SELECT *, regexp_matches(legal_nm, '(?i)Customer#00000001') AS signer FROM owed WHERE "Note" <> 'Vacated'
  AND coalesce("Case Status", '') <> 'Closed' AND bw_amt >= 1.05 * ee_pmt_recv)"""


@query("report_rows", f"""WITH {REPORT_SQL}
SELECT case_id_1, CASE WHEN signer THEN 1 ELSE 0 END AS "Signatory", CAST(bw_amt AS DOUBLE) AS bw_amt, CAST(cmp_assd_cnt AS DOUBLE) AS cmp_assd_cnt,
  CAST(violtn_cnt AS DOUBLE) AS violtn_cnt, CAST(ee AS DOUBLE) AS ee_violtd_cnt, CAST(owed AS DOUBLE) AS backwage_owed FROM opened""")
def report_row_query(spark: SparkSession, sf: str) -> DataFrame:
    rows, _, _ = shaped(spark, sf)
    return rows.select("case_id_1", "Signatory", num("bw_amt"), num("cmp_assd_cnt"), num("violtn_cnt"), num("ee_violtd_cnt"), num("backwage_owed"))


@query("report_end_to_end", f"""WITH {REPORT_SQL}, shown AS (SELECT *, CASE WHEN signer THEN 'MASKED' ELSE upper(legal_nm) END AS name FROM opened)
SELECT name AS legal_nm, count(*) AS records, format('{{:,.0f}}', CAST(sum(bw_amt) AS DOUBLE)) AS bw_amt,
  format('{{:,.0f}}', CAST(sum(ee) AS DOUBLE)) AS ee_violtd_cnt FROM shown GROUP BY name ORDER BY sum(bw_amt) DESC, name LIMIT 6""")
def report_end_to_end(spark: SparkSession, sf: str) -> DataFrame:
    rows, everything, options = shaped(spark, sf)
    tables = report_tables(*presented(rows, options, LOOKUPS), everything, replace(options, include_top_tables=True), {"top_by_amount"})
    return tables["top_by_amount"].select("legal_nm", "records", "bw_amt", "ee_violtd_cnt")


@query("report_by_industry_and_city", f"""WITH {REPORT_SQL}, shown AS (SELECT *, CASE WHEN signer THEN 'MASKED' ELSE upper(legal_nm) END AS name FROM opened),
firsts AS (SELECT *, row_number() OVER (PARTITION BY name ORDER BY _row) AS rn FROM shown),
grouped AS (SELECT name, max(CASE WHEN rn = 1 THEN cty_nm END) AS cty_nm, max(CASE WHEN rn = 1 THEN industry END) AS industry, count(*) AS records,
  sum(bw_amt) AS bw_amt FROM firsts GROUP BY name)
SELECT industry, CASE WHEN grouping(cty_nm) = 1 THEN 'COUNTYWIDE' ELSE cty_nm END AS cty_nm,
  format('{{:,}}', CAST(sum(records) AS BIGINT)) AS records, format('{{:,.0f}}', CAST(sum(bw_amt) AS DOUBLE)) AS bw_amt FROM grouped WHERE cty_nm IS NOT NULL GROUP BY GROUPING SETS ((industry, cty_nm), (industry))""")
def report_by_industry_and_city(spark: SparkSession, sf: str) -> DataFrame:
    rows, everything, options = shaped(spark, sf)
    tables = report_tables(*presented(rows, options, LOOKUPS), everything, options, {"by_industry_and_city"})
    return tables["by_industry_and_city"].select("industry", "cty_nm", "records", "bw_amt")


@query("report_prevailing_headline", f"""WITH {REPORT_SQL}, shown AS (SELECT *, CASE WHEN signer THEN 'MASKED' ELSE upper(legal_nm) END AS name FROM opened),
firsts AS (SELECT *, row_number() OVER (PARTITION BY name ORDER BY _row) AS rn FROM shown),
grouped AS (SELECT name, max(CASE WHEN rn = 1 THEN "Prevailing" END) AS flag, sum(bw_amt) AS bw_amt FROM firsts GROUP BY name)
SELECT count(*) AS cases, CAST(coalesce(sum(bw_amt), 0) AS DOUBLE) AS back_wages FROM grouped WHERE flag = 1""")
def report_prevailing_headline(spark: SparkSession, sf: str) -> DataFrame:
    rows, everything, options = shaped(spark, sf)
    return report_tables(*presented(rows, options, LOOKUPS), everything, options, {"prevailing_headline"})["prevailing_headline"]


@query("report_violator_list", f"""WITH {REPORT_SQL}, shown AS (SELECT *, CASE WHEN signer THEN 'MASKED' ELSE upper(legal_nm) END AS name FROM opened),
firsts AS (SELECT *, row_number() OVER (PARTITION BY name ORDER BY _row) AS rn FROM shown)
SELECT name AS legal_nm, count(*) AS records, CAST(sum(bw_amt) AS DOUBLE) AS bw_amt, CAST(sum(ee) AS DOUBLE) AS ee_violtd_cnt
FROM firsts GROUP BY name HAVING max(CASE WHEN rn = 1 THEN "Prevailing" END) = 1""")
def report_violator_list(spark: SparkSession, sf: str) -> DataFrame:
    rows, everything, options = shaped(spark, sf)
    listed = report_tables(*presented(rows, options, LOOKUPS), everything, options, {"prevailing_violators"})["prevailing_violators"]
    return listed.select("legal_nm", "records", num("bw_amt"), num("ee_violtd_cnt"))


# coarse ids, so that sources report the same cases and one switched off would displace the others'
TAGGED = {**CANONICAL,
          "source": ("region", "case when r_name in ('ASIA', 'EUROPE') then 'DOL_WHD' when r_name = 'AMERICA' then 'DIR_DLSE' else 'DLSE_J-23' end"),
          "case_id_1": ("", "concat('C', cast(l_orderkey % 499 as varchar(20)), '-', cast(l_linenumber as varchar(20)))")}
SCOPE_COLUMNS = ["case_id_1", "source", "violation", "zip_cd", "st_cd", "industry", "bw_amt", "legal_nm", "trade_nm", "findings_start_date", "findings_end_date"]


def _scope_sql(where: str) -> str:
    """Duplicates settled within what ``where`` leaves, then the window."""
    return f"""asked AS (SELECT * FROM cases WHERE {where}),
best AS (SELECT * FROM asked QUALIFY row_number() OVER (PARTITION BY case_id_1, violation
  ORDER BY (bw_amt + interest_owed) DESC NULLS LAST, "Businesstype" DESC, _row) = 1),
scoped AS (SELECT * FROM best WHERE (findings_start_date BETWEEN DATE '1996-01-01' AND DATE '1999-12-31')
  OR (findings_start_date IS NULL AND findings_end_date BETWEEN DATE '1996-01-01' AND DATE '1999-12-31')
  OR (findings_start_date IS NULL AND findings_end_date IS NULL))"""


def _scoped(spark: SparkSession, sf: str, **asked: object) -> DataFrame:
    options = ReportOptions(year_start=date(1996, 1, 1), year_end=date(1999, 12, 31), **asked).normalise(AS_OF)
    df = cases(spark, sf, [c for c in SCOPE_COLUMNS if c not in TAGGED], TAGGED)
    return scoped_rows(df, options, Lookups(regions=dims(spark, sf))).select("case_id_1", "source", "violation", "zip_cd", num("bw_amt"))


@query("report_for_county", f"""WITH {cases_sql(TAGGED)}, {DIMS_SQL}, {_scope_sql("true")}
SELECT case_id_1, source, violation, zip_cd, CAST(bw_amt AS DOUBLE) AS bw_amt FROM scoped
WHERE zip_cd IN (SELECT zip FROM dim WHERE county = 'NATION_7')""")
def report_for_county(spark: SparkSession, sf: str) -> DataFrame:
    return _scoped(spark, sf, target_county="NATION 7")


@query("report_for_source", f"""WITH {cases_sql(TAGGED)}, {_scope_sql("source = 'DOL_WHD'")}
SELECT case_id_1, source, violation, zip_cd, CAST(bw_amt AS DOUBLE) AS bw_amt FROM scoped WHERE st_cd = 'CA' OR st_cd IS NULL OR st_cd = ''""")
def report_for_source(spark: SparkSession, sf: str) -> DataFrame:
    return _scoped(spark, sf, include_federal=True)
