"""Filters, regions, masks."""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from caseloom.operators import filters as FI
from caseloom.operators import places as P
from caseloom.operators.flags import signatory_flag
from caseloom.operators.group import group_by_key
from caseloom.operators.topk import preview
from caseloom.rules.book import name_rule
from checks.cases import ORDER, cases, cases_sql, table
from checks.registry import num, query, text

FIRST, LAST = date(1996, 1, 1), date(1998, 6, 30)
WINDOW_SQL = """((findings_start_date BETWEEN DATE '1996-01-01' AND DATE '1998-06-30')
  OR (findings_start_date IS NULL AND findings_end_date BETWEEN DATE '1996-01-01' AND DATE '1998-06-30')
  OR (findings_start_date IS NULL AND findings_end_date IS NULL))"""
DATES_SQL = """CAST(findings_start_date AS VARCHAR) AS findings_start_date,
  CAST(findings_end_date AS VARCHAR) AS findings_end_date"""


def in_window() -> F.Column:
    return FI.date_window("findings_start_date", "findings_end_date", F.lit(FIRST), F.lit(LAST))


@query("filter_date_window", f"""WITH {cases_sql()}
SELECT case_id_1, ord3, {DATES_SQL} FROM cases WHERE {WINDOW_SQL}""")
def filter_date_window(spark: SparkSession, sf: str) -> DataFrame:
    df = cases(spark, sf, ["case_id_1", "ord3", "findings_start_date", "findings_end_date"])
    return df.where(in_window()).select("case_id_1", "ord3", text("findings_start_date"), text("findings_end_date"))


# regions: state = region, county = nation, city = market segment within a nation
DIMS_SQL = """dim AS (
  SELECT DISTINCT r_name AS state, n_name AS county, n_name || '_' || c_mktsegment AS city_key,
    lpad(CAST(c_custkey % 1000 AS VARCHAR), 5, '0') AS zip
  FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey)"""


def dims(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    nation = table(spark, sf, "nation")
    states = (nation.join(table(spark, sf, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
              .select(F.col("r_name").alias("state"), F.col("n_name").alias("county")))
    homes = table(spark, sf, "customer").join(nation, F.col("c_nationkey") == F.col("n_nationkey")).select(
        F.col("n_name").alias("county"), F.concat_ws("_", "n_name", "c_mktsegment").alias("city_key"),
        F.lpad((F.col("c_custkey") % 1000).cast("string"), 5, "0").alias("zip")).distinct()
    # at most a thousand different zips exist, so a city's list is bounded
    city = homes.groupBy("city_key").agg(F.sort_array(F.collect_set("zip")).alias("zips")).select(
        "city_key", F.col("city_key").alias("city"), "zips")
    return city, homes.select("county", "city_key").distinct(), states


@query("region_expand", f"""WITH {DIMS_SQL}, chosen AS (SELECT * FROM dim WHERE state = 'ASIA'),
  latest AS (SELECT city_key, max(zip) AS zip FROM chosen GROUP BY city_key)
SELECT DISTINCT zip FROM (SELECT zip FROM chosen UNION ALL SELECT left(zip, 4) || 'X' FROM latest)""")
def region_expand(spark: SparkSession, sf: str) -> DataFrame:
    return P.region_zips(*dims(spark, sf), state="ASIA")


@query("region_options", """SELECT DISTINCT replace(n_name, '_', ' ') AS option
FROM customer JOIN nation ON c_nationkey = n_nationkey""")
def region_options(spark: SparkSession, sf: str) -> DataFrame:
    return P.region_options(dims(spark, sf)[0])


@query("filter_region", f"""WITH {cases_sql()}, {DIMS_SQL}
SELECT case_id_1, ord3, zip_cd FROM cases WHERE zip_cd IN (SELECT zip FROM dim WHERE county = 'NATION_7')""")
def filter_region(spark: SparkSession, sf: str) -> DataFrame:
    city, county, state = dims(spark, sf)
    zips = P.region_zips(city, county, state, county="NATION_7")
    df = cases(spark, sf, ["case_id_1", "ord3", "zip_cd"])
    return FI.in_region(df, zips, with_generic=False)


@query("filter_home_state", f"""WITH {cases_sql()}
SELECT case_id_1, ord3, st_cd FROM cases WHERE st_cd = 'CA' OR st_cd IS NULL OR st_cd = ''""")
def filter_home_state(spark: SparkSession, sf: str) -> DataFrame:
    return FI.in_region(cases(spark, sf, ["case_id_1", "ord3", "st_cd"]), None, home_state="CA")


@query("filter_label_distinct", f"""WITH {cases_sql()}
SELECT DISTINCT legal_nm, cty_nm, industry FROM cases
WHERE upper(industry) IN ('BUILDING', 'MACHINERY') AND naic_cd IS NOT NULL""")
def filter_label_distinct(spark: SparkSession, sf: str) -> DataFrame:
    df = cases(spark, sf, ["legal_nm", "cty_nm", "industry", "naic_cd"])
    return df.where(FI.label_in("industry", ["building", "Machinery"], "naic_cd")).drop("naic_cd").distinct()


@query("filter_organisation", f"""WITH {cases_sql()}
SELECT DISTINCT legal_nm, trade_nm, cty_nm FROM cases
WHERE regexp_matches(legal_nm, '(?i)(customer#00000010|customer#0000007)')
   OR regexp_matches(trade_nm, '(?i)(customer#00000010|customer#0000007|supplier#00000001[0-5])')""")
def filter_organisation(spark: SparkSession, sf: str) -> DataFrame:
    df = cases(spark, sf, ["legal_nm", "trade_nm", "cty_nm"])
    terms = "customer#00000010|customer#0000007|supplier#00000001[0-5]"
    return df.where(FI.organisation(["legal_nm", "trade_nm"], terms)).distinct()


@query("filter_source", f"""WITH {cases_sql()}
SELECT case_id_1, ord3, source FROM cases WHERE source NOT IN ('ASIA', 'EUROPE')""")
def filter_source(spark: SparkSession, sf: str) -> DataFrame:
    return cases(spark, sf, ["case_id_1", "ord3", "source"]).where(FI.not_from("source", ["ASIA", "EUROPE"]))


NOTES = {
    "Case Status": ("orders", "case when o_orderkey % 17 = 0 then null when o_orderstatus = 'F' then 'Closed' "
                                     "when o_orderstatus = 'O' then 'Open' else 'P' end"),
    "Note": ("", "case when l_returnflag = 'R' and l_linenumber = 3 then 'Vacated' when l_returnflag = 'A' then null "
                 "else 'kept' end"),
    "Reason For Closing": ("", "case when l_linenumber = 5 then 'Pd per ODA' else '' end"),
}


@query("filter_open_cases", f"""WITH {cases_sql(NOTES)}
SELECT case_id_1, ord3, "Case Status" AS status, CAST(coalesce(bw_amt, 0) AS DOUBLE) AS bw_amt,
  CAST(ee_pmt_recv AS DOUBLE) AS ee_pmt_recv
FROM cases
WHERE ("Note" IS NULL OR "Note" NOT IN ('Closed - Paid in Full (PIF)/Satisfied', 'Full Satisfaction', 'Vacated'))
  AND ("Case Status" IS NULL OR "Case Status" <> 'Closed') AND "Reason For Closing" <> 'Pd per ODA'
  AND coalesce(bw_amt, 0) >= 1.05 * coalesce(ee_pmt_recv, 0)
  AND coalesce(bw_amt, 0) - coalesce(ee_pmt_recv, 0) >= -0.001""")
def filter_open_cases(spark: SparkSession, sf: str) -> DataFrame:
    df = cases(spark, sf, ["case_id_1", "ord3", "bw_amt", "ee_pmt_recv"], NOTES)
    return FI.open_cases(df).select("case_id_1", "ord3", F.col("Case Status").alias("status"),
                                    F.coalesce(num("bw_amt"), F.lit(0.0)).alias("bw_amt"), num("ee_pmt_recv"))


LISTED = [name_rule("Construction", ["Customer#0000001", "Supplier#00000002", "(!Customer#00000010)"])]
LISTED_SQL = """CASE WHEN (regexp_matches(legal_nm, '(?i)(Customer#0000001|Supplier#00000002)')
    AND NOT regexp_matches(legal_nm, '(?i)(Customer#00000010)'))
  OR (regexp_matches(trade_nm, '(?i)(Customer#0000001|Supplier#00000002)')
    AND NOT regexp_matches(trade_nm, '(?i)(Customer#00000010)')) THEN 1 ELSE 0 END"""


@query("mask_rows", f"""WITH {cases_sql()}, flagged AS (SELECT *, {LISTED_SQL} AS flag FROM cases)
SELECT CASE WHEN flag = 1 THEN 'masked' ELSE case_id_1 END AS case_id_1, ord3,
  CASE WHEN flag = 1 THEN 'masked' ELSE legal_nm END AS legal_nm,
  CASE WHEN flag = 1 THEN 'masked' ELSE trade_nm END AS trade_nm, flag
FROM flagged""")
def mask_rows(spark: SparkSession, sf: str) -> DataFrame:
    df = cases(spark, sf, ["case_id_1", "ord3", "legal_nm", "trade_nm"])
    return FI.masked(signatory_flag(df, LISTED, ["legal_nm", "trade_nm"], "flag"), "flag",
                     ["case_id_1", "legal_nm", "trade_nm"])


FLAGGED_SQL = f"""{cases_sql()}, named AS (SELECT *, {LISTED_SQL} AS flag FROM cases WHERE trade_nm <> ''),
  firsts AS (SELECT *, row_number() OVER (PARTITION BY upper(trade_nm) ORDER BY ord1, ord2, ord3) AS rn FROM named),
  grouped AS (SELECT upper(trade_nm) AS trade_nm, count(*) AS records,
    CAST(coalesce(sum(bw_amt), 0) AS DOUBLE) AS bw_amt, max(CASE WHEN rn = 1 THEN flag END) AS flag
  FROM firsts GROUP BY upper(trade_nm))"""


def flagged(spark: SparkSession, sf: str) -> DataFrame:
    df = signatory_flag(cases(spark, sf, ["trade_nm", "legal_nm", "bw_amt", *ORDER]), LISTED,
                        ["legal_nm", "trade_nm"], "flag")
    grouped = group_by_key(df, "trade_nm", ORDER, ("bw_amt",), ["flag"])
    return grouped.where("flag = 1").select("trade_nm", "records", num("bw_amt"), "flag")


@query("flagged_groups", f"WITH {FLAGGED_SQL} SELECT * FROM grouped WHERE flag = 1")
def flagged_groups(spark: SparkSession, sf: str) -> DataFrame:
    return flagged(spark, sf)


@query("violator_list", f"WITH {FLAGGED_SQL} SELECT * FROM grouped WHERE flag = 1 ORDER BY trade_nm LIMIT 24")
def violator_list(spark: SparkSession, sf: str) -> DataFrame:
    return preview(flagged(spark, sf), "trade_nm", n=24)


@query("composite_filter", f"""WITH {cases_sql()}, {DIMS_SQL}
SELECT case_id_1, ord3, zip_cd, industry FROM cases WHERE {WINDOW_SQL}
  AND zip_cd IN (SELECT zip FROM dim WHERE state = 'EUROPE') AND upper(industry) = 'FURNITURE'""")
def composite_filter(spark: SparkSession, sf: str) -> DataFrame:
    df = cases(spark, sf, ["case_id_1", "ord3", "zip_cd", "industry", "findings_start_date", "findings_end_date"])
    df = FI.in_region(df.where(in_window()), P.region_zips(*dims(spark, sf), state="EUROPE"))
    return df.where(FI.label_in("industry", ["Furniture"])).select("case_id_1", "ord3", "zip_cd", "industry")
