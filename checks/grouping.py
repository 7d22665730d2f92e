"""Groups, roll-ups, rankings."""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from caseloom.operators import group as G
from caseloom.operators import topk as K
from caseloom.operators.filters import date_window
from caseloom.operators.summary import largest_per
from checks.cases import ORDER, cases, cases_sql
from checks.filtering import WINDOW_SQL
from checks.registry import num, query, text

SUMS = ("bw_amt", "violtn_cnt", "ee_violtd_cnt", "ee_pmt_recv")
SUMS_SQL = ", ".join(f"CAST(coalesce(sum({m}), 0) AS DOUBLE) AS {m}" for m in SUMS)


def sums(df: DataFrame, *others: str) -> DataFrame:
    return df.select(*others, *[num(m) for m in SUMS])


def _group_sql(key: str, carried: tuple[str, ...] = ("trade_nm", "cty_nm"), where: str = "true") -> str:
    """One line per key in capitals, attributes of its first row."""
    picked = ", ".join(f"max(CASE WHEN rn = 1 THEN {c} END) AS {c}" for c in carried if c != key)
    return (f"named AS (SELECT *, row_number() OVER (PARTITION BY upper({key}) ORDER BY ord1, ord2, ord3) AS rn FROM cases "
            f"WHERE {key} IS NOT NULL AND {key} NOT IN ('', 'nan', 'NAN') AND {where}), "
            f"grouped AS (SELECT upper({key}) AS {key}, count(*) AS records, {SUMS_SQL}, {picked} FROM named GROUP BY upper({key}))")


BASIC = [*SUMS, "legal_nm", "trade_nm", "cty_nm", *ORDER]


def employers(spark: SparkSession, sf: str, carry: list[str] | None = None) -> DataFrame:
    carry = carry or ["trade_nm", "cty_nm"]
    return G.group_by_key(cases(spark, sf, [*SUMS, "legal_nm", *carry, *ORDER]), "legal_nm", ORDER, SUMS, carry)


@query("flagship", f"""WITH {cases_sql()}, {_group_sql('legal_nm', where=WINDOW_SQL)}
SELECT * FROM grouped ORDER BY bw_amt DESC, legal_nm LIMIT 6""")
def flagship(spark: SparkSession, sf: str) -> DataFrame:
    df = cases(spark, sf, [*BASIC, "findings_start_date", "findings_end_date"])
    df = df.where(date_window("findings_start_date", "findings_end_date", F.lit(date(1996, 1, 1)), F.lit(date(1998, 6, 30))))
    grouped = G.group_by_key(df, "legal_nm", ORDER, SUMS, ["trade_nm", "cty_nm"])
    return sums(K.top(grouped, "bw_amt", "legal_nm", K.TOP_VIOLATORS), "legal_nm", "records", "trade_nm", "cty_nm")


@query("group_representative", f"WITH {cases_sql()}, {_group_sql('legal_nm')} SELECT * FROM grouped")
def group_representative(spark: SparkSession, sf: str) -> DataFrame:
    return sums(employers(spark, sf), "legal_nm", "records", "trade_nm", "cty_nm")


# a fifth of these keys are blank, in the several ways a key can be
BLANKS = {"trade_nm": ("supplier", "case l_suppkey % 8 when 0 then '' when 1 then null when 2 then 'nan' when 3 then 'NAN' else lower(s_name) end")}


@query("group_blank_keys", f"WITH {cases_sql(BLANKS)}, {_group_sql('trade_nm', ('legal_nm', 'cty_nm'))} SELECT * FROM grouped")
def group_blank_keys(spark: SparkSession, sf: str) -> DataFrame:
    df = cases(spark, sf, [*SUMS, "legal_nm", "cty_nm", *ORDER], BLANKS)
    return sums(G.group_by_key(df, "trade_nm", ORDER, SUMS, ["legal_nm", "cty_nm"]), "trade_nm", "records", "legal_nm", "cty_nm")


@query("group_repeat", f"WITH {cases_sql()}, {_group_sql('street_addr')} SELECT *, 0 AS backwage_owed FROM grouped WHERE records > 1")
def group_repeat(spark: SparkSession, sf: str) -> DataFrame:
    df = cases(spark, sf, [*SUMS, "street_addr", "trade_nm", "cty_nm", *ORDER])
    grouped = G.repeat_groups(df, "street_addr", ORDER, carry=["trade_nm", "cty_nm"])
    return sums(grouped, "street_addr", "records", "trade_nm", "cty_nm", F.col("backwage_owed").cast("int").alias("backwage_owed"))


def _multi_sql(within: str = "") -> str:
    outer = f"{within}, " if within else ""
    return f"""pairs AS (SELECT {outer}upper(legal_nm) AS legal_nm, upper(juris_or_proj_nm) AS agency, count(*) AS records,
    CAST(coalesce(sum(bw_amt), 0) AS DECIMAL(38,2)) AS bw_amt, min((ord1, ord2, ord3)) AS at_ FROM cases WHERE legal_nm <> '' AND juris_or_proj_nm <> '' GROUP BY ALL),
  multi AS (SELECT {outer}legal_nm, count(*) AS agencies, CAST(sum(records) AS BIGINT) AS records, CAST(sum(bw_amt) AS DOUBLE) AS bw_amt,
    string_agg(agency, ', ' ORDER BY at_) AS agency_names, arg_min(agency, at_) AS agency FROM pairs GROUP BY ALL HAVING count(*) > 1)"""


def multi(spark: SparkSession, sf: str, within: list[str] | None = None) -> DataFrame:
    df = cases(spark, sf, ["legal_nm", "juris_or_proj_nm", "bw_amt", *(within or []), *ORDER])
    return G.multi_agency(df, "legal_nm", "juris_or_proj_nm", ORDER, ("bw_amt",), within=within)


@query("group_multi_agency", f"""WITH {cases_sql()}, {_multi_sql()}
SELECT legal_nm, agencies, records, bw_amt, agency_names, upper(left(agency, 1)) || lower(substr(agency, 2)) AS juris_or_proj_nm FROM multi""")
def group_multi_agency(spark: SparkSession, sf: str) -> DataFrame:
    return multi(spark, sf).select("legal_nm", "agencies", "records", num("bw_amt"), "agency_names", "juris_or_proj_nm")


def _rollup_sql(outer: str, inner: str, label: str) -> str:
    return f"""WITH {cases_sql()}, {_group_sql('legal_nm', ('industry', 'cty_nm', 'zip_cd'))}
SELECT {outer}, CASE WHEN grouping({inner}) = 1 THEN '{label}' ELSE {inner} END AS {inner},
  CAST(sum(records) AS BIGINT) AS records, {', '.join(f'CAST(sum({m}) AS DOUBLE) AS {m}' for m in SUMS)}
FROM grouped WHERE {outer} IS NOT NULL AND {inner} IS NOT NULL GROUP BY GROUPING SETS (({outer}, {inner}), ({outer}))"""


def _rollup(spark: SparkSession, sf: str, outer: str, inner: str, label: str) -> DataFrame:
    rolled = G.subtotals(employers(spark, sf, ["industry", "cty_nm", "zip_cd"]), outer, inner, ["records", *SUMS], label)
    return sums(rolled, outer, inner, "records")


@query("rollup_industry_city", _rollup_sql("industry", "cty_nm", "COUNTYWIDE"))
def rollup_industry_city(spark: SparkSession, sf: str) -> DataFrame:
    return _rollup(spark, sf, "industry", "cty_nm", "COUNTYWIDE")


@query("rollup_zip_industry", _rollup_sql("zip_cd", "industry", "ZIPCODEWIDE"))
def rollup_zip_industry(spark: SparkSession, sf: str) -> DataFrame:
    return _rollup(spark, sf, "zip_cd", "industry", "ZIPCODEWIDE")


@query("rollup_city_industry", _rollup_sql("cty_nm", "industry", "CITYWIDE"))
def rollup_city_industry(spark: SparkSession, sf: str) -> DataFrame:
    return _rollup(spark, sf, "cty_nm", "industry", "CITYWIDE")


# the same roll-up straight from the cases, whose outer key is as skewed as the data has it
@query("rollup_cases", f"""WITH {cases_sql()}
SELECT source, CASE WHEN grouping(industry) = 1 THEN 'ALL' ELSE industry END AS industry, CAST(sum(ee_pmt_recv) AS DOUBLE) AS paid
FROM cases GROUP BY GROUPING SETS ((source, industry), (source))""")
def rollup_cases(spark: SparkSession, sf: str) -> DataFrame:
    rolled = G.subtotals(cases(spark, sf, ["source", "industry", "ee_pmt_recv"]), "source", "industry", ["ee_pmt_recv"], "ALL")
    return rolled.select("source", "industry", num("ee_pmt_recv", "paid"))


FOUR = ["cty_nm", "zip_cd", "industry", "legal_nm"]


@query("group_city_zip_employer", f"""WITH {cases_sql()} SELECT {', '.join(FOUR)}, count(*) AS records, {SUMS_SQL} FROM cases
WHERE cty_nm IS NOT NULL GROUP BY {', '.join(FOUR)}""")
def group_city_zip_employer(spark: SparkSession, sf: str) -> DataFrame:
    df = cases(spark, sf, [*FOUR, *SUMS]).withColumn("records", F.lit(1))
    fine = G.sums_by(df, FOUR, ["records", *SUMS])
    return fine.select(*FOUR, "records", *[F.coalesce(num(m), F.lit(0.0)).alias(m) for m in SUMS])


def _top_sql(by: str) -> str:
    return (f"WITH {cases_sql()}, {_group_sql('legal_nm')} SELECT * FROM grouped ORDER BY {by} DESC, legal_nm LIMIT 6")


def _top(spark: SparkSession, sf: str, by: str) -> DataFrame:
    return sums(K.top(employers(spark, sf), by, "legal_nm", K.TOP_VIOLATORS), "legal_nm", "records", "trade_nm", "cty_nm")


@query("top_by_amount", _top_sql("bw_amt"))
def top_by_amount(spark: SparkSession, sf: str) -> DataFrame:
    return _top(spark, sf, "bw_amt")


@query("top_by_workers", _top_sql("ee_violtd_cnt"))
def top_by_workers(spark: SparkSession, sf: str) -> DataFrame:
    return _top(spark, sf, "ee_violtd_cnt")


@query("top_by_records", _top_sql("records"))
def top_by_records(spark: SparkSession, sf: str) -> DataFrame:
    return _top(spark, sf, "records")


def _repeat_sql(key: str) -> str:
    return (f"WITH {cases_sql()}, {_group_sql(key, ('cty_nm', 'violation'))} SELECT * FROM grouped WHERE records > 1 "
            f"ORDER BY records DESC, {key} LIMIT 24")


def _repeat(spark: SparkSession, sf: str, key: str) -> DataFrame:
    df = cases(spark, sf, [*SUMS, key, "violation", *(["cty_nm"] if key != "cty_nm" else []), *ORDER])
    grouped = G.repeat_groups(df, key, ORDER, SUMS, ["cty_nm", "violation"])
    return sums(K.top(grouped, "records", key, K.TOP_REPEATS), key, "records", "cty_nm", "violation")


for _name, _key in (("top_repeat_addresses", "street_addr"), ("top_repeat_legal_names", "legal_nm"),
                    ("top_repeat_trade_names", "trade_nm"), ("top_repeat_agencies", "juris_or_proj_nm"),
                    ("top_repeat_owners", "source")):
    query(_name, _repeat_sql(_key))(lambda spark, sf, key=_key: _repeat(spark, sf, key))


REPEAT_KEYS = ("street_addr", "legal_nm", "trade_nm", "juris_or_proj_nm", "source")


def _tables_sql() -> str:
    tables = []
    for key in REPEAT_KEYS:
        inner = _group_sql(key, ("cty_nm", "violation"))
        tables.append(f"(WITH {inner} SELECT '{key}' AS kind, {key} AS value, records, {', '.join(SUMS)}, cty_nm, violation FROM grouped "
                      f"WHERE records > 1 ORDER BY records DESC, {key} LIMIT 24)")
    return f"WITH {cases_sql()} " + " UNION ALL ".join(f"SELECT * FROM {t}" for t in tables)


@query("top_repeat_tables", _tables_sql())
def top_repeat_tables(spark: SparkSession, sf: str) -> DataFrame:
    df = cases(spark, sf, [*SUMS, *REPEAT_KEYS, "violation", "cty_nm", *ORDER])
    return sums(G.repeat_tables(df, list(REPEAT_KEYS), ORDER, K.TOP_REPEATS, SUMS), "kind", "value", "records", "cty_nm", "violation")


@query("top_multi_agency", f"""WITH {cases_sql()}, {_multi_sql()}
SELECT legal_nm, agencies, records, bw_amt, agency_names FROM multi ORDER BY records DESC, legal_nm LIMIT 24""")
def top_multi_agency(spark: SparkSession, sf: str) -> DataFrame:
    return K.top(multi(spark, sf), "records", "legal_nm", K.TOP_REPEATS).select(
        "legal_nm", "agencies", "records", num("bw_amt"), "agency_names")


@query("largest_per_city", f"""WITH {cases_sql()}, owing AS (SELECT cty_nm, legal_nm, CAST(sum(ee_pmt_recv) AS DOUBLE) AS owed FROM cases
  WHERE cty_nm IS NOT NULL GROUP BY ALL)
SELECT cty_nm, legal_nm, owed, CAST(row_number() OVER (PARTITION BY cty_nm ORDER BY owed DESC NULLS LAST, legal_nm) AS INTEGER) AS place FROM owing
QUALIFY place <= 3""")
def largest_per_city(spark: SparkSession, sf: str) -> DataFrame:
    owing = G.sums_by(cases(spark, sf, ["cty_nm", "legal_nm", "ee_pmt_recv"]), ["cty_nm", "legal_nm"], ["ee_pmt_recv"])
    return largest_per(owing.select("cty_nm", "legal_nm", num("ee_pmt_recv", "owed")), "cty_nm", "owed", "legal_nm")
