"""Duplicates: dropped, kept best, flagged."""

from __future__ import annotations

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from caseloom.operators import dedup as D
from caseloom.operators.spread import group_totals, on_distinct
from caseloom.plans.steps import with_duplicate_flags
from caseloom.functions import text as T
from checks.cases import ORDER, cases, cases_sql
from checks.registry import num, query

KEYED = ["case_id_1", "legal_nm", "trade_nm", "street_addr", "violation", "bw_amt", "ee_pmt_recv", *ORDER]

# ids repeat as (order, line) pairs repeat; a coarser id makes larger groups
COARSE = {"case_id_1": ("", "concat(' ', cast(l_orderkey % 997 as varchar(20)), '-', l_returnflag, ' ')"),
          "form": ("", "case when l_suppkey % 3 = 0 then null when l_suppkey % 3 = 1 then 'Corporation' else 'Individual' end"),
          "interest_owed": ("", "case when l_partkey % 21 = 0 then null else cast(l_tax as decimal(18,2)) end")}
COARSE_BLANK = {**COARSE, "violation": ("", "''")}
COARSE_COLUMNS = ["bw_amt", "violation", *ORDER]
BEST_ORDER = ("(bw_amt + interest_owed) DESC NULLS LAST, form DESC NULLS LAST, ord1, ord2, ord3")


@query("dedup_full", f"""WITH {cases_sql()}
SELECT DISTINCT case_id_1, legal_nm, cty_nm, violation FROM cases""")
def dedup_full(spark: SparkSession, sf: str) -> DataFrame:
    return D.distinct_rows(cases(spark, sf, ["case_id_1", "legal_nm", "cty_nm", "violation"]))


@query("dedup_full_keep_last", f"""WITH {cases_sql()}, ranked AS (SELECT case_id_1, legal_nm, violation, ord3,
  row_number() OVER (PARTITION BY case_id_1, legal_nm, violation ORDER BY ord1 DESC, ord2 DESC, ord3 DESC) AS rn FROM cases)
SELECT case_id_1, legal_nm, violation, ord3 FROM ranked WHERE rn = 1""")
def dedup_full_keep_last(spark: SparkSession, sf: str) -> DataFrame:
    df = cases(spark, sf, ["case_id_1", "legal_nm", "violation", *ORDER])
    return D.distinct_rows(df, ignoring=ORDER, order=ORDER, keep="last").drop("ord1", "ord2")


def _best_sql(extra: dict, keys: str) -> str:
    return f"""WITH {cases_sql(extra)}, trimmed AS (SELECT * REPLACE (trim(case_id_1) AS case_id_1) FROM cases),
ranked AS (SELECT *, row_number() OVER (PARTITION BY {keys} ORDER BY {BEST_ORDER}) AS rn FROM trimmed)
SELECT case_id_1, violation, coalesce(form, 'none') AS form, CAST(bw_amt AS DOUBLE) AS bw_amt, ord1, ord2, ord3 FROM ranked WHERE rn = 1"""


def _coarse(spark: SparkSession, sf: str, extra: dict) -> DataFrame:
    df = cases(spark, sf, COARSE_COLUMNS, extra)
    return D.drop_duplicates(df, "case_id_1", "violation", ["bw_amt", "interest_owed"], "form", ORDER).select(
        "case_id_1", "violation", F.coalesce("form", F.lit("none")).alias("form"), num("bw_amt"), *ORDER)


@query("dedup_keep_best", _best_sql(COARSE, "case_id_1, violation"))
def dedup_keep_best(spark: SparkSession, sf: str) -> DataFrame:
    return _coarse(spark, sf, COARSE)


# ids repeat seldom here: only the rivals are ranked, the other rows pass as they are
RARE = {**COARSE, "case_id_1": ("", "concat(' ', case when l_orderkey % 23 = 0 then 'X' || cast(l_orderkey % 46 as varchar(20)) else "
                                    "cast(l_orderkey as varchar(20)) || '-' || cast(l_linenumber as varchar(20)) end)")}


@query("dedup_rivals_only", _best_sql(RARE, "case_id_1, violation"))
def dedup_rivals_only(spark: SparkSession, sf: str) -> DataFrame:
    df = cases(spark, sf, COARSE_COLUMNS, RARE)
    return D.drop_duplicates(df, "case_id_1", "violation", ["bw_amt", "interest_owed"], "form", ORDER, split=True).select(
        "case_id_1", "violation", F.coalesce("form", F.lit("none")).alias("form"), num("bw_amt"), *ORDER)


# no violation is ever given: duplicates are not ranked, only (id, violation, amount) counts; full copies go first
@query("dedup_blank_key", f"""WITH {cases_sql(COARSE_BLANK)}, trimmed AS (SELECT * REPLACE (trim(case_id_1) AS case_id_1) FROM cases),
ranked AS (SELECT *, row_number() OVER (PARTITION BY case_id_1, violation, bw_amt ORDER BY ord1, ord2, ord3) AS rn FROM trimmed)
SELECT case_id_1, violation, coalesce(form, 'none') AS form, CAST(bw_amt AS DOUBLE) AS bw_amt, ord1, ord2, ord3 FROM ranked WHERE rn = 1""")
def dedup_blank_key(spark: SparkSession, sf: str) -> DataFrame:
    return _coarse(spark, sf, COARSE_BLANK)


@query("dedup_wide_keys", f"""WITH {cases_sql()},
a AS (SELECT * FROM cases QUALIFY row_number() OVER (PARTITION BY case_id_1, violation, bw_amt ORDER BY ord1, ord2, ord3) = 1),
b AS (SELECT * FROM a QUALIFY row_number() OVER (PARTITION BY case_id_1, trade_nm, street_addr, violation, bw_amt ORDER BY ord1, ord2, ord3) = 1),
c AS (SELECT * FROM b QUALIFY row_number() OVER (PARTITION BY case_id_1, legal_nm, street_addr, violation, bw_amt ORDER BY ord1, ord2, ord3) = 1)
SELECT case_id_1, legal_nm, violation, CAST(bw_amt AS DOUBLE) AS bw_amt, ord3 FROM c""")
def dedup_wide_keys(spark: SparkSession, sf: str) -> DataFrame:
    df = cases(spark, sf, ["case_id_1", "legal_nm", "trade_nm", "street_addr", "violation", "bw_amt", *ORDER])
    keys = [["case_id_1", "violation", "bw_amt"], ["case_id_1", "trade_nm", "street_addr", "violation", "bw_amt"],
            ["case_id_1", "legal_nm", "street_addr", "violation", "bw_amt"]]
    return D.keep_first_by_each(df, keys, ORDER, split=True).select("case_id_1", "legal_nm", "violation", num("bw_amt"), "ord3")


# two sources report the same lines; the cross-source pass keeps one of each
@query("dedup_across_sources", f"""WITH {cases_sql()}
SELECT case_id_1, violation, CAST(max(bw_amt) AS DOUBLE) AS bw_amt FROM cases GROUP BY case_id_1, violation""")
def dedup_across_sources(spark: SparkSession, sf: str) -> DataFrame:
    df = cases(spark, sf, ["case_id_1", "violation", "bw_amt", *ORDER])
    state = df.where("violation like '%F'").withColumn("source", F.lit("state"))
    both = df.withColumn("source", F.lit("federal")).unionByName(state).withColumns(
        {"form": F.lit(""), "interest_owed": F.lit(0), "ord0": F.when(F.col("source") == "state", 1).otherwise(0)})
    kept = D.drop_duplicates(both, "case_id_1", "violation", ["bw_amt", "interest_owed"], "form", ["ord0", *ORDER])
    return kept.select("case_id_1", "violation", num("bw_amt"))


# the keys the cleaning step names, with the rows it would drop
SIX = {"_row": ("", "(cast(l_orderkey as bigint) * 8 + l_linenumber) * 100000000 + cast(cast(l_extendedprice as decimal(18,2)) * 100 as bigint)"),
       "Businesstype": ("", "case when l_suppkey % 3 = 0 then 'Corporation' else 'Individual' end"), "interest_owed": ("", "cast(l_tax as decimal(18,2))"),
       "case_id_1": ("", "concat(' ', cast(l_orderkey % 97 as varchar(20)), ' ')")}
SIX_KEYS = {"_Case_X": "id, violation, bw_amt", "_T_NM_X": "id, trade_nm, street_addr, violation, bw_amt",
            "_L-NM_X": "id, legal_nm, street_addr, violation, bw_amt", "_DUP_BW": "id, legal_nm, violation, bw_amt",
            "_DUP_PMT_REC": "id, legal_nm, violation, ee_pmt_recv", "_DUP_PMT_DUE": "id, legal_nm, bw_amt"}


@query("dedup_six_flags", f"""WITH {cases_sql(SIX)}, t AS (SELECT *, trim(case_id_1) AS id FROM cases)
SELECT _row, row_number() OVER (PARTITION BY source, id, violation ORDER BY (bw_amt + interest_owed) DESC NULLS LAST, "Businesstype", _row) > 1
  AS "_DELETED_DUP", """ + ", ".join(f'count(*) OVER (PARTITION BY {keys}) > 1 AS "{name}"' for name, keys in SIX_KEYS.items()) + " FROM t")
def dedup_six_flags(spark: SparkSession, sf: str) -> DataFrame:
    columns = ["source", "legal_nm", "trade_nm", "street_addr", "violation", "bw_amt", "ee_pmt_recv"]
    # the rows are read several times; on disk they take no memory from the counting
    flagged = with_duplicate_flags(cases(spark, sf, columns, SIX).persist(StorageLevel.DISK_ONLY))
    return flagged.select("_row", "_DELETED_DUP", *[f"`{name}`" for name in SIX_KEYS])


FLAGS = {"dup_case": ["case_id_1", "violation", "ee_pmt_recv"], "dup_pay": ["case_id_1", "legal_nm", "violation", "bw_amt"],
         "dup_blank": ["trade_nm", "violation"]}


@query("dedup_flags", f"""WITH {cases_sql()} SELECT ord1, ord2, ord3, """ + ", ".join(
    f"count(*) OVER (PARTITION BY {', '.join(keys)}) > 1 AS {name}" for name, keys in FLAGS.items()) + " FROM cases")
def dedup_flags(spark: SparkSession, sf: str) -> DataFrame:
    df = cases(spark, sf, ["case_id_1", "legal_nm", "trade_nm", "violation", "bw_amt", "ee_pmt_recv", *ORDER])
    return D.flag_repeats(df.persist(StorageLevel.DISK_ONLY), FLAGS, ORDER).select(*ORDER, *FLAGS)


@query("dedup_flag_deleted", f"""WITH {cases_sql(COARSE)}
SELECT ord1, ord2, ord3, row_number() OVER (PARTITION BY case_id_1, violation ORDER BY (bw_amt + interest_owed) DESC NULLS LAST,
  form ASC NULLS LAST, ord1, ord2, ord3) > 1 AS "_DELETED_DUP" FROM cases""")
def dedup_flag_deleted(spark: SparkSession, sf: str) -> DataFrame:
    df = cases(spark, sf, COARSE_COLUMNS, COARSE)
    return D.flag_deleted(df, ["case_id_1", "violation"], ["bw_amt", "interest_owed"], "form", ORDER).select(*ORDER, "_DELETED_DUP")


@query("group_totals_back", f"""WITH {cases_sql()} SELECT ord1, ord2, ord3, count(*) OVER (PARTITION BY trade_nm) AS records,
  CAST(sum(ee_pmt_recv) OVER (PARTITION BY trade_nm) AS DOUBLE) AS paid FROM cases""")
def group_totals_back(spark: SparkSession, sf: str) -> DataFrame:
    df = cases(spark, sf, ["trade_nm", "ee_pmt_recv", *ORDER])
    totals = {"records": F.count(F.lit(1)), "paid": F.sum("ee_pmt_recv").cast("double")}
    return group_totals(df, ["trade_nm"], totals, ORDER).select(*ORDER, "records", "paid")


@query("distinct_text_step", f"""WITH {cases_sql()}
SELECT ord1, ord2, ord3, CASE WHEN regexp_matches(street_addr, '(?i)(red|old) (ring|bolt)') THEN 1 ELSE 0 END AS flag FROM cases""")
def distinct_text_step(spark: SparkSession, sf: str) -> DataFrame:
    df = cases(spark, sf, ["street_addr", *ORDER])
    flagged = on_distinct(df, ["street_addr"], lambda d: d.withColumn(
        "flag", T.has_any("street_addr", "(red|old) (ring|bolt)").cast("int")), ORDER)
    return flagged.select(*ORDER, "flag")
