"""Numbers, texts, names, addresses, types, and sources with headers of their own."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from caseloom.functions import text as T
from caseloom.functions.address import clean_address
from caseloom.functions.business import business_type, clean_names, liability_home
from caseloom.operators.topk import formatted
from caseloom.plans.steps import clean_measures, clean_step, typed
from caseloom.rules.names import FORMS, HOMES
from caseloom.rules.address import STREET_WORDS
from caseloom.sources import harmonise as H
from checks.cases import cases, cases_sql, table
from checks.registry import num, query, text

RAW_AMOUNTS = {
    "raw_amt": ("", "case l_linenumber when 1 then concat('$', cast(cast(l_quantity as int) as varchar(20)), ',', "
                    "cast(100 + cast(l_quantity as int) as varchar(20)), '.50') "
                    "when 2 then concat('(', cast(cast(l_quantity as int) as varchar(20)), ')') "
                    "when 3 then concat('−', cast(cast(l_quantity as int) as varchar(20)), '.25') "
                    "when 4 then 'abc' when 5 then '' when 6 then null "
                    "else concat(' ', cast(cast(l_quantity as int) as varchar(20)), ' ') end"),
    "raw_cnt": ("", "case when l_returnflag = 'A' then '-7' when l_returnflag = 'N' then '12d' else '1e2' end"),
}


def _cleaned(col: str) -> str:
    stripped = f"replace(replace(replace(replace(replace({col}, '$', ''), ',', ''), '−', '-'), ')', ''), '(', '-')"
    return f"abs(coalesce(TRY_CAST(trim({stripped}) AS DOUBLE), 0))"


@query("clean_numbers", f"""WITH {cases_sql(RAW_AMOUNTS)}
SELECT case_id_1, ord3, {_cleaned('raw_amt')} AS raw_amt, {_cleaned('raw_cnt')} AS raw_cnt, CAST(0 AS DOUBLE) AS absent
FROM cases""")
def clean_numbers(spark: SparkSession, sf: str) -> DataFrame:
    return clean_measures(cases(spark, sf, ["case_id_1", "ord3"], RAW_AMOUNTS), ["raw_amt", "raw_cnt", "absent"])


@query("one_line_texts", r"""SELECT doc_id, regexp_replace(text, '\s', ' ', 'g') AS text FROM documents""")
def one_line_texts(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").select("doc_id", T.one_line("text").alias("text"))


RAW_ADDRESS = {
    "raw_addr": ("part", "concat(case l_linenumber when 1 then '12 S. ' when 2 then '  5 E ' when 3 then '#' "
                         "when 4 then '1ST ' when 5 then 'Unit ' when 6 then '(9) N. ' else '7 ' end, "
                         "upper(p_name), case cast(l_quantity as int) % 9 when 0 then ' ST.' when 1 then ' Ave, Ste. 4' "
                         "when 2 then ' BLVD' when 3 then ' Boulevard; Apt 3' when 4 then ' CTR' when 5 then ' PROSPECT DR' "
                         "when 6 then ' Rd # 12' when 7 then ' & LN., STE 7-B' else ' PLZ,' end)"),
}


def _chain(start: str, steps: list[tuple[str, str]], regex: bool = False, options: str = "g") -> str:
    """Nested replacements; every step a literal, or a regular expression if so asked."""
    for find, put in steps:
        find, put = find.replace("'", "''"), put.replace("'", "''")
        start = f"regexp_replace({start}, '{find}', '{put}', '{options}')" if regex else f"replace({start}, '{find}', '{put}')"
    return start


def _address_tail(c: str) -> str:
    """Spacing, punctuation, spacing, written with single-character replacements."""
    spacing = lambda x: f"trim(replace(replace({x}, ',,', ','), '  ', ' '), ' ;,.')"
    c = spacing(c)
    c = _chain(c, [(ch, "") for ch in [",", ".", ";", "-", "'"]] + [("  ", " "), ("&", "and")])
    c = _chain(f"trim({c}, ' ;,.')", [(ch, "") for ch in "()|/*"] + [("  ", " ")])
    return spacing(c)


def _street_steps(edge: str) -> list[tuple[str, str]]:
    """One step per spelling and ending, the way a list of literal replacements would have it."""
    steps = []
    for forms in ([w for w in STREET_WORDS], [w if w == "PLZ" else w.capitalize() for w in STREET_WORDS]):
        for ending, kept in ((r"\.", ""), (",", ""), (" ", " ")):
            for short, word in zip(forms, STREET_WORDS.values()):
                find, put = (" ST", " Street") if short == "ST" else (edge + short, word)
                steps.append((find + ending, put + kept))
    return steps


def _address_sql(c: str, whole: bool) -> str:
    edge = r"\b" if whole else ""
    c = f"(trim(replace({c}, '  ', ' '), ' ;,.') || ' ')"
    steps = _street_steps(edge)
    steps += [("Boulevard", "Blvd."), ("Expressway", "Expy."), ("Building", "Bldg.")]
    for short in ("STE", "Ste", "APT", "Apt"):
        steps += [(rf"{edge}{short}\.", "Suite"), (f"{edge}{short} ", "Suite ")]
    steps += [(f"{edge}Unit{edge}", "Suite"), ("# ", "Suite "), ("#", "Suite ")]
    steps += [(rf"{edge}{a}\. ", f"{b} ") for a, b in (("S", "South"), ("W", "West"), ("E", "East"), ("N", "North"))]
    c = _chain(c, steps, regex=True)
    c = _chain(c, [(" S ", " South "), (" W ", " West "), (" E ", " East "), (" N ", " North ")])
    c = _chain(c, [(f"{edge}{a} ", f"{b} ") for a, b in (("1ST", "First"), ("2ND", "Second"), ("3RD", "Third"),
                                                        ("4TH", "Fourth"), ("5TH", "Fifth"))], regex=True, options="gi")
    return _address_tail(c)


@query("clean_address", f"WITH {cases_sql(RAW_ADDRESS)} SELECT case_id_1, ord3, {_address_sql('raw_addr', True)} AS addr FROM cases")
def clean_addresses(spark: SparkSession, sf: str) -> DataFrame:
    df = cases(spark, sf, ["case_id_1", "ord3"], RAW_ADDRESS)
    return clean_address(df, "raw_addr", "addr").drop("raw_addr")


@query("clean_address_loose", f"WITH {cases_sql(RAW_ADDRESS)} SELECT case_id_1, ord3, {_address_sql('raw_addr', False)} AS addr FROM cases")
def clean_addresses_loose(spark: SparkSession, sf: str) -> DataFrame:
    df = cases(spark, sf, ["case_id_1", "ord3"], RAW_ADDRESS)
    return clean_address(df, "raw_addr", "addr", whole_words=False).drop("raw_addr")


RAW_CITY = {"raw_city": ("part nation", "concat(case l_returnflag when 'A' then ' San, ' when 'N' then 'St. ' else '(Old) ' end, "
                                        "n_name, case l_linestatus when 'O' then ' & Co-op;' else '''s  /*' end)")}


@query("clean_city", f"WITH {cases_sql(RAW_CITY)} SELECT case_id_1, ord3, " + _chain(
    "trim(" + _chain("raw_city", [(ch, "") for ch in [",", ".", ";", "'"]] + [("  ", " "), ("&", "")]) + ", ' ;,.')",
    [(ch, "") for ch in "()|/*"] + [("  ", " ")]) + " AS city FROM cases")
def clean_city(spark: SparkSession, sf: str) -> DataFrame:
    df = cases(spark, sf, ["case_id_1", "ord3"], RAW_CITY)
    return df.select("case_id_1", "ord3", T.city_punctuation("raw_city").alias("city"))


RAW_NAMES = {
    "legal": ("customer part", "concat(p_name, case cast(l_quantity as int) % 12 when 0 then ', Inc.' when 1 then ' & Sons LLC' "
                          "when 2 then ' CORPORATION, a California corporation' when 3 then ' FRANCISCO' when 4 then "
                          "' Builders, individually and as partners' when 5 then ' LINCOLN PLUMBING CO.' when 6 then "
                          "', an individual' when 7 then ' a limited liability company' when 8 then ' (a Nevada L.L.C.)' "
                          "when 9 then ' a general partnership, LLP' when 10 then ', , , ;' else ' O''Brien''s a foreign non-profit' end)"),
    "trade": ("part", "concat(case l_linenumber when 1 then 'Company of ' when 2 then 'The  Comapany ' when 3 then "
                      "'an individual ' when 4 then '' else 'CONSTRUCTION ' end, p_name, '*')"),
}


def _name_punctuation(c: str) -> str:
    return _chain(f"trim(replace(replace({c}, '  ', ' '), '&', 'and'), ' ;,.')",
                  [(ch, "") for ch in [";", ",", ".", "-", "'", "(", ")", "|", "/", "*"]] + [("  ", " ")])


def _name_spacing(c: str) -> str:
    return f"(trim(replace(replace(replace({c}, '  ', ' '), ', , ', ', '), ', , , ', ', '), ' ;,.') || ' ')"


@query("clean_names", f"""WITH {cases_sql(RAW_NAMES)}
SELECT case_id_1, ord3, {_name_spacing(_name_punctuation('legal'))} AS legal,
  {_name_spacing(_name_punctuation('trade'))} AS trade FROM cases""")
def clean_name_texts(spark: SparkSession, sf: str) -> DataFrame:
    df = cases(spark, sf, ["case_id_1", "ord3"], RAW_NAMES)
    return df.withColumns({n: T.name_spacing(T.name_punctuation(n)) for n in ("legal", "trade")})


def _whole(phrases: tuple[str, ...]) -> str:
    """Phrases from long to short, each between word boundaries."""
    out = []
    for p in sorted(phrases, key=lambda x: (-len(x), x)):
        p = p.strip()
        body = "".join("\\" + ch if ch in ".()-&" and ch != "-" and ch != "&" else ch for ch in p)
        out.append(rf"\b{body}" + (r"\b" if p[-1].isalnum() else ""))
    return "(?:" + "|".join(out) + ")"


def _form_sql(source: str, loose: bool, with_homes: bool = True, carried: str = "case_id_1, ord3") -> tuple[str, str]:
    """One common table expression per form, each reading the names the one before has left."""
    parts, previous = [], source
    steps = [(r, "form") for r in FORMS] + ([(r, "home") for r in HOMES] if with_homes else [])
    for i, (rule, target) in enumerate(steps):
        marks = "(?:" + "|".join(rule.marks) + ")" if loose else _whole(rule.marks)
        hit = " OR ".join(f"regexp_matches({n}, '(?i){marks}')" for n in ("legal", "trade"))
        removed = (rule.loose_removed or rule.removed) if loose else (_whole(rule.removed),)
        new = {n: _chain(n, [(p, "") for p in removed], regex=True, options="gi") for n in ("legal", "trade")}
        other = "home" if target == "form" else "form"
        parts.append(f"f{i} AS (SELECT {carried}, {new['legal']} AS legal, {new['trade']} AS trade, "
                     f"CASE WHEN {hit} THEN '{rule.label}' ELSE {target} END AS {target}, {other} FROM {previous})")
        previous = f"f{i}"
    return ",\n".join(parts), previous


def _names_sql(loose: bool) -> str:
    start = (f"named AS (SELECT case_id_1, ord3, {_name_spacing(_name_punctuation('legal'))} AS legal, "
             f"{_name_spacing(_name_punctuation('trade'))} AS trade, '' AS form, '' AS home FROM cases)")
    steps, last = _form_sql("named", loose)
    return (f"WITH {cases_sql(RAW_NAMES)},\n{start},\n{steps}\nSELECT case_id_1, ord3, form AS \"Businesstype\", "
            f"home AS \"Liabilitytype\", {_name_punctuation('legal')} AS legal, {_name_punctuation('trade')} AS trade FROM {last}")


@query("business_type", _names_sql(loose=False))
def business_types(spark: SparkSession, sf: str) -> DataFrame:
    df = clean_names(cases(spark, sf, ["case_id_1", "ord3"], RAW_NAMES), ["legal", "trade"])
    return df.select("case_id_1", "ord3", "Businesstype", "Liabilitytype", "legal", "trade")


@query("business_type_loose", _names_sql(loose=True))
def business_types_loose(spark: SparkSession, sf: str) -> DataFrame:
    df = clean_names(cases(spark, sf, ["case_id_1", "ord3"], RAW_NAMES), ["legal", "trade"], loose=True)
    return df.select("case_id_1", "ord3", "Businesstype", "Liabilitytype", "legal", "trade")


def _raw_form_sql() -> str:
    steps, last = _form_sql("raw", False)
    return (f"WITH {cases_sql(RAW_NAMES)}, raw AS (SELECT case_id_1, ord3, legal, trade, '' AS form, '' AS home FROM cases),\n"
            f"{steps}\nSELECT form AS \"Businesstype\", home AS \"Liabilitytype\", count(*) AS cases FROM {last} GROUP BY form, home")


@query("business_type_counts", _raw_form_sql())
def business_type_counts(spark: SparkSession, sf: str) -> DataFrame:
    names = ["legal", "trade"]
    df = liability_home(business_type(cases(spark, sf, ["case_id_1", "ord3"], RAW_NAMES), names), names)
    return df.groupBy("Businesstype", "Liabilitytype").agg(F.count(F.lit(1)).alias("cases"))


RAW_TYPES = {
    "zip_cd": ("orders", "case l_linenumber when 1 then '95112-1234' when 2 then 'nan' when 3 then null "
                         "else lpad(cast(o_custkey % 1000 as varchar(20)), 5, '0') end"),
    "amt_text": ("", "case when l_linenumber = 4 then 'n/a' when l_linenumber = 5 then null "
                     "else concat(cast(cast(l_quantity as int) as varchar(20)), ',', '500.25') end"),
    "flag_text": ("", "case when l_returnflag = 'A' then '1' when l_returnflag = 'N' then '' else '0' end"),
}


@query("define_types", f"""WITH {cases_sql(RAW_TYPES)}
SELECT case_id_1, ord3, coalesce(replace(substr(zip_cd, 1, 5), 'nan', '0'), '0') AS zip_cd, upper(street_addr) AS street_addr,
  TRY_CAST(replace(amt_text, ',', '') AS DOUBLE) AS amt_text, coalesce(TRY_CAST(nullif(flag_text, '') AS INTEGER), -1) AS flag_text
FROM cases""")
def define_types(spark: SparkSession, sf: str) -> DataFrame:
    df = cases(spark, sf, ["case_id_1", "ord3", "street_addr"], RAW_TYPES)
    df = typed(df, ["street_addr"], numbers={"amt_text": "double", "flag_text": "int"})
    return df.withColumn("flag_text", F.coalesce("flag_text", F.lit(-1)))


# two sources with headers of their own: customers as one agency's file, suppliers as another's
@query("harmonise_sources", """WITH a AS (
  SELECT CAST(c_custkey AS VARCHAR) AS id, c_name AS legal_nm, '' AS trade_nm, '' AS st_cd, c_mktsegment AS naics_desc,
    greatest(abs(c_acctbal), 0) AS bw_amt, c_acctbal, 'DIR_DLSE' AS source,
    CASE WHEN c_custkey % 3 = 0 THEN NULL ELSE 'Open' END AS stage FROM customer),
b AS (SELECT CAST(s_suppkey AS VARCHAR) AS id, s_name AS legal_nm, s_name || ' dba' AS trade_nm, 'NV' AS st_cd, '' AS naics_desc,
    abs(s_acctbal) AS bw_amt, s_acctbal, 'DOL_WHD' AS source, NULL AS stage FROM supplier)
SELECT id AS case_id_1, legal_nm, trade_nm, CASE WHEN source = 'DIR_DLSE' AND st_cd = '' THEN 'CA' ELSE st_cd END AS st_cd,
  naics_desc, CAST(CAST(bw_amt AS DECIMAL(18,2)) AS DOUBLE) AS bw_amt, source, source AS juris_or_proj_nm,
  CASE WHEN source = 'DIR_DLSE' THEN coalesce(stage, 'Filed') ELSE '' END AS status,
  CASE WHEN source = 'DIR_DLSE' THEN '1999-03-04' END AS findings_start_date, '0' AS zip_cd,
  CASE WHEN source = 'DOL_WHD' THEN CAST(CAST(100.5 AS DECIMAL(18,2)) AS DOUBLE) ELSE 0 END AS ee_pmt_recv
FROM (SELECT * FROM a UNION ALL SELECT * FROM b)""")
def harmonise_sources(spark: SparkSession, sf: str) -> DataFrame:
    a = table(spark, sf, "customer").select(
        F.col("c_custkey").cast("string").alias("Case Number"), F.col("c_name").alias("Employer"),
        F.col("c_mktsegment").alias("NAICS Code Title"), F.lit("").alias("Primary Address State"),
        F.format_string("$%s", F.col("c_acctbal").cast("decimal(18,2)")).alias("EE(s) Amt Assessed"), F.lit("0").alias("Judgment Total"),
        F.lit("3/4/1999").alias("Date of Docket"), F.lit("1,000").alias("Interest Balance Due"),
        F.when(F.col("c_custkey") % 3 != 0, "Open").alias("Case Status"), F.lit("Filed").alias("Case Stage"))
    b = table(spark, sf, "supplier").select(
        F.col("s_suppkey").cast("string").alias("case_id"), F.col("s_name").alias("legal_name"),
        F.concat("s_name", F.lit(" dba")).alias("trade_nm"), F.lit("NV").alias("st_cd"),
        F.col("s_acctbal").cast("decimal(18,2)").cast("string").alias("bw_atp_amt"), F.lit("0").alias("ee_pmt_recv"),
        F.lit("$100.50").alias("EE_Payments_Received"), F.lit("no date").alias("findings_start_date"))
    both = H.stack([H.harmonise(H.tagged(a, "DIR_DLSE")), H.harmonise(H.tagged(b, "DOL_WHD"))])
    return both.select("case_id_1", "legal_nm", "trade_nm", "st_cd", "naics_desc", num("bw_amt"), "source", "juris_or_proj_nm",
                       F.col("Case Status").alias("status"), text("findings_start_date"), "zip_cd", num("ee_pmt_recv"))


@query("status_fill", f"""WITH {cases_sql()}
SELECT case_id_1, ord3, CASE WHEN findings_end_date IS NULL AND case_status IS NULL THEN 'APPEARS OPEN: NO END + NO STATUS'
  ELSE case_status END AS case_status FROM cases""")
def status_fill(spark: SparkSession, sf: str) -> DataFrame:
    df = cases(spark, sf, ["case_id_1", "ord3", "findings_end_date", "case_status"])
    return H.fill_status(df, status="case_status").drop("findings_end_date")


@query("format_table", f"""WITH {cases_sql()}
SELECT case_id_1, ord3, format('{{:,.0f}}', CAST(ee_pmt_recv AS DOUBLE)) AS ee_pmt_recv, format('{{:,.0f}}', ord3) AS amount FROM cases""")
def format_table(spark: SparkSession, sf: str) -> DataFrame:
    df = cases(spark, sf, ["case_id_1", "ord3", "ee_pmt_recv"]).withColumn("amount", F.col("ord3"))
    return formatted(df, ["ee_pmt_recv", "amount"])


# the whole cleaning step: every kind of raw cell at once, then duplicates within a source
RAW_CASES = {
    "_row": ("", "(cast(l_orderkey as bigint) * 8 + l_linenumber) * 100000000 + cast(cast(l_extendedprice as decimal(18,2)) * 100 as bigint)"),
    "legal_nm": RAW_NAMES["legal"], "trade_nm": RAW_NAMES["trade"], "street_addr": RAW_ADDRESS["raw_addr"],
    "cty_nm": RAW_CITY["raw_city"], "zip_cd": RAW_TYPES["zip_cd"],
    "st_cd": ("nation", "case when n_regionkey = 0 then 'ca' else '' end"),
    "violation": ("", "concat('Issue ', l_returnflag, case when l_linestatus = 'O' then '\n' else ' ' end, 'late')".replace("'\n'", "chr(10)")),
    "interest_owed": ("", "cast(0 as decimal(18,2))"),
}


BLANK_SOURCE = {"violation": ("region", "case when r_name = 'ASIA' then '' else concat('Issue ', l_returnflag, ' Issue ', l_linestatus) end")}


def _clean_step_sql(raw: dict = RAW_CASES, key: str = "source, case_id_1, violation",
                    rank: str = "bw_amt DESC NULLS LAST, form DESC NULLS LAST, _row") -> str:
    carried = "case_id_1, source, violation, street_addr, cty_nm, zip_cd, st_cd, bw_amt, _row"
    city = _chain("trim(" + _chain("cty_nm", [(ch, "") for ch in [",", ".", ";", "'"]] + [("  ", " "), ("&", "")]) + ", ' ;,.')",
                  [(ch, "") for ch in "()|/*"] + [("  ", " ")])
    start = (f"named AS (SELECT trim(case_id_1) AS case_id_1, source, regexp_replace(violation, '\\s', ' ', 'g') AS violation, "
             f"upper({_address_sql('street_addr', True)}) AS street_addr, upper({city}) AS cty_nm, "
             "coalesce(replace(substr(zip_cd, 1, 5), 'nan', '0'), '0') AS zip_cd, upper(st_cd) AS st_cd, bw_amt, _row, "
             f"{_name_spacing(_name_punctuation('legal_nm'))} AS legal, {_name_spacing(_name_punctuation('trade_nm'))} AS trade, "
             "'' AS form, '' AS home FROM cases)")
    steps, last = _form_sql("named", False, carried=carried)
    return (f"WITH {cases_sql(raw)},\n{start},\n{steps}\nSELECT case_id_1, source, violation, street_addr, cty_nm, zip_cd, st_cd, "
            f"CAST(bw_amt AS DOUBLE) AS bw_amt, _row, upper({_name_punctuation('legal')}) AS legal_nm, upper({_name_punctuation('trade')}) AS trade_nm, "
            f"form AS \"Businesstype\", home AS \"Liabilitytype\" FROM {last} QUALIFY row_number() OVER (PARTITION BY {key} ORDER BY {rank}) = 1")


@query("clean_step", _clean_step_sql())
def clean_step_query(spark: SparkSession, sf: str) -> DataFrame:
    columns = ["case_id_1", "source", "violation", "street_addr", "cty_nm", "zip_cd", "st_cd", "bw_amt", "_row", "legal_nm", "trade_nm"]
    df = cases(spark, sf, [c for c in columns if c not in RAW_CASES], RAW_CASES)
    return clean_step(df.select(*columns, "interest_owed")).select(
        *[num(c) if c == "bw_amt" else c for c in columns], "Businesstype", "Liabilitytype")


# a source that never gives a violation: only there (id, violation, amount) decides, and the first row stays
_ASIA = "CASE WHEN source = 'ASIA' THEN {} END"


@query("clean_step_blank_source", _clean_step_sql(
    {**RAW_CASES, **BLANK_SOURCE}, "source, case_id_1, violation, " + _ASIA.format("bw_amt"),
    "CASE WHEN source = 'ASIA' THEN NULL ELSE bw_amt END DESC NULLS LAST, CASE WHEN source = 'ASIA' THEN NULL ELSE form END DESC NULLS LAST, _row"))
def clean_step_blank_source(spark: SparkSession, sf: str) -> DataFrame:
    columns = ["case_id_1", "source", "violation", "street_addr", "cty_nm", "zip_cd", "st_cd", "bw_amt", "_row", "legal_nm", "trade_nm"]
    extra = {**RAW_CASES, **BLANK_SOURCE}
    df = cases(spark, sf, [c for c in columns if c not in extra], extra)
    return clean_step(df.select(*columns, "interest_owed")).select(
        *[num(c) if c == "bw_amt" else c for c in columns], "Businesstype", "Liabilitytype")
