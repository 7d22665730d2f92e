"""Places, industries, flags, agencies, term lookups."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from caseloom.functions import text as T
from caseloom.operators import agency as A
from caseloom.operators import flags as FL
from caseloom.operators.classify import infer_detail, infer_industry
from caseloom.operators.impute import penalty_terms
from caseloom.operators.lookup import default_amount, term_amount, term_amounts, unmatched_terms, unmatched_texts
from caseloom.operators.places import Place, infer_zip
from caseloom.plans.steps import infer_step
from caseloom.rules import agency as AR
from caseloom.rules import prevailing as PR
from caseloom.rules.book import compile_rule, name_rule
from caseloom.rules.industries import all_details, industry_names
from caseloom.rules.penalties import PENALTIES
from checks.cases import ORDER, cases, cases_sql, table
from checks.registry import num, query

# place names taken from the words of part names; the order matters, and some contain others
PLACES = [Place("Red Ring", "9000X"), Place("old", "9001X"), Place("red", "9002X"), Place("Blue Bolt", "9003X"),
          Place("bolt", "9004X"), Place("gear", "9005X"), Place("small gizmo", "9006X"), Place("small", "9007X"),
          Place("ring", "9008X"), Place("nation_1", "9009X"), Place("dget", "9010X")]

PLACE_TEXTS = {
    "zip_cd": ("orders", "case when l_linenumber <= 3 then '' when l_linenumber = 4 then '99999' when l_linenumber = 5 "
                         "then null when l_linenumber = 6 then '0' else lpad(cast(o_custkey % 1000 as varchar(20)), 5, '0') end"),
    "cty_nm": ("part nation", "case when l_quantity > 20 then '' when l_returnflag = 'A' then upper(p_name) "
                              "when l_returnflag = 'N' then null else n_name end"),
    "trade_nm": ("part", "case when l_linestatus = 'O' then concat(' The ', p_name, '-works') else 'x' end"),
    "legal_nm": ("part customer", "case when l_suppkey % 3 = 0 then concat(c_name, p_name) else c_name end"),
    "street_addr": ("part", "case when l_suppkey % 4 = 1 then concat(cast(p_size as varchar(20)), ' ', p_name, ' ST') else '5 main' end"),
    "juris_or_proj_nm": ("part", "concat('AG_', p_name)"),
    "office": ("part", "case when l_partkey % 5 = 0 then p_name else 'hq' end"),
}


def _place_case(c: str, bounded: bool, what: str) -> str:
    def found(p: Place) -> str:
        name = p.name.lower()
        return (rf"regexp_matches(lower(trim({c})), '\b{name}\b')" if bounded
                else f"contains(lower(trim({c})), '{name}')")
    return "CASE " + " ".join(f"WHEN coalesce({found(p)}, false) THEN {i if what == 'rank' else repr(p.code)}"
                              for i, p in enumerate(PLACES)) + " END"


@query("infer_place", f"""WITH {cases_sql(PLACE_TEXTS)}, ranked AS (
SELECT case_id_1, ord3, zip_cd, cty_nm, {_place_case('cty_nm', True, 'rank')} AS a,
  least({_place_case('trade_nm', True, 'rank')}, {_place_case('legal_nm', False, 'rank')}) AS b,
  {_place_case('street_addr', True, 'rank')} AS c,
  least({_place_case('juris_or_proj_nm', False, 'rank')}, {_place_case('office', True, 'rank')}) AS d FROM cases),
hit AS (SELECT *, CASE WHEN zip_cd IS NULL OR zip_cd IN ('', '0', '99999') THEN
  coalesce(a, CASE WHEN cty_nm IS NULL OR cty_nm = '' THEN b END, c, CASE WHEN cty_nm IS NULL OR cty_nm = '' THEN d END) END AS at_
  FROM ranked)
SELECT case_id_1, ord3, coalesce(CASE at_ {' '.join(f"WHEN {i} THEN '{p.code}'" for i, p in enumerate(PLACES))} END,
    CASE WHEN zip_cd NOT IN ('', '0', '99999') THEN zip_cd END, '99999') AS zip_cd,
  CASE at_ {' '.join(f"WHEN {i} THEN '{p.name}'" for i, p in enumerate(PLACES))} END AS inferred_city
FROM hit""")
def infer_place(spark: SparkSession, sf: str) -> DataFrame:
    df = cases(spark, sf, ["case_id_1", "ord3"], PLACE_TEXTS)
    return infer_zip(df, PLACES, office="office").select("case_id_1", "ord3", "zip_cd", "inferred_city")


# rules over the words and sizes of parts
TERMS = (
    ("Metal", "ring", "bolt", "^(1)", "^(22)"),
    ("Tools", "anvil", "gear", "(!small)", "^(3)"),
    ("Standard", "widget", "(!STANDARD blue)", "^(45)"),
    ("Cold", "cold", r"\bold\b", "(!cold plate)", "^(4)"),
    ("Promo", "gizmo.*", "(!red)", "^(49)", "^(9)"),
)
RULES = [compile_rule(t) for t in TERMS]
TRADES = {"name_a": ("part", "case when l_linenumber <= 2 then p_name else '' end"),
          "name_b": ("part", "case when l_linenumber = 3 then concat(p_type, ' ', p_name) when l_linenumber = 4 then null else 'acme' end"),
          "desc": ("part", "case when l_returnflag = 'A' then concat(p_type, ' ', p_name) when l_returnflag = 'N' then null else '' end"),
          "code": ("part", "case when l_linestatus = 'O' and l_suppkey % 2 = 0 then cast(p_size as varchar(20)) else '' end")}


def _rule_hit(c: str, terms: tuple[str, ...]) -> str:
    include = "|".join(terms)
    vetoes = [t.replace("!", "") for t in terms if "!" in t]
    hit = f"coalesce(regexp_matches({c}, '(?i)({include})'), false)"
    return f"({hit} AND NOT coalesce(regexp_matches({c}, '(?i)({'|'.join(vetoes)})'), false))" if vetoes else hit


def _rule_steps(source: str, terms_of: tuple, names: list[str], desc: str, code: str) -> tuple[list[str], str]:
    """The rules one after the other, each step reading the columns the last one set."""
    ctes, previous = [], source
    for i, terms in enumerate(terms_of, 1):
        label = terms[0]
        named = "(" + " OR ".join(_rule_hit(n, terms) for n in names) + ")"
        ctes.append(f"s{i}a AS (SELECT * REPLACE (CASE WHEN {named} THEN '{label}' ELSE trade2 END AS trade2) FROM {previous})")
        by_desc = f"((industry = '' OR industry IS NULL) AND {_rule_hit(desc, terms)})"
        ctes.append(f"s{i}b AS (SELECT * REPLACE (CASE WHEN {by_desc} THEN '{label}' ELSE industry END AS industry, "
                    f"CASE WHEN {by_desc} THEN '' ELSE trade2 END AS trade2) FROM s{i}a)")
        by_code = _rule_hit(code, terms)
        ctes.append(f"s{i} AS (SELECT * REPLACE (CASE WHEN {by_code} THEN '{label}' ELSE industry END AS industry, "
                    f"CASE WHEN {by_code} THEN '' ELSE trade2 END AS trade2) FROM s{i}b)")
        previous = f"s{i}"
    return ctes, previous


SETTLED_SQL = "CASE WHEN coalesce(industry, '') <> '' THEN industry WHEN trade2 <> '' THEN trade2 ELSE 'Undefined' END"


def _rules_sql() -> str:
    start = "s0 AS (SELECT case_id_1, ord3, name_a, name_b, \"desc\", code, industry, '' AS trade2 FROM cases)"
    ctes, last = _rule_steps("s0", TERMS, ["name_a", "name_b"], '"desc"', "code")
    return ("WITH " + ",\n".join([cases_sql(TRADES), start, *ctes])
            + f"\nSELECT case_id_1, ord3, {SETTLED_SQL} AS industry, trade2 FROM {last}")


@query("classify_rules", _rules_sql())
def classify_rules(spark: SparkSession, sf: str) -> DataFrame:
    df = cases(spark, sf, ["case_id_1", "ord3", "industry"], TRADES)
    return infer_industry(df, RULES, ["name_a", "name_b"], "desc", "code").select("case_id_1", "ord3", "industry", "trade2")


@query("industry_options", "SELECT * FROM (VALUES " + ", ".join(f"('{n}')" for n in industry_names()) + """) AS v(option)
UNION SELECT DISTINCT c_mktsegment FROM customer""")
def industry_options(spark: SparkSession, sf: str) -> DataFrame:
    known = spark.createDataFrame([(n,) for n in industry_names()], "option string")
    seen = table(spark, sf, "customer").select(F.col("c_mktsegment").alias("option"))
    return known.union(seen).distinct()


LISTS = [("BUILDING", ["Customer#0000001", "Supplier#00000003", "(!Supplier#000000031)"]),
         ("MACHINERY", ["Customer#00000012", r"Supplier#0{7}4"]), ("FURNITURE", ["Customer#0000000[45]", "(!Customer#00000005)"])]
LIST_RULES = [name_rule(label, names) for label, names in LISTS]
NAMED = ["legal_nm", "trade_nm"]


def _listed_sql(names: list[str]) -> str:
    return "(" + " OR ".join(_rule_hit(c, tuple(names)) for c in NAMED) + ")"


@query("flag_name_list", f"""WITH {cases_sql()}, flagged AS (
SELECT *, CASE WHEN {' OR '.join(_listed_sql(names) for _, names in LISTS)} THEN 1 ELSE 0 END AS "Signatory" FROM cases)
SELECT case_id_1, ord3, "Signatory", CASE {' '.join(
    f"WHEN {_listed_sql(names)} OR ({chr(34)}Signatory{chr(34)} = 1 AND industry = '{label}') THEN '{label}'"
    for label, names in reversed(LISTS))} ELSE 'Undefined' END AS signatory_industry FROM flagged""")
def flag_name_list(spark: SparkSession, sf: str) -> DataFrame:
    df = cases(spark, sf, ["case_id_1", "ord3", "industry", *NAMED])
    return FL.infer_signatories(df, LIST_RULES, NAMED).select("case_id_1", "ord3", "Signatory", "signatory_industry")


@query("flag_address_list", f"""WITH {cases_sql()}
SELECT case_id_1, ord3, CASE WHEN regexp_matches(street_addr, '(?i)(^12 red|blue bolt st)') THEN 1 ELSE 0 END AS "Signatory" FROM cases""")
def flag_address_list(spark: SparkSession, sf: str) -> DataFrame:
    df = cases(spark, sf, ["case_id_1", "ord3", "street_addr"])
    return FL.flag_by_address(df, "^12 red|blue bolt st").drop("street_addr")


@query("flag_name_and_address", f"""WITH {cases_sql()}
SELECT case_id_1, ord3, CASE WHEN regexp_matches(street_addr, '(?i)(ring st|gear)') AND (regexp_matches(legal_nm, '(?i)(#00000001|#0000002)')
  OR regexp_matches(trade_nm, '(?i)(#00000001|#0000002)')) THEN 1 ELSE 0 END AS "Signatory" FROM cases""")
def flag_name_and_address(spark: SparkSession, sf: str) -> DataFrame:
    df = cases(spark, sf, ["case_id_1", "ord3", "street_addr", *NAMED])
    return FL.flag_by_address(df, "ring st|gear", names=NAMED, name_pattern="#00000001|#0000002").drop("street_addr", *NAMED)


RAW_LISTED = {"trade_raw": ("supplier", "concat(' ', lower(s_name), case when l_suppkey % 2 = 0 then ', Inc.' else ' LLC' end)")}


@query("signatory_list_join", f"""WITH {cases_sql(RAW_LISTED)}
SELECT case_id_1, ord3, CASE WHEN l.s_name IS NOT NULL THEN 1 ELSE 0 END AS "Signatory"
FROM cases LEFT JOIN (SELECT DISTINCT s_name FROM supplier JOIN nation ON s_nationkey = n_nationkey WHERE n_regionkey = 2) l
  ON upper(trim(replace(replace(trade_raw, ', Inc.', ''), ' LLC', ''))) = upper(l.s_name)""")
def signatory_list_join(spark: SparkSession, sf: str) -> DataFrame:
    nation = table(spark, sf, "nation").where("n_regionkey = 2")
    members = table(spark, sf, "supplier").join(nation, F.col("s_nationkey") == F.col("n_nationkey"))
    names = FL.clean_list(members.select(F.concat("s_name", F.lit(" Company")).alias("name")), name="name")
    # the list's names go through the cleaning the cases get
    df = cases(spark, sf, ["case_id_1", "ord3"], RAW_LISTED)
    df = FL.clean_list(df, name="trade_raw").withColumn("name", F.trim("trade_raw"))
    return FL.listed(df.select("case_id_1", "ord3", "name"), names.select(F.trim("name").alias("name")), "name").drop("name")


WORKS = {
    "industry": ("customer", "case c_mktsegment when 'BUILDING' then 'Construction' when 'MACHINERY' then 'Utilities' else c_mktsegment end"),
    "reason": ("", "case when l_linenumber = 1 and l_returnflag = 'A' then 'Public notice of Works, misc' when l_linenumber = 2 and "
                   "l_returnflag = 'R' then 'Apprentices owed' when l_linenumber = 3 then null else 'Paid' end"),
    "viol": ("", "concat(case l_returnflag when 'A' then 'L.C. ' when 'N' then 'section ' else 'LC ' end, "
                 "cast(1700 + cast(l_quantity as int) * 2 as varchar(20)), case when l_linestatus = 'O' then ' unpaid' else '' end)"),
    "boss": ("nation", "case when l_suppkey % 6 = 0 then concat('City of ', n_name) when l_suppkey % 6 = 1 then 'Unified School, Dist 4' else n_name end"),
    "dbra": ("", "case when l_linenumber = 7 and l_returnflag = 'N' then 2 when l_linenumber = 6 then null else 0 end"),
    "vcode": ("", "'none'"),
}
_ALL_SECTIONS = "|".join(f"({spelling} {n})" for code, listed in PR.SECTIONS.items() for n in listed
                         for spelling in (code, "section", code.replace(".", "")))


@query("flag_conjunction", f"""WITH {cases_sql(WORKS)}, hit AS (
SELECT *, ((coalesce(regexp_matches(reason, '(?i)({'|'.join(PR.TERMS)})'), false)
    OR regexp_matches(viol, '(?i)({_ALL_SECTIONS})') OR regexp_matches(boss, '(?i)({'|'.join(PR.PUBLIC_BODIES)})'))
  AND industry IN ('Construction', 'Utilities')) AS marked FROM cases)
SELECT case_id_1, ord3, CASE WHEN marked OR coalesce(dbra > 0, false) THEN 1 ELSE 0 END AS "Prevailing",
  CASE WHEN coalesce(dbra > 0, false) THEN 'DBRA' ELSE vcode END AS vcode FROM hit""")
def flag_conjunction(spark: SparkSession, sf: str) -> DataFrame:
    df = cases(spark, sf, ["case_id_1", "ord3"], WORKS)
    return FL.prevailing_flag(df, ["reason"], ["viol"], ["boss"], federal="dbra", code="vcode").select(
        "case_id_1", "ord3", "Prevailing", "vcode")


AGENCIES = {"label": ("", "case when l_linenumber <= 2 then null else juris end".replace("juris", "concat('AG-', cast(l_suppkey as varchar(20)))")),
            "case_no": ("", "case when l_returnflag = 'A' then concat(cast(l_suppkey as varchar(20)), '-CM-', cast(l_orderkey as varchar(20))) "
                            "when l_returnflag = 'N' then concat('WC', cast(l_orderkey as varchar(20))) else cast(l_orderkey as varchar(20)) end")}


@query("derive_agency", f"""WITH {cases_sql(AGENCIES)}, filled AS (SELECT *, coalesce(label, CASE WHEN contains(case_no, '-')
    THEN split_part(case_no, '-', 1) ELSE left(case_no, 3) END) AS l FROM cases)
SELECT case_id_1, ord3, CASE WHEN regexp_matches(l, '{'|'.join(AR.LABEL_CODES)}') THEN 'DLSE' ELSE l END AS label FROM filled""")
def derive_agency(spark: SparkSession, sf: str) -> DataFrame:
    df = cases(spark, sf, ["case_id_1", "ord3"], AGENCIES)
    return A.infer_agency(df, "label", "case_no").select("case_id_1", "ord3", "label")


def _codes_sql(c: str) -> str:
    for code in AR.COLUMN_CODES:
        c = f"replace({c}, '{code}', 'DLSE')"
    return c


@query("replace_agency_codes", f"WITH {cases_sql(AGENCIES)} SELECT case_id_1, ord3, {_codes_sql('case_no')} AS case_no FROM cases")
def replace_agency_codes(spark: SparkSession, sf: str) -> DataFrame:
    df = cases(spark, sf, ["case_id_1", "ord3"], AGENCIES)
    return df.select("case_id_1", "ord3", A.replace_codes("case_no").alias("case_no"))


TERM_TEXTS = {"viol": ("", "concat('Issue ', case l_linenumber when 1 then 'overtime' when 2 then 'L.C. 226(a) paystub, Minimum wages' "
                           "when 3 then 'vacation wages; split shift premium wages' when 4 then 'l.c. 1197' when 5 then 'other' "
                           "when 6 then concat('L.C. ', cast(200 + cast(l_quantity as int) as varchar(20))) else '' end)")}


def _terms_sql(c: str, mean: str, default: str) -> str:
    whens = " ".join(f"WHEN contains(upper({c}), '{term.upper()}') THEN {mean if amount is None else float(amount)}"
                     for term, amount in reversed(PENALTIES))
    return f"CAST(CASE {whens} ELSE {default} END AS DOUBLE)"


@query("term_lookup", f"WITH {cases_sql(TERM_TEXTS)} SELECT case_id_1, ord3, {_terms_sql('viol', '1234.5', '26.30')} AS amount FROM cases")
def term_lookup(spark: SparkSession, sf: str) -> DataFrame:
    df = cases(spark, sf, ["case_id_1", "ord3"], TERM_TEXTS)
    return df.select("case_id_1", "ord3", term_amount("viol", penalty_terms(F.lit(1234.5)), default_amount()).cast("double").alias("amount"))


@query("term_unmatched", f"""WITH {cases_sql(TERM_TEXTS)} SELECT DISTINCT viol FROM cases
WHERE NOT ({' OR '.join(f"contains(upper(viol), '{term.upper()}')" for term, _ in PENALTIES)})""")
def term_unmatched(spark: SparkSession, sf: str) -> DataFrame:
    return unmatched_terms(cases(spark, sf, ["case_id_1"], TERM_TEXTS), "viol", [t for t, _ in PENALTIES])


# a term table drawn from the part names: pieces of one to eight letters, the later one wins
TERM_TABLE_SQL = """terms AS (SELECT substr(p_name, CAST(1 + p_partkey % 3 AS INT), CAST(1 + p_partkey % 8 AS INT)) AS term, max(p_partkey) AS ord,
  max(p_partkey) * 1.5 AS amount FROM part GROUP BY 1),
texts AS (SELECT DISTINCT naics_desc FROM cases),
hits AS (SELECT naics_desc, arg_max(amount, ord) AS amount FROM texts JOIN terms ON term <> '' AND contains(upper(naics_desc), upper(term)) GROUP BY naics_desc)"""


def _term_table(spark: SparkSession, sf: str) -> DataFrame:
    term = F.expr("substr(p_name, cast(1 + p_partkey % 3 as int), cast(1 + p_partkey % 8 as int))")
    return table(spark, sf, "part").groupBy(term.alias("term")).agg(F.max("p_partkey").alias("ord")).withColumn("amount", F.col("ord") * F.lit(1.5).cast("double"))


@query("term_table_lookup", f"""WITH {cases_sql()}, {TERM_TABLE_SQL}
SELECT case_id_1, ord3, CAST(coalesce(amount, 26.30) AS DOUBLE) AS amount FROM cases LEFT JOIN hits USING (naics_desc)""")
def term_table_lookup(spark: SparkSession, sf: str) -> DataFrame:
    df = cases(spark, sf, ["case_id_1", "naics_desc", *ORDER])
    found = term_amounts(df, "naics_desc", _term_table(spark, sf), default_amount(), "amount", ORDER)
    return found.select("case_id_1", "ord3", F.col("amount").cast("double").alias("amount"))


@query("term_table_unmatched", f"""WITH {cases_sql()}, {TERM_TABLE_SQL.replace("term <> ''", "length(term) = 8 AND ord % 3 = 0")}
SELECT naics_desc FROM texts WHERE naics_desc NOT IN (SELECT naics_desc FROM hits)""")
def term_table_unmatched(spark: SparkSession, sf: str) -> DataFrame:
    return unmatched_texts(cases(spark, sf, ["naics_desc"]), "naics_desc", _term_table(spark, sf).where((F.length("term") == 8) & (F.col("ord") % 3 == 0)))


WORDS = ("the", "ing on", "email", "license", "http")


@query("document_terms", f"""SELECT doc_id, CAST(CASE {' '.join(f"WHEN contains(upper(text), '{w.upper()}') THEN {i}.5" for i, w in reversed(list(enumerate(WORDS))))}
  ELSE 26.30 END AS DOUBLE) AS amount FROM documents""")
def document_terms(spark: SparkSession, sf: str) -> DataFrame:
    terms = [(w, F.lit(i + 0.5)) for i, w in enumerate(WORDS)]
    return table(spark, sf, "documents").select("doc_id", term_amount("text", terms, default_amount()).cast("double").alias("amount"))


# the whole inference step on the canonical columns
OFFICE = "Jurisdiction_region_or_General_Contractor"
STEP_TERMS = (("Construction", "bolt", r"\bold\b", "^(1)"), ("Utilities", "gear", "(!small)", "^(3)"), ("Retail", "widget", "ring.*", "(!red)", "^(45)"))
STEP_TEXTS = {
    **{c: e for c, e in PLACE_TEXTS.items() if c != "office"}, OFFICE: PLACE_TEXTS["office"],
    "juris_or_proj_nm": ("part", "concat(case l_linenumber when 1 then 'WC ' when 2 then '07-' else 'AG_' end, p_name)"),
    "industry": ("customer", "case when l_partkey % 9 < 6 then '' else c_mktsegment end"), "trade2": ("", "''"),
    "naics_desc": ("part", "case when l_returnflag = 'A' then p_name else '' end"),
    "naic_cd": ("part", "case when l_linestatus = 'O' then cast(p_size as varchar(20)) else '' end"),
    "Reason For Closing": WORKS["reason"], "Closure Disposition - Other Reason": ("", "case when l_linenumber = 4 then 'fringe pay' else '' end"),
    "violation": WORKS["viol"], "violation_code": ("", "''"), "Note": ("", "case when l_linenumber = 5 then 'P.C. 4104' else null end"),
    "dbra_cl_violtn_cnt": WORKS["dbra"],
}


def _infer_step_sql() -> str:
    def rank(c: str, bounded: bool) -> str:
        return _place_case(c, bounded, "rank")
    office = f'"{OFFICE}"'
    zips = f"""ranked AS (SELECT *, {rank('cty_nm', True)} AS a, least({rank('trade_nm', True)}, {rank('legal_nm', False)}) AS b,
    {rank('street_addr', True)} AS c, least({rank('juris_or_proj_nm', False)}, {rank(office, True)}) AS d FROM cases),
  hit AS (SELECT *, coalesce(a, CASE WHEN coalesce(cty_nm, '') = '' THEN b END, c, CASE WHEN coalesce(cty_nm, '') = '' THEN d END) AS at_ FROM ranked),
  placed AS (SELECT * REPLACE (CASE WHEN zip_cd IS NULL OR zip_cd IN ('', '0', '99999') THEN coalesce(CASE at_
    {' '.join(f"WHEN {i} THEN '{p.code}'" for i, p in enumerate(PLACES))} END, '99999') ELSE zip_cd END AS zip_cd) FROM hit)"""
    ctes, last = _rule_steps("placed", STEP_TERMS, ["legal_nm", "trade_nm"], "naics_desc", "naic_cd")
    marked = " OR ".join(
        [f"coalesce(regexp_matches({c}, '(?i)({'|'.join(PR.TERMS)})'), false)" for c in ('"Reason For Closing"', '"Closure Disposition - Other Reason"')]
        + [f"coalesce(regexp_matches({c}, '(?i)({_ALL_SECTIONS})'), false)" for c in ("violation_code", "violation", '"Note"')]
        + [f"regexp_matches(legal_nm, '(?i)({'|'.join(PR.PUBLIC_BODIES)})')"])
    final = f"labelled AS (SELECT * REPLACE ({SETTLED_SQL} AS industry, CASE WHEN regexp_matches(juris_or_proj_nm, '{'|'.join(AR.LABEL_CODES)}') THEN 'DLSE' ELSE juris_or_proj_nm END AS juris_or_proj_nm) FROM {last})"
    return ("WITH " + ",\n".join([cases_sql(STEP_TEXTS), zips, *ctes, final]) + f"""
SELECT case_id_1, ord3, zip_cd, industry, trade2, juris_or_proj_nm, CASE WHEN (({marked}) AND industry IN ('Construction', 'Utilities'))
  OR coalesce(dbra_cl_violtn_cnt > 0, false) THEN 1 ELSE 0 END AS "Prevailing",
  CASE WHEN coalesce(dbra_cl_violtn_cnt > 0, false) THEN 'DBRA' ELSE violation_code END AS violation_code,
  CAST(CASE WHEN bw_amt < ee_pmt_recv THEN 0 ELSE bw_amt - ee_pmt_recv END AS DOUBLE) AS wages_owed FROM labelled""")


@query("infer_step", _infer_step_sql())
def infer_step_query(spark: SparkSession, sf: str) -> DataFrame:
    df = cases(spark, sf, ["case_id_1", "ord3", "bw_amt", "ee_pmt_recv"], STEP_TEXTS)
    labelled = infer_step(df, PLACES, [compile_rule(t) for t in STEP_TERMS])
    return labelled.select("case_id_1", "ord3", "zip_cd", "industry", "trade2", "juris_or_proj_nm", "Prevailing", "violation_code", num("wages_owed"))


# parts of industries: by code, else by description, else by name, the more special part winning
DETAILED = {"name_a": ("part", "case when l_linenumber = 3 then concat(p_name, ' Yoga House') else p_name end"),
            "name_b": ("", "case when l_linenumber = 4 then 'First Church' else '' end"),
            "desc": ("", "case when l_returnflag = 'A' then 'Full service Restaurant' when l_returnflag = 'N' and l_linestatus = 'O' then 'Janitor work' else null end"),
            "code": ("", "case l_suppkey % 6 when 0 then '722513' when 1 then '562111' when 2 then '81211' when 3 then '62331' else '' end")}


@query("classify_detail", f"""WITH {cases_sql(DETAILED)}
SELECT case_id_1, ord3, CASE WHEN code = '722513' THEN 'Fast_food' WHEN code = '562111' THEN 'Waste' WHEN code = '81211' THEN 'Personal_care'
  WHEN code = '62331' THEN 'Residential_carehome' WHEN "desc" LIKE '%Restaurant%' THEN 'Restaurant' WHEN "desc" LIKE 'Janitor%' THEN 'Janitorial'
  WHEN name_b LIKE '%Church%' THEN 'Religion' WHEN name_a LIKE '%Yoga%' THEN 'Fitness' END AS industry_detail FROM cases""")
def classify_detail(spark: SparkSession, sf: str) -> DataFrame:
    df = cases(spark, sf, ["case_id_1", "ord3"], DETAILED)
    return infer_detail(df, all_details(), ["name_a", "name_b"], "desc", "code").select("case_id_1", "ord3", "industry_detail")
