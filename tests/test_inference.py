"""Places, rules, flags, agencies."""

from __future__ import annotations

from pyspark.sql import functions as F

import random

from caseloom.operators.agency import infer_agency, replace_codes
from caseloom.operators.classify import infer_industry
from caseloom.operators.flags import infer_signatories, prevailing_flag
from caseloom.operators.places import Place, infer_zip, places_from, region_options, region_zips
from caseloom.rules.book import check_terms, compile_rule, exclusion_pattern, name_rule, read_rules
from caseloom.rules.industries import TERMS, all_industries
from caseloom.rules.prevailing import SECTIONS, section_pattern

CITIES = [("Chino_Zipcode", "Chino", 1, ["91708", "91710"]), ("Chino_Hills_Zipcode", "Chino Hills", 2, ["91709"]),
          ("Chula_Vista_Zipcode", "Chula Vista", 3, ["91910", "91915"]), ("Vista_Zipcode", "Vista", 4, ["92081", "92084"])]


def dims(spark):
    city = spark.createDataFrame(CITIES, "city_key string, city string, ord int, zips array<string>")
    county = spark.createDataFrame([("A_County", "Chino_Zipcode"), ("A_County", "Chino_Hills_Zipcode"), ("B_County", "Vista_Zipcode")],
                                   "county string, city_key string")
    state = spark.createDataFrame([("California", "A_County"), ("California", "B_County")], "state string, county string")
    return city, county, state


def test_regions(spark):
    def zips(**region):
        return sorted(r["zip"] for r in region_zips(*dims(spark), **region).collect())
    assert zips(city="Chino_Zipcode") == ["91708", "91710", "9171X"]
    assert zips(county="A_County") == ["91708", "91709", "9170X", "91710", "9171X"]
    assert zips(state="California") == ["91708", "91709", "9170X", "91710", "9171X", "92081", "92084", "9208X"]
    assert "Chula Vista" in [r[0] for r in region_options(dims(spark)[0]).collect()]


def test_places_overlap(spark):
    places = places_from(dims(spark)[0])
    blank = ("", "", "", "", "", "")
    cells = [("chino hills",) + blank[1:], ("CHULA VISTA",) + blank[1:], ("", "vistamar", "xvistax", "", "", ""), ("", "", "", "1 Vista ave", "", ""),
             ("nowhere", "vista inc", "", "", "vista", ""), ("", "", "", "", "preVISTAl", ""), ("", "vista co", "chino co", "", "", "")]
    df = spark.createDataFrame([(i, "0", *c) for i, c in enumerate(cells)],
                               "i int, zip_cd string, cty_nm string, trade_nm string, legal_nm string, street_addr string, "
                               "juris_or_proj_nm string, Jurisdiction_region_or_General_Contractor string")
    got = [r["zip_cd"] for r in infer_zip(df, places).orderBy("i").collect()]
    # the earlier place wins, so "chino hills" is taken for chino and "chula vista" for itself
    assert got == ["9171X", "9191X", "9208X", "9208X", "99999", "9208X", "9171X"]


def reference_industry(row, rules):
    """The loop the rules describe."""
    import re
    industry, detail = row["industry"] or "", ""
    hit = lambda text, r: bool(text) and bool(re.search(r.include, text, re.I)) and not re.search(r.exclude, text, re.I)
    for r in rules:
        if hit(row["legal"], r) or hit(row["trade"], r):
            detail = r.label
        if industry == "" and hit(row["desc"], r):
            industry, detail = r.label, ""
        if hit(row["code"], r):
            industry, detail = r.label, ""
    return (industry or detail or "Undefined"), detail


def test_industry_rules_equal_the_loop(spark):
    rng = random.Random(1)
    words = ["farm market", "roofing", "power", "plumbing", "school of medicine", "hotel", "auto repair", "data", "hospital", "", None]
    data = [(i, rng.choice(words), rng.choice(words), rng.choice(words), rng.choice(["", "2382", "621", "611", "99", None]),
             rng.choice(["", None, "Retail"])) for i in range(400)]
    df = spark.createDataFrame(data, "i int, legal string, trade string, desc string, code string, industry string")
    rules = all_industries()
    expected = {r["i"]: reference_industry(r.asDict(), rules) for r in df.collect()}
    got = infer_industry(df, rules, ["legal", "trade"], "desc", "code").collect()
    assert {r["i"]: (r["industry"], r["trade2"]) for r in got} == expected


def test_rule_tables_are_sound():
    assert exclusion_pattern(["a", "(!b)", "!c"]) == "(b)|c"
    assert exclusion_pattern(["a"]) == "999999"
    assert check_terms(["L", "x(!y)", "x(!y)", " "]) == ["two terms in one: x(!y)", "repeated: x(!y)", "two terms in one: x(!y)",
                                                        "empty term matches everything"]
    assert not [f for terms in TERMS for f in check_terms(terms)]


def test_rules_from_a_file(spark, tmp_path):
    path = tmp_path / "rules.csv"
    path.write_text("rule_set,ord,label,term_ord,term\ns,2,B,1,bee\ns,1,A,2,(!no)\ns,1,A,1,ay\nt,1,C,1,sea\n")
    assert read_rules(spark, str(path), "s") == [compile_rule(["A", "ay", "(!no)"]), compile_rule(["B", "bee"])]


def test_signatories(spark):
    lists = [name_rule("Health_care", ["Good Hospital"]), name_rule("Construction", ["Ace", "(!Ace Foods)"])]
    df = spark.createDataFrame([("Ace Paving", "", ""), ("Ace Foods", "", ""), ("", "good hospital x", "Construction"), ("Zed", "", "")],
                               "legal_nm string, trade_nm string, industry string")
    got = [(r["Signatory"], r["signatory_industry"]) for r in infer_signatories(df, lists, ["legal_nm", "trade_nm"]).collect()]
    assert got == [(1, "Construction"), (0, "Undefined"), (1, "Construction"), (0, "Undefined")]


def test_sections_cover_three_spellings(spark):
    import re
    pattern = re.compile(section_pattern(), re.I)
    for code, listed in SECTIONS.items():
        for n in listed:
            assert all(pattern.search(t) for t in (f"{code} {n}", f"{code.replace('.', '')} {n}", f"section {n}"))
    assert sum(len(v) for v in SECTIONS.values()) * 3 == 342
    assert not pattern.search("L.C. 999")


def test_prevailing(spark):
    df = spark.createDataFrame([("prevailing rate", "", "x", "Construction", 0, ""), ("", "LC 1771", "x", "Retail", 0, ""),
                                ("", "", "City of X", "Utilities", None, ""), ("", "", "x", "Retail", 3, "")],
                               "why string, viol string, boss string, industry string, dbra_cl_violtn_cnt int, violation_code string")
    got = [(r["Prevailing"], r["violation_code"]) for r in prevailing_flag(df, ["why"], ["viol"], ["boss"]).collect()]
    assert got == [(1, ""), (0, ""), (1, ""), (1, "DBRA")]


def test_agencies(spark):
    df = spark.createDataFrame([("05-123", None), ("WC-CM-1", None), ("1234567", None), ("9", "County"), ("ab-1", None)], "case_id_1 string, juris_or_proj_nm string")
    assert [r["juris_or_proj_nm"] for r in infer_agency(df).collect()] == ["DLSE", "DLSE", "DLSE", "County", "ab"]
    codes = spark.createDataFrame([("1025",), ("WC-7",)], "c string")
    assert [r[0] for r in codes.select(replace_codes("c")).collect()] == ["1DLSE5", "DLSE-7"]


def test_unplaced_rows_are_marked(spark):
    df = spark.createDataFrame([("", "", "", "", "", "", "")], "zip_cd string, cty_nm string, trade_nm string, legal_nm string, "
                               "street_addr string, juris_or_proj_nm string, Jurisdiction_region_or_General_Contractor string")
    r = infer_zip(df, [Place("Napa", "9455X")]).first()
    assert (r["zip_cd"], r["inferred_city"]) == ("99999", None)


def test_vocabularies_hold_what_they_should():
    """Typed by hand, since the SQL of the queries draws on the same tables."""
    from caseloom.rules.agency import COLUMN_CODES, LABEL_CODES
    from caseloom.rules.industries import DETAILS
    from caseloom.rules.penalties import MEAN_CEILING, MEAN_PLUG, PENALTIES, PENALTY_SHARE
    amounts = dict(PENALTIES)
    assert len(PENALTIES) == 37 and sum(a is None for a in amounts.values()) == 10
    assert (amounts["L.C. 203"], amounts["VACATION WAGES"], amounts["MINIMUM WAGES"], amounts["L.C. 1771"], amounts["Overtime"]) == (3600, 2000, 50, 125, None)
    assert (MEAN_CEILING, MEAN_PLUG, PENALTY_SHARE) == (4000, 3368, 0.125)
    assert {code: len(listed) for code, listed in SECTIONS.items() if len(listed) < 10} == {
        "P.C.": 6, "P.R.C.": 3, "P.U.C.": 8, "S.H.C.": 2, "W.C.": 1, "W.I.C.": 1, "E.C.": 2, "F.G.C.": 2, "G.C.": 9, "H.S.C.": 8}
    assert SECTIONS["L.C."][:3] == ("223", "1720", "1720.2") and SECTIONS["L.C."][-1] == "1861"
    assert (len(LABEL_CODES), len(COLUMN_CODES), COLUMN_CODES[0], COLUMN_CODES[-3:]) == (20, 27, "01", ("25", "35", "WC"))
    assert not [f for terms in DETAILS for f in check_terms(terms)]


def test_a_hundred_thousand_terms_without_a_nested_loop(spark):
    import random

    from caseloom.operators.lookup import term_amounts, unmatched_texts
    rng = random.Random(12)
    letters = "abcdefg hijklmnop.é😀"

    def piece(low, high):
        return "".join(rng.choice(letters) for _ in range(rng.randrange(low, high)))

    terms = [(piece(5, 12), i, float(i)) for i in range(100_000)] + [("e", 100_000, 7.5), ("Q", 100_001, 8.5), ("", 100_002, 9.5), (None, 100_003, 1.0), ("wAge claim", 200_000, 3.5)]
    texts = [piece(0, 60) for _ in range(120)] + [terms[i][0].upper() + piece(0, 9) for i in range(0, 100_000, 2500)] + ["", None, "no WAGE claim here", "wage", "abc"]
    rows = [(i, t) for i, t in enumerate(texts)] + [(10_000 + i, "no WAGE claim here") for i in range(100)]
    df = spark.createDataFrame(rows, "_row long, text string")
    table = spark.createDataFrame(terms, "term string, ord long, amount double").repartition(5)
    listed = [((t or "").upper(), a) for t, _, a in sorted(terms, key=lambda x: -x[1])]

    def plain(text):
        return next((a for t, a in listed if t and t in (text or "").upper()), None)

    want = {t: plain(t) for t in set(texts)}
    found = term_amounts(df, "text", table, F.lit(26.3), "amount", ["_row"])
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan
    got = {r["_row"]: r["amount"] for r in found.collect()}
    assert got == {i: 26.3 if want[t] is None else want[t] for i, t in rows}
    assert want["no WAGE claim here"] == 3.5 and found.columns == ["_row", "text", "amount"]
    none = unmatched_texts(df, "text", table)
    assert "NestedLoop" not in none._jdf.queryExecution().executedPlan().toString()
    assert sorted(r["text"] for r in none.collect()) == sorted({t or "" for t in texts if want[t] is None})
    assert term_amounts(df, "text", table.limit(0), F.lit(26.3), "amount", ["_row"]).where("amount <> 26.3").count() == 0


def test_repeat_tables_equal_groups_one_by_one(spark):
    import random

    from caseloom.operators import group as G
    rng = random.Random(2)
    rows = [(rng.choice(["a", "A", "b", "", None, "nan", f"x{i % 90}"]), "hot" if i % 3 else f"y{i % 7}", float(i % 5) if i % 4 else None, i % 3, 1.0, 2.0, i) for i in range(600)]
    df = spark.createDataFrame(rows, "legal_nm string, trade_nm string, bw_amt double, violtn_cnt int, ee_violtd_cnt double, ee_pmt_recv double, _row long").repartition(5)
    tables = G.repeat_tables(df, ["legal_nm", "trade_nm"], ["_row"], 5)
    for key in ("legal_nm", "trade_nm"):
        whole = G.repeat_groups(df, key, ["_row"]).orderBy(F.desc("records"), key).limit(5)
        some = G.repeats_of(tables, key).select(whole.columns)
        assert sorted(map(tuple, some.collect()), key=repr) == sorted(map(tuple, whole.collect()), key=repr)
    assert G.repeat_tables(df.limit(0), ["legal_nm"], ["_row"], 5).count() == 0


def test_repeat_tables_shuffle_counts_and_winners_alone(spark):
    """No measure and no attribute is shuffled for a group that does not win; a first row is found by several columns, with gaps."""
    from caseloom.operators import group as G
    rows = [(f"x{i % 40}", float(i), None if i % 7 == 0 else i % 3, -i, f"note {i}") for i in range(400)]
    df = spark.createDataFrame(rows, "legal_nm string, bw_amt double, a int, b int, note string").repartition(4)
    tables = G.repeat_tables(df, ["legal_nm"], ["a", "b"], 3, ("bw_amt",))
    plan = tables._jdf.queryExecution().executedPlan().toString()
    wide = [line for line in plan.splitlines() if "Exchange hashpartitioning(no" in line and "value" in line]
    assert wide and plan.count("SortMergeJoin") == 0
    got = {r["value"]: (r["records"], r["bw_amt"], r["a"], r["b"], r["note"]) for r in tables.collect()}
    want = {}
    for value in ("X0", "X1", "X10"):  # 40 groups of ten: the lesser value wins
        own = [r for r in rows if r[0].upper() == value]
        lead = min(own, key=lambda r: (r[2] is not None, r[2] or 0, r[3]))
        want[value] = (10, sum(r[1] for r in own), *lead[2:])
    assert got == want
    counted = G.repeat_tables(df, ["legal_nm"], ["a", "b"], 3, ("bw_amt",))._jdf.queryExecution().optimizedPlan().toString()
    assert "min_by(" in counted and "dropDuplicates" not in counted and counted.count("min(struct(") == 0


def test_many_places_agree_with_a_loop_over_the_list(spark):
    """1,241 names, some inside others, some twice: the earliest listed one that stands in the text."""
    import random
    import re

    from caseloom.operators.places import place_in
    rng = random.Random(8)
    parts = ["san", "santa", "chino", "hills", "jose", "la", "el", "monte", "park", "st. helena", "o'neil", "bay", "valley", "lake"]
    names = ["chino", "san jose", "chino hills", "park", "san", "st.", "lake-side", "san"]
    names += [" ".join(rng.choices(parts, k=rng.randrange(1, 4))) + rng.choice(["", "", "s", f" {rng.randrange(99)}"]) for _ in range(1241 - len(names))]
    texts = [" ".join(rng.choices([*parts, "of", "sanjose", "chinohills", "12", "lake-side", "CHINO", "parks", "x."], k=rng.randrange(0, 7))) for _ in range(400)] + ["", None]
    df = spark.createDataFrame(list(enumerate(texts)), "i long, t string")
    places = [Place(n.title(), "90000") for n in names]
    got = {r["i"]: (r["w"], r["s"]) for r in df.select("i", place_in("t", places).alias("w"), place_in("t", places, whole_words=False).alias("s")).collect()}
    for i, text in enumerate(texts):
        text = (text or "").lower().strip()
        whole = next((k for k, n in enumerate(names, 1) if re.search(rf"\b{re.escape(n)}\b", text)), None)
        part = next((k for k, n in enumerate(names, 1) if n in text), None)
        assert got[i] == (whole, part), text
    assert df.select(place_in("t", []).alias("p")).where("p is not null").count() == 0


def test_checkpoints_need_a_shared_folder():
    import pytest

    from caseloom.session import fallback_dir
    assert fallback_dir("file:/w/warehouse/", "local[4]") == "file:/w/warehouse/_checkpoints"
    assert fallback_dir("hdfs://n/warehouse", "yarn") == "hdfs://n/warehouse/_checkpoints"
    for master in ("yarn", "spark://h:7077", "local-cluster[2,1,1024]"):
        with pytest.raises(ValueError, match="share"):
            fallback_dir("/w/warehouse", master)
