"""Options, and figures checked by hand."""

from __future__ import annotations

from datetime import date

import pytest

from caseloom.operators import group as G
from caseloom.operators import summary as S
from caseloom.operators.impute import fill_penalties, fill_wages, owed_amounts, wage_means
from caseloom.plans.report import REQUIRED, ReportOptions, has_records, options_from
from caseloom.rules.industries import labels_for

DAY = date(2024, 2, 29)


def test_option_rules():
    o = ReportOptions(target_city="X", target_county="Y", only_significant=True).normalise(DAY)
    assert (o.target_state, o.target_county, o.target_city) == ("", "", "X")
    assert o.include_federal and o.include_state_cases and o.include_state_judgements and o.infer_zip and o.infer_by_naics
    assert o.include_summaries and o.include_tables and o.include_top_tables
    assert (o.year_start, o.year_end, o.target_industry) == (date(2020, 2, 29), DAY, "All NAICS")
    assert ReportOptions().normalise(DAY).target_state == "California"
    assert ReportOptions(include_federal=True).normalise(DAY).infer_zip is False
    assert ReportOptions(target_county="Y").normalise(date(2023, 5, 1)).year_start == date(2019, 5, 1)


def test_requests():
    request = dict.fromkeys(REQUIRED, 0) | {"target_city": "", "target_industry": "Real Estate", "target_organization": "A|B",
                                            "YEAR_START": "2016/05/01", "YEAR_END": "today", "include_tables": "1"}
    o = options_from(request)
    assert (o.year_start, o.year_end, o.include_tables, o.target_organization) == (date(2016, 5, 1), None, True, "A|B")
    assert labels_for(o.target_industry) == ["Real_estate"]
    with pytest.raises(ValueError, match="YEAR_END"):
        options_from({k: v for k, v in request.items() if k != "YEAR_END"})


def cases(spark):
    """55 cases: three agencies, three statuses that repeat and others that do not."""
    agencies = ["TEST"] * 30 + ["DLSE"] * 17 + ["DLSE_WAGECLAIM"] * 8
    statuses = ["Open"] * 10 + ["Judgment"] * 7 + ["P"] * 2 + [None] * 30 + [f"once {i}" for i in range(6)]
    rows = [(i, f"Employer {i % 29}", agencies[i], statuses[i], 4437.0 if i else 4479.0, 0.0, 1, 1, 5000.0) for i in range(55)]
    return spark.createDataFrame(rows, "_row long, legal_nm string, juris_or_proj_nm string, status string, bw_amt double, "
                                       "ee_pmt_recv double, ee_violtd_cnt int, violtn_cnt int, backwage_owed double")


def test_summary_figures(spark):
    df = cases(spark)
    grouped = G.group_by_key(df, "legal_nm", ["_row"])
    multi = G.multi_agency(df, "legal_nm", "juris_or_proj_nm", ["_row"])
    r = S.report_summary(df, grouped, multi).first()
    assert (r["cases"], r["back_wages"], r["wage_per_employee"]) == (55, 244077.0, 4437.0)
    assert f"{r['penalty_per_employee']:,.0f}" == "555"
    assert (r["employers"], r["repeat_employers"], r["violations_per_employee"]) == (29, 26, 1.0)
    assert grouped.agg({"records": "sum", "bw_amt": "sum"}).first().asDict() == {"sum(records)": 55, "sum(bw_amt)": 244077.0}
    assert r["multi_agency_employers"] == multi.count()


def test_status_shares(spark):
    got = {r["status"]: (r["cases"], f"{r['share']:.0%}") for r in S.status_shares(cases(spark), "status").collect()}
    assert got == {"Open": (10, "18%"), "Judgment": (7, "13%"), "<Not Defined>": (2, "4%")}


def test_agency_groups(spark):
    groups = G.repeat_groups(cases(spark), "juris_or_proj_nm", ["_row"], carry=[])
    assert {r["juris_or_proj_nm"]: r["records"] for r in groups.collect()} == {"TEST": 30, "DLSE": 17, "DLSE_WAGECLAIM": 8}


def test_agencies_are_listed_by_first_appearance(spark):
    df = spark.createDataFrame([(1, "a", "z", 1.0), (2, "A", "b", 1.0), (3, "a", "Z", 1.0), (4, "nan", "b", 1.0), (5, "c", "", 1.0)],
                               "_row long, e string, g string, bw_amt double")
    r, = G.multi_agency(df, "e", "g", ["_row"], ("bw_amt",)).collect()
    assert (r["e"], r["g"], r["agency_names"], r["records"], r["agencies"]) == ("A", "Z", "Z, B", 3, 2)


def test_subtotals_equal_their_lines(spark):
    df = spark.createDataFrame([("x", "1", 2), ("x", "1", 3), ("x", "2", 5), ("y", "1", 7), (None, "1", 9)], "a string, b string, n int")
    got = {(r["a"], r["b"]): r["n"] for r in G.subtotals(df, "a", "b", ["n"], "ALL").collect()}
    assert got == {("x", "1"): 5, ("x", "2"): 5, ("x", "ALL"): 10, ("y", "1"): 7, ("y", "ALL"): 7}


def test_imputation(spark):
    from pyspark.sql import functions as F
    df = spark.createDataFrame([(1000.0, 2, 0), (None, 3, 4), (0.0, None, 0)], "bw_amt double, ee_violtd_cnt int, violtn_cnt int")
    means = wage_means(df)
    r = fill_penalties(fill_wages(df, means), means).orderBy(F.desc("ee_violtd_cnt")).collect()
    # mean of 1000 and 0 is 500 per employee; then (1000 + 1500 + 500) / 3 = 1000, an eighth of which is the penalty
    assert [(float(x["bw_amt"]), x["assumed_backwage"], x["violtn_cnt"], float(x["cmp_assd_cnt"])) for x in r] == [
        (1500.0, "YES", 4, 125.0), (1000.0, "NO", 2, 125.0), (500.0, "YES", 1, 125.0)]


def test_owed(spark):
    from pyspark.sql import functions as F
    df = spark.createDataFrame([(1000.0, 0.0, 10.0, -5.0, date(2023, 1, 1), None), (1000.0, 0.0, 10.0, 0.0, None, None)],
                               "bw_amt double, ee_pmt_recv double, cmp_assd_cnt double, Interest_Payments_Recd double, "
                               "findings_start_date date, findings_end_date date")
    a, b = owed_amounts(df, F.lit(date(2024, 1, 1))).collect()
    assert float(a["interest_owed"]) == round(1000 * (1 + 0.07 / 365) ** 365 - 1000, 2)
    assert float(a["backwage_owed"]) == float(a["interest_owed"]) + 1010
    assert b["interest_owed"] is None and b["backwage_owed"] is None


def test_empty_reports(spark):
    df = cases(spark).where("false")
    assert not has_records(df)
    assert S.report_summary(df, G.group_by_key(df, "legal_nm", ["_row"]),
                            G.multi_agency(df, "legal_nm", "juris_or_proj_nm", ["_row"])).first()["cases"] == 0


def test_reliable_reports_cut_their_lineage(spark):
    """The rows on show are written to the session's shared folder; tables no longer depend on the source files."""
    from caseloom.session import checkpoint_dir, materialise
    kept = materialise(cases(spark).where("bw_amt > 0"), reliable=True)
    assert kept.count() == 55
    assert "Scan ExistingRDD" in kept._jdf.queryExecution().executedPlan().toString()
    configured = spark.conf.get("spark.checkpoint.dir", None)
    assert not configured or (checkpoint_dir(spark) == configured and configured in spark.sparkContext.getCheckpointDir())
    assert materialise(cases(spark)).storageLevel.useDisk


def region_tables(spark):
    city = spark.createDataFrame([("San_Jose_city", "San Jose", ["95112", "95113"]), ("Napa_city", "Napa", ["94558"])], "city_key string, city string, zips array<string>")
    county = spark.createDataFrame([("Santa_Clara", "San_Jose_city"), ("Napa", "Napa_city")], "county string, city_key string")
    state = spark.createDataFrame([("Elsewhere", "Napa")], "state string, county string")
    return city, county, state


def test_region_options_choose_the_population(spark):
    from caseloom.plans.report import Lookups, scoped_rows
    rows = [(i, z, "CA", s, "v", str(i), 1.0, 0.0, "", "", "", date(2023, 1, 1), None) for i, (z, s) in enumerate(
        [("95112", "DOL_WHD"), ("9511X", "DIR_DLSE"), ("94558", "DOL_WHD"), ("00000", "DLSE_J-23")])]
    df = spark.createDataFrame(rows, "_row long, zip_cd string, st_cd string, source string, violation string, case_id_1 string, bw_amt double, interest_owed double, "
                                     "Businesstype string, legal_nm string, trade_nm string, findings_start_date date, findings_end_date date")
    lookups = Lookups(regions=region_tables(spark))

    def seen(with_lookups=lookups, **asked):
        return sorted(r["_row"] for r in scoped_rows(df, ReportOptions(**asked).normalise(DAY), with_lookups).collect())
    assert seen(target_city="San Jose") == seen(target_city="San_Jose_city") == seen(target_county="Santa Clara") == [0, 1]
    assert seen(target_state="Elsewhere") == [2] and seen(target_city="Nowhere") == []
    assert seen() == [0, 1, 2, 3] and seen(include_federal=True) == [0, 2]
    assert seen(include_state_judgements=True) == [3] and seen(include_state_cases=True, target_city="San Jose") == [1]
    with pytest.raises(ValueError, match="San Jose"):
        seen(Lookups(), target_city="San Jose")


def test_exported_violators_are_as_many_as_the_headline_counts(spark, tmp_path):
    from pyspark.sql import functions as F
    from caseloom.plans.report import report_tables, write_report
    df = spark.range(3600).select(F.col("id").alias("_row"), F.concat(F.lit("E"), "id").alias("legal_nm"), F.lit(1).alias("Prevailing"), F.lit(2.0).alias("bw_amt"),
                                  F.lit(1).alias("violtn_cnt"), F.lit(1).alias("ee_violtd_cnt"), F.lit(0.0).alias("ee_pmt_recv"), F.lit("x").alias("trade_nm"))
    o = ReportOptions(prevailing_wage_report=True, signatories_report=False).normalise(DAY)
    tables = report_tables(df, df, df, o, {"prevailing_headline", "prevailing_violators"})
    write_report(tables, str(tmp_path))
    exported = spark.read.option("header", True).csv(str(tmp_path / "prevailing_violators"))
    assert exported.count() == tables["prevailing_headline"].first()["cases"] == 3600


def test_two_way_tables_are_ordered_and_formatted(spark):
    from caseloom.operators.topk import two_way
    df = spark.createDataFrame([("b", "x", 1200), ("a", "y", 5), ("a", "x", 1500), ("a", "ALL", 1505), ("b", "ALL", 1200)], "o string, i string, n int")
    assert [tuple(r) for r in two_way(df, "o", "i", "ALL", ["n"]).collect()] == [
        ("a", "ALL", "1,505"), ("a", "x", "1,500"), ("a", "y", "5"), ("b", "ALL", "1,200"), ("b", "x", "1,200")]


def test_every_selectable_industry_has_rules():
    from caseloom.rules.industries import detail_names, industry_names
    asked = ("Agriculture", "Mining", "Utilities", "Construction", "Manufacturing", "Trade", "Retail", "Gig", "Transportation", "Information", "Finance", "Real Estate",
             "Professional", "Management", "Janitorial", "Waste", "Administrative", "Educational", "Carehome", "Residential Carehome", "HealthCare", "Entertainment",
             "Fitness", "Accommodation", "Fast Food", "Restaurant", "Service", "Automotive", "Personal Care", "Religion", "Public Servant", "Other")
    assert all(labels_for(a)[0] in industry_names() + detail_names() for a in asked)
