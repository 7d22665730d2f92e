"""Files in, snapshots, exports."""

from __future__ import annotations

from datetime import date

import pytest

from caseloom.plans.refresh import refresh_snapshot
from caseloom.plans.report import ReportOptions, build_report, write_report
from caseloom.sources import snapshot as S
from caseloom.sources.export import BOM, write_csv
from caseloom.sources.harmonise import harmonise, parse_date, tagged
from caseloom.sources.readers import read_delimited, read_plain, with_row_number
from caseloom.sources.registry import build_registry, only, switched_off

FEDERAL = """case_id,trade_nm,legal_name,street_addr_1_txt,cty_nm,st_cd,zip_cd,naic_cd,naics_code_description,case_violtn_cnt,cmp_assd_cnt,ee_violtd_cnt,bw_atp_amt,dbra_cl_violtn_cnt,findings_start_date,findings_end_date
1001,Acme,"Acme Builders, Inc.","12 S. Main St., Ste. 4",San Jose,CA,95112-1234,2382,Roofing,3,$0,2,"$1,234.50",1,2021-03-04,2021-09-01
1002,Señor Café,Señor Café LLC,1ST AVE,Fresno,CA,0,722511,Restaurants,1,$50,1,(500),0,3/5/2022,
1003,too,many,fields,here,CA,1,1,x,1,1,1,1,0,2021-01-01,2021-01-01,extra
1004,Short line,Zed Co
"""
STATE = """Case Number,Employer,Account - DBA,Primary Address Street,Primary Address City,Primary Address State,NAICS Code,NAICS Code Title,Case Issue Type,EE(s) Amt Assessed,EE Payments Rec'd,Interest Balance Due,Interest Payments Rec'd,Date of Docket,Case Closed Date,Case Stage,Case Status,Closure Disposition,Closure Disposition - Other Reason,Reason For Closing,DIR Office,Note
1001,ACME BUILDERS,,5 E Oak Rd,San Jose,,238,Construction,,900,0,5,0,2021-03-04,,Judgment,,,,,San Jose,
05-7,"O'Brien & Sons LLC",,#7,,,238160,Roofing Contractors,Issue 1 Issue 2,"2,000",100,5,10,1/2/2020,,Open,,,,,Oakland,
05-7,"O'Brien & Sons LLC",,#7,,,238160,Roofing Contractors,Issue 1 Issue 2,"2,500",100,5,10,1/2/2020,,Open,,,,,Oakland,
05-8,nan,,,,,,,,0,0,,,no date,,,Closed,,,,,
"""


@pytest.fixture
def landed(tmp_path):
    (tmp_path / "fed.csv").write_bytes(FEDERAL.encode("ISO-8859-1"))
    (tmp_path / "state.csv").write_bytes(STATE.encode("ISO-8859-1"))
    return build_registry({"DOL_WHD": str(tmp_path / "fed.csv"), "DIR_DLSE": str(tmp_path / "state.csv")})


def test_registry_switches(landed):
    assert [s.tag for s in landed] == ["DOL_WHD", "DIR_DLSE"]
    assert switched_off(build_registry({"DOL_WHD": "a", "DIR_DLSE": "b", "DLSE_J-23": "c"}, state_cases=False)) == ["DIR_DLSE"]
    assert switched_off(build_registry({"DOL_WHD": "a", "TEST": "t"}, test=True)) == ["DOL_WHD"]
    assert switched_off(only(landed, "DOL_WHD")) == ["DIR_DLSE"]


def test_long_lines_go_and_short_lines_stay(spark, landed):
    df = read_delimited(spark, landed[0].path, encoding=landed[0].encoding)
    rows = {r["case_id"]: r for r in df.collect()}
    assert sorted(rows) == ["1001", "1002", "1004"]
    assert rows["1002"]["trade_nm"] == "Señor Café"
    assert rows["1004"]["naic_cd"] is None
    assert rows["1001"]["legal_name"] == "Acme Builders, Inc."
    assert read_plain(spark, landed[1].path, rows=2).count() == 2


def test_harmonised_columns(spark, landed):
    df = harmonise(tagged(with_row_number(read_delimited(spark, landed[1].path), 2), "DIR_DLSE")).orderBy("_row")
    first, second = df.collect()[:2]
    assert (first["st_cd"], first["Case Status"], first["source"]) == ("CA", "Judgment", "DIR_DLSE")
    assert (float(second["bw_amt"]), float(second["ee_pmt_recv"])) == (2000.0, 100.0)
    assert second["findings_start_date"] == date(2020, 1, 2)
    assert "Interest Balance Due" not in df.columns


def test_bad_dates_are_unknown(spark):
    df = spark.createDataFrame([("2021-03-04",), ("3/5/2022",), ("0816-99-12",), ("",), (None,)], "d string")
    assert [r[0] for r in df.select(parse_date("d")).collect()] == [date(2021, 3, 4), date(2022, 3, 5), None, None, None]


def test_refresh_and_report(spark, landed, tmp_path):
    root = str(tmp_path / "snap")
    day = date(2023, 1, 10)
    taken = refresh_snapshot(spark, root, landed, day)
    cases = S.read_cases(spark, root)
    by_id = {(r["case_id_1"], r["source"]): r for r in cases.collect()}
    assert set(by_id) == {("1001", "DOL_WHD"), ("1002", "DOL_WHD"), ("1004", "DOL_WHD"), ("1001", "DIR_DLSE"), ("05-7", "DIR_DLSE"), ("05-8", "DIR_DLSE")}
    acme = by_id[("1001", "DOL_WHD")]
    assert (acme["legal_nm"], acme["street_addr"], acme["zip_cd"]) == ("ACME BUILDERS", "12 SOUTH MAIN STREET SUITE 4", "95112")
    assert (acme["industry"], acme["Businesstype"], acme["Prevailing"], acme["shared"]) == ("Construction", "Corporation", 1, 1)
    assert float(by_id[("05-7", "DIR_DLSE")]["bw_amt"]) == 2500.0 and not by_id[("05-7", "DIR_DLSE")]["shared"]

    # fresh: nothing is rebuilt; stale or forced: it is
    assert refresh_snapshot(spark, root, landed, date(2023, 2, 1)) == taken
    assert refresh_snapshot(spark, root, landed, date(2023, 3, 1)).taken_on == date(2023, 3, 1)
    assert S.read_cases(spark, root, ["DIR_DLSE"]).where("source = 'DIR_DLSE'").count() == 0
    assert S.reduced(cases, day).count() == 3

    options = ReportOptions(target_industry="Construction", year_start=date(2019, 1, 1), year_end=day, include_tables=True,
                            include_summaries=True, include_top_tables=True, prevailing_wage_report=True, signatories_report=True)
    tables = build_report(cases, options, day)
    summary = tables["summary"].first()
    # 1001 is reported by two sources and counted once, with the larger amount
    assert (summary["cases"], summary["back_wages"]) == (2, 3734.5)
    assert tables["prevailing_headline"].first()["cases"] == 1
    assert list(tables)[:7] == ["overview", "coverage", "summary", "date_range", "totals", "status", "cases"]
    write_report({k: tables[k] for k in ("summary", "top_by_amount")}, str(tmp_path / "out"))
    assert spark.read.option("header", True).csv(str(tmp_path / "out" / "top_by_amount")).count() == 2


def test_reports_prune_the_snapshot(spark, landed, tmp_path):
    from caseloom.plans.report import Lookups, scoped_rows
    root, day = str(tmp_path / "snap"), date(2023, 1, 10)
    refresh_snapshot(spark, root, landed, day)
    cases = S.read_cases(spark, root)
    spark.conf.set("spark.sql.maxMetadataStringLength", 2000)
    for df in (S.reduced(cases, day), scoped_rows(cases, ReportOptions(target_industry="Construction").normalise(day), Lookups())):
        plan = df._jdf.queryExecution().executedPlan().toString()
        filters = plan[plan.index("PartitionFilters"):plan.index("PushedFilters")]
        assert "industry" in filters and "start_year" in filters and "st_cd" in filters
    spark.conf.unset("spark.sql.maxMetadataStringLength")
    # the unmarked rows come straight from their scan; only the marked ones are aggregated
    assert plan.count("Exchange hashpartitioning") == 1


def test_organisations_are_matched_before_masking(spark, landed, tmp_path):
    from caseloom.plans.report import Lookups
    from caseloom.rules.book import name_rule
    root, day = str(tmp_path / "snap"), date(2023, 1, 10)
    refresh_snapshot(spark, root, landed, day)
    tables = build_report(S.read_cases(spark, root), ReportOptions(target_organization="acme|nobody", year_start=date(2019, 1, 1)),
                          day, Lookups(signatories=[name_rule("Construction", ["Acme"])]))
    shown = tables["cases"].collect()
    assert [r["legal_nm"] for r in shown] == ["masked"] and not any("ACME" in str(v) for r in shown for v in r)


def test_missing_snapshot_is_an_error(spark, tmp_path):
    with pytest.raises(FileNotFoundError):
        S.read_cases(spark, str(tmp_path / "none"))
    assert S.is_stale(None, date(2023, 1, 1))


def test_export_carries_the_mark(spark, tmp_path):
    df = spark.createDataFrame([("a,\"b\"", 1), (None, 2)], "x string, y int").coalesce(1)
    write_csv(df, str(tmp_path / "o"))
    part = next((tmp_path / "o").glob("part-*"))
    assert part.read_bytes().decode("utf-8").splitlines() == [BOM + "x,y", '"a,""b""",1', ",2"]


def test_numbers_follow_the_files_however_they_are_split(spark, tmp_path):
    """Large file last by name, split into many parts and read as one: the same numbers."""
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "b.csv").write_text("id,note\n" + "".join(f"b{i},{'x' * 200}\n" for i in range(3000)))
    (tmp_path / "in" / "a.csv").write_text("id,note\na0,\n\"a1\",\"two\nlines\"\na3,y,z\n")
    seen = []
    for size, lines in (("128m", False), ("64k", False), ("16k", False), ("128m", True)):
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)
        df = with_row_number(read_delimited(spark, str(tmp_path / "in"), multi_line=lines), 1)
        seen.append([r["id"] for r in df.orderBy("_row").collect() if r["id"].startswith("b")])
        low = {r["id"]: r["_row"] - (1 << 58) for r in df.collect()}
        assert sorted(low.values()) == list(range(len(low)))
        if lines:
            assert {k: v for k, v in low.items() if k.startswith("a")} == {"a0": 0, "a1": 1}
            assert df.where("id = 'a1'").first()["note"] == "two\nlines"
    spark.conf.set("spark.sql.files.maxPartitionBytes", "128m")
    assert seen[0] == [f"b{i}" for i in range(3000)] and seen.count(seen[0]) == 4


def test_a_forced_refresh_leaves_nothing_of_the_day_before_it(spark, landed, tmp_path):
    from pathlib import Path
    root, day = str(tmp_path / "snap"), date(2023, 1, 10)
    first = refresh_snapshot(spark, root, landed, day)
    second = refresh_snapshot(spark, root, only(landed, "DOL_WHD"), day, force=True)
    assert S.latest(spark, root) == second != first
    assert {r["source"] for r in S.read_cases(spark, root).select("source").distinct().collect()} == {"DOL_WHD"}
    assert Path(first.cases).exists()  # readers under way keep what they began with
    third = refresh_snapshot(spark, root, landed, day, force=True)
    assert not Path(first.cases).exists() and not Path(first.raw).exists() and Path(second.cases).exists()
    assert S.latest(spark, root) == third and not any(p.name.startswith(day.isoformat()) for p in Path(root, "unique").iterdir())


def test_sources_decide_alone_whether_their_keys_count(spark, tmp_path):
    """The federal file has no violations, so its amounts tell cases apart, whatever other sources have."""
    (tmp_path / "fed.csv").write_text("case_id,legal_name,bw_atp_amt\n1,A,100\n1,A,200\n")
    (tmp_path / "state.csv").write_text("Case Number,Employer,Case Issue Type,EE(s) Amt Assessed\n5,B,Issue 1,10\n5,B,Issue 1,20\n")
    root = str(tmp_path / "snap")
    refresh_snapshot(spark, root, build_registry({"DOL_WHD": str(tmp_path / "fed.csv"), "DIR_DLSE": str(tmp_path / "state.csv")}), date(2023, 1, 10))
    got = sorted((r["source"], float(r["bw_amt"])) for r in S.read_cases(spark, root).collect())
    assert got == [("DIR_DLSE", 20.0), ("DOL_WHD", 100.0), ("DOL_WHD", 200.0)]


def test_flag_mode_keeps_all_rows(spark):
    from caseloom.plans.steps import clean_step
    columns = "case_id_1 string, source string, violation string, street_addr string, cty_nm string, zip_cd string, st_cd string, legal_nm string, " \
              "trade_nm string, bw_amt double, ee_pmt_recv double, interest_owed double, _row long"
    df = spark.createDataFrame([("1 ", "a", "v", "", "", "", "", "X", "", 5.0, 0.0, 0.0, 0), ("1", "a", "v", "", "", "", "", "X", "", 9.0, 0.0, 0.0, 1),
                                ("2", "a", "v", "", "", "", "", "X", "", 9.0, 0.0, 0.0, 2)], columns)
    rows = {r["_row"]: r for r in clean_step(df, flag_only=True).collect()}
    assert [rows[i]["_DELETED_DUP"] for i in range(3)] == [True, False, False]
    assert [rows[i]["_DUP_PMT_REC"] for i in range(3)] == [True, True, False] and not any(r["_DUP_BW"] for r in rows.values())


def _messy(rng, rows):
    """Quoted breaks, commas, doubled and stray quotes, empty lines, fields too many and too few."""
    fields = ["", "plain", '"a, b"', '"two\nlines"', '"say ""hi"" now"', 'in"ch 5"', '"x\n\n, ""y"",\nz"', '""', '"odd"tail', '"""start"', '"end"""']
    out = ["id,note,more"]
    for i in range(rows):
        out += [f"{i},{rng.choice(fields)},{rng.choice(fields)}" + rng.choice(["", "", "", ",", ",extra", ",x,y"]), *[""] * (rng.random() < 0.1)]
        out += [f"{i}s"] * (rng.random() < 0.1)
    return out


@pytest.mark.parametrize("newline", ["\n", "\r\n"])
def test_quoted_breaks_are_read_alike_wherever_a_file_is_cut(spark, tmp_path, newline):
    import random

    from pyspark.sql import types as T

    from caseloom.sources.quoted import read_records
    from caseloom.sources.readers import number_placed
    rng = random.Random(11)
    for name, rows in (("a", 40), ("b", 0), ("c", 25)):
        (tmp_path / f"{name}.csv").write_bytes("\n".join(_messy(rng, rows)).replace("\n", newline).encode() + newline.encode() * (name != "c"))
    schema = T.StructType([T.StructField(n, T.StringType()) for n in ("id", "note", "more")])
    want = [tuple(r) for r in with_row_number(read_delimited(spark, str(tmp_path), schema, multi_line=True), 3).orderBy("_row").collect()]
    assert len(want) > 50 and [r[3] - 3 * (1 << 58) for r in want] == list(range(len(want)))
    spark.conf.set("spark.sql.files.openCostInBytes", "0")
    try:
        for size in ("128m", 41, 60, 97, 150):
            spark.conf.set("spark.sql.files.maxPartitionBytes", size)
            df = read_records(spark, str(tmp_path), schema)
            assert [tuple(r) for r in number_placed(df, 3).orderBy("_row").collect()] == want, size
            if size == 41:
                assert df.select("_path", "_block").distinct().count() > 10  # one file, many parts
    finally:
        spark.conf.unset("spark.sql.files.openCostInBytes")
        spark.conf.set("spark.sql.files.maxPartitionBytes", "128m")


def test_quoted_reading_of_other_encodings_and_open_quotes(spark, tmp_path):
    from pyspark.sql import types as T

    from caseloom.sources.quoted import read_records
    from caseloom.sources.readers import read_placed
    (tmp_path / "l.csv").write_bytes('id,näme\n1,"Señor\nCafé"\n2,"open\n3,x\n'.encode("ISO-8859-1"))
    rows = read_placed(spark, str(tmp_path / "l.csv"), "ISO-8859-1", multi_line=True).orderBy("_at").collect()
    assert [(r["id"], r["näme"]) for r in rows] == [("1", "Señor\nCafé"), ("2", "open\n3,x")]
    schema = T.StructType([T.StructField("id", T.StringType())])
    with pytest.raises(ValueError, match="UTF-16"):
        read_records(spark, str(tmp_path), schema, "UTF-16")
    (tmp_path / "u.csv").write_bytes('id,n\n1,"a\nb"\n'.encode("UTF-16"))
    assert read_placed(spark, str(tmp_path / "u.csv"), "UTF-16", multi_line=True).first()["n"] == "a\nb"


def test_one_changed_source_renews_its_own_rows_and_the_marks(spark, landed, tmp_path):
    import os
    from pathlib import Path
    root, day = str(tmp_path / "snap"), date(2023, 1, 10)
    first = refresh_snapshot(spark, root, landed, day)
    was = {s.tag: s for s in first.sources}

    def touched(spec, text):
        Path(spec.path).write_bytes(text.encode("ISO-8859-1"))
        os.utime(spec.path, (2_000_000_000 + len(text), 2_000_000_000 + len(text)))

    # a row that no other source has: the other source's files are carried over as they lie
    touched(landed[1], STATE + "05-9,New Co,,#8,,,238160,Roofing Contractors,Issue 3,300,0,5,10,1/2/2021,,Open,,,,,Oakland,\n")
    second = refresh_snapshot(spark, root, landed, day)
    now = {s.tag: s for s in second.sources}
    assert now["DOL_WHD"] == was["DOL_WHD"] and now["DIR_DLSE"].cases != was["DIR_DLSE"].cases
    cases = {(r["case_id_1"], r["source"]): r for r in S.read_cases(spark, root).collect()}
    assert len(cases) == 7 and cases["1001", "DOL_WHD"]["shared"] == 1 and cases["05-9", "DIR_DLSE"]["shared"] == 0
    assert refresh_snapshot(spark, root, landed, day) == second

    # the shared case goes: the other source is marked anew, not landed or cleaned again
    touched(landed[1], STATE.replace("1001,ACME", "1099,ACME"))
    third = refresh_snapshot(spark, root, landed, day)
    marked = {s.tag: s for s in third.sources}["DOL_WHD"]
    assert marked.cases != was["DOL_WHD"].cases and marked.raw == was["DOL_WHD"].raw and marked.taken_on == day
    cases = {(r["case_id_1"], r["source"]): r for r in S.read_cases(spark, root).collect()}
    assert cases["1001", "DOL_WHD"]["shared"] == 0 and len(cases) == 6
    assert Path(marked.raw).exists() and Path(was["DOL_WHD"].cases).exists()  # the snapshot before still reads it
    assert not Path(was["DIR_DLSE"].cases).exists()

    # ages are those of the sources; switching one off leaves the other as it is
    later = refresh_snapshot(spark, root, only(landed, "DOL_WHD"), date(2023, 1, 20))
    assert later.sources == (marked,) and later.taken_on == date(2023, 1, 20)
    assert refresh_snapshot(spark, root, only(landed, "DOL_WHD"), date(2023, 2, 11)).sources[0].taken_on == date(2023, 2, 11)
    with pytest.raises(ValueError, match="switched on"):
        refresh_snapshot(spark, root, only(landed, "nobody"), day)


def test_refresh_can_flag_instead_of_delete(spark, landed, tmp_path):
    root, day = str(tmp_path / "snap"), date(2023, 1, 10)
    dropped = refresh_snapshot(spark, root, landed, day)
    assert S.read_cases(spark, root).count() == 6
    assert refresh_snapshot(spark, root, landed, day, flag_only=True) != dropped
    rows = S.read_cases(spark, root).where("source = 'DIR_DLSE'").orderBy("_row").collect()
    assert [(r["case_id_1"], r["_DELETED_DUP"], r["_Case_X"], r["_DUP_PMT_REC"]) for r in rows] == [
        ("1001", False, False, False), ("05-7", True, False, True), ("05-7", False, False, True), ("05-8", False, False, False)]
    tables = build_report(S.read_cases(spark, root), ReportOptions(target_industry="Construction", year_start=date(2019, 1, 1), year_end=day, include_summaries=True), day)
    assert tables["summary"].first()["cases"] == 2


def test_overviews_read_roll_ups(spark, landed, tmp_path):
    """The figures of the full pass, from rolled-up cases and those that two sources report."""
    root, day = str(tmp_path / "snap"), date(2023, 1, 10)
    refresh_snapshot(spark, root, landed, day)
    options = ReportOptions(target_industry="Construction", year_start=date(2019, 1, 1), year_end=day)
    for off in (None, ["DIR_DLSE"]):
        cases, rolled = S.read_cases(spark, root, off), S.read_rollup(spark, root, off)
        whole = build_report(cases, options, day, only={"overview", "coverage"})
        quick = build_report(cases, options, day, only={"overview", "coverage"}, rolled=rolled)
        for name in ("overview", "coverage"):
            assert quick[name].collect() == whole[name].collect(), name
    assert whole["overview"].first()["cases"] == 3
    # amounts are read of the cases that several sources report alone
    from caseloom.plans.steps import across_sources
    spark.conf.set("spark.sql.maxMetadataStringLength", 2000)
    plan = across_sources(S.read_cases(spark, root)).where("shared = 1")._jdf.queryExecution().executedPlan().toString()
    spark.conf.unset("spark.sql.maxMetadataStringLength")
    scans = [line for line in plan.splitlines() if "FileScan" in line and "bw_amt" in line]
    assert scans and all("shared" in line[line.index("PartitionFilters"):line.index("PushedFilters")] for line in scans)
