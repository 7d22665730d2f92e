"""Scalar rules on hand-built cells."""

from __future__ import annotations

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from caseloom.functions import text as T
from caseloom.functions.address import clean_address
from caseloom.functions.blanks import first_filled, first_nonzero, is_blank, largest, none_of
from caseloom.functions.business import clean_names
from caseloom.functions.money import wages_owed
from caseloom.functions.numbers import clean_number, thousands
from caseloom.operators.places import generic_zip
from caseloom.plans.steps import typed


def column(spark, values, expression, kind="string"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")
    return [r[0] for r in df.orderBy("i").select(expression).collect()]


def test_amounts(spark):
    cells = ["$1,234.50", "(500)", "−20", "", "abc", "0", None, "12d", "NaN", "-(5)", " 7 ", "1e2", "1 234"]
    assert column(spark, cells, clean_number("v")) == [1234.5, 500, 20, 0, 0, 0, 0, 0, 0, 0, 7, 100, 0]


def test_blanks(spark):
    assert column(spark, ["", "nan", "NAN", None, "0", "x"], is_blank("v")) == [True, True, True, True, False, False]
    assert column(spark, ["a", None, "b"], none_of("v", ("a",))) == [False, True, True]


def test_alternatives(spark):
    row = spark.sql("select '' a, 'x' b, cast(null as string) c, 0 z, 5 p, 9 q").select(
        first_filled("a", "c", "b"), first_nonzero("z", "p"), largest("p", "q", "z")).first()
    assert tuple(row) == ("x", 5, 9)


@pytest.mark.parametrize("raw, clean", [
    ("12 S. Main St., Ste. 4", "12 South Main Street Suite 4"), ("1ST AVE", "First Avenue"), ("5 EAST DR", "5 EAST Drive"),
    ("Unit 7", "Suite 7"), ("9 PROSPECT CT.", "9 PROSPECT Court"), ("4 N Oak Boulevard", "4 North Oak Blvd"),
    ("#12 W 5th st", "Suite 12 West Fifth st"), (None, None)])
def test_addresses(spark, raw, clean):
    df = spark.createDataFrame([(raw,)], "v string")
    assert clean_address(df, "v").first()[0] == clean


def test_loose_addresses_expand_inside_words(spark):
    df = spark.createDataFrame([("9 PROSPECT AVE",)], "v string")
    assert clean_address(df, "v", whole_words=False).first()[0] == "9 PROSPECourt Avenue"


def names(spark, value, loose=False):
    df = spark.createDataFrame([(value, "")], "legal_nm string, trade_nm string")
    r = clean_names(df, ["legal_nm", "trade_nm"], loose=loose).first()
    return r["legal_nm"].strip(), r["Businesstype"], r["Liabilitytype"]


@pytest.mark.parametrize("raw, clean", [
    ("Acme Builders, Inc.", ("Acme Builders", "Corporation", "")), ("O'Brien & Sons LLC", ("OBrien and Sons", "Company", "")),
    ("FRANCISCO RAMON", ("FRANCISCO RAMON", "", "")), ("LINCOLN PLUMBING", ("LINCOLN PLUMBING", "", "")),
    ("Ann Lee, an individual", ("Ann Lee", "Individual", "")), ("X, a Nevada company", ("X", "Company", "Nevada")),
    ("A and B individually and as partners", ("A and B", "Partnership", ""))])
def test_names(spark, raw, clean):
    assert names(spark, raw) == clean


def test_loose_names_match_inside_words(spark):
    assert names(spark, "LINCOLN CONSTRUCTION", loose=True)[1] == "Company"
    assert names(spark, "FRANCISCO RAMON", loose=True)[0] == "FRANCISRAMON"


def test_city(spark):
    assert column(spark, ["San Jose.", " St. & Co-op;", "O'Neals (CA)"], T.city_punctuation("v")) == ["San Jose", "St Co-op", "ONeals CA"]


def test_zip_and_types(spark):
    df = spark.createDataFrame([("95112-1234", "a", "1,500.5"), ("nan", "b", "n/a"), (None, "c", None)], "zip_cd string, n string, x string")
    got = typed(df, ["n"], numbers={"x": "double"}).orderBy("n").collect()
    assert [tuple(r) for r in got] == [("95112", "A", 1500.5), ("0", "B", None), ("0", "C", None)]


def test_generic_zip(spark):
    assert column(spark, ["95112"], generic_zip("v")) == ["9511X"]
    assert column(spark, ["95112"], generic_zip("v", 2)) == ["951XX"]


def test_thousands_round_half_to_even(spark):
    assert column(spark, [1234.5, 1235.5, 0.4], thousands("v"), "double") == ["1,234", "1,236", "0"]


def test_wages_keep_unknown(spark):
    df = spark.createDataFrame([(100.0, 30.0), (10.0, 30.0), (None, 1.0)], "bw_amt double, ee_pmt_recv double")
    assert [None if r[0] is None else float(r[0]) for r in df.select(wages_owed()).collect()] == [70.0, 0.0, None]


@settings(max_examples=15, deadline=None)
@given(st.lists(st.text(alphabet="aB ;,.-'()&/*|", max_size=18), min_size=20, max_size=40))
def test_name_punctuation_settles(spark, values):
    once = column(spark, values, T.name_punctuation("v"))
    assert all(not set(x) & set(";,.-'()|/*&") for x in once)
    # removing marks can bring blanks together; once those are gone nothing changes any more
    settled = once
    for _ in range(5):
        settled = column(spark, settled, T.name_punctuation("v"))
    assert column(spark, settled, T.name_punctuation("v")) == settled


def test_one_line(spark):
    assert column(spark, ["a\nb\tc"], T.one_line("v")) == ["a b c"]


def test_closed_values_are_disjoint_from_open(spark):
    from caseloom.operators.filters import open_cases
    df = spark.createDataFrame(
        [("", "Open", 100.0, 10.0), ("Vacated", "Open", 100.0, 0.0), (None, None, 100.0, 0.0), ("", "Closed", 100.0, 0.0),
         ("", "Open", 100.0, 99.0), ("", "Open", None, None), ("", "Open", 105.0, 100.0)],
        "Note string, `Case Status` string, bw_amt double, ee_pmt_recv double")
    assert sorted(str(r["bw_amt"]) for r in open_cases(df).collect()) == ["100.0", "100.0", "105.0", "None"]


def test_masks_leak_no_name(spark):
    from caseloom.operators.filters import masked
    df = spark.createDataFrame([("A", 1), ("B", 0)], "legal_nm string, Signatory int")
    assert {r["legal_nm"] for r in masked(df, "Signatory", ["legal_nm", "absent"]).collect()} == {"masked", "B"}
    assert F is not None


def test_searches_for_forms_leave_out_what_others_find():
    """A shorter list of patterns finds just the texts the whole list finds, and the literals stand in all of them."""
    import re

    from caseloom.functions import business as B
    from caseloom.rules.names import FORMS, HOMES
    for rule in (*FORMS, *HOMES):
        for loose in (False, True):
            listed = tuple(dict.fromkeys((*rule.marks, *((loose and rule.loose_removed) or rule.removed))))
            whole = "(?:" + "|".join(listed) + ")" if loose else B.whole_words(listed)
            fewer = B._search(listed, loose)
            assert len(B._needed(listed, loose)) <= len(listed)
            cores = [core for core in (B._core(p, loose) for p in B._needed(listed, loose))]
            for phrase in ("", "Lincoln", "San Francisco", "Co", "x co ", "l-l-c- y", "ALLCO", *(f(p.replace("\\b", "").replace("\\", "").replace("$", ""))
                           for p in (*listed, *FORMS[0].marks, *FORMS[2].marks) for f in (str.upper, str.lower, "a {} b".format, "x{}y".format))):
                found = re.search(whole, phrase, re.I | re.A)
                assert bool(found) == bool(re.search(fewer, phrase, re.I | re.A)), (phrase, fewer)
                assert not found or any(core in phrase.lower() for core in cores)


def test_address_rules_are_tried_where_their_literals_stand():
    import re

    from caseloom.rules import address as R
    for whole in (False, True):
        assert len(R.street_rules(whole)) == len(R.street_parts())
        for (find, _), parts in zip(R.street_rules(whole), R.street_parts()):
            for text in ("12 MAIN ST., STE 4", "1 Oak Ave, Apt. 2", "9 PLZ Dr Unit 7", "EAST Ct CTR Wy. RD LN ", "PROSPECT RDS"):
                assert not re.search(find, text) or any(p in text for p in parts)
