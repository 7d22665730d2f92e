"""Every registered query against its SQL, and what its plan must not contain."""

from __future__ import annotations

import pytest

from __spark_entry__ import entry, oracle_sql, queries
from checks import catalogue
from checks.verify import compare

SMALL = "/root/testdata/sf0.001"
# all pairs, row-at-a-time Python, and whole groups gathered by a window have no place in a plan
UNWANTED = ("CartesianProduct", "BroadcastNestedLoopJoin", "ArrowEvalPython", "BatchEvalPython", "MapInPandas",
            "FlatMapGroupsInPandas")
RANKED = {"largest_per_city", "top_repeat_tables"}  # a top-k window, limited per task before it shuffles

QUERIES = catalogue.QUERIES


def plan_of(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_each_query_has_its_sql():
    assert set(QUERIES) == set(catalogue.ORACLES)
    assert set(QUERIES) <= set(queries()) and set(oracle_sql()) <= set(queries())


def test_entry(spark):
    assert entry(spark).count() == 6


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, name):
    plan = plan_of(QUERIES[name](spark, SMALL))
    assert not [u for u in UNWANTED if u in plan]
    assert "Window [" not in plan or name in RANKED and plan.count("WindowGroupLimit") >= 2
    good, note = compare(spark, SMALL, name, QUERIES[name], oracle_sql()[name])
    assert good, note


def test_top_k_window_is_limited_before_the_shuffle(spark):
    plan = plan_of(QUERIES["largest_per_city"](spark, SMALL))
    assert plan.count("WindowGroupLimit") == 2


def test_filters_and_columns_reach_the_scan(spark):
    from checks.cases import table
    plan = plan_of(table(spark, SMALL, "lineitem").where("l_quantity > 10").select("l_orderkey"))
    assert "GreaterThan(l_quantity,10.0)" in plan and "l_extendedprice" not in plan
    home = plan_of(QUERIES["filter_home_state"](spark, SMALL))
    assert "l_shipdate" not in home and "p_name" not in home
