"""Duplicates against a plain Python reading of the rules, with hot keys."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from caseloom.operators import dedup as D
from caseloom.operators.spread import attach_by_key, group_totals, row_total, split_listed, split_repeated

SCHEMA = "case_id_1 string, violation string, bw_amt double, interest_owed double, Businesstype string, source string, _row long"
DEDUP = ("case_id_1", "violation", ["bw_amt", "interest_owed"], "Businesstype", ["_row"])


def rows(n=600, seed=3, blank_violation=False):
    """A third of all rows share one key."""
    rng = random.Random(seed)
    out = []
    for i in range(n):
        hot = i % 3 == 0
        out.append(("hot" if hot else f" {rng.randrange(60)} ", "" if blank_violation else ("v" if hot else rng.choice("vw")),
                    rng.choice([None, 1.0, 2.5, 9.0]), rng.choice([0.0, 1.0, None]), rng.choice(["", "Corporation", None]),
                    rng.choice("abc"), i))
    return out


def best_of(data, within=False):
    """Sort by amount, form and row, then keep the first per key."""
    def amount(r):
        return None if r[2] is None or r[3] is None else r[2] + r[3]

    seen, kept = set(), []
    ranked = sorted(data, key=lambda r: r[6])
    ranked = sorted(ranked, key=lambda r: (r[4] is not None, r[4] or ""), reverse=True)
    ranked = sorted(ranked, key=lambda r: (amount(r) is not None, amount(r) or 0), reverse=True)
    for r in ranked:
        key = (r[0].strip(), r[1], r[5] if within else None)
        if key not in seen:
            seen.add(key)
            kept.append(r[6])
    return sorted(kept)


def ids(df):
    return sorted(r["_row"] for r in df.select("_row").collect())


@pytest.mark.parametrize("within", [False, True])
def test_best_row_per_key(spark, within):
    data = rows()
    df = spark.createDataFrame(data, SCHEMA)
    kept = D.drop_duplicates(df, *DEDUP, within=["source"] if within else None)
    assert ids(kept) == best_of(data, within)
    assert ids(D.drop_duplicates(kept, *DEDUP, within=["source"] if within else None)) == ids(kept)


def test_blank_keys_fall_back_to_the_amount(spark):
    data = rows(blank_violation=True)
    seen, expected = set(), []
    for r in data:
        key = (r[0].strip(), r[1], r[2])
        if key not in seen:
            seen.add(key)
            expected.append(r[6])
    assert ids(D.drop_duplicates(spark.createDataFrame(data, SCHEMA), *DEDUP)) == sorted(expected)


def test_marked_tables_lose_the_same_rows(spark):
    """Per-source duplicates first, then across sources: with and without the mark."""
    df = D.drop_duplicates(spark.createDataFrame(rows(seed=5), SCHEMA), *DEDUP, within=["source"])
    marked = D.mark_shared(df, ["case_id_1", "violation"], ["_row"])
    assert ids(D.drop_shared_duplicates(marked, "shared", *DEDUP)) == ids(D.drop_duplicates(df, *DEDUP))
    some = marked.where("source <> 'a'")
    assert ids(D.drop_shared_duplicates(some, "shared", *DEDUP)) == ids(D.drop_duplicates(df.where("source <> 'a'"), *DEDUP))


@pytest.mark.parametrize("blank", [False, True])
def test_rows_that_are_not_wanted_still_displace_others(spark, blank):
    """As a filter after the duplicates are settled; what is not wanted is shuffled without its columns."""
    data = rows(600, seed=9, blank_violation=blank)
    df = spark.createDataFrame(data, SCHEMA).withColumn("note", F.concat(F.lit("n"), "_row"))
    wanted = (F.col("source") == "a") & (F.col("bw_amt") > 1)
    after = D.drop_duplicates(df, *DEDUP).where(wanted)
    for split in (False, True):
        within = D.drop_duplicates(df, *DEDUP, split=split, wanted=wanted)
        assert within.columns == after.columns and after.count()
        assert sorted(map(tuple, within.collect()), key=repr) == sorted(map(tuple, after.collect()), key=repr)
    marked = D.mark_shared(df, ["case_id_1", "violation"], ["_row"])
    some = D.drop_shared_duplicates(marked, "shared", *DEDUP, wanted=wanted)
    assert ids(some) == ids(D.drop_shared_duplicates(marked, "shared", *DEDUP).where(wanted))


def test_whether_keys_hold_values_is_one_pass(spark):
    df = spark.createDataFrame([("a", ""), (None, None), ("", "")], "x string, y string")
    assert [df.select(D.keys_usable(df, k).alias("u")).first()["u"] for k in (["x"], ["y"], ["x", "y"])] == [True, False, False]
    assert spark.range(1).select(D.keys_usable(df.limit(0), ["x", "y"]).alias("u")).first()["u"] is False
    plan = df.select(D.keys_usable(df, ["x", "y"]))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("scalar-subquery") == 1


def test_flags(spark):
    data = rows()
    counts = {}
    for r in data:
        counts[r[0]] = counts.get(r[0], 0) + 1
    df = D.flag_repeats(spark.createDataFrame(data, SCHEMA), {"rep": ["case_id_1"], "rep2": ["source", "bw_amt"]}, ["_row"])
    assert all(r["rep"] == (counts[r["case_id_1"]] > 1) and r["rep2"] for r in df.collect())
    assert df.count() == len(data)


def test_deleted_flag_spares_one_row_per_key(spark):
    df = D.flag_deleted(spark.createDataFrame(rows(), SCHEMA).withColumn("case_id_1", F.trim("case_id_1")),
                        ["case_id_1", "violation"], ["bw_amt", "interest_owed"], "Businesstype", ["_row"])
    kept = df.where("not _DELETED_DUP")
    assert kept.count() == df.select("case_id_1", "violation").distinct().count()


def test_first_by_each_skips_settled_keys(spark):
    df = spark.createDataFrame(rows(), SCHEMA)
    once = D.keep_first_by_each(df, [["case_id_1"], ["case_id_1", "violation"]], ["_row"])
    assert once._jdf.queryExecution().optimizedPlan().toString().count("Aggregate") == 1
    assert ids(once) == ids(D.keep_by_key(df, ["case_id_1"], ["_row"]))


def test_hot_keys_are_salted_not_gathered(spark):
    """The salt has to be part of the shuffle key, and the broadcast side stays small."""
    df = spark.createDataFrame(rows(3000), SCHEMA)
    per_key = df.groupBy("case_id_1").agg(F.count(F.lit(1)).alias("n"), F.sum("bw_amt").alias("s"))
    joined = attach_by_key(df, per_key, ["case_id_1"], "n", ["_row"], row_total(df), hot_share=0.1)
    plan = joined._jdf.queryExecution().optimizedPlan().toString()
    assert "(_salt" in plan and "_cold_salt" in plan
    expected = {r["case_id_1"]: r["s"] for r in per_key.collect()}
    assert all(r["s"] == expected[r["case_id_1"]] for r in joined.collect())
    assert joined.count() == 3000


def test_group_totals_treat_null_as_a_key(spark):
    df = spark.createDataFrame([(None, 1), (None, 2), ("a", 3)], "k string, _row long")
    got = group_totals(df, ["k"], {"n": F.count(F.lit(1))}, ["_row"]).orderBy("_row").collect()
    assert [r["n"] for r in got] == [2, 2, 1]


def shuffled(df):
    """What the plan shuffles at full width: lines of exchanges that no broadcast stands above."""
    lines, hidden, out = df._jdf.queryExecution().executedPlan().toString().splitlines(), None, []
    for line in lines:
        depth = len(line) - len(line.lstrip(" :+-"))
        if hidden is not None and depth <= hidden:
            hidden = None
        if hidden is None and "BroadcastExchange" in line:
            hidden = depth
        if hidden is None and "Exchange hashpartitioning" in line:
            out.append(line)
    return out


@pytest.mark.parametrize("bits", [26, 6])
def test_rows_alone_under_their_key_are_not_shuffled(spark, bits):
    """With a map of 64 bits nearly all keys look repeated; then all are ranked, and the rows are the same."""
    data = [(f"u{i}" if i % 5 else "hot", "v" if i % 7 else None, float(i % 3), 0.0, "", "a", i) for i in range(1500)]
    df = spark.createDataFrame(data, SCHEMA)
    alone, rivals = split_repeated(df, ["case_id_1", "violation"], bits)
    counts = {}
    for r in data:
        counts[r[:2]] = counts.get(r[:2], 0) + 1
    repeated = {r[6] for r in data if counts[r[:2]] > 1}
    assert set(ids(rivals)) >= repeated and sorted(ids(alone) + ids(rivals)) == list(range(1500))
    if bits == 26:
        assert set(ids(rivals)) == repeated
    assert not shuffled(alone) and alone.columns == df.columns


@pytest.mark.parametrize("bits", [26, 6])
def test_rows_that_are_not_listed_are_not_shuffled(spark, bits):
    df = spark.createDataFrame([(i if i % 50 else None, f"x{i}") for i in range(2000)], "k int, v string")
    listed = spark.createDataFrame([(3 * i,) for i in range(100)] + [(3,)], "k int")
    out, maybe = split_listed(df, ["k"], listed, bits)
    assert not shuffled(out) and out.columns == df.columns
    out, maybe = ({r.v for r in part.collect()} for part in (out, maybe))
    assert maybe >= {f"x{3 * i}" for i in range(100) if 3 * i % 50} and len(out) + len(maybe) == 2000 and not out & maybe
    assert bits < 26 or len(maybe) < 110


@pytest.mark.parametrize("within", [False, True])
@pytest.mark.parametrize("blank", [False, True])
def test_split_keeps_the_same_rows(spark, within, blank):
    """A third of the rows share a key; unique keys, null ids and blank violations beside it."""
    data = [*rows(blank_violation=blank), *[(f"once{i}", "" if blank else "v", 1.0, 0.0, "", "a", 1000 + i) for i in range(300)],
            *[(None, "" if blank else "v", 1.0, 0.0, "", "a", 2000 + i) for i in range(3)]]
    df = spark.createDataFrame(data, SCHEMA)
    by = ["source"] if within else None
    whole, split = D.drop_duplicates(df, *DEDUP, within=by), D.drop_duplicates(df, *DEDUP, within=by, split=True)
    assert ids(split) == ids(whole)
    # one exchange of rivals; what decides whether keys count at all is a scalar or broadcast
    assert len([x for x in shuffled(split) if "case_id_1" in x]) == 1
    sets = [["case_id_1", "violation"], ["source", "bw_amt"]]
    assert ids(D.keep_first_by_each(df, sets, ["_row"], split=True)) == ids(D.keep_first_by_each(df, sets, ["_row"]))


def test_flags_in_one_go_equal_flags_one_by_one(spark):
    data = [*rows(900, seed=8), *[(None, "v", 1.0, 0.0, "", "a", 5000), ("", "v", 1.0, 0.0, "", "a", 5001), (None, "v", 1.0, 0.0, "", "a", 5002)]]
    df = spark.createDataFrame(data, SCHEMA)
    flags = {"rep": ["case_id_1"], "odd name": ["source", "bw_amt", "case_id_1"], "rep3": ["violation", "Businesstype", "interest_owed", "_row"]}
    keys, amounts = ["source", "case_id_1", "violation"], ["bw_amt", "interest_owed"]
    once = D.flag_groups(df, flags, "_row", "_DELETED_DUP", keys, amounts, "Businesstype", ["_row"])
    each = D.flag_repeats(D.flag_deleted(df, keys, amounts, "Businesstype", ["_row"]), flags, ["_row"])
    assert once.columns == each.columns
    assert sorted(map(tuple, once.collect()), key=lambda r: r[6]) == sorted(map(tuple, each.collect()), key=lambda r: r[6])
    assert len(shuffled(once.select("*"))) == 3
    assert once.where("false").count() == 0 and D.flag_groups(df.limit(0), flags, "_row", "d", keys, amounts, "Businesstype", ["_row"]).count() == 0


def test_rows_are_shuffled_once_for_all_flags(spark):
    """Also where ``order`` does not tell rows apart: 0 and 1 share a number, and 2 is there twice."""
    data = [*rows(900, seed=9), *[(c, "v", a, 0.0, "", "a", n) for c, a, n in
                                  ((None, 1.0, 7000), ("", 1.0, 7000), ("x2", 7.5, 7001), ("x2", 7.5, 7001), ("x3", None, 7002), (" x3", 8.5, 7003))]]
    df = spark.createDataFrame(data, SCHEMA)
    flags = {"rep": ["case_id_1"], "rep2": ["source", "bw_amt", "case_id_1"], "rep 3": ["violation", "bw_amt"]}
    got = D.flag_repeats(df, flags, ["_row"])
    assert got.columns == [*df.columns, *flags] and len(shuffled(got)) == 3
    found = [r.asDict() for r in got.collect()]
    seen = {f: {} for f in flags}
    for f, keys in flags.items():
        for r in found:
            key = tuple(r[k] for k in keys)
            seen[f][key] = seen[f].get(key, 0) + 1
    assert len(found) == len(data)
    assert all(r[f] == (seen[f][tuple(r[k] for k in keys)] > 1) for f, keys in flags.items() for r in found)


def test_best_rows_apart_leave_nothing_to_sort_in_the_counts(spark):
    data = [*rows(900, seed=10), (None, "v", 1.0, 0.0, "", "a", 5000), ("", "v", 1.0, 0.0, None, "a", 5001), (None, "v", None, 0.0, "", "a", 5002)]
    df = spark.createDataFrame(data, SCHEMA)
    flags = {"rep": ["case_id_1"], "odd name": ["source", "bw_amt", "case_id_1"], "rep3": ["violation", "Businesstype", "interest_owed", "_row"]}
    rest = (flags, "_row", "_DELETED_DUP", ["source", "case_id_1", "violation"], ["bw_amt", "interest_owed"], "Businesstype", ["_row"])
    apart, together = D.flag_groups(df, *rest, apart=True), D.flag_groups(df, *rest)
    assert sorted(map(tuple, apart.collect()), key=lambda r: r[6]) == sorted(map(tuple, together.collect()), key=lambda r: r[6])
    sorting = [line for line in apart._jdf.queryExecution().executedPlan().toString().splitlines() if "SortAggregate" in line]
    assert sorting and all("count(" not in line and "min(_rank" in line for line in sorting)


@pytest.mark.parametrize("name", ["dedup_flags", "dedup_six_flags"])
def test_case_table_is_joined_once_for_all_flags(spark, name):
    from checks.catalogue import QUERIES
    plan = QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    # every reading of the rows is one of the table kept on disk
    assert "lineitem" not in "".join(line for line in plan.splitlines() if line.strip(" :+-").startswith("Relation")) and plan.count("InMemoryRelation") >= 2
