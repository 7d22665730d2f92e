"""Repeat offenders: groups with totals and the attributes of their first row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from caseloom.functions.blanks import KEY_BLANKS, is_blank

MEASURES = ("bw_amt", "violtn_cnt", "ee_violtd_cnt", "ee_pmt_recv")


def named_keys(df: DataFrame, key: str) -> DataFrame:
    """Rows that have a key, in capitals. Runs before any shuffle: blanks are the largest group."""
    return df.where(~is_blank(key, KEY_BLANKS)).withColumn(key, F.upper(key))


def total(c: str | Column) -> Column:
    """Sum that is zero when there is nothing to add."""
    return F.coalesce(F.sum(c), F.lit(0))


def group_by_key(df: DataFrame, key: str, order: list[str], measures: tuple[str, ...] = MEASURES,
                 carry: list[str] | None = None) -> DataFrame:
    """One row per key: ``records``, summed measures, and ``carry`` from the first row.

    ``carry`` defaults to all other columns. Partial aggregation leaves at most one row per
    key and task, so a hot key costs no more to shuffle than a rare one.
    """
    measures = tuple(m for m in measures if m in df.columns)
    if carry is None:
        carry = [c for c in df.columns if c not in (key, "records", *measures)]
    aggs = [F.count(F.lit(1)).alias("records"), *[total(m).alias(m) for m in measures]]
    if carry:
        aggs.append(F.min_by(F.struct(*carry), F.struct(*order)).alias("_first"))
    return (named_keys(df, key).groupBy(key).agg(*aggs)
            .select(key, "records", *measures, *[F.col("_first")[c].alias(c) for c in carry]))


def repeat_groups(df: DataFrame, key: str, order: list[str],
                  measures: tuple[str, ...] = (*MEASURES, "backwage_owed"),
                  carry: list[str] | None = None) -> DataFrame:
    """Groups of more than one record; a measure the table lacks counts as zero."""
    df = df.withColumns({m: F.lit(0) for m in measures if m not in df.columns})
    return group_by_key(df, key, order, measures, carry).where("records > 1")


def repeat_tables(df: DataFrame, keys: list[str], order: list[str], n: int,
                  measures: tuple[str, ...] = (*MEASURES, "backwage_owed")) -> DataFrame:
    """The ``n`` groups with most records of ``repeat_groups`` for each of several keys, in two passes over the rows.

    The first counts: a row is dealt out once per key it has, as key and number, and with the counts goes the least of the
    first column of ``order``. That settles which groups win, of which there are ``n`` per key. The second reads the rows of
    these alone and sums them where they lie; a row is only kept whole if it may be the first of its group by ``order``, whose
    columns identify rows. Columns: ``kind`` (the key's name), ``value`` (in capitals), ``records``, the
    columns of the first row, summed measures in the place of its own. Of equally many records the lesser value wins.
    """
    df = df.withColumns({m: F.lit(0) for m in measures if m not in df.columns})
    sides = F.array(*[F.struct(F.lit(i).alias("no"), F.when(~is_blank(k, KEY_BLANKS), F.upper(k)).alias("value")) for i, k in enumerate(keys)])
    dealt = df.withColumn("_k", F.explode(F.filter(sides, lambda s: s["value"].isNotNull())))
    groups = dealt.select("_k.*", F.col(order[0]).alias("_lead")).groupBy("no", "value").agg(
        F.count(F.lit(1)).alias("records"), F.min("_lead").alias("_lead"), F.count("_lead").alias("_leads"))
    nth = F.row_number().over(Window.partitionBy("no").orderBy(F.desc("records"), "value"))
    won = groups.where("records > 1").withColumn("_nth", nth).where(F.col("_nth") <= n)
    # a missing value comes before all others; at most n rows per key
    won = won.select(F.col("no").alias("_no"), F.col("value").alias("_value"), F.when(F.col("_leads") == F.col("records"), F.col("_lead")).alias("_lead"))
    rows = dealt.join(F.broadcast(won), (F.col("_k.no") == F.col("_no")) & (F.col("_k.value") == F.col("_value")))
    may_lead = F.when(F.col(order[0]).eqNullSafe(F.col("_lead")), F.struct(*[df[f"`{c}`"] for c in df.columns]))
    parts = rows.select("_k.*", may_lead.alias("_row"), *measures).groupBy("no", "value", "_row").agg(
        F.count(F.lit(1)).alias("records"), *[total(m).alias(m) for m in measures])
    first = F.min_by("_row", F.struct(F.col("_row").isNull(), *[F.col("_row")[c] for c in order])).alias("_row")
    won = parts.groupBy("no", "value").agg(F.sum("records").alias("records"), *[
        F.sum(m).cast(parts.schema[m].dataType).alias(m) for m in measures], first)
    kept = [F.col(c) if c in measures else F.col("_row")[c].alias(c) for c in df.columns]
    return won.select(F.element_at(F.array(*[F.lit(k) for k in keys]), F.col("no") + 1).alias("kind"), "value", "records", *kept)


def repeats_of(tables: DataFrame, key: str) -> DataFrame:
    """The groups of one key, as ``repeat_groups`` has them."""
    return tables.where(F.col("kind") == key).withColumn(key, F.col("value")).drop("kind", "value")


def multi_agency(df: DataFrame, employer: str, agency: str, order: list[str],
                 measures: tuple[str, ...] = MEASURES, carry: list[str] | None = None,
                 within: list[str] | None = None) -> DataFrame:
    """Employers cited by several agencies, agencies listed by first appearance.

    Two levels: (employer, agency), then employer. ``within`` adds outer keys (a city, say).
    """
    within = within or []
    carry = carry or []
    pairs = named_keys(named_keys(df, employer), agency)
    first = F.min(F.struct(*order)).alias("_at")
    picked = [F.min_by(F.struct(*carry), F.struct(*order)).alias("_first")] if carry else []
    pairs = pairs.groupBy(*within, employer, agency).agg(
        F.count(F.lit(1)).alias("records"), *[total(m).alias(m) for m in measures], first, *picked)
    carried = [F.min_by("_first", "_at").alias("_first")] if carry else []
    grouped = pairs.groupBy(*within, employer).agg(
        F.count(F.lit(1)).alias("agencies"),
        F.sum("records").alias("records"),
        *[F.sum(m).alias(m) for m in measures],
        F.min_by(agency, "_at").alias(agency),
        F.expr(f"listagg(`{agency}`, ', ') WITHIN GROUP (ORDER BY _at)").alias("agency_names"),
        *carried)
    return (grouped.where("agencies > 1")
            .select(*within, employer, F.initcap(agency).alias(agency), "agencies", "agency_names",
                    "records", *measures, *[F.col("_first")[c].alias(c) for c in carry]))


def subtotals(df: DataFrame, outer: str, inner: str, measures: list[str], label: str) -> DataFrame:
    """Sums per (outer, inner) and a line per outer whose inner is ``label``.

    Rows are summed to the finer level first; only those sums are expanded for the subtotal,
    so the table itself is shuffled once and never doubled.
    """
    fine = (df.where(F.col(outer).isNotNull() & F.col(inner).isNotNull())
            .groupBy(outer, inner).agg(*[F.sum(m).alias(m) for m in measures]))
    return (fine.groupingSets([[F.col(outer), F.col(inner)], [F.col(outer)]], F.col(outer), F.col(inner))
            .agg(*[F.sum(m).alias(m) for m in measures], F.grouping(inner).alias("_sub"))
            .select(outer, F.when(F.col("_sub") == 1, label).otherwise(F.col(inner)).alias(inner), *measures))


def sums_by(df: DataFrame, keys: list[str], measures: list[str]) -> DataFrame:
    """Plain sums; rows with a missing key take no part."""
    present = df
    for key in keys:
        present = present.where(F.col(key).isNotNull())
    return present.groupBy(*keys).agg(*[F.sum(m).alias(m) for m in measures])
