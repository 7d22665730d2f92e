"""Duplicates. Winners are picked by aggregation, so copies collapse before the shuffle."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from caseloom.functions.blanks import all_of, is_blank
from caseloom.functions.numbers import money
from caseloom.operators.spread import attach_by_key, row_total, split_repeated


def distinct_rows(df: DataFrame, ignoring: list[str] | None = None, order: list[str] | None = None,
                  keep: str = "first") -> DataFrame:
    """Full-row distinct. Row-identity columns are ignored; the first or last copy gives them."""
    ignoring = ignoring or []
    if not ignoring:
        return df.distinct()
    return keep_by_key(df, [c for c in df.columns if c not in ignoring], order or ignoring, keep)


def keep_by_key(df: DataFrame, keys: list[str], order: list[str], keep: str = "first", split: bool = False) -> DataFrame:
    """One row per key (null equals null): the first or the last in ``order``; ``split`` as in ``keep_best``."""
    return _pick(df, keys, F.struct(*order), keep, split)


def _pick(df: DataFrame, keys: list[str], rank: Column, keep: str = "first", split: bool = False,
          wanted: Column | None = None) -> DataFrame:
    """With ``split`` only rows whose key occurs again go through the aggregation. Of rows that are not ``wanted`` only
    key and rank are shuffled: they beat others, and are dropped if they win."""
    if split:
        alone, rivals = split_repeated(df, keys)
        return (alone if wanted is None else alone.where(wanted)).unionByName(_pick(rivals, keys, rank, keep, wanted=wanted))
    rest = [c for c in df.columns if c not in keys]
    if not rest:
        return (df if wanted is None else df.where(wanted)).distinct()
    pick = F.min_by if keep == "first" else F.max_by
    if wanted is None:
        won = df.groupBy(*keys).agg(pick(F.struct(*rest), rank).alias("_won"))
    else:
        shown = df.select(*keys, F.when(wanted, F.struct(*rest)).alias("_shown"), rank.alias("_rank"))
        won = shown.groupBy(*keys).agg(pick("_shown", "_rank").alias("_won")).where(F.col("_won").isNotNull())
    return won.select(*[F.col(c) if c in keys else F.col("_won")[c].alias(c) for c in df.columns])


def _summed(amounts: list[str]) -> Column:
    """Null if any part is null, as a sum of columns is."""
    first, *others = [money(a) for a in amounts]
    for other in others:
        first = first + other
    return first


def keys_usable(df: DataFrame, keys: list[str]) -> Column:
    """Whether every key column holds a value somewhere, asked of all of them in one pass that keeps a row per task."""
    seen = df.agg(*[F.coalesce(F.max(~is_blank(key, ("",))), F.lit(False)).alias(f"_k{i}") for i, key in enumerate(keys)])
    return seen.select(all_of([F.col(f"_k{i}") for i in range(len(keys))])).scalar()


def keys_usable_within(df: DataFrame, keys: list[str], within: list[str]) -> Column:
    """The same for each group of rows, such as each source: a list of the groups whose keys hold
    values, as a scalar subquery. One row per group and task is shuffled."""
    held = df.groupBy(*within).agg(*[F.max(~is_blank(key, ("",))).alias(f"_k{i}") for i, key in enumerate(keys)])
    good = held.where(all_of([F.col(f"_k{i}") for i in range(len(keys))]))
    name = F.concat_ws("\u0001", *[F.coalesce(F.col(w).cast("string"), F.lit("\u0002")) for w in within])
    return F.array_contains(good.agg(F.collect_list(name)).scalar(), name)


def keep_best(df: DataFrame, keys: list[str], amounts: list[str], form: str, order: list[str],
              fallback_keys: list[str] | None = None, usable: Column | None = None,
              within: list[str] | None = None, split: bool = False, wanted: Column | None = None) -> DataFrame:
    """Per key the row with the highest amount, then the last form in the alphabet, then the first row.

    A key column that is blank on every row identifies nothing: then only ``fallback_keys``
    count and their first row is kept. With ``within``, each group of rows decides that for itself.
    Row-order columns are numeric. Missing amounts and forms rank last.

    With ``split`` the keys are counted first, as hashes, and rows that are alone under their key
    pass as they are: only rivals are shuffled at full width. That reads ``df`` three times, the first time
    its keys alone, so it pays for tables read from files in which most keys are unique.

    ``wanted`` looks at one row at a time and leaves what ``where(wanted)`` after this would leave; the other rows
    are shuffled by key and rank alone.
    """
    fallback_keys = fallback_keys or order
    if usable is None:
        usable = keys_usable_within(df, keys, within) if within else keys_usable(df, keys)
    guarded = df.withColumn("_guard", F.when(~usable, F.struct(*fallback_keys)))
    earliest = [(-F.col(c)).alias(c) for c in order]
    rank = F.struct(F.when(usable, F.struct(_summed(amounts).alias("amount"), F.col(form).alias("form")))
                    .alias("best"), *earliest)
    return _pick(guarded, [*(within or []), *keys, "_guard"], rank, "last", split, wanted).drop("_guard")


def keep_first_by_each(df: DataFrame, key_sets: list[list[str]], order: list[str],
                       unique_on: list[str] | None = None, split: bool = False) -> DataFrame:
    """Keep the first row per key, for several keys in turn.

    Once rows are unique on some columns they are unique on every wider key, so such passes
    (and, with ``unique_on``, passes an earlier step has settled) cost no shuffle.
    """
    settled = [set(unique_on)] if unique_on else []
    for keys in key_sets:
        if any(done <= set(keys) for done in settled):
            continue
        df = keep_by_key(df, keys, order, split=split)
        settled.append(set(keys))
    return df


def flag_repeats(df: DataFrame, flags: dict[str, list[str]], order: list[str]) -> DataFrame:
    """Per flag, true on every member of a group that has more than one row.

    All counts are taken from the table as given, not from the output of the flag before. Rows are known by a hash of
    96 bits of ``order`` and all keys: rows that agree in these have the same flags. What meets the rows again is which
    of them are alone under their keys, so no group is gathered and the rows are shuffled once for all flags. ``df`` is
    read twice, and best settled where it is dear.
    """
    one, two = _hashes(0, list(dict.fromkeys([*order, *[k for keys in flags.values() for k in keys]])))
    known = df.withColumns({"_at": one, "_by": F.shiftright(two, 32).cast("int")})
    marks = _alone(known, flags, ["_at", "_by"]).groupBy("_at", "_by").agg(F.bit_or("_mark").alias("_marks"))
    joined = known.join(marks, ["_at", "_by"], "left")
    return joined.select(*[known[f"`{c}`"] for c in df.columns], *[_unmarked(i).alias(f) for i, f in enumerate(flags, 1)])


def _hashes(salt: int, names: list[str]) -> tuple[Column, Column]:
    """Two hashes of 64 bits; null and blank differ, and a null says in which column it stands."""
    parts = [x for n in names for x in (F.col(f"`{n}`").isNull(), F.col(f"`{n}`"))]
    return F.xxhash64(F.lit(salt), *parts), F.xxhash64(F.lit(~salt), *parts)


def _alone(df: DataFrame, flags: dict[str, list[str]], of: list[str]) -> DataFrame:
    """(of, _mark): the rows that are alone under the keys of a flag, by number from 1, as a bit.

    A row is dealt out once per flag, as a hash of 96 bits with the flag's number beside it, and counted. All that is
    counted has a fixed width, so tasks add up in a hash map and sort nothing.
    """
    def dealt(bit: int, names: list[str]) -> Column:
        one, two = _hashes(bit, names)
        return F.struct(one.alias("one"), two.bitwiseAND(F.lit(0xFFFFFFFF00)).bitwiseOR(F.lit(bit).cast("bigint")).alias("two"))

    sets = F.explode(F.array(*[dealt(i, names) for i, names in enumerate(flags.values(), 1)]))
    entries = df.select(*of, sets.alias("_k")).select(*of, "_k.one", "_k.two")
    counted = entries.groupBy("one", "two").agg(F.count(F.lit(1)).alias("_n"), *[F.min(c).alias(c) for c in of])
    return counted.where("_n = 1").select(*of, F.expr("shiftleft(1L, cast(two & 255 as int))").alias("_mark"))


def _unmarked(bit: int) -> Column:
    return F.coalesce(F.getbit("_marks", F.lit(bit)), F.lit(0)) == 0


def flag_deleted(df: DataFrame, keys: list[str], amounts: list[str], form: str, order: list[str],
                 name: str = "_DELETED_DUP") -> DataFrame:
    """True on all rows but the best of each key; among equal amounts the form ranks ascending."""
    columns = df.columns
    rank = F.struct(*_ascending(amounts, form, order))
    winners = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_weight"), F.min(rank).alias("_best"))
    # rows that are alone under their key are their own winners and need no partner
    df = attach_by_key(df, winners.where("_weight > 1"), keys, "_weight", order, row_total(df))
    beaten = F.col("_best").isNotNull() & (F.struct(*[F.col("_best")[c] for c in order]) != F.struct(*order))
    return df.select(*columns, beaten.alias(name))


def flag_groups(df: DataFrame, flags: dict[str, list[str]], row: str, deleted: str, keys: list[str], amounts: list[str],
                form: str, order: list[str], apart: bool = False) -> DataFrame:
    """``flag_repeats`` for all ``flags`` and ``flag_deleted`` for ``keys`` in one go, for rows that ``row`` tells apart.

    Every row is dealt out once per key set, as a hash of 128 bits and its row number, and counted. What comes
    back is not the repeated keys but the rows that are alone under theirs, and the best row of each of
    ``keys``: one row per key, so that a key with a third of all rows is one row per task and no join with it is
    needed. Those marks meet per row, and then the rows themselves: three shuffles, one of them at full width.

    A best row is found by sorting, and in one aggregation the entries of all flags are sorted with it, which spills
    where tasks are large. With ``apart`` the best rows have an aggregation of their own, and a fourth shuffle; ``df`` is
    read three times then, and best settled where it is dear.
    """
    best = _ascending(amounts, form, order)
    marked = _best(df, row, keys, best).unionByName(_alone(df, flags, [row])) if apart else _marked(df, flags, row, keys, best)
    marks = marked.groupBy(row).agg(F.bit_or("_mark").alias("_marks"))
    joined = df.join(marks, row, "left")
    return joined.select(*[df[f"`{c}`"] for c in df.columns], _unmarked(0).alias(deleted), *[_unmarked(i).alias(f) for i, f in enumerate(flags, 1)])


def _best(df: DataFrame, row: str, keys: list[str], best: list[Column]) -> DataFrame:
    """(row, _mark): the best row of each of ``keys``, marked as number 0."""
    one, two = _hashes(0, keys)
    ranked = df.select(one.alias("one"), two.alias("two"), F.struct(F.struct(*best).alias("rank"), F.col(row).alias("of")).alias("_rank"))
    won = ranked.groupBy("one", "two").agg(F.min("_rank").alias("_best"))
    return won.select(F.col("_best.of").alias(row), F.lit(1).cast("bigint").alias("_mark"))


def _marked(df: DataFrame, flags: dict[str, list[str]], row: str, keys: list[str], best: list[Column]) -> DataFrame:
    """The best rows and those that are alone, from one aggregation."""
    def dealt(bit: int, names: list[str], rank: Column) -> Column:
        one, two = _hashes(bit, names)
        return F.struct(one.alias("one"), two.alias("two"), F.lit(bit).cast("byte").alias("bit"), rank.alias("rank"))

    sets = [dealt(0, keys, F.struct(*best)), *[dealt(i, names, F.lit(None)) for i, names in enumerate(flags.values(), 1)]]
    entries = df.select(F.col(row).alias("_of"), F.explode(F.array(*sets)).alias("k")).select("_of", "k.*")
    counted = entries.groupBy("one", "two", "bit").agg(F.count(F.lit(1)).alias("n"), F.min("_of").alias("_first"),
                                                       F.min(F.struct("rank", F.col("_of").alias("of"))).alias("_best"))
    return counted.where("bit = 0 or n = 1").select(
        F.when(F.col("bit") == 0, F.col("_best.of")).otherwise(F.col("_first")).alias(row), F.expr("shiftleft(1L, cast(bit as int))").alias("_mark"))


def _ascending(amounts: list[str], form: str, order: list[str]) -> list[Column]:
    """What ranks the rows of a key where flags are set: the highest amount, then the first form, then the first row."""
    amount = _summed(amounts)
    return [amount.isNull().alias("no_amount"), (-amount).alias("amount"), F.col(form).isNull().alias("no_form"), F.col(form).alias("form"),
            *[F.col(c) for c in order]]


def drop_duplicates(df: DataFrame, id_col: str, violation: str, amounts: list[str], form: str,
                    order: list[str], within: list[str] | None = None, usable: Column | None = None, split: bool = False,
                    wanted: Column | None = None) -> DataFrame:
    """Trim ids, full-row distinct, then the best row per (id, violation), per ``within`` if given.

    Wider keys (with amount, names or address added) can find nothing further once rows are
    unique per (id, violation); where ids or violations are blank throughout, (id, violation,
    amount) decides and the other wider keys contain it. A full copy shares all keys, and the
    best row of a group is one of its first copies, so the full-row pass is part of the same
    aggregation: one shuffle in all, and with ``split`` one of rivals alone. ``wanted`` as in ``keep_best``.
    """
    df = df.withColumn(id_col, F.trim(id_col))
    keys = [id_col, violation]
    return keep_best(df, keys, amounts, form, order, fallback_keys=[*keys, amounts[0]], usable=usable, within=within, split=split, wanted=wanted)


def shared_keys(tables: list[DataFrame], keys: list[str]) -> DataFrame:
    """Keys that occur more than once in all tables together, with ``_weight``, how often."""
    narrow = reduce(DataFrame.unionByName, [t.select(*keys) for t in tables])
    return narrow.groupBy(*keys).agg(F.count(F.lit(1)).alias("_weight")).where("_weight > 1")


def mark_shared(df: DataFrame, keys: list[str], order: list[str], name: str = "shared", known: DataFrame | None = None) -> DataFrame:
    """True where a key occurs more than once, so that later passes can leave the rest alone.

    ``known`` has the keys that several tables share, from ``shared_keys``; else those that repeat in ``df`` count.
    """
    repeated = (shared_keys([df], keys) if known is None else known).withColumn(name, F.lit(True))
    marked = attach_by_key(df, repeated, keys, "_weight", order, row_total(df))
    return marked.withColumn(name, F.coalesce(name, F.lit(False)))


def drop_shared_duplicates(df: DataFrame, shared: str, id_col: str, violation: str, amounts: list[str],
                           form: str, order: list[str], wanted: Column | None = None) -> DataFrame:
    """``drop_duplicates`` for a table marked with ``mark_shared`` on (id, violation).

    Rows that share their key with no other row cannot be duplicates: they go straight
    through, filters reach their scan, and only the marked remainder is shuffled.
    """
    usable = keys_usable(df, [id_col, violation])
    marked = F.col(shared).cast("boolean")
    rivals = drop_duplicates(df.where(marked), id_col, violation, amounts, form, order, usable=usable, wanted=wanted)
    alone = df.where(~marked) if wanted is None else df.where(~marked & wanted)
    return alone.unionByName(rivals.select(*df.columns))
