"""Bringing per-key values back to rows when one key may hold a third of them.

A window over the key would sort a whole hot key in one task. Here the per-key values are
aggregated first (map-side partial sums shrink a hot key to one row per task) and joined
back. Keys above a share of all rows number at most 1 / share, so that part is broadcast with
a proven bound; their rows then carry a salt, so the shuffle join for the remaining keys
does not gather them either.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from caseloom.functions.blanks import all_of

HOT_SHARE = 0.001
SALTS = 64
#: Positions of the map of repeated keys: 2**26 bits are a million words, a broadcast of some 50 MB at most.
MAP_BITS = 26


def row_total(rows: DataFrame) -> Column:
    """Number of rows, as a scalar subquery that reads no column it does not need."""
    return rows.agg(F.count(F.lit(1))).scalar()


def attach_by_key(rows: DataFrame, per_key: DataFrame, keys: list[str], weight: str,
                  spread_by: list[str], total: Column, hot_share: float = HOT_SHARE,
                  salts: int = SALTS) -> DataFrame:
    """Left-join ``per_key`` (one row per key) to ``rows``; null keys equal null keys.

    ``weight`` is the number of rows behind a key, ``total`` the number of all rows, and
    ``spread_by`` the columns that tell rows of one key apart. Every column of ``per_key``
    but the keys and the weight is attached.
    """
    values = [c for c in per_key.columns if c not in keys and c != weight]
    limit = total * F.lit(hot_share)

    def renamed(df: DataFrame, tag: str, *more: Column) -> DataFrame:
        return df.select(*[F.col(k).alias(f"_{tag}_{k}") for k in keys], F.struct(*values).alias(f"_{tag}"), *more)

    def same_key(tag: str) -> Column:
        return all_of([F.col(k).eqNullSafe(F.col(f"_{tag}_{k}")) for k in keys])

    hot = renamed(per_key.where(F.col(weight) > limit), "hot")
    # always 0, yet not a literal: a literal would be folded into a filter and leave the join key
    zero = F.least(F.col(weight), F.lit(0)).cast("int").alias("_cold_salt")
    cold = renamed(per_key.where(F.col(weight) <= limit), "cold", zero)
    salt = F.pmod(F.xxhash64(*spread_by), F.lit(salts)) + 1
    return (
        rows.join(F.broadcast(hot), same_key("hot"), "left")
        .withColumn("_salt", F.when(F.col("_hot").isNull(), 0).otherwise(salt).cast("int"))
        .join(cold, same_key("cold") & (F.col("_salt") == F.col("_cold_salt")), "left")
        .select(*[rows[c] for c in rows.columns],
                *[F.coalesce(F.col("_hot")[v], F.col("_cold")[v]).alias(v) for v in values])
    )


def split_repeated(rows: DataFrame, keys: list[str], map_bits: int = MAP_BITS) -> tuple[DataFrame, DataFrame]:
    """(rows that are alone under their key, all others); null equals null.

    Keys are counted as hashes, with partial counts. Those met again set bits in a map whose size is bounded
    whatever the data, and which is broadcast; rows look their own bit up. A unique key that shares a
    bit with a repeated one lands among the others, so these have to be settled as if nothing were known
    of them; a row among the first is alone for certain. No row is shuffled here but as a hash.
    """
    counted = rows.select(_hashed(keys).alias("_h")).groupBy("_h").agg(F.count(F.lit(1)).alias("_n"))
    return _split(rows, keys, counted.where("_n > 1"), map_bits)


def split_listed(rows: DataFrame, keys: list[str], listed: DataFrame, map_bits: int = MAP_BITS) -> tuple[DataFrame, DataFrame]:
    """(rows whose key is not in ``listed`` for certain, rows whose key may be): as ``split_repeated``, for a list
    of keys of the same columns and types. What a shuffle join has to look at are the second ones alone."""
    return _split(rows, keys, listed.select(_hashed(keys).alias("_h")), map_bits)


def _hashed(keys: list[str]) -> Column:
    return F.xxhash64(*[x for k in keys for x in (F.col(f"`{k}`").isNull(), F.col(f"`{k}`"))])


def _split(rows: DataFrame, keys: list[str], hashes: DataFrame, map_bits: int) -> tuple[DataFrame, DataFrame]:
    def place(h: Column) -> Column:
        return F.pmod(h, F.lit(1 << map_bits))

    def word(h: Column) -> Column:
        return F.shiftright(place(h), 6)

    def bit(h: Column) -> Column:
        return F.call_function("shiftleft", F.lit(1).cast("bigint"), place(h).cast("int").bitwiseAND(63))

    h = F.col("_h")
    words = hashes.groupBy(word(h).alias("_word")).agg(F.bit_or(bit(h)).alias("_bits"))
    looked = rows.withColumn("_h", _hashed(keys)).withColumn("_at", word(h)).join(F.broadcast(words), F.col("_at") == F.col("_word"), "left")
    again = F.coalesce(F.col("_bits").bitwiseAND(bit(h)) != 0, F.lit(False))
    columns = [f"`{c}`" for c in rows.columns]
    return looked.where(~again).select(*columns), looked.where(again).select(*columns)


def group_totals(rows: DataFrame, keys: list[str], totals: dict[str, Column],
                 spread_by: list[str]) -> DataFrame:
    """Each row with the totals of its group, without gathering the group."""
    per_key = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("_weight"),
                                      *[c.alias(name) for name, c in totals.items()])
    return attach_by_key(rows, per_key, keys, "_weight", spread_by, row_total(rows))


def on_distinct(rows: DataFrame, texts: list[str], step: Callable[[DataFrame], DataFrame],
                spread_by: list[str]) -> DataFrame:
    """Run a costly text step once per distinct combination of its inputs, then bring it back.

    Worth it where texts repeat many times over and the step is dearer than one shuffle;
    otherwise apply the step to the rows themselves, which needs no shuffle at all.
    """
    distinct = rows.groupBy(*texts).agg(F.count(F.lit(1)).alias("_weight"))
    return attach_by_key(rows, step(distinct), texts, "_weight", spread_by, row_total(rows))
