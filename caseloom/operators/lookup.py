"""Amounts by the term a text contains.

A short list of terms is part of the expression. A term table of any size is joined through an index of
character runs: a text can only contain a term if it has the term's rarest run, and runs meet in an equi-join.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from caseloom.operators.spread import on_distinct
from caseloom.rules.penalties import UNMATCHED

#: Characters of a run; shorter terms are runs of their own length.
RUN = 4


def _holds(text: Column, term: str) -> Column:
    return F.contains(text, F.lit(term.upper()))


def term_amount(text: Column | str, terms: list[tuple[str, Column]], default: Column) -> Column:
    """Amount of the last listed term the text contains, whatever the case.

    The table is part of the expression and read from its end, so the first hit settles it;
    a contains-join would compare every text with every term.
    """
    upper = F.upper(F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit("")))
    return F.coalesce(*[F.when(_holds(upper, term), amount) for term, amount in reversed(terms)], default)


def default_amount(column: int = 1) -> Column:
    return F.lit(UNMATCHED[column - 1])


def unmatched_terms(df: DataFrame, text: str, terms: list[str]) -> DataFrame:
    """Distinct texts no term fits: what a rule writer should look at next."""
    upper = F.upper(F.coalesce(F.col(text), F.lit("")))
    none = F.lit(True)
    for term in terms:
        none = none & ~_holds(upper, term)
    return df.where(none).select(F.coalesce(F.col(text), F.lit("")).alias(text)).distinct()


def _runs(text: Column, length: Column) -> Column:
    """Distinct runs of ``length`` characters, at most ``RUN``; none of a shorter text."""
    characters = F.regexp_extract_all(text, F.lit("(?s)."), F.lit(0))

    def cut(chars: Column) -> Column:
        def one(i: Column) -> Column:
            return F.concat(F.get(chars, i), *[F.when(length > k, F.get(chars, i + k)).otherwise("") for k in range(1, RUN)])
        starts = F.when(F.size(chars) >= length, F.sequence(F.lit(0), F.greatest(F.size(chars) - length, F.lit(0)))).otherwise(F.array().cast("array<int>"))
        return F.array_distinct(F.transform(starts, one))

    return F.transform(F.array(characters), cut)[0]


def _matches(distinct: DataFrame, text: str, terms: DataFrame) -> DataFrame:
    """(_t1, _t2, term, ord, amount) of each distinct text, known by two hashes, and each term it contains."""
    listed = terms.select(F.upper("term").alias("term"), "ord", "amount").where("term <> ''").withColumn("_length", F.least(F.length("term"), F.lit(RUN)))
    lengths = [r[0] for r in listed.select("_length").distinct().collect()]  # RUN numbers at most
    known = distinct.select(F.col(text).alias("_text"), F.xxhash64(F.lit(1), text).alias("_t1"), F.xxhash64(F.lit(2), text).alias("_t2"))
    all_runs = F.flatten(F.array(*[_runs(F.col("_text"), F.lit(n)) for n in lengths])) if lengths else F.array().cast("array<string>")
    held = known.select("_t1", "_t2", F.explode(all_runs).alias("_run"))
    often = held.groupBy("_run").agg(F.count(F.lit(1)).alias("_often"))
    # a term with a run that no text has cannot be in any
    ways = listed.withColumn("_run", F.explode(_runs(F.col("term"), F.col("_length")))).join(often, "_run", "left")
    rarest = ways.groupBy("term", "ord").agg(F.first("amount").alias("amount"), F.min(F.struct(F.coalesce("_often", F.lit(0)).alias("n"), "_run")).alias("_least"))
    asked = rarest.where("_least.n > 0").select("term", "ord", "amount", F.col("_least._run").alias("_run"))
    candidates = held.join(asked, "_run").join(known, ["_t1", "_t2"])
    return candidates.where(F.contains("_text", "term")).select("_t1", "_t2", "term", "ord", "amount")


def term_amounts(df: DataFrame, text: str, terms: DataFrame, default: Column, name: str, order: list[str]) -> DataFrame:
    """``term_amount`` from a table ``terms(term, ord, amount)`` of any size: the amount of the term of highest ``ord``.

    Terms are searched in each distinct text once, and the amounts come back to the rows with hot texts
    salted; ``order`` has the columns that tell rows apart. Null and empty terms fit nothing.
    """
    upper = F.upper(F.coalesce(F.col(f"`{text}`"), F.lit("")))

    def step(distinct: DataFrame) -> DataFrame:
        last = _matches(distinct, "_upper", terms).groupBy("_t1", "_t2").agg(F.max_by(F.struct("amount"), "ord").alias("_hit"))
        keyed = distinct.withColumns({"_t1": F.xxhash64(F.lit(1), "_upper"), "_t2": F.xxhash64(F.lit(2), "_upper")})
        return keyed.join(last, ["_t1", "_t2"], "left").select(*distinct.columns, "_hit")

    found = on_distinct(df.withColumn("_upper", upper), ["_upper"], step, order)
    return found.select(*[found[f"`{c}`"] for c in df.columns], F.coalesce(F.col("_hit.amount"), default).alias(name))


def unmatched_texts(df: DataFrame, text: str, terms: DataFrame) -> DataFrame:
    """``unmatched_terms`` against a term table of any size."""
    shown = df.select(F.coalesce(F.col(f"`{text}`"), F.lit("")).alias(text)).distinct()
    upper = shown.withColumn("_upper", F.upper(F.col(f"`{text}`")))
    hit = _matches(upper.select("_upper").distinct(), "_upper", terms).select("_t1", "_t2").distinct()
    keyed = upper.withColumns({"_t1": F.xxhash64(F.lit(1), "_upper"), "_t2": F.xxhash64(F.lit(2), "_upper")})
    return keyed.join(hit, ["_t1", "_t2"], "left_anti").select(f"`{text}`")
