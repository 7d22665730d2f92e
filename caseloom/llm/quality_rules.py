"""Quality rules with thresholds drawn from the corpus itself.

Measures of each document go into mergeable quantile sketches per language and source: integer
histograms whose buckets are exact for small values and logarithmic above. A sketch is a set of
counts, so partial sketches of tasks, sources and languages merge by adding. Groups with few
documents fall back on the merged sketch of their language, then of the corpus. Documents that the
fixed rules reject anyway shape no threshold. A document is rejected where a measure lies further from
its group's median than several times the distance of an upper (or lower) quantile of the group.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from caseloom.llm.common import BLANKS, arrow_column, as_bytes, blocks, settle, shingles, struct_of, without, word_hashes

SPACES = bytes.maketrans(BLANKS, b" " * len(BLANKS))
SYMBOLS = b"#*$%&|<>"
WINDOW = 5
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines")
RESULT = "struct<" + ",".join(f"{c}:bigint" for c in COUNTS) + ">"
_WEIGHS = np.zeros(256, np.int64)
_WEIGHS[list(SYMBOLS)] = 1


@dataclass(frozen=True)
class Fence:
    """How far a measure may lie from its group's median: ``reach`` times the distance of the ``share`` quantile.

    Where that distance is nothing, as the measure is constant in the group up to this quantile,
    ``least`` stands in for it.
    """

    measure: str
    value: str
    least: int
    reach: int
    share: float = 0.75
    below: bool = False


#: Measures as integers: hundredths of a character, symbols per 100 words, lines and words per 1000. Junk is a
#: few in a hundred of a source, so quartiles are taken where its values are extreme, and a percentile of the tail where
#: the fixed rules have rejected the extreme ones and what is left of the measure lies there.
FENCES = (
    Fence("word_length", "m.word_chars * 100 div greatest(m.n_words, 1)", least=10, reach=12, below=True),
    Fence("symbols", "m.n_symbols * 100 div greatest(m.n_words, 1)", least=3, reach=8),
    Fence("dup_lines", "m.n_dup_lines * 1000 div greatest(m.n_lines, 1)", least=60, reach=5, share=0.95),
    Fence("repeats", "m.n_repeat_words * 1000 div greatest(m.n_words, 1)", least=30, reach=3, share=0.98),
)
#: Values kept exactly, and buckets to each doubling beyond.
EXACT, STEPS = 1024, 128


def _repeated(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Words of each text, and how many of them lie in a window that the text has twice or more."""
    hashes, counts = word_hashes(texts, SPACES)
    keys, first = shingles(hashes, counts, WINDOW)
    doc = np.repeat(np.arange(len(counts)), counts)
    if not len(keys):
        return counts, np.zeros(len(texts), np.int64)
    keys = keys + doc[first].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    order = np.argsort(keys, kind="stable")
    ranked, owner = keys[order], doc[first][order]
    same = (ranked[1:] == ranked[:-1]) & (owner[1:] == owner[:-1])
    twice = np.zeros(len(keys), bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    change = np.zeros(len(hashes) + 1, np.int64)
    np.add.at(change, first[twice], 1)
    np.add.at(change, first[twice] + WINDOW, -1)
    return counts, np.bincount(doc, weights=np.cumsum(change[:-1]) > 0, minlength=len(texts)).astype(np.int64)


def _measure(texts: pa.Array) -> pa.Array:
    out = {c: np.zeros(len(texts), np.int64) for c in COUNTS}
    for i, j, part in blocks(texts):
        out["n_words"][i:j], out["n_repeat_words"][i:j] = _repeated(part)
        for k, text in enumerate(part, i):
            a = np.frombuffer(text.translate(None, BLANKS), np.uint8)
            out["word_chars"][k] = np.count_nonzero((a & 0xC0) != 0x80)
            out["n_symbols"][k] = _WEIGHS[a].sum()
            lines = [line for line in text.split(b"\n") if line.strip(BLANKS)]
            out["n_lines"][k] = len(lines)
            out["n_dup_lines"][k] = len(lines) - len(set(lines))
    return struct_of(**{c: (v, pa.int64()) for c, v in out.items()})


def measures(text: str = "text") -> Column:
    """The counts of one text as a struct; null and empty texts count nothing."""
    return arrow_column(_measure, RESULT, as_bytes(text))


def _bucket(value: Column) -> Column:
    """Exact to ``EXACT``, then ``STEPS`` buckets to each doubling: relative error below 0.6 %."""
    return F.when(value < EXACT, value).otherwise(F.lit(EXACT) + F.floor((F.log2(value) - math.log2(EXACT)) * STEPS)).cast("int")


def _floor_of(bucket: Column) -> Column:
    """The smallest value of a bucket."""
    return F.when(bucket < EXACT, bucket.cast("double")).otherwise(F.pow(F.lit(2.0), (bucket - EXACT) / STEPS) * EXACT)


def sketches(measured: DataFrame, lang: str = "lang", source: str = "source") -> DataFrame:
    """Counts per language, source, measure and bucket: the mergeable sketch of every group.

    ``measured`` has the struct of ``measures`` as column ``m``.
    """
    each = F.array(*[F.struct(F.lit(f.measure).alias("measure"), _bucket(F.expr(f.value)).alias("bucket")) for f in FENCES])
    return (measured.where(F.expr("m.n_words > 0") & ~base_failed()).select(F.col(lang).alias("lang"), F.col(source).alias("source"), F.explode(each).alias("s"))
            .groupBy("lang", "source", "s.measure", "s.bucket").agg(F.count("*").alias("n")))


def _quartiles(sketch: DataFrame, *by: str) -> DataFrame:
    """Median, and the quantile of each measure's fence on both sides, of a group, from merged counts. The counts of
    one group are as many as there are buckets, however many documents it has."""
    merged = sketch.groupBy(*by, "measure", "bucket").agg(F.sum("n").alias("n"))
    held = merged.groupBy(*by, "measure").agg(F.sum("n").alias("docs"), F.sort_array(F.collect_list(F.struct("bucket", "n"))).alias("counts"))

    upper = _of_measure("share")

    def at(share: Column) -> Column:
        need = F.col("docs") * share
        found = F.aggregate(
            "counts", F.struct(F.lit(0).cast("bigint").alias("sum"), F.lit(0).alias("bucket")),
            lambda a, x: F.when(a["sum"] >= need, a).otherwise(F.struct((a["sum"] + x["n"]).alias("sum"), x["bucket"].alias("bucket"))))
        return _floor_of(found["bucket"])

    return held.select(*by, "measure", "docs", at(1 - upper).alias("q1"), at(F.lit(0.5)).alias("q2"), at(upper).alias("q3"))


def _of_measure(name: str) -> Column:
    """A number of the fence that a row's measure belongs to."""
    return F.create_map(*[F.lit(x) for f in FENCES for x in (f.measure, getattr(f, name))])[F.col("measure")]


def thresholds(sketch: DataFrame, min_docs: int = 200) -> DataFrame:
    """``low`` and ``high`` of each measure per language and source.

    Groups of fewer than ``min_docs`` documents take their language's, and languages as small
    the whole corpus's. Null languages and sources are groups like any other.
    """
    nothing = F.lit(None).cast("string")
    levels = [F.struct(F.lit(k).alias("level"), (F.col("lang") if k < 2 else nothing).alias("of_lang"),
                       (F.col("source") if k < 1 else nothing).alias("of_source")) for k in range(3)]
    asked = sketch.select("lang", "source").distinct().select("lang", "source", F.explode(F.array(*levels)).alias("k")).select("lang", "source", "k.*")
    known = (_quartiles(sketch, "lang", "source").withColumn("level", F.lit(0))
             .unionByName(_quartiles(sketch, "lang").withColumns({"source": nothing, "level": F.lit(1)}))
             .unionByName(_quartiles(sketch).withColumns({"lang": nothing, "source": nothing, "level": F.lit(2)}))
             .withColumnsRenamed({"lang": "_lang", "source": "_source", "level": "_level"}))
    offered = asked.join(known, (F.col("level") == F.col("_level")) & F.col("of_lang").eqNullSafe(F.col("_lang"))
                         & F.col("of_source").eqNullSafe(F.col("_source")))
    # the narrowest sketch that is large enough; where even the corpus is small, the corpus
    rank = F.when(F.col("docs") >= min_docs, F.col("level")).otherwise(F.lit(20) - F.col("level"))
    chosen = offered.groupBy("lang", "source", "measure").agg(F.min_by(F.struct("q1", "q2", "q3"), rank).alias("q"))

    def spread(distance: Column) -> Column:
        return _of_measure("reach") * F.when(distance > 0, distance).otherwise(_of_measure("least"))

    return chosen.select("lang", "source", "measure", (F.col("q.q2") - spread(F.col("q.q2") - F.col("q.q1"))).alias("low"),
                         (F.col("q.q2") + spread(F.col("q.q3") - F.col("q.q2"))).alias("high"))


def by_group(limits: DataFrame) -> DataFrame:
    """One row per group: a map from measure to its limits."""
    return limits.groupBy("lang", "source").agg(
        F.map_from_entries(F.collect_list(F.struct("measure", F.struct("low", "high")))).alias("limits"))


def base_failed() -> Column:
    return F.expr("m.n_words < 10 or 100 * m.n_repeat_words > 20 * m.n_words")


def judged(measured: DataFrame, limits: DataFrame, most_groups: int = 20_000) -> DataFrame:
    """Joins each document with its group's limits; adds ``base_failed`` and ``kept``.

    ``limits`` comes from ``by_group`` and should be a settled table: it is broadcast if it has
    at most ``most_groups`` rows, else both sides meet in a shuffle, where Spark splits a
    language and source that hold many documents.
    """
    narrow = limits.withColumnsRenamed({"lang": "_lang", "source": "_source"})
    if limits.count() <= most_groups:
        narrow = F.broadcast(narrow)
    joined = measured.join(narrow, measured["lang"].eqNullSafe(narrow["_lang"]) & measured["source"].eqNullSafe(narrow["_source"]), "left")
    inside = F.lit(True)
    for f in FENCES:
        limit = F.col("limits")[f.measure]
        inside = inside & F.coalesce(F.expr(f.value) <= limit["high"], F.lit(True))
        if f.below:
            inside = inside & F.coalesce(F.expr(f.value) >= limit["low"], F.lit(True))
    failed = base_failed()
    return joined.withColumns({"base_failed": failed, "kept": ~failed & inside}).drop("limits", "_lang", "_source")


def quality_verdicts(docs: DataFrame, min_docs: int = 200) -> DataFrame:
    """One row per document: doc_id, the counts, ``base_failed`` and ``kept``.

    Documents without words fail. Null texts are empty; null languages and sources form groups
    of their own; repeated rows are judged each, and alike. Other columns are left behind.
    """
    measured = settle(docs.select("doc_id", "lang", "source", measures().alias("m")), "measures")
    limits = settle(by_group(thresholds(sketches(measured), min_docs)), "limits")
    return judged(measured, limits).select("doc_id", "lang", "source", "m.*", "base_failed", "kept")


def keep_good(docs: DataFrame, min_docs: int = 200) -> DataFrame:
    """The documents whose verdict is to keep, with the columns they came with.

    Measures are taken once for the sketches, and again, without moving a text, for the filter.
    """
    measured = docs.select("lang", "source", measures().alias("m"))
    limits = settle(by_group(thresholds(settle(sketches(measured), "sketches"), min_docs)), "limits")
    whole = without(docs, "m", "limits", "kept", "base_failed").withColumn("m", measures())
    clashing = [c for c in docs.columns if c not in whole.columns]
    if clashing:  # columns of the input that the filter's own would hide travel beside it
        whole = docs.select(F.struct(*[F.col(f"`{c}`") for c in clashing]).alias("_rest"), *[F.col(f"`{c}`") for c in whole.columns if c != "m"]).withColumn("m", measures())
    kept = judged(whole, limits).where("kept")
    return kept.select(*[F.col(f"_rest.`{c}`").alias(c) if c in clashing else F.col(f"`{c}`") for c in docs.columns])
