"""The corpus pipeline: from raw documents to packed training sequences.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written and read again before
the next one, so a stage that fails starts from what the one before it kept. ORACLE_SQL is None: shingle
samples, quantile fences and tokens have no SQL; the tests hold each stage against a plain reading.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from caseloom.llm import decontaminate, line_dedup, near_dedup, packing, quality_rules
from caseloom.llm.common import settle, table


def _with_text(docs: DataFrame, columns: list[str]) -> DataFrame:
    """Counts the characters anew where a stage has changed the text."""
    if "n_chars" not in columns:
        return docs
    return docs.withColumn("n_chars", F.length("text").cast("bigint"))


def good_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents the adaptive quality rules reject go."""
    return quality_rules.keep_good(docs)


def without_shared_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines found in ten documents or more stay in the first one only; every document stays.

    A document that would lose all it says is a copy as a whole: it keeps its text, so that the next stage can
    choose which copy to keep, and no text is lost with all its copies.
    """
    done = line_dedup.drop_shared_lines(docs, keep_first=True)
    says = F.col("kept_text").rlike(r"[^\x20\x09-\x0D]")
    text = F.when((F.col("n_dropped") > 0) & says, F.col("kept_text")).otherwise(F.col("text"))
    return _with_text(done.withColumn("text", text), docs.columns).select(docs.columns)


def without_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of copies and near copies stays."""
    return near_dedup.one_per_class(docs)


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Contaminated documents go; shorter passages of the benchmark are cut out of the others."""
    return _with_text(decontaminate.remove_contamination(docs, table(spark, sf_dir, "benchmark")), docs.columns).select(docs.columns)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents in sequences of 2048 tokens, with their ids."""
    return packing.pack_documents(docs)


STAGES = [
    ("quality_rules", good_documents),
    ("line_dedup", without_shared_lines),
    ("near_dedup", without_copies),
    ("decontamination", without_benchmark),
    ("packing", packed),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = settle(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
