"""Ordered include/exclude rules, and how a list of terms compiles into them."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

# fixed values: marks a term as an exclusion; stands for "excludes nothing"
EXCLUDE_MARK = "!"
NEVER = "999999"


@dataclass(frozen=True)
class Rule:
    """One label with the pattern that grants it and the pattern that vetoes it."""

    label: str
    include: str
    exclude: str = NEVER


def exclusion_pattern(terms: list[str] | tuple[str, ...]) -> str:
    """Terms that carry the mark, without it, as one alternation."""
    vetoes = [t.replace(EXCLUDE_MARK, "") for t in terms if EXCLUDE_MARK in t]
    return "|".join(vetoes) or NEVER


def compile_rule(terms: list[str] | tuple[str, ...]) -> Rule:
    """The first term is the label and a pattern at once; marked terms are inert as patterns."""
    return Rule(terms[0], "|".join(terms), exclusion_pattern(terms))


def name_rule(label: str, names: list[str] | tuple[str, ...]) -> Rule:
    """A rule whose label is not itself a pattern (name lists)."""
    return Rule(label, "|".join(names) or NEVER, exclusion_pattern(names))


def check_terms(terms: list[str] | tuple[str, ...]) -> list[str]:
    """Findings in a term list: empty or repeated terms, and two terms run together."""
    findings, seen = [], set()
    for term in terms[1:]:
        if not term.strip():
            findings.append("empty term matches everything")
        if term in seen:
            findings.append(f"repeated: {term}")
        if EXCLUDE_MARK in term and not term.lstrip("^(").startswith(EXCLUDE_MARK):
            findings.append(f"two terms in one: {term}")
        seen.add(term)
    return findings


def read_rules(spark: SparkSession, path: str, rule_set: str) -> list[Rule]:
    """Rules of one set from a table (rule_set, ord, label, term, term_ord).

    Rule tables are vocabulary, written by people; they are compiled into patterns on the
    driver because a pattern is part of the plan.
    """
    table = spark.read.option("header", True).csv(path).where(F.col("rule_set") == rule_set)
    per_rule = (table.groupBy(F.col("ord").cast("int").alias("ord"), "label")
                .agg(F.sort_array(F.collect_list(F.struct(F.col("term_ord").cast("int"), "term"))).alias("terms"))
                .orderBy("ord"))
    return [compile_rule([row["label"], *[t["term"] for t in row["terms"]]]) for row in per_rule.toLocalIterator()]
