"""Industry by ordered rules."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from caseloom.functions import text as T
from caseloom.functions.blanks import any_of
from caseloom.rules.book import NEVER, Rule
from caseloom.rules.industries import UNDEFINED


def matches(c: Column | str, rule: Rule) -> Column:
    hit = T.has_any(c, f"(?:{rule.include})")
    return hit if rule.exclude == NEVER else hit & ~T.has_any(c, f"(?:{rule.exclude})")


def _first(cols: list[str], rules: list[Rule]) -> Column:
    """Index of the first rule any column matches; later rules are not even tried."""
    picks = [F.when(any_of([matches(c, r) for c in cols]), F.lit(i)) for i, r in enumerate(rules)]
    return F.coalesce(*picks)


def _last(cols: list[str], rules: list[Rule]) -> Column:
    picks = [F.when(any_of([matches(c, r) for c in cols]), F.lit(i))
             for i, r in reversed(list(enumerate(rules)))]
    return F.coalesce(*picks)


def infer_detail(df: DataFrame, rules: list[Rule], names: list[str], description: str, code: str,
                 detail: str = "industry_detail") -> DataFrame:
    """The part of an industry a case belongs to, or null: by code, else by description, else by
    name. Rules later in order are the more special ones and win."""
    picks = [_last([code], rules), _last([description], rules), _last(names, rules)]
    labels = F.array(*[F.lit(r.label) for r in rules])
    at = F.coalesce(*picks)
    return df.withColumn(detail, F.when(at.isNotNull(), F.get(labels, at)))


def infer_industry(df: DataFrame, rules: list[Rule], names: list[str], description: str, code: str,
                   industry: str = "industry", detail: str = "trade2") -> DataFrame:
    """Label rows from what they say about their trade.

    Running the rules in order, a name match sets the detail (later rules overwrite), a
    description match sets a blank industry (the first one stays) and a code match sets the
    industry whatever it was (later rules overwrite); the last two clear the detail. That
    comes to three indexes per row, so nothing is carried from rule to rule:

    * the last code match, if any, is the industry;
    * else, where the industry was blank, the first description match;
    * else the last name match.
    """
    labels = F.array(*[F.lit(r.label) for r in rules])

    def label(index: str) -> Column:
        return F.when(F.col(index).isNotNull(), F.get(labels, F.col(index)))

    blank = F.col(industry).isNull() | (F.trim(industry) == "")
    out = df.withColumns({
        "_code": _last([code], rules),
        "_code_first": _first([code], rules),
        "_desc": F.when(blank, _first([description], rules)),
        "_name": _last(names, rules),
    })
    # a code match before the description match would already have filled the industry
    set_by_desc = F.when(F.col("_code_first").isNull() | (F.col("_code_first") >= F.col("_desc")), F.col("_desc"))
    cleared = F.greatest(F.col("_code"), set_by_desc)
    settled = F.coalesce(label("_code"), label("_desc"), F.when(~blank, F.col(industry)))
    kept_detail = F.when(cleared.isNull() | (F.col("_name") > cleared), label("_name"))
    return (out.withColumns({industry: F.coalesce(settled, label("_name"), F.lit(UNDEFINED)),
                             detail: F.coalesce(kept_detail, F.lit(""))})
            .drop("_code", "_code_first", "_desc", "_name"))
