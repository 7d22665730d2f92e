"""Street addresses in one spelling."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from caseloom.functions import text as T
from caseloom.rules import address as R


def _folded(c: Column, rules: list[tuple[str, str, list[str]]], lower: bool = False) -> Column:
    """The rules in order, each tried only where one of the literals is that its pattern cannot do without; and all of
    them only where any of these literals is: none can apply elsewhere, as the first to change a text has to find one in
    it as it came."""
    def held(x: Column, parts: list[str]) -> Column:
        return T.holds(F.lower(x) if lower else x, parts)

    def each(x: Column) -> Column:
        for find, put, parts in rules:
            x = T.gated(x, lambda y, p=parts: held(y, p), lambda y, f=find, w=put: F.regexp_replace(y, f, w))
        return x

    return T.gated(c, lambda x: held(x, [p for *_, parts in rules for p in parts]), each)


def _street(c: Column, whole_words: bool) -> Column:
    c = F.concat(T.trim_edges(T.squeeze_once(c)), F.lit(" "))
    c = T.fold_literals(c, list(R.SHORTENED.items()))
    rules = [(find, word, parts) for (find, word), parts in zip(R.street_rules(whole_words), R.street_parts(), strict=True)]
    # the commonest word has a step of its own, so that the others are not tried wherever it stands
    own = next(i for i, (_, word, _) in enumerate(rules) if word == R.STREET_WORDS["ST"])
    c = _folded(_folded(_folded(c, rules[:own]), [rules[own]]), rules[own + 1:])
    return T.fold_literals(c, R.NUMBER_MARKS)


def _dotted_compass(c: Column, whole_words: bool) -> Column:
    if not whole_words:
        return T.fold_literals(c, R.dotted_compass())
    return _folded(c, [(rf"(?={letter})\b{letter}\. ", f"{word} ", [f"{letter}. "]) for letter, word in R.COMPASS.items()])


def clean_address(df: DataFrame, c: str, target: str | None = None, whole_words: bool = True) -> DataFrame:
    """Abbreviations written out, punctuation and spacing settled.

    ``whole_words=False`` also expands inside longer words (PROSPECT -> PROSPECourt), which
    is what plain substring replacement does.
    """
    at = _dotted_compass(_street(F.col(c), whole_words), whole_words)
    ordinals = [(find, word, [short.lower()]) for (find, word), short in zip(R.ordinal_rules(whole_words), R.ORDINALS, strict=True)]
    at = _folded(T.fold_literals(at, R.lone_compass()), ordinals, lower=True)
    return df.withColumn(target or c, T.address_spacing(T.address_punctuation(T.address_spacing(at))))
