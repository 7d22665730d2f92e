"""Text cleaning as folds over one column."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

EDGE = " ;,."


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def swap(c: Column, find: str, put: str) -> Column:
    """Replace a literal everywhere."""
    return F.replace(c, F.lit(find), F.lit(put))


def drop_chars(c: Column, chars: str) -> Column:
    return F.translate(c, chars, "")


def squeeze_once(c: Column) -> Column:
    """Each pair of blanks becomes one blank (a single pass, so four become two)."""
    return swap(c, "  ", " ")


def trim_edges(c: Column, chars: str = EDGE) -> Column:
    return F.btrim(c, F.lit(chars))


def one_line(c: Column | str) -> Column:
    """Every whitespace character becomes a blank; those that are one are not looked for."""
    return F.regexp_replace(_col(c), r"[\t\n\x0B\f\r]", " ")


def address_punctuation(c: Column | str) -> Column:
    c = squeeze_once(drop_chars(_col(c), ",.;-'"))
    c = trim_edges(swap(c, "&", "and"))
    return squeeze_once(drop_chars(c, "()|/*"))


def address_spacing(c: Column | str) -> Column:
    return trim_edges(squeeze_once(swap(_col(c), ",,", ",")))


def city_punctuation(c: Column | str) -> Column:
    c = squeeze_once(drop_chars(_col(c), ",.;'"))
    c = trim_edges(drop_chars(c, "&"))
    return squeeze_once(drop_chars(c, "()|/*"))


def name_punctuation(c: Column | str) -> Column:
    c = trim_edges(swap(squeeze_once(_col(c)), "&", "and"))
    return squeeze_once(drop_chars(c, ";,.-'()|/*"))


def name_spacing(c: Column | str) -> Column:
    """Tidy separators, then end the name with one blank so that whole words can be told apart."""
    c = squeeze_once(_col(c))
    c = swap(swap(c, ", , ", ", "), ", , , ", ", ")
    return F.concat(trim_edges(c), F.lit(" "))


def fold(c: Column | str, rules: list[tuple[str, str]]) -> Column:
    """Apply (regular expression, replacement) pairs in order."""
    return reduce(lambda acc, rule: F.regexp_replace(acc, rule[0], rule[1]), rules, _col(c))


def fold_literals(c: Column | str, rules: list[tuple[str, str]]) -> Column:
    return reduce(lambda acc, rule: swap(acc, rule[0], rule[1]), rules, _col(c))


def gated(c: Column, test: Callable[[Column], Column], then: Callable[[Column], Column]) -> Column:
    """``then(c)`` where ``test(c)`` holds, else ``c``: many rules that seldom apply cost one search. ``c`` is mentioned
    once, so chains of such steps stay as long as they are."""
    return F.transform(F.array(c), lambda x: F.when(test(x), then(x)).otherwise(x))[0]


def holds(c: Column, parts: list[str]) -> Column:
    """Whether a text holds one of some literals; false, not null, on null text. Far cheaper than a regular expression."""
    return F.coalesce(reduce(lambda a, b: a | b, [c.contains(p) for p in parts]), F.lit(False))


def has_any(c: Column | str, pattern: str) -> Column:
    """Case-insensitive search that is false, not null, on null text."""
    return F.coalesce(_col(c).rlike("(?i)" + pattern), F.lit(False))
