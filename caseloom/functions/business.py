"""Legal form and home of liability, moved out of the names into columns of their own."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from caseloom.functions import text as T
from caseloom.functions.blanks import any_of
from caseloom.rules.names import FORMS, HOMES, FormRule

_SPECIAL = set(".^$*+?{}[]\\|()")


def quote(phrase: str) -> str:
    """A phrase as a regular expression that matches just itself."""
    return "".join("\\" + ch if ch in _SPECIAL else ch for ch in phrase)


def whole_words(phrases: tuple[str, ...]) -> str:
    """One alternation between word boundaries, longest phrase first, so that a phrase wins over
    its own parts. A look at the first letter and the leading boundary stand outside, the cheaper one
    first: at another letter, or within a word, no phrase is even tried."""
    ordered = sorted((p.strip() for p in phrases), key=lambda p: (-len(p), p))
    first = "".join(sorted({p[0].lower() for p in ordered}))
    return rf"(?=[{first}])\b(?:" + "|".join(quote(p) + (r"\b" if p[-1].isalnum() else "") for p in ordered) + ")"


def _needed(patterns: tuple[str, ...], loose: bool) -> tuple[str, ...]:
    """The patterns a search for any of them has to try: one whose text contains another's match is found by that one."""
    def implied(p: str, q: str) -> bool:
        if loose:  # expressions: only a plain text says what it contains, and only a plain one or one with full stops is looked for
            return not set(p) & _SPECIAL and not set(q) & (_SPECIAL - {"."}) and bool(re.search(q, p, re.I))
        return bool(re.search(rf"\b{re.escape(q)}" + (r"\b" if q[-1].isalnum() else ""), p, re.I))

    kept: list[str] = []
    for p in sorted(dict.fromkeys(patterns if loose else (x.strip() for x in patterns)), key=lambda x: (len(x), x)):
        if not any(implied(p, q) for q in kept):
            kept.append(p)
    return tuple(kept)


def _search(patterns: tuple[str, ...], loose: bool) -> str:
    """Finds whether any of the patterns is there, not which: no longer than it has to be, and tried at their first letters alone."""
    if not loose:
        return whole_words(_needed(patterns, False))
    needed = _needed(patterns, True)
    first = sorted({p.removeprefix(r"\b")[0].lower() for p in needed})
    guard = f"(?=[{''.join(first)}])" if all(letter.isalnum() for letter in first) else ""
    return guard + "(?:" + "|".join(needed) + ")"


def marked(c: Column, rule: FormRule, loose: bool) -> Column:
    return T.has_any(c, _search(rule.marks, loose))


def stripped(c: Column, rule: FormRule, loose: bool) -> Column:
    if not loose:
        return F.regexp_replace(c, "(?i)" + whole_words(rule.removed), "")
    removed = rule.loose_removed or rule.removed
    done = T.fold(c, [("(?i)" + p, "") for p in removed])
    # many patterns that seldom apply: one search decides whether they are run
    return F.when(T.has_any(c, rule.stem or _search(removed, True)), done).otherwise(c)


def _core(pattern: str, loose: bool) -> str:
    """The longest literal that stands in whatever the pattern matches, in small letters."""
    text = pattern.strip() if not loose else pattern.replace(r"\.", "\0").replace(r"\b", "\n").replace("$", "\n").replace(".", "\n").replace("\0", ".")
    return max(text.lower().split("\n"), key=len)


def _may_have(c: Column, rules: tuple[FormRule, ...], loose: bool) -> Column:
    """False where no phrase of the rules can be: then nothing marks the name and nothing is taken out. Literals are looked
    for; where a pattern has none to speak of, the patterns are."""
    needed = _needed(tuple(p for r in rules for p in (*r.marks, *((loose and r.loose_removed) or r.removed))), loose)
    cores = [_core(p, loose) for p in needed]
    vague = tuple(p for p, core in zip(needed, cores) if len(core) < 2)
    told = sorted({core for core in cores if len(core) > 1}, key=len)
    told = [core for i, core in enumerate(told) if not any(other in core for other in told[:i])]
    found = T.holds(F.lower(c), told)
    return found | T.has_any(c, _search(vague, loose)) if vague else found


def business_type(df: DataFrame, names: list[str], target: str = "Businesstype",
                  loose: bool = False) -> DataFrame:
    """A later form overwrites an earlier one: corporation, partnership, company, individual.

    Forms are taken in order, each reading the names the one before it has left. A name's
    expression mentions the name before it once, so a filter that Spark moves below the
    cleaning stays as long as the chain and does not double at every form. Expressions are only
    tried on names that hold a literal of the form's phrases.
    """
    if target not in df.columns:
        df = df.withColumn(target, F.lit(""))
    columns = df.columns
    may = {n: f"_may_{i}" for i, n in enumerate(names)}
    for rule in FORMS:
        df = df.withColumns({m: _may_have(F.col(n), (rule,), loose) for n, m in may.items()})
        hit = any_of([F.col(may[n]) & marked(F.col(n), rule, loose) for n in names])
        df = df.withColumns({
            target: F.when(hit, rule.label).otherwise(F.col(target)),
            **{n: T.gated(F.col(n), lambda x, m=may[n]: F.col(m), lambda x, r=rule: stripped(x, r, loose)) for n in names},
        })
    return df.select(*[f"`{c}`" for c in columns])


def liability_home(df: DataFrame, names: list[str], target: str = "Liabilitytype",
                   loose: bool = False) -> DataFrame:
    """Where a company is liable. The phrases cannot overlap, so one search finds whether there is
    any, the last home that is marked wins, and one replacement takes all of them out."""
    def hit(rules: tuple[FormRule, ...]) -> Column:
        every = FormRule("", tuple(m for r in rules for m in r.marks), ())
        return any_of([_may_have(F.col(n), (every,), loose) & marked(F.col(n), every, loose) for n in names])

    home = F.coalesce(*[F.when(hit((r,)), r.label) for r in reversed(HOMES)])
    phrases = FormRule("", (), tuple(dict.fromkeys(p for r in HOMES for p in r.removed)))
    pattern = "(?=[a])(?:" + "|".join(phrases.removed) + ")" if loose else whole_words(phrases.removed)
    return df.withColumns({
        target: F.when(hit(HOMES), home).otherwise(""),
        **{n: T.gated(F.col(n), lambda x: _may_have(x, (phrases,), loose), lambda x: F.regexp_replace(x, "(?i)" + pattern, "")) for n in names},
    })


def clean_names(df: DataFrame, names: list[str], loose: bool = False) -> DataFrame:
    """Punctuation, spacing, legal forms, liability home, and punctuation once more."""
    df = df.withColumns({n: T.name_spacing(T.name_punctuation(n)) for n in names})
    df = liability_home(business_type(df, names, loose=loose), names, loose=loose)
    return df.withColumns({n: T.name_punctuation(n) for n in names})
