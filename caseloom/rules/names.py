"""Legal-form vocabulary: what marks a form, and what is then taken out of the name."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class FormRule:
    """``marks`` set the label; ``removed`` are deleted from both names.

    In the loose reading the entries are regular expressions tried in the order given, so a
    full stop stands for any character and a match may start inside a word. In the whole-word
    reading they are phrases. Every removed entry contains the ``stem``, if one is given.
    """

    label: str
    marks: tuple[str, ...]
    removed: tuple[str, ...]
    loose_removed: tuple[str, ...] | None = None
    stem: str = ""


# fixed values: corporations
CORPORATION = FormRule(
    "Corporation",
    marks=("inc.", "corporation", "corp.", "corp", "inc", "a corporation", "Incorporated",
           "non-profit corporation", "nonprofit", "non-profit"),
    removed=("a corporation", "non-profit corporation", "corporation", "incorporated",
             "corp.", "corp", "inc.", "inc", "nonprofit", "non-profit"),
    loose_removed=("a corporation", "Corporation", "Incorporated", "Corp ", "Inc ", "Inc.", "inc",
                   "Corp.", "non-profit corporation", "nonprofit", "non-profit"),
)

# fixed values: partnerships; longer phrases stand before the phrases they contain
PARTNERSHIP = FormRule(
    "Partnership",
    marks=("as partners", "LLP", "individually & jointly", "both individually & as partners",
           "individually and as partners", "both individually and as partners",
           "both individually and jointly liable"),
    removed=("both jointly and severally as employers", "jointly and severally as employers",
             "each individually and as partners", "both individually and as partners",
             "individually and as partners", "each individually and jointly liable",
             "both individually and jointly liable", "individually and jointly liable",
             "each individually and jointly", "both individually and jointly",
             "individually and jointly", "each jointly and severally",
             "both jointly and severally", "jointly and severally",
             "each severally and as joint employers", "each severally and as joint employ",
             "both severally and as joint employers", "severally and as joint employers",
             "each severally and as joint", "severally and as joint", "a general partnership",
             "general partnership", "a limited partnership", "limited partnership",
             "a partnership", "partnership", "each severally and as"),
    stem="(?:partner|joint|several)",
)

# fixed values: limited-liability companies
COMPANY = FormRule(
    "Company",
    marks=("LLC", "L.L.C.", "company", "Comapany", "a limited liability company",
           "a limited liability", "Co.", "Limited Liability", "Limited Liability Comapany",
           "Limited Liability Company"),
    removed=("L.L.C.", "LLC", "a limited liability company", "limited liability company",
             "a limited liability comapany", "limited liability comapany",
             "a limited liability", "limited liability", "company", "comapany", "Co.", "Co"),
    loose_removed=(r"\bLLC$", r"\bL.L.C.$", "L.L.C., ", "LLC, ", "L.L.C. ", "LLC ", "company",
                   "comapany", "a limited liability", "limited liability", r"\bCo$", r"Co\. ",
                   "Co ", "CO "),
)

# fixed values: individuals
INDIVIDUAL = FormRule(
    "Individual",
    marks=("an individual", "individual "),
    removed=("an individual", "individual "),
)

FORMS = (CORPORATION, PARTNERSHIP, COMPANY, INDIVIDUAL)

# fixed values: homes of liability; the last one keeps its phrase in the name
HOMES = (
    FormRule("California", ("a California", "a Californi", "a Californ"),
             ("a California", "a Californi")),
    FormRule("Delaware", ("a Delaware",), ("a Delaware",)),
    FormRule("Nevada", ("a Nevada",), ("a Nevada",)),
    FormRule("Nebraska", ("a Nebraska",), ("a Nebraska",)),
    FormRule("Foreign", ("a foreign",), ("a foreign",)),
    FormRule("California", ("Which Will Be Doing Business In California",
                            "Which Will Be Doing Business In California As"), ("a foreign",)),
)
