"""What marks public-works pay: closing terms, sections of law, public employers."""

from __future__ import annotations

# fixed values: terms in closing reasons
TERMS = ("misclassification", "prevailing", "fringe", "apprentice.*", "Public.*Contract.*",
         "Public.*Work.*")

# fixed values: public employers
PUBLIC_BODIES = (
    "City of.*", "City and County of.*", "County of.*", "City Depart.*", "County Depart.*",
    "School.*Dist.*", "High School", "Middle School", "Elementary School", "Charter School.*",
    "Charter Academ.*", "Community College", "Junior Collge", "City College", "College.*Dist.*",
    "University", "Library", "State of Cal.*", "Fire.*station.*", "Fire.*depart.*", "Sheriff.*",
    "Police", ".*Police.*Depart.*", "Water.*Dist.*", "Water District", "Municipal Water",
)

# fixed values: sections per code of law
SECTIONS: dict[str, tuple[str, ...]] = {
    "L.C.": (
        "223", "1720", "1720.2", "1720.3", "1720.4", "1720.5", "1720.6", "1720.7", "1721", "1722", "1722.1",
        "1723", "1724", "1725.5", "1726", "1727", "1728", "1729", "1730", "1734", "1735", "1736", "1740",
        "1741", "1741.1", "1742", "1742.1", "1743", "1750", "1770", "1771", "1771.1", "1771.2", "1771.3",
        "1771.4", "1771.5", "1771.6", "1771.7", "1772", "1773", "1773.1", "1773.2", "1773.3", "1773.4",
        "1773.5", "1773.6", "1773.7", "1773.8", "1773.9", "1773.11", "1774", "1775", "1776", "1777", "1777.1",
        "1777.5", "1777.6", "1777.7", "1778", "1779", "1780", "1781", "1782", "1784", "1810", "1811", "1812",
        "1813", "1814", "1815", "1860", "1861",
    ),
    "P.C.": (
        "4104", "6823", "6953", "10128", "20672", "20919.27",
    ),
    "P.R.C.": (
        "5366", "43501", "75075",
    ),
    "P.U.C.": (
        "399.13", "3354.1", "16461.5", "100152", "102284", "102288", "103396", "130242",
    ),
    "S.H.C.": (
        "670.1", "27189",
    ),
    "W.C.": ("8007",),
    "W.I.C.": ("1752.9",),
    "E.C.": (
        "17066", "81704",
    ),
    "F.G.C.": (
        "1350", "1501.5",
    ),
    "G.C.": (
        "5956.8", "14453", "14670.36", "14955", "14975", "14976", "54253", "63036", "91533",
    ),
    "H.S.C.": (
        "33425", "50675.4", "50746", "50749", "50766", "50898.2", "50953", "125290.65",
    ),
}

# fixed values: industries in which these marks count, and the label for federal findings
INDUSTRIES = ("Construction", "Utilities")
FEDERAL_CODE = "DBRA"


def any_of(terms: tuple[str, ...]) -> str:
    return "(?:" + "|".join(terms) + ")"


def section_pattern() -> str:
    """Each section in three spellings: "L.C. 1771", "LC 1771" and "section 1771".

    One alternative per code of law, so a text is scanned for a dozen openings rather than
    for several hundred strings. A full stop matches any character.
    """
    parts, every = [], []
    for code, listed in SECTIONS.items():
        every += listed
        parts.append(f"(?:{code}|{code.replace('.', '')}) (?:{'|'.join(listed)})")
    return f"(?:section (?:{'|'.join(every)})|{'|'.join(parts)})"
