"""Address vocabulary."""

from __future__ import annotations

# fixed values: street words by abbreviation
STREET_WORDS = {
    "CT": "Court",
    "WY": "Way",
    "CTR": "Center",
    "AVE": "Avenue",
    "ST": "Street",
    "DR": "Drive",
    "RD": "Road",
    "LN": "Lane",
    "PLZ": "Plaza",
}
# fixed values: long words that are shortened
SHORTENED = {"Boulevard": "Blvd.", "Expressway": "Expy.", "Building": "Bldg."}
# fixed values: words for part of a building
SUITE_WORDS = ("STE", "Ste", "APT", "Apt")
# fixed values: compass letters, in the order they are tried
COMPASS = {"S": "South", "W": "West", "E": "East", "N": "North"}
# fixed values: ordinals that are spelled out
ORDINALS = {"1ST": "First", "2ND": "Second", "3RD": "Third", "4TH": "Fourth", "5TH": "Fifth"}


def _spellings(short: str) -> str:
    """Capitals and mixed case, save for PLZ which is only known in capitals."""
    if short == "PLZ":
        return short
    mixed = short.capitalize()
    # a bare ST would also end EAST, so in capitals it has to follow a blank
    return rf"(?:(?<= )ST|{mixed})" if short == "ST" else f"(?:{short}|{mixed})"


def street_rules(whole_words: bool) -> list[tuple[str, str]]:
    """(pattern, replacement) pairs; a full stop or comma is swallowed, a blank is kept. The first letter is looked at
    before anything else."""
    edge = r"\b" if whole_words else ""
    ending = r"(?:[.,]|(?= ))"
    rules = [(f"(?={short[0]})" + edge + _spellings(short) + ending, word) for short, word in STREET_WORDS.items()]
    rules.append((f"(?=[SA]){edge}(?:{'|'.join(SUITE_WORDS)})" + r"(?:\.|(?= ))", "Suite"))
    rules.append((f"(?=U){edge}Unit" + (r"\b" if whole_words else ""), "Suite"))
    return rules


def street_parts() -> list[list[str]]:
    """For each of the street rules the literals of which its pattern needs one."""
    return [*[[short] if short == "PLZ" else [short, short.capitalize()] for short in STREET_WORDS], list(SUITE_WORDS), ["Unit"]]


# fixed values: marks for a number within a building
NUMBER_MARKS = [("# ", "Suite "), ("#", "Suite ")]


def dotted_compass() -> list[tuple[str, str]]:
    return [(f"{letter}. ", f"{word} ") for letter, word in COMPASS.items()]


def lone_compass() -> list[tuple[str, str]]:
    return [(f" {letter} ", f" {word} ") for letter, word in COMPASS.items()]


def ordinal_rules(whole_words: bool) -> list[tuple[str, str]]:
    edge = r"\b" if whole_words else ""
    return [(f"(?i)(?={short[0]}){edge}{short} ", f"{word} ") for short, word in ORDINALS.items()]
