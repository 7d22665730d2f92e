"""Which files belong to which agency."""

from __future__ import annotations

from dataclasses import dataclass, replace

# fixed values: source tags in reading order, the switch each one hangs on, and its encoding
_KNOWN = (
    ("TEST", "test", "UTF-8"),
    ("DOL_WHD", "federal", "ISO-8859-1"),
    ("DIR_DLSE", "state_cases", "ISO-8859-1"),
    ("DLSE_WageClaim", "state_cases", "UTF-8"),
    ("DLSE_J-23", "state_judgements", "UTF-8"),
    ("DLSE_J-5413", "state_judgements", "UTF-8"),
)


@dataclass(frozen=True)
class SourceSpec:
    tag: str
    path: str
    include: bool = True
    encoding: str = "UTF-8"
    rank: int = 0
    #: line breaks inside quotes, as free text has them; costs the landing two shuffles, no parallelism
    multi_line: bool = True


def build_registry(paths: dict[str, str], federal: bool = True, state_cases: bool = True,
                   state_judgements: bool = True, test: bool = False, multi_line: bool = True) -> list[SourceSpec]:
    """Sources with a path, each switched on or off; test mode reads the test source alone."""
    on = {"test": test, "federal": federal and not test, "state_cases": state_cases and not test,
          "state_judgements": state_judgements and not test}
    return [SourceSpec(tag, paths[tag], on[switch], encoding, rank, multi_line)
            for rank, (tag, switch, encoding) in enumerate(_KNOWN) if tag in paths]


def tags_off(federal: bool, state_cases: bool, state_judgements: bool) -> list[str]:
    """Tags of the sources whose switch is off."""
    on = {"federal": federal, "state_cases": state_cases, "state_judgements": state_judgements, "test": True}
    return [tag for tag, switch, _ in _KNOWN if not on[switch]]


def switched_off(specs: list[SourceSpec]) -> list[str]:
    return [s.tag for s in specs if not s.include]


def only(specs: list[SourceSpec], tag: str) -> list[SourceSpec]:
    return [replace(s, include=s.tag == tag) for s in specs]
