"""Values that say a case is over."""

from __future__ import annotations

# fixed values: closing values per status column
_SETTLED = (
    "Dismissed   Claimant Withdrew", "Paid in Full   Post ODA", "Paid in Full   Pre-Hearing",
    "Settled   At Conference", "Settled   At hearing", "Settled   Pre-Conference",
    "Settled   Pre-hearing",
    "Settled   Post Hearing (Post Judgment, Prior to JEU referral)",
    "Settled   Post Hearing (Prior to ODA)",
    "Settled   Post Hearing (Post ODA, Prior to Judgment)", "Settled   Post Appeal",
    "Plaintiff rec d ODA", "Paid in Full   Post Judgment Entry",
)
_OTHER = (
    "Duplicate", "duplicate", "Duplicate Case", "Duplicate Claim", "ODA - Dft",
    "Outside settlement between parties", "Parties settled outside the office",
    "Payment remitted to Labor Commissioner because employer cannot locate employee",
    "Pd prior to PHC", "nothing owed still employed",
)
CLOSED: dict[str, tuple[str, ...]] = {
    "Note": ("Closed - Paid in Full (PIF)/Satisfied", "Full Satisfaction", "Vacated"),
    "Case Status": ("Closed-Claimant Judgment", "Closed - Satisfied", "Closed", *_SETTLED, *_OTHER),
    "Closure Disposition": _SETTLED,
    "Closure Disposition - Other Reason": _OTHER,
    "Reason For Closing": (
        "Plt settled w/Dft - SofJ", "conceded wages paid by employer. no claims by plaintiff",
        "duplicate", "Duplicate", "Duplicate case", "ODA - Pd", "ODA Pd",
        "Paid in full per settlement", "Paid in Full", "paid in full post judgment entry.",
        "parties settled", "Pd per ODA", "Pd", "Plaintiff withdrew claim", "Plt w/d clm",
        "Parties settled for an amount less on ODA",
    ),
}
