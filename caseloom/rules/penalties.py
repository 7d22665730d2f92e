"""Penalty per kind of violation. ``None`` stands for the mean back wage."""

from __future__ import annotations

# fixed values: (term, amount); a later match wins
PENALTIES: tuple[tuple[str, float | None], ...] = (
    ("ACCESS TO PAYROLL", 750), ("L.C. 1021", 200), ("L.C. 11942", None), ("L.C. 1197", None),
    ("L.C. 1299", 500), ("L.C. 1391", 500), ("L.C. 203", 3600), ("L.C. 2054", None),
    ("L.C. 2060", None), ("L.C. 223", None), ("L.C. 226(a)", 250), ("LCS 226(a)", 250),
    ("L.C. 2267", 150), ("L.C. 2675(a)", 250), ("L.C. 3700", 500), ("L.C. 510", 200),
    ("LIQUIDATED DAMAGES", None), ("MEAL PERIOD PREMIUM WAGES", 75), ("MINIMUM WAGES", 50),
    ("Misclassification", None), ("Overtime", None), ("PAID SICK LEAVE", 200),
    ("PIECE RATE WAGES", 1200), ("PRODUCTION BONUS", None), ("REGULAR WAGES", None),
    ("REPORTING TIME PAY", 1000), ("REST PERIOD PREMIUM WAGES", 2000), ("VACATION WAGES", 2000),
    ("SPLIT SHIFT PREMIUM WAGES", 500), ("UNLAWFUL DEDUCTIONS", 2000),
    ("UNLAWFUL TIP DEDUCTIONS", 1000), ("UNREIMBURSED BUSINESS EXPENSES", 2500),
    ("WAITING TIME PENALTIES", 2500), ("LC 1771", 125), ("L.C. 1771", 125), ("L.C. 1774", 125),
    ("LC 1774", 125),
)

# fixed values: amounts per column for a text no term fits
UNMATCHED = (26.30, 33.49, 50.24, 50.24)

# fixed values: highest mean taken at face value, the mean used otherwise, penalty share of it
MEAN_CEILING = 4000
MEAN_PLUG = 3368
PENALTY_SHARE = 0.125
