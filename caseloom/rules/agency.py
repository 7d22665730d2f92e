"""Agency codes inside case numbers and labels."""

from __future__ import annotations

AGENCY = "DLSE"

# fixed values: office codes that name the agency when found in a label
LABEL_CODES = ("01", "04", "05", "06", "07", "08", "09", "10", "11", "12", "13", "14", "15",
               "16", "17", "18", "23", "32", "35", "WC")

# fixed values: office codes replaced inside a column, in this order (01 to 25, then two more)
COLUMN_CODES = (*[f"{n:02d}" for n in range(1, 26)], "35", "WC")
