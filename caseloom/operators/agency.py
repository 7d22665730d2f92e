"""Which agency a case belongs to."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from caseloom.functions.text import swap
from caseloom.rules.agency import AGENCY, COLUMN_CODES, LABEL_CODES


def infer_agency(df: DataFrame, label: str = "juris_or_proj_nm", case_id: str = "case_id_1") -> DataFrame:
    """A missing label is the part of the case id before its first hyphen, else its first three
    characters; a label that contains an office code becomes the agency."""
    head = F.when(F.col(case_id).contains("-"), F.substring_index(case_id, "-", 1)).otherwise(F.substring(case_id, 1, 3))
    filled = F.coalesce(F.col(label), head)
    return df.withColumn(label, F.when(filled.rlike("|".join(LABEL_CODES)), AGENCY).otherwise(filled))


def replace_codes(c: Column | str) -> Column:
    """Office codes inside a text become the agency, one code after the other."""
    return reduce(lambda acc, code: swap(acc, code, AGENCY), COLUMN_CODES, F.col(c) if isinstance(c, str) else c)
