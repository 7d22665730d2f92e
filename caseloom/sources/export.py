"""Report tables as delimited files."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BOM = "﻿"


def write_csv(df: DataFrame, path: str, bom: bool = True) -> None:
    """One folder of parts, each with a header. The mark that spreadsheet programs look for
    travels in the first header, because a part file starts with it."""
    if bom and df.columns:
        first = df.columns[0]
        df = df.select(F.col(f"`{first}`").alias(BOM + first), *[F.col(f"`{c}`") for c in df.columns[1:]])
    df.write.mode("overwrite").options(header=True, encoding="UTF-8", escape='"').csv(path)
