"""Delimited files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from caseloom.sources import layout as L
from caseloom.sources.quoted import BYTE_ENCODINGS, read_records

_OVERFLOW = "_overflow"


def header_of(spark: SparkSession, path: str, encoding: str = "UTF-8") -> list[str]:
    """Column names from the first line; reads that line only."""
    return spark.read.option("header", True).option("encoding", encoding).csv(path).columns


def read_delimited(spark: SparkSession, path: str, schema: T.StructType | None = None,
                   encoding: str = "UTF-8", rows: int | None = None, multi_line: bool = False) -> DataFrame:
    """Comma-separated text with a header; every column arrives as text unless a schema is given.

    Lines with too many fields are dropped and short lines are padded. A spare column catches the
    extra field, so lines are told apart without reading them twice; a line whose only extra field
    is empty loses nothing and stays. ``multi_line`` allows line breaks inside quotes, at the price
    of one task per file; ``read_placed`` reads the same rows without it.
    """
    if schema is None:
        schema = T.StructType([T.StructField(n, T.StringType()) for n in header_of(spark, path, encoding)])
    wide = T.StructType([*schema.fields, T.StructField(_OVERFLOW, T.StringType())])
    lines = (spark.read.schema(wide)
             .options(header=True, encoding=encoding, mode="PERMISSIVE", multiLine=multi_line, escape='"')
             .csv(path).where(F.col(_OVERFLOW).isNull()).drop(_OVERFLOW))
    return lines if rows is None else lines.limit(rows)


def read_plain(spark: SparkSession, path: str, rows: int | None = None) -> DataFrame:
    """UTF-8 text with a header and nothing else assumed."""
    return read_delimited(spark, path, rows=rows)


def placed(df: DataFrame) -> DataFrame:
    """Rows straight from files with the place of each: file, part of the file, number inside the part."""
    file, part, at = L.PLACE
    return df.select("*", F.col("_metadata.file_path").alias(file), F.col("_metadata.file_block_start").alias(part), F.monotonically_increasing_id().alias(at))


def number_placed(df: DataFrame, rank: int, name: str = L.ROW) -> DataFrame:
    """A numeric row order in the place of places: source rank, then path of the file, then place in the file.

    Spark deals files and parts of files out by size and number of cores. Rows are therefore
    counted per part, and the parts put in the order of the files: the numbers are the same
    however a run was split. The counts, one row per part, need the place columns alone.
    """
    part, at = list(L.PART), L.PLACE[-1]
    counts = df.groupBy(*part).agg(F.min(at).alias("_first"), F.count(F.lit(1)).alias("_n"))
    before = F.sum("_n").over(Window.orderBy(*part)) - F.col("_n")
    offsets = counts.select(*part, (before - F.col("_first")).alias("_shift"))
    numbered = df.join(F.broadcast(offsets), part)
    kept = [F.col(f"`{c}`") for c in df.columns if c not in L.PLACE]
    return numbered.select(*kept, (F.lit(rank).cast("long") * F.lit(1 << 58) + F.col(at) + F.col("_shift")).alias(name))


def with_row_number(df: DataFrame, rank: int, name: str = L.ROW) -> DataFrame:
    """``number_placed`` for rows straight from files, which are read twice; a landed copy with its places is not."""
    return number_placed(placed(df), rank, name)


def read_placed(spark: SparkSession, path: str, encoding: str = "UTF-8", multi_line: bool = False) -> DataFrame:
    """A source with the place of each row. Line breaks inside quotes cost no parallelism: one large file is read
    by many tasks either way, but for encodings whose line breaks are not single bytes."""
    schema = T.StructType([T.StructField(n, T.StringType()) for n in header_of(spark, path, encoding)])
    if multi_line and encoding.upper() in BYTE_ENCODINGS:
        return read_records(spark, path, schema, encoding)
    return placed(read_delimited(spark, path, schema, encoding, multi_line=multi_line))
