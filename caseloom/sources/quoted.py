"""Delimited files with line breaks inside quotes, read by many tasks.

A file is read as lines, so that its parts go to different tasks, and a part does not know whether it
begins inside a quoted field. What a line does is therefore a function: where the text stands after
it, outside quotes or inside, for either way of entering it. Such functions compose, so a part sums
up to one of them, a prefix over the parts of a file says how each part is entered, and then every
line knows where it stands. Lines that are records by themselves are parsed as they are; only the
lines of longer records are brought together, across parts if need be.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from caseloom.sources import layout as L

QUOTE, DELIMITER = '"', ","
#: Encodings in which line breaks, quotes and commas are the bytes they are in ASCII; others need one task per file.
BYTE_ENCODINGS = frozenset({"UTF-8", "US-ASCII", "ISO-8859-1", "ISO-8859-15", "WINDOWS-1252"})
PART, AT = list(L.PART), L.PLACE[-1]
OVERFLOW = "_overflow"
RECORD = "_record"


def _after(line: Column, inside: int) -> Column:
    """1 if the text stands inside quotes after ``line``, 0 if not, when it is entered with ``inside``.

    A quote opens a field only as its first character, a doubled quote inside stays inside, and any other quote
    inside ends the quoting: what follows up to the delimiter is taken as it is. 2 is passed between the two
    quotes of a pair.
    """
    pieces = F.split(line, QUOTE)
    n = F.size(pieces) - 1

    def step(state: Column, i: Column) -> Column:
        before, following = F.element_at(pieces, i), F.element_at(pieces, i + 1)
        opens = before.endswith(DELIMITER) | ((i == 1) & (before == ""))
        paired = (following == "") & (i < n)
        return F.when(state == 2, F.lit(1)).when(state == 1, F.when(paired, F.lit(2)).otherwise(F.lit(0))).otherwise(opens.cast("int"))

    met = F.aggregate(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), F.lit(inside), step)
    return F.when(line.contains(QUOTE), met).otherwise(F.lit(inside))


def _lines(spark: SparkSession, path: str, encoding: str) -> DataFrame:
    """Lines with the part they lie in and their order inside it."""
    read = spark.read.option("lineSep", "\n").text(path).select(
        "value", F.col("_metadata.file_path").alias("_path"), F.col("_metadata.file_block_start").alias("_block"), F.monotonically_increasing_id().alias(AT))
    text = F.col("value") if encoding.upper() == "UTF-8" else F.decode(F.col("value").cast("binary"), encoding)
    return read.withColumn("value", F.regexp_replace(text, "\r$", ""))


def _flipped(state: Column, times: Column) -> Column:
    return F.when(times % 2 == 0, state).otherwise(1 - state)


def _placed(lines: DataFrame) -> DataFrame:
    """Lines with ``_in``, the state in which each is entered, and ``_out``, the state after it."""
    lines = lines.withColumns({"_t0": _after(F.col("value"), 0), "_t1": _after(F.col("value"), 1)})
    # a line sets the state, flips it or leaves it
    sets = F.when(F.col("_t0") == F.col("_t1"), F.col("_t0"))
    flips = ((F.col("_t0") == 1) & (F.col("_t1") == 0)).cast("int")
    own = Window.partitionBy(*PART).orderBy(AT)
    counted = lines.withColumn("_flips", F.sum(flips).over(own)).withColumn("_set", F.when(sets.isNotNull(), F.struct(sets.alias("to"), F.col("_flips").alias("flips"))))
    counted = counted.withColumn("_last", F.last("_set", ignorenulls=True).over(own.rowsBetween(Window.unboundedPreceding, -1)))

    parts = counted.groupBy(*PART).agg(F.max_by("_set", F.when(F.col("_set").isNotNull(), F.col(AT))).alias("_set"), F.max("_flips").alias("_all"))
    whole = F.when(F.col("_set").isNotNull(), F.struct(_flipped(F.col("_set.to"), F.col("_all") - F.col("_set.flips")).alias("to"), F.col("_sum").alias("sum")))
    order = Window.partitionBy("_path").orderBy("_block")
    entered = parts.withColumn("_sum", F.sum("_all").over(order)).withColumn("_whole", whole)
    entered = entered.withColumn("_was", F.last("_whole", ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, -1)))
    so_far = F.col("_sum") - F.col("_all")
    entry = _flipped(F.coalesce(F.col("_was.to"), F.lit(0)), so_far - F.coalesce(F.col("_was.sum"), F.lit(0)))
    entered = entered.select(*PART, entry.alias("_entry"))

    known = counted.join(entered, PART)
    before = F.col("_flips") - flips
    state = F.when(F.col("_last").isNotNull(), _flipped(F.col("_last.to"), before - F.col("_last.flips"))).otherwise(_flipped(F.col("_entry"), before))
    placed = known.withColumn("_in", state)
    return placed.select("value", *PART, AT, "_in", F.when(F.col("_in") == 1, F.col("_t1")).otherwise(F.col("_t0")).alias("_out"))


def _records(placed: DataFrame) -> DataFrame:
    """One row per record: its text, with the place of its first line."""
    alone = (F.col("_in") == 0) & (F.col("_out") == 0)
    single = placed.where(alone).select(*PART, AT, F.col("value").alias(RECORD))
    longer = placed.where(~alone)
    # a record's lines carry the place of its first line: the last one entered outside quotes, in this part or in one before
    first = F.when(F.col("_in") == 0, F.struct(F.col("_block").alias("block"), F.col(AT).alias("at")))
    own = Window.partitionBy(*PART).orderBy(AT)
    longer = longer.withColumn("_start", F.last(first, ignorenulls=True).over(own))
    last = longer.groupBy(*PART).agg(F.max("_start").alias("_start"))
    before = Window.partitionBy("_path").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    carried = last.select(*PART, F.last("_start", ignorenulls=True).over(before).alias("_carried"))
    longer = longer.join(carried, PART).withColumn("_start", F.coalesce("_start", "_carried"))
    lines = F.sort_array(F.collect_list(F.struct("_block", AT, "value")))
    joined = longer.groupBy("_path", "_start").agg(F.array_join(F.transform(lines, lambda x: x["value"]), "\n").alias(RECORD))
    return single.unionByName(joined.select("_path", F.col("_start.block").alias("_block"), F.col("_start.at").alias(AT), RECORD))


def read_records(spark: SparkSession, path: str, schema: T.StructType, encoding: str = "UTF-8") -> DataFrame:
    """Rows of quoted files with a header line each, and the place (``_path``, ``_block``, ``_at``) of every row: the part
    of the file it begins in and a number that grows inside the part without gaps.

    As with any other reading, records with too many fields go, short ones are padded, empty lines are passed
    over and carriage returns before a line break belong to the break. A quote that is never closed takes the
    rest of its file into one record. Files may be compressed; then each is one part.
    """
    if encoding.upper() not in BYTE_ENCODINGS:
        raise ValueError(f"{encoding} cannot be cut into lines before it is decoded")
    records = _records(_placed(_lines(spark, path, encoding))).where(F.col(RECORD) != "")
    heads = records.groupBy("_path").agg(F.min(F.struct("_block", AT)).alias("_head"))
    body = records.join(heads, "_path").where(F.struct("_block", AT) != F.col("_head"))
    wide = T.StructType([*schema.fields, T.StructField(OVERFLOW, T.StringType())])
    ddl = ", ".join(f"`{f.name.replace('`', '``')}` {f.dataType.simpleString()}" for f in wide.fields)
    parsed = body.withColumn("_fields", F.from_csv(RECORD, ddl, {"escape": QUOTE, "mode": "PERMISSIVE"}))
    kept = parsed.where(F.col(f"_fields.{OVERFLOW}").isNull())
    number = (F.row_number().over(Window.partitionBy(*PART).orderBy(AT)) - 1).cast("bigint")
    return kept.withColumn(AT, number).select(*[F.col("_fields")[f.name].alias(f.name) for f in schema.fields], *PART, AT)
