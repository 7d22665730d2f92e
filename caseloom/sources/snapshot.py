"""Dated snapshots of the cleaned case table.

Each refresh writes folders of its own, one per source it renews, and registers them when the write has
succeeded, so a failed or half-done refresh is never read. What the registry has of a run is its manifest:
for each source the files it was made from, when, and where its rows lie, which may be a folder that an earlier
run wrote. The newest registered snapshot is current.
"""

from __future__ import annotations

import hashlib
import json
import time
import uuid
from dataclasses import dataclass
from datetime import date, timedelta
from itertools import groupby

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from caseloom.sources import layout as L
from caseloom.sources.harmonise import stack

# fixed value: days a snapshot stays fresh
MAX_AGE_DAYS = 30

CASES_BY = ("shared", "st_cd", "industry", "start_year")
ROWS_PER_FILE = 5_000_000
REGISTRY = ("taken_on date, cases string, raw string, run string, place int, tag string, fingerprint string, source_taken_on date, "
            "source_cases string, source_raw string, columns string, source_rolled string, rolled_columns string")
# what is rolled up with the snapshot: cases that one source alone reports, per source, state and year
ROLLED_BY = (L.SOURCE, "st_cd", "start_year")


@dataclass(frozen=True)
class SourceState:
    """One source in a snapshot: what its rows were made from and on which day, their folders and their schema."""

    tag: str
    fingerprint: str
    taken_on: date
    cases: str
    raw: str
    columns: str
    rolled: str = ""
    rolled_columns: str = ""

    def read(self, spark: SparkSession) -> DataFrame:
        return spark.read.schema(T.StructType.fromJson(json.loads(self.columns))).parquet(self.cases)

    def read_rolled(self, spark: SparkSession) -> DataFrame:
        return spark.read.schema(T.StructType.fromJson(json.loads(self.rolled_columns))).parquet(self.rolled)


@dataclass(frozen=True)
class Snapshot:
    """``cases`` and ``raw`` are the folders of the run, ``sources`` where the rows lie, in reading order."""

    taken_on: date
    cases: str
    raw: str | None = None
    sources: tuple[SourceState, ...] = ()


def new_run(taken_on: date) -> str:
    """A folder name no other run has; names of one day sort by time."""
    return f"{taken_on.isoformat()}-{time.time_ns():020d}-{uuid.uuid4().hex[:8]}"


def write_rows(df: DataFrame, path: str) -> DataFrame:
    """Write a folder that does not exist yet, and read it back."""
    df.write.mode("error").option("maxRecordsPerFile", ROWS_PER_FILE).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def write_partitioned(df: DataFrame, path: str, by: tuple[str, ...]) -> None:
    """Write a folder that does not exist yet.

    The rebalance hint gathers each partition's rows into full files and, unlike a
    repartition on the partition columns, splits a partition that outgrows one task.
    """
    (df.hint("rebalance", *by).write.mode("error").option("maxRecordsPerFile", ROWS_PER_FILE)
     .partitionBy(*by).parquet(path))


def with_start_year(df: DataFrame) -> DataFrame:
    return df.withColumn("start_year", F.coalesce(F.year("findings_start_date"), F.year("findings_end_date"), F.lit(0)))


def fingerprint(spark: SparkSession, path: str, settings: str = "") -> str:
    """What a source's rows depend on: names, lengths and dates of its files, and the settings they are cleaned with.
    The files are listed, not read."""
    files = spark.read.format("binaryFile").load(path).select("path", "length", "modificationTime")
    seen = files.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("length"), F.lit(0)).alias("size"),
                     F.coalesce(F.sum(F.xxhash64("path", "length", "modificationTime").cast("decimal(38,0)")), F.lit(0)).alias("hash")).first()
    return f"{seen.n}-{seen.size}-{seen.hash}-{hashlib.sha256(settings.encode()).hexdigest()[:16]}"


def register(spark: SparkSession, root: str, snapshot: Snapshot, run: str) -> None:
    rows = [(snapshot.taken_on, snapshot.cases, snapshot.raw, run, i, s.tag, s.fingerprint, s.taken_on, s.cases, s.raw, s.columns, s.rolled, s.rolled_columns)
            for i, s in enumerate(snapshot.sources)]
    spark.createDataFrame(rows, REGISTRY).coalesce(1).write.mode("append").parquet(f"{root}/registry")


def registered(spark: SparkSession, root: str) -> list[Snapshot]:
    """All snapshots, newest first, a later run of one day before an earlier one."""
    try:
        rows = spark.read.schema(REGISTRY).parquet(f"{root}/registry").where("tag is not null").orderBy(F.desc("taken_on"), F.desc("run"), "place").collect()
    except AnalysisException:
        return []
    return [Snapshot(own[0].taken_on, own[0].cases, own[0].raw,
                     tuple(SourceState(r.tag, r.fingerprint, r.source_taken_on, r.source_cases, r.source_raw, r.columns, r.source_rolled, r.rolled_columns) for r in own))
            for own in (list(rows_of) for _, rows_of in groupby(rows, key=lambda r: r.run))]


def latest(spark: SparkSession, root: str) -> Snapshot | None:
    return next(iter(registered(spark, root)), None)


def remove(spark: SparkSession, folders: list[str]) -> None:
    for folder in folders:
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def expire(spark: SparkSession, root: str, keep: int = 2) -> None:
    """Folders of all but the newest snapshots go, one before the current being kept for readers under way; folders
    that a kept snapshot has carried over stay."""
    known = registered(spark, root)
    used = {f for s in known[:max(keep, 1)] for state in s.sources for f in (state.cases, state.raw, state.rolled)}
    for old in known[max(keep, 1):]:
        remove(spark, [f for state in old.sources for f in (state.cases, state.raw, state.rolled) if f and f not in used])
        remove(spark, [f for f in (old.cases, old.raw) if f and not any(u.startswith(f"{f}/") for u in used)])


def is_stale(snapshot: Snapshot | None, as_of: date, max_age_days: int = MAX_AGE_DAYS, force: bool = False) -> bool:
    return force or snapshot is None or as_of - snapshot.taken_on > timedelta(days=max_age_days)


def read_cases(spark: SparkSession, root: str, off: list[str] | None = None) -> DataFrame:
    """Current cases. Predicates on state, industry and start year prune folders, which stands
    in for a second, reduced copy."""
    current = latest(spark, root)
    if current is None:
        raise FileNotFoundError(f"no snapshot is registered under {root}")
    cases = stack([state.read(spark) for state in current.sources])
    return cases.where(~F.col(L.SOURCE).isin(*off)) if off else cases


def read_rollup(spark: SparkSession, root: str, off: list[str] | None = None) -> DataFrame:
    """The roll-ups of the current snapshot, for ``build_report``."""
    current = latest(spark, root)
    if current is None:
        raise FileNotFoundError(f"no snapshot is registered under {root}")
    rolled = stack([state.read_rolled(spark) for state in current.sources])
    return rolled.where(~F.col(L.SOURCE).isin(*off)) if off else rolled


def reduced(cases: DataFrame, as_of: date, state: str = "CA", industry: str = "Construction",
            years: int = 9) -> DataFrame:
    """The recent slice most reports ask for, by partition columns and date."""
    first = as_of - timedelta(days=years * 365)
    return cases.where((F.col("st_cd").isin(state, "") | F.col("st_cd").isNull()) & (F.col("industry") == industry)
                       & ((F.col("start_year") >= first.year) | (F.col("start_year") == 0))
                       & (F.coalesce("findings_start_date", "findings_end_date").isNull()
                          | F.coalesce("findings_start_date", "findings_end_date").between(F.lit(first), F.lit(as_of))))
