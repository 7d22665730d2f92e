"""Session settings and the one place that decides where lineage may be cut."""

from __future__ import annotations

import re

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession

CHECKPOINT_DIR = "spark.checkpoint.dir"

SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    # let a coalesced shuffle keep its tasks busy rather than fewer and larger
    "spark.sql.adaptive.coalescePartitions.parallelismFirst": "false",
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "128MB",
    "spark.sql.files.maxPartitionBytes": "128MB",
    "spark.sql.parquet.compression.codec": "zstd",
    "spark.sql.sources.partitionOverwriteMode": "dynamic",
}


def build_session(app: str = "caseloom", master: str | None = None, **extra: str) -> SparkSession:
    """A session with the settings the operators were planned for.

    ``extra`` takes further settings with ``__`` for dots, for example
    ``spark__sql__shuffle__partitions="8"``.
    """
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in SETTINGS.items():
        builder = builder.config(key, value)
    for key, value in extra.items():
        builder = builder.config(key.replace("__", "."), value)
    return builder.getOrCreate()


def checkpoint_dir(spark: SparkSession) -> str:
    """The folder all executors share for tables that cut lineage.

    ``spark.checkpoint.dir`` as the session has it, else the folder set on the context, else one inside the
    warehouse if that is shared. A local session shares its disk with itself; on a cluster a warehouse on local disks
    is refused, where every executor would write to a disk of its own.
    """
    given = spark.conf.get(CHECKPOINT_DIR, None) or spark.sparkContext.getCheckpointDir()
    if given:
        return given
    warehouse = spark.conf.get("spark.sql.warehouse.dir")
    return fallback_dir(warehouse, spark.sparkContext.master)


def fallback_dir(warehouse: str, master: str) -> str:
    scheme = warehouse.split(":", 1)[0] if ":" in warehouse else "file"
    if scheme == "file" and not re.match(r"local(\[.*\])?$", master):
        raise ValueError(f"set {CHECKPOINT_DIR} to a folder that all executors share; {warehouse} is on local disks")
    return f"{warehouse.rstrip('/')}/_checkpoints"


def materialise(df: DataFrame, reliable: bool = False) -> DataFrame:
    """Keep a table that many outputs read.

    The default persists with spill to disk: a lost executor costs a recomputation from
    the snapshot. ``reliable`` cuts the lineage with a checkpoint in the shared folder.
    """
    if not reliable:
        return df.persist(StorageLevel.MEMORY_AND_DISK)
    spark = df.sparkSession
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(checkpoint_dir(spark))
    return df.checkpoint(eager=False)
