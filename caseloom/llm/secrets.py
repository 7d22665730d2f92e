"""Secret scans over a ledger of blobs, as column expressions only.

A blob is a text, addressed by its SHA-256; paths, here rows of a table, point to blobs. The
ledger holds what each version of the rules found in each blob. A run scans the blobs that
this version of the rules has not seen, once each however many paths have them, adds them to
the ledger, and joins the findings back to every path.
"""

from __future__ import annotations

import hashlib
import uuid
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from caseloom.llm.common import matches, without
from caseloom.session import checkpoint_dir

SPANS = "array<struct<start:int,rank:int,end:int,kind:string>>"


@dataclass(frozen=True)
class SecretRule:
    kind: str
    #: Java expression; places are those of the whole match.
    pattern: str
    #: The group whose length counts, 0 for the whole match, and the least length.
    group: int = 0
    least: int = 1
    base: bool = False


#: The first three as the contract fixes them, runs too short for their rule already left out where
#: that cannot move another match; the others are the method's own.
RULES = (
    SecretRule("assign", r"(?i)(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", 2, 12, base=True),
    SecretRule("access", r"AKIA[A-Z0-9]{14,}", base=True),
    SecretRule("hex", r"[0-9a-f]{16,}", base=True),
    SecretRule("private-key", r"-----BEGIN (?:RSA |DSA |EC |OPENSSH |ENCRYPTED |PGP )?PRIVATE KEY(?: BLOCK)?-----[A-Za-z0-9+/=\s:,.-]*?-----END [A-Z ]{0,30}-----"),
    SecretRule("code-host", r"(?<![0-9A-Za-z])(?:gh[pousr]_[0-9A-Za-z]{36,}|github_pat_[0-9A-Za-z_]{22,}|glpat-[0-9A-Za-z_-]{20,})"),
    SecretRule("chat", r"xox[abeoprs]-[0-9A-Za-z-]{10,}"),
    SecretRule("web-token", r"(?<![0-9A-Za-z_-])eyJ[0-9A-Za-z_-]{8,}\.[0-9A-Za-z_-]{8,}\.[0-9A-Za-z_-]{8,}"),
    SecretRule("cloud-key", r"(?<![0-9A-Za-z])AIza[0-9A-Za-z_-]{35}(?![0-9A-Za-z_-])"),
    SecretRule("payment", r"(?<![0-9A-Za-z])[rs]k_(?:live|test)_[0-9A-Za-z]{16,}"),
    SecretRule("url-login", r"(?i)(?<![a-z0-9])[a-z][a-z0-9+.-]{1,20}://[^\s/:@\"'<>]{1,64}:[^\s/@\"'<>]{3,128}@"),
)


def version_of(rules: tuple[SecretRule, ...]) -> str:
    """Names a set of rules: any change of a rule is a new version."""
    return hashlib.sha256(repr(rules).encode()).hexdigest()[:16]


def _spans(text: Column, rule: SecretRule, rank: int) -> Column:
    """Places of one rule's matches in code points; the work grows with the text and n log n of its matches."""
    long = F.filter(matches(text, F.lit(rule.pattern), rule.group), lambda x: x["size"] >= rule.least)
    return F.transform(long, lambda x: F.struct(
        x["start"].alias("start"), F.lit(rank).alias("rank"), x["end"].alias("end"), F.lit(rule.kind).alias("kind")))


def find_secrets(text: Column, rules: tuple[SecretRule, ...] = RULES) -> Column:
    """All spans of a text, by start, then by rule in order."""
    return F.array_sort(F.concat(*[_spans(text, r, i) for i, r in enumerate(rules)]))


def blob_id(text: str | Column) -> Column:
    """SHA-256 of the content; null counts as empty."""
    column = F.col(text) if isinstance(text, str) else text
    return F.sha2(F.coalesce(column.cast("string"), F.lit("")), 256)


def new_ledger(spark: SparkSession) -> str:
    """A place for a ledger that nothing else uses, in the shared checkpoint folder."""
    return f"{checkpoint_dir(spark).rstrip('/')}/ledger-{uuid.uuid4().hex}"


def read_ledger(spark: SparkSession, path: str, version: str) -> DataFrame | None:
    """Blobs and their spans under one version of the rules; None before the first run."""
    folder = f"{path.rstrip('/')}/rules={version}"
    where = spark._jvm.org.apache.hadoop.fs.Path(folder)
    if not where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where):
        return None
    return spark.read.schema(f"blob string, spans {SPANS}").parquet(folder)


def scan_ledger(versions: DataFrame, path: str, rules: tuple[SecretRule, ...] = RULES, text: str = "text") -> DataFrame:
    """Scans the blobs of a table that the ledger at ``path`` lacks, adds them, and returns the ledger's
    blobs and spans under these rules.

    Copies meet in each task before they are shuffled, so a blob that many rows hold moves a few
    times only. A run that is repeated after a failure scans what the last complete one left.
    """
    spark, version = versions.sparkSession, version_of(rules)
    blobs = versions.select(blob_id(text).alias("blob"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))
    known = read_ledger(spark, path, version)
    if known is not None:
        blobs = blobs.join(known.select("blob"), "blob", "left_anti")
    unseen = blobs.groupBy("blob").agg(F.first("text").alias("text"))
    unseen.select("blob", find_secrets(F.col("text"), rules).alias("spans")).write.mode("append").option("compression", "zstd").parquet(
        f"{path.rstrip('/')}/rules={version}")
    return read_ledger(spark, path, version)


def with_findings(docs: DataFrame, path: str, rules: tuple[SecretRule, ...] = RULES, text: str = "text") -> DataFrame:
    """The rows with ``spans`` (start, rank, end, kind; code points, end exclusive) of their blob.

    Null and empty texts are one blob without spans; repeated rows get the same spans. Input
    columns named ``spans`` or ``blob`` are replaced. Texts do not move: the ledger's narrow rows do,
    and a blob that many rows hold is split by Spark's skew handling.
    """
    docs = without(docs, "spans", "blob")
    found = scan_ledger(docs, path, rules, text).where(F.size("spans") > 0).dropDuplicates(["blob"])
    joined = docs.withColumn("blob", blob_id(text)).join(found, "blob", "left")
    return joined.withColumn("spans", F.coalesce("spans", F.array().cast(SPANS)))


def shown(spans: Column) -> Column:
    """Spans as kind:start:end, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
