"""Hard negatives of embeddings, scored exactly by Kronecker-packed integer products.

Components become whole numbers. The candidates of a block are packed dimension by dimension: each
one's component, biased so that it is not negative, stands in a field of its own of one wide integer.
Multiplying that integer by the anchor's component scores the whole block in one product per
dimension; the sum over dimensions, biased once more so that no field borrows from the next, is cut
back into fields, and taking the biases off gives the exact inner products. The field's width
follows from the largest numbers in the block and among the anchors, so no carry can cross it.

Anchors are a query set that meets all rows. They are numbered by prefix sums and taken in chunks of a
fixed size, each broadcast; for each chunk the rows are scanned twice, where they lie: once against
the anchors of their own label for positives, once against the others for the negatives that fit a
positive's band. A task hands on a few rows per anchor. No row is dropped or sampled to save work.
"""

from __future__ import annotations

import uuid
from bisect import insort
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from operator import mul

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from caseloom.llm.common import settle
from caseloom.llm.whitening import whole_numbers
from caseloom.session import checkpoint_dir

SCALE = 256
POSITIVES = 5
NEGATIVES = 3
#: Percent of a positive's score between which a negative's lies.
BAND = (50, 95)
#: Anchors broadcast at once.
CHUNK = 4096
#: Candidates packed into one wide integer.
PACKED = 2048

FOUND = "anchor int, wanted decimal(38,0), score decimal(38,0), vec_id bigint, row bigint"
RESULT = ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]


def prepare(rows: DataFrame, vector: str = "embedding", label: str | Column = "label", scale: int = SCALE) -> DataFrame:
    """(row, vec_id, label, x) of the rows that take part, written to the shared folder.

    Out are rows with a null label, a null vector or a component that is null, not finite or beyond 64
    bits, and vectors of another length than most (of equally frequent lengths the greater counts).
    ``row`` tells repeated rows apart.
    """
    label = F.col(label) if isinstance(label, str) else label
    numbers = rows.select(F.col("vec_id").cast("bigint").alias("vec_id"), label.cast("bigint").alias("label"), whole_numbers(vector, scale, 0).alias("x"))
    whole = settle(numbers.where("x is not null and label is not null").withColumn("row", F.monotonically_increasing_id()), "vectors")
    lengths = whole.groupBy(F.size("x").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).limit(1).collect()
    return whole.where(F.size("x") == lengths[0].d) if lengths else whole


def numbered(anchors: DataFrame) -> DataFrame:
    """Anchors with ``place``, 0 to n - 1: their number inside a task plus the totals of the tasks before."""
    own = settle(anchors.withColumn("_n", F.monotonically_increasing_id()), "anchors")
    task, place = F.shiftright("_n", 33), F.col("_n").bitwiseAND((1 << 33) - 1)
    # one row per task
    totals = own.groupBy(task.alias("_task")).agg(F.count("*").alias("n"))
    before = totals.select("_task", (F.sum("n").over(Window.orderBy("_task")) - F.col("n")).alias("_before"))
    return own.withColumn("_task", task).join(F.broadcast(before), "_task").withColumn("place", F.col("_before") + place).drop("_n", "_task", "_before")


@dataclass
class Block:
    """Candidates in the order of their labels, packed into one wide integer per dimension."""

    ids: np.ndarray
    rows: np.ndarray
    labels: np.ndarray
    packed: list[int]
    bias: int
    width: int
    offset: int
    start: int

    @staticmethod
    def of(ids: np.ndarray, rows: np.ndarray, labels: np.ndarray, x: np.ndarray, largest: int) -> Block:
        """``largest``: the size of an anchor's components at most."""
        bias = max(int(x.max()), -int(x.min()), 1) if x.size else 1
        # |sum of a * (y + bias)| is at most this; added to each field, none is negative or reaches twice it
        offset = max(1, x.shape[1] * largest * 2 * bias)
        need = ((2 * offset).bit_length() + 7) // 8
        width = next((w for w in (4, 8) if need <= w), need)
        return Block(ids, rows, labels, [_fields(column.tolist(), bias, width) for column in x.T], bias, width, offset, _fields([0] * len(ids), offset, width))

    def scores(self, anchor: list[int]) -> np.ndarray:
        """Inner products with every candidate: one multiplication per component of the anchor."""
        total = sum(map(mul, anchor, self.packed), self.start)
        raw, off = total.to_bytes(len(self.ids) * self.width, "little"), self.offset + self.bias * sum(anchor)
        if self.width == 4:
            return np.frombuffer(raw, "<u4").astype(np.int64) - off
        if self.width == 8 and 2 * self.offset < 1 << 62:
            return np.frombuffer(raw, "<u8").astype(np.int64) - off
        w = self.width
        return np.array([int.from_bytes(raw[i:i + w], "little") - off for i in range(0, len(raw), w)], object)


def _fields(numbers: list[int], bias: int, width: int) -> int:
    """The numbers, biased, side by side in one integer, the first in the lowest field."""
    if width <= 8:
        return int.from_bytes((np.array(numbers, np.int64) + bias).astype(f"<u{width}").tobytes(), "little")
    return int.from_bytes(b"".join((n + bias).to_bytes(width, "little") for n in numbers), "little")


def _blocks(batches: Iterator[pa.RecordBatch], largest: int) -> Iterator[Block]:
    for batch in batches:
        if not batch.num_rows:
            continue
        ids = batch.column("vec_id").fill_null(np.iinfo(np.int64).max).to_numpy(zero_copy_only=False)
        rows, labels = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("row", "label"))
        x = batch.column("x").flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)
        order = np.argsort(labels, kind="stable")
        for at in range(0, len(order), PACKED):
            part = order[at:at + PACKED]
            yield Block.of(ids[part], rows[part], labels[part], x[part], largest)


class Best:
    """The first few candidates by falling score, then id (null last), then row."""

    def __init__(self, most: int) -> None:
        self.most = most
        self.held: list[tuple[int, int, int]] = []

    def add(self, scores: np.ndarray, ids: np.ndarray, rows: np.ndarray) -> None:
        if len(self.held) == self.most:
            near = scores >= -self.held[-1][0]
            if not near.any():
                return
            scores, ids, rows = scores[near], ids[near], rows[near]
        if scores.dtype != object and len(scores) > 4 * self.most:
            near = scores >= np.partition(scores, len(scores) - self.most)[len(scores) - self.most]
            scores, ids, rows = scores[near], ids[near], rows[near]
            first = np.lexsort((rows, ids, -scores))[:self.most]
            scores, ids, rows = scores[first], ids[first], rows[first]
        for key in zip((-scores).tolist(), ids.tolist(), rows.tolist(), strict=True):
            insort(self.held, key)
            del self.held[self.most:]


def _handed_on(found: Iterable[tuple[int, int | None, Best]]) -> Iterator[pa.RecordBatch]:
    at, wanted, scores, ids, rows = [], [], [], [], []
    for place, score, best in found:
        for minus, vec_id, row in best.held:
            at.append(place)
            wanted.append(score)
            scores.append(-minus)
            ids.append(None if vec_id == np.iinfo(np.int64).max else vec_id)
            rows.append(row)
    yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(wanted, pa.decimal128(38, 0)), pa.array(scores, pa.decimal128(38, 0)),
                                      pa.array(ids, pa.int64()), pa.array(rows, pa.int64())], names=["anchor", "wanted", "score", "vec_id", "row"])


def _nearest(shared, most: int):
    """Of each anchor the best rows with its label. One more than wanted is kept, as the anchor may be among them."""
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vectors, labels, largest = shared.value
        found: dict[int, Best] = {}
        for block in _blocks(batches, largest):
            for label in np.unique(block.labels).tolist():
                lo, hi = np.searchsorted(block.labels, [label, label + 1])
                for place in np.flatnonzero(labels == label).tolist():
                    scores = block.scores(vectors[place])
                    found.setdefault(place, Best(most + 1)).add(scores[lo:hi], block.ids[lo:hi], block.rows[lo:hi])
        yield from _handed_on((place, None, best) for place, best in found.items())
    return work


def _within(shared, bands, most: int):
    """Of each anchor, for each of its positives' scores, the best rows of other labels inside the band."""
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vectors, labels, largest = shared.value
        found: dict[tuple[int, int], Best] = {}
        for block in _blocks(batches, largest):
            for place, wanted in bands.value.items():
                lo, hi = np.searchsorted(block.labels, [labels[place], labels[place] + 1])
                if hi - lo == len(block.labels):
                    continue
                scores = block.scores(vectors[place])
                fits = scores >= min(w[1] for w in wanted)
                fits[lo:hi] = False
                near = np.flatnonzero(fits)
                for score, low, high in wanted if len(near) else ():
                    inside = near[(scores[near] >= low) & (scores[near] <= high)]
                    if len(inside):
                        found.setdefault((place, score), Best(most)).add(scores[inside], block.ids[inside], block.rows[inside])
        yield from _handed_on((place, score, best) for (place, score), best in found.items())
    return work


def _ranked(found: DataFrame, keys: list[str]) -> DataFrame:
    order = [F.desc("score"), F.asc_nulls_last("vec_id"), F.asc("row")]
    return found.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))


def bounds(score: int, band: tuple[int, int]) -> tuple[int, int]:
    """The least and the greatest whole score between the band's percentages of ``score``."""
    return -(-band[0] * score // 100), band[1] * score // 100


def mine_hard_negatives(rows: DataFrame, anchors: DataFrame, positives: int = POSITIVES, negatives: int = NEGATIVES,
                        band: tuple[int, int] = BAND, chunk: int = CHUNK) -> DataFrame:
    """For each anchor and positive the first negatives of another label whose score lies in the band.

    ``rows`` come from ``prepare``, ``anchors`` are some of them. An anchor's positives are the
    first other rows of its label; its own row is not one, a repeated row with its id is. Equal scores go
    by the smaller vec_id, null ids last. Columns: anchor_id, positive_id, rank, negative_id, positive_score,
    negative_score; scores are decimals, which hold any inner product. An anchor without positives and a
    positive without negatives have no row, an empty table none at all. The rows are read twice per ``chunk``
    anchors; what is broadcast is bounded by ``chunk``.
    """
    spark = rows.sparkSession
    placed = settle(numbered(anchors.select("row", "vec_id", "label", "x")), "placed")
    total = placed.count()
    path = f"{checkpoint_dir(spark).rstrip('/')}/negatives-{uuid.uuid4().hex}"
    schema = "anchor_id bigint, positive_id bigint, rank int, negative_id bigint, positive_score decimal(38,0), negative_score decimal(38,0)"
    for first in range(0, total, chunk):
        own = placed.where((F.col("place") >= first) & (F.col("place") < first + chunk)).withColumn("anchor", (F.col("place") - first).cast("int"))
        taken = own.select("anchor", "label", "x").orderBy("anchor").toArrow()
        vectors = taken.column("x").to_pylist()
        largest = max((abs(c) for v in vectors for c in v), default=0)
        shared = spark.sparkContext.broadcast((vectors, taken.column("label").to_numpy(), largest))
        met = rows.mapInArrow(_nearest(shared, positives), FOUND)
        self_row = own.select("anchor", F.col("vec_id").alias("anchor_id"), F.col("row").alias("_self"))
        others = met.join(F.broadcast(self_row), "anchor").where("row != _self")
        chosen = settle(_ranked(others, ["anchor"]).where(F.col("rank") <= positives).select(
            "anchor", "anchor_id", F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score")), "positives")
        wanted: dict[int, set[int]] = {}
        for r in chosen.select("anchor", "positive_score").distinct().collect():  # at most chunk * positives rows
            low, high = bounds(int(r.positive_score), band)
            if low <= high:
                wanted.setdefault(r.anchor, set()).add((int(r.positive_score), low, high))
        bands = spark.sparkContext.broadcast({place: sorted(some) for place, some in wanted.items()})
        inside = _ranked(rows.mapInArrow(_within(shared, bands, negatives), FOUND), ["anchor", "wanted"]).where(F.col("rank") <= negatives)
        mined = inside.withColumnsRenamed({"wanted": "positive_score", "vec_id": "negative_id", "score": "negative_score"})
        mined.join(F.broadcast(chosen), ["anchor", "positive_score"]).select(*RESULT).write.mode("append").parquet(path)
        shared.unpersist()
        bands.unpersist()
    return spark.read.schema(schema).parquet(path) if total else spark.createDataFrame([], schema)
