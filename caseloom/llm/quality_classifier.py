"""Ordinal regression on graded ratings: one set of hashed-text weights, ordered thresholds.

A cumulative-link model says P(grade > k | text) = logistic(w . x - t_k) with t_0 < t_1 < ...
It is fitted on a bounded sample of rated documents; scoring is one pass over all documents
with a broadcast weight vector of fixed size.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from caseloom.llm.common import FOLD, arrow_column, as_bytes, blocks, struct_of, without, word_hashes

#: Size of the hashed vocabulary: the weights broadcast are 2**BITS floats.
BITS = 22
#: Rated documents the model is fitted on, at most; they are the ones with the least hash of their id.
MOST_RATED = 8_000
#: A hashed word has a weight of its own if so many rated documents have it.
LEAST_SEEN = 3
#: and if having it goes with the grade beyond chance: chi-squared for one of the cuts between grades.
LEAST_CHI = 30.0
STEPS, RATE, RIDGE = 300, 0.1, 1e-4


@dataclass(frozen=True)
class OrdinalModel:
    weights: np.ndarray
    thresholds: np.ndarray

    def tails(self, score: np.ndarray) -> np.ndarray:
        """P(grade > k) for each threshold k, a column each."""
        return 1.0 / (1.0 + np.exp(-(score[:, None] - self.thresholds[None, :])))


def features(texts: list[bytes], bits: int = BITS) -> tuple[np.ndarray, np.ndarray]:
    """Hashed words each text has, each once and in order, and how many each text has."""
    hashes, counts = word_hashes(texts, FOLD)
    doc = np.repeat(np.arange(len(texts), dtype=np.uint64), counts)
    keys = np.unique((doc << np.uint64(bits)) | (hashes >> np.uint64(64 - bits)))
    return (keys & np.uint64((1 << bits) - 1)).astype(np.int64), np.bincount((keys >> np.uint64(bits)).astype(np.int64), minlength=len(texts))


def _chi_squared(both: np.ndarray, have: np.ndarray, above: int, n: int) -> np.ndarray:
    """How far each word's share above a cut lies from chance, given the documents that have it."""
    if not 0 < above < n:
        return np.zeros(len(have))
    return (both * n - have * above)**2 / np.maximum(have * above * (n - above) * (n - have) / n, 1e-9)


def fit(words: np.ndarray, counts: np.ndarray, grades: np.ndarray, n_grades: int, bits: int = BITS) -> OrdinalModel:
    """Maximum likelihood with a ridge, by full-batch adaptive gradient steps.

    Thresholds stay ordered: they are a first one and positive gaps. Rare grades weigh as much as
    common ones. With no rows or a single grade, weights are zero and thresholds follow the shares.
    """
    n = len(grades)
    doc = np.repeat(np.arange(n), counts)
    known, column, seen_in = np.unique(words, return_inverse=True, return_counts=True)
    telling = np.zeros(len(known), bool)
    for k in range(n_grades - 1):
        telling |= _chi_squared(np.bincount(column, weights=grades[doc] > k, minlength=len(known)), seen_in, int(np.sum(grades > k)), n) >= LEAST_CHI
    often = (seen_in >= LEAST_SEEN) & telling
    use = often[column]
    doc, column = doc[use], (np.cumsum(often) - 1)[column[use]]
    known, size = known[often], int(often.sum())
    share = np.array([(np.sum(grades > k) + 0.5) / (n + 1.0) for k in range(n_grades - 1)])
    start = -np.log(share / (1 - share))
    first, gaps = start[0], np.log(np.maximum(np.diff(start), 1e-3))
    w = np.zeros(size)
    if n == 0 or len(np.unique(grades)) < 2:
        return OrdinalModel(np.zeros(1 << bits, np.float32), np.concatenate(([first], first + np.cumsum(np.exp(gaps)))))
    seen = np.bincount(grades, minlength=n_grades)
    weight = (n / (np.count_nonzero(seen) * np.maximum(seen, 1)))[grades]
    past_w, past_t = np.full(size, 1e-8), np.full(n_grades - 1, 1e-8)
    lo, hi = np.maximum(grades - 1, 0), np.minimum(grades, n_grades - 2)
    for _ in range(STEPS):
        t = np.concatenate(([first], first + np.cumsum(np.exp(gaps))))
        score = np.bincount(doc, weights=w[column], minlength=n)
        tail = 1 / (1 + np.exp(-np.clip(score[:, None] - t[None, :], -40, 40)))
        rows = np.arange(n)
        upper = np.where(grades > 0, tail[rows, lo], 1.0)  # P(grade >= own)
        lower = np.where(grades < n_grades - 1, tail[rows, hi], 0.0)  # P(grade > own)
        p = np.maximum(upper - lower, 1e-12)
        d_up, d_low = upper * (1 - upper) / p * weight, lower * (1 - lower) / p * weight
        g_score = -(d_up - d_low) / n
        g_t = np.zeros(n_grades - 1)
        np.add.at(g_t, lo[grades > 0], (d_up / n)[grades > 0])
        np.add.at(g_t, hi[grades < n_grades - 1], -(d_low / n)[grades < n_grades - 1])
        g_w = np.bincount(column, weights=g_score[doc], minlength=size) + RIDGE * w
        past_w += g_w**2
        w -= RATE * g_w / np.sqrt(past_w)
        back = np.cumsum(g_t[::-1])[::-1]
        g_first, g_gaps = back[0], back[1:] * np.exp(gaps)
        past_t += np.concatenate(([g_first], g_gaps))**2
        first -= RATE * g_first / np.sqrt(past_t[0])
        gaps = gaps - RATE * g_gaps / np.sqrt(past_t[1:])
    weights = np.zeros(1 << bits, np.float32)
    weights[known] = w
    return OrdinalModel(weights, np.concatenate(([first], first + np.cumsum(np.exp(gaps)))))


def _word_lists(bits: int):
    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for _, _, part in blocks(batch.column("text")):
                words, counts = features(part, bits)
                rows += np.split(words.astype(np.int32), np.cumsum(counts)[:-1])
            yield pa.RecordBatch.from_arrays([batch.column("grade"), pa.array(rows, pa.list_(pa.int32()))], names=["grade", "words"])
    return emit


def train(docs: DataFrame, ratings: DataFrame, n_grades: int, most_rated: int = MOST_RATED, bits: int = BITS) -> OrdinalModel:
    """Fits on documents with a rating ``grade`` in 0 .. n_grades - 1.

    The sample is the ``most_rated`` rated ids of least hash, so it does not depend on order or
    partitions; repeated ratings of an id count once, by the lowest grade. Null ids and grades
    and those out of range count nowhere. The whole texts of the sample are hashed where they lie;
    what reaches the driver is one number per distinct word of a sampled text.
    """
    rated = ratings.where(F.col("doc_id").isNotNull() & F.col("grade").between(0, n_grades - 1)).groupBy("doc_id").agg(F.min("grade").cast("int").alias("grade"))
    sample = rated.orderBy(F.xxhash64("doc_id"), "doc_id").limit(most_rated)
    read = docs.select("doc_id", as_bytes("text").alias("text")).join(F.broadcast(sample), "doc_id").select("grade", "text")
    got = read.mapInArrow(_word_lists(bits), "grade int, words array<int>").toArrow()
    lists = got.column("words").combine_chunks()
    lists = lists if isinstance(lists, pa.Array) else pa.array([], pa.list_(pa.int32()))
    counts = np.diff(lists.offsets.to_numpy()) if len(lists) else np.zeros(0, np.int64)
    words = lists.flatten().to_numpy(zero_copy_only=False).astype(np.int64) if len(lists) else np.zeros(0, np.int64)
    return fit(words, counts, got.column("grade").to_numpy().astype(np.int64), n_grades, bits)


def _scorer(shared, bits: int):
    def score(texts: pa.Array) -> pa.Array:
        model, out = shared.value, np.zeros(len(texts))
        for i, j, part in blocks(texts):
            words, counts = features(part, bits)
            out[i:j] = np.bincount(np.repeat(np.arange(j - i), counts), weights=model.weights[words], minlength=j - i)
        tails = model.tails(out)
        return struct_of(score=(out, pa.float64()), expected_grade=(tails.sum(axis=1), pa.float64()),
                         tails=(list(tails), pa.list_(pa.float64())))
    return score


def grade_documents(docs: DataFrame, model: OrdinalModel, bits: int = BITS) -> DataFrame:
    """The documents with ``score``, ``expected_grade`` and ``tails``: P(grade > k) for each k.

    A null or empty text has no words: score 0, as an average text. Input columns named like the
    new ones are replaced, repeated rows are scored each, and nothing moves between tasks.
    """
    docs = without(docs, "score", "expected_grade", "tails")
    shared = docs.sparkSession.sparkContext.broadcast(model)
    scored = arrow_column(_scorer(shared, bits), "struct<score:double,expected_grade:double,tails:array<double>>", as_bytes("text"))
    return docs.withColumn("_s", scored).select(*[F.col(f"`{c}`") for c in docs.columns], "_s.*")
