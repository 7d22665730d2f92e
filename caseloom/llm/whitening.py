"""Whitening of embeddings by Golub-Kahan-Lanczos bidiagonalisation of the centred rows.

Vectors become whole numbers, so that counts, sums and deviations are exact. With X the centred
rows, the bidiagonalisation alternates Xv and X'u; both products, the reorthogonalisation and
the small matrix they build need no more of the data than one scan per step: a task multiplies
its rows by the direction and its part of the outcome by its rows again, and only vectors as long
as a row are summed over the tasks. Left vectors are never stored: each is X times a vector that
the driver holds, which is also what the reorthogonalisation of the left side works on.

The singular vectors and values of the small bidiagonal matrix give components and deviations. One
starting direction meets each distinct deviation once; so a second bidiagonalisation, kept
orthogonal to what is found, looks for equal ones until none is left above the last component.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from caseloom.llm.common import arrow_column, settle, struct_of, without

SCALE, OFFSET = 1024, 100_000
COMPONENTS = 8
#: Residual of a singular triplet, as a share of the largest singular value, at which it has converged.
CONVERGED = 1e-14
#: What rounding leaves of zero, as a share of the norm of all rows.
NOTHING = 1e-13
#: Numbers of a block of rows worked on at once.
BLOCK = 1 << 19
NUMBERS = "_numbers"


@dataclass
class Whitening:
    """What a fit knows: the number of rows, the sums, unit components by falling variance, their variances."""

    n: int
    sums: list[int]
    largest: int
    components: np.ndarray
    variances: np.ndarray
    trace: float
    identity_error: float
    scans: int = 0

    @property
    def explained(self) -> list[float]:
        return [float(v / self.trace) for v in self.variances]


def whole_numbers(vector: str, scale: int = SCALE, offset: int = OFFSET) -> Column:
    """floor(scale * c) + offset of each component; null if the vector, or one component, is null, not finite
    or too large for a 64-bit number."""
    doubles = F.transform(F.col(f"`{vector}`"), lambda c: c.cast("double") * F.lit(float(scale)))
    good = F.forall(doubles, lambda c: F.coalesce(F.abs(c) < F.lit(2.0 ** 62), F.lit(False)))
    return F.when(F.coalesce(good, F.lit(False)), F.transform(doubles, lambda c: F.floor(c) + F.lit(offset).cast("bigint")))


def prepare(rows: DataFrame, vector: str = "embedding", scale: int = SCALE, offset: int = OFFSET) -> DataFrame:
    """The rows that take part, with their whole numbers in place of the vector, written to the shared folder.

    Rows whose vector is null or holds null, non-finite or (beyond 2**62) unwieldy entries are left out,
    as are those of another length than most vectors (of equally frequent lengths the greater counts).
    """
    numbers = whole_numbers(vector, scale, offset)
    kept = [F.col(f"`{c}`") for c in without(rows, vector, NUMBERS).columns]
    whole = settle(rows.select(*kept, numbers.alias(NUMBERS)).where(F.col(NUMBERS).isNotNull()), "numbers")
    size = F.size(NUMBERS)
    lengths = whole.groupBy(size.alias("d")).count().orderBy(F.desc("count"), F.desc("d")).limit(1).collect()
    return whole.where(size == lengths[0].d) if lengths else whole


def _matrices(column: pa.Array) -> Iterator[np.ndarray]:
    """Rows of whole numbers, a block at a time."""
    rows = len(column)
    if not rows:
        return
    flat = column.flatten().to_numpy(zero_copy_only=False)
    matrix = flat.reshape(rows, -1)
    step = max(1, BLOCK // max(1, matrix.shape[1]))
    for at in range(0, rows, step):
        yield matrix[at:at + step]


def deviations(matrix: np.ndarray, n: int, sums: list[int], largest: int) -> np.ndarray:
    """n * x - S, exact: in 64 bits where nothing can overflow, else as Python's numbers."""
    if n * largest + max(map(abs, sums), default=0) < 1 << 62:
        return matrix * n - np.array(sums, np.int64)
    return matrix.astype(object) * n - np.array(sums, object)


def centred(matrix: np.ndarray, n: int, sums: list[int], largest: int) -> np.ndarray:
    """x - S/n: subtracted as whole numbers, so that a large common offset costs no digit."""
    return (deviations(matrix, n, sums, largest) / n).astype(np.float64)


def squared(differences: np.ndarray) -> list[int] | np.ndarray:
    """The sum of squares of each row, exact."""
    most = int(np.abs(differences).max()) if differences.size else 0
    if most * most * differences.shape[1] < 1 << 62:
        return np.einsum("ij,ij->i", differences.astype(np.int64), differences.astype(np.int64))
    wide = differences.astype(object)
    return (wide * wide).sum(axis=1)


def _totals(rows: DataFrame) -> tuple[int, list[int], int]:
    """Number of rows, sum of each dimension and the largest number by size."""
    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, n, most = None, 0, 0
        for batch in batches:
            for m in _matrices(batch.column(0)):
                top = int(max(abs(int(m.max())), abs(int(m.min())))) if m.size else 0
                part = m.sum(axis=0) if top * len(m) < 1 << 62 else m.astype(object).sum(axis=0)
                total = part.astype(object) if total is None else total + part.astype(object)
                n, most = n + len(m), max(most, top)
        if total is not None:
            exact = pa.array([*[int(t) for t in total], n], pa.decimal128(38, 0))
            yield pa.RecordBatch.from_arrays([pa.array([*range(len(total)), -1], pa.int32()), exact, pa.array([most] * (len(total) + 1), pa.int64())],
                                             names=["at", "total", "most"])

    sums = rows.select(NUMBERS).mapInArrow(summed, "at int, total decimal(38,0), most bigint")
    found = sums.groupBy("at").agg(F.sum("total").alias("total"), F.max("most").alias("most")).orderBy("at").collect()
    if not found:
        return 0, [], 0
    return int(found[0].total), [int(r.total) for r in found[1:]], max(r.most for r in found)


class Rows:
    """The centred rows as an operator; each product is one scan whose tasks hand on a few vectors."""

    def __init__(self, rows: DataFrame) -> None:
        self.rows = rows.select(NUMBERS)
        self.n, self.sums, self.largest = _totals(rows)
        self.d = len(self.sums)
        self.scans = 1

    def _summed(self, work: Callable[[np.ndarray], np.ndarray], size: int) -> np.ndarray:
        """The sum over all blocks of rows of what ``work`` makes of a block: ``size`` numbers."""
        n, sums, largest = self.n, self.sums, self.largest

        def folded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = np.zeros(size)
            for batch in batches:
                for m in _matrices(batch.column(0)):
                    total += work(centred(m, n, sums, largest))
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(size, dtype=np.int32)), pa.array(total)], names=["at", "part"])

        self.scans += 1
        parts = self.rows.mapInArrow(folded, "at int, part double").groupBy("at").agg(F.sum("part").alias("total")).collect()
        out = np.zeros(size)
        for r in parts:
            out[r.at] = r.total
        return out

    def norm(self) -> float:
        return float(np.sqrt(self._summed(lambda x: np.array([np.einsum("ij,ij->", x, x)]), 1)[0]))

    def product(self, direction: np.ndarray) -> tuple[np.ndarray, float]:
        """X'p and p'p for p = Xv."""
        def both(x: np.ndarray) -> np.ndarray:
            p = x @ direction
            return np.concatenate([p @ x, [p @ p]])

        out = self._summed(both, self.d + 1)
        return out[:-1], float(out[-1])

    def covariance(self, directions: np.ndarray) -> np.ndarray:
        """The covariance, divisor n, of the rows projected on some directions (columns)."""
        k = directions.shape[1]

        def gram(x: np.ndarray) -> np.ndarray:
            y = x @ directions
            return np.concatenate([(y.T @ y).ravel(), y.sum(axis=0)])

        out = self._summed(gram, k * k + k) / self.n
        return out[:k * k].reshape(k, k) - np.outer(out[k * k:], out[k * k:])


@dataclass
class Bidiagonal:
    """X V = U B as far as it has come: ``right`` and ``left`` are lists of vectors as long as a row, a left
    vector u being X times its entry; ``back`` has X'u of each. ``closed`` once nothing is left to add."""

    alphas: list[float] = field(default_factory=list)
    betas: list[float] = field(default_factory=list)
    right: list[np.ndarray] = field(default_factory=list)
    left: list[np.ndarray] = field(default_factory=list)
    back: list[np.ndarray] = field(default_factory=list)
    closed: bool = False

    def triplets(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Singular values by size, right vectors as columns, and the residual of each triplet."""
        k = len(self.alphas)
        if not k:
            return np.zeros(0), np.zeros((len(self.right[0]), 0)), np.zeros(0)
        # where the last direction met no new left vector, B has one column more than rows
        small = np.zeros((k, k + 1 if self.closed and len(self.right) > k else k))
        for i in range(k):
            small[i, i] = self.alphas[i]
            if i + 1 < small.shape[1]:
                small[i, i + 1] = self.betas[i]
        u, s, vt = np.linalg.svd(small, full_matrices=False)
        directions = np.array(self.right[:small.shape[1]]).T @ vt.T
        residuals = np.zeros(k) if self.closed else abs(self.betas[-1]) * np.abs(u[-1])
        return s, directions, residuals


def _orthogonal(vector: np.ndarray, to: list[np.ndarray]) -> np.ndarray:
    """Twice is enough."""
    if to:
        basis = np.array(to)
        for _ in range(2):
            vector = vector - basis.T @ (basis @ vector)
    return vector


def bidiagonalise(rows: Rows, nothing: float, apart: list[np.ndarray], seed: int, done: Callable[[Bidiagonal], bool]) -> Bidiagonal:
    """Steps of Golub, Kahan and Lanczos orthogonal to ``apart``, until ``done`` says so or no direction is left."""
    b = Bidiagonal()
    v = _orthogonal(np.random.default_rng(seed).standard_normal(rows.d), apart)
    v = _orthogonal(v / np.linalg.norm(v), apart)
    b.right.append(v / np.linalg.norm(v))
    while True:
        v = b.right[-1]
        # p = Xv less the left vector before, as X times one direction
        q = v - b.betas[-1] * b.left[-1] if b.left else v
        z, pp = rows.product(q)
        for _ in range(2):
            if b.left:
                c = np.array(b.left) @ z
                q, z, pp = q - np.array(b.left).T @ c, z - np.array(b.back).T @ c, pp - float(c @ c)
        alpha = float(np.sqrt(max(pp, 0.0)))
        if alpha <= nothing:
            b.closed = True
            return b
        b.alphas.append(alpha)
        b.left.append(q / alpha)
        b.back.append(z / alpha)
        r = _orthogonal(z / alpha - alpha * v, [*b.right, *apart])
        beta = float(np.linalg.norm(r))
        full = len(b.right) + len(apart) >= rows.d
        if full or beta <= nothing:
            b.betas.append(0.0)
            b.closed = True
            return b
        b.betas.append(beta)
        if done(b):
            return b
        b.right.append(r / beta)


def decompose(rows: Rows, components: int, nothing: float) -> tuple[np.ndarray, np.ndarray]:
    """The largest singular values of the centred rows and their right vectors (columns)."""
    values, found = np.zeros(0), np.zeros((rows.d, 0))

    def settled(b: Bidiagonal) -> bool:
        """All wanted triplets have converged; of a later run, also: it shows none above those known."""
        s, _, residuals = b.triplets()
        if len(values) >= components and len(s) and s[0] + residuals[0] < values[components - 1] and residuals[0] < 0.01 * s[0]:
            return True
        good = residuals <= CONVERGED * max([*s[:1], *values[:1]])
        return bool(len(good) >= components and good[:components].all())

    for seed in range(rows.d):
        b = bidiagonalise(rows, nothing, list(found.T), seed, settled)
        s, directions, residuals = b.triplets()
        good = residuals <= CONVERGED * max([*s[:1], *values[:1], 0.0])
        more = good & ((s > values[components - 1]) if len(values) >= components else (s > nothing))
        known = len(values)
        order = np.argsort(-np.concatenate([values, s[more]]), kind="stable")
        values, found = np.concatenate([values, s[more]])[order], np.concatenate([found, directions[:, more]], axis=1)[:, order]
        # nothing new above the last one: no later run can find it either
        complete = b.closed and len(b.right) + known >= rows.d
        if complete or not more.any():
            break
    return values[:components], found[:, :components]


def fit(rows: DataFrame, components: int = COMPONENTS) -> Whitening:
    """Components of the rows that ``prepare`` returned. Those without variance have none: an empty table and a
    single row have no component, k rows at most k - 1."""
    x = Rows(rows)
    norm = x.norm() if x.n else 0.0
    if not norm:
        return Whitening(x.n, x.sums, x.largest, np.zeros((x.d, 0)), np.zeros(0), 0.0, 0.0, x.scans)
    values, directions = decompose(x, min(components, x.d), NOTHING * norm)
    white = x.covariance(directions / values * np.sqrt(x.n))
    error = float(np.abs(white - np.eye(len(values))).max())
    return Whitening(x.n, x.sums, x.largest, directions, values ** 2 / x.n, norm ** 2 / x.n, error, x.scans)


def whiten(rows: DataFrame, model: Whitening) -> DataFrame:
    """The rows with ``deviation`` (sum over dimensions of (n*x - S)**2, exact) and ``whitened``, an array with a
    number for each component. Repeated rows count and return each; columns named like the new ones are replaced."""
    n, sums, largest = model.n, model.sums, model.largest
    projection = model.components / np.sqrt(model.variances)

    def projected(column: pa.Array) -> pa.Array:
        exact, white = [], []
        for m in _matrices(column):
            differences = deviations(m, n, sums, largest)
            squares = squared(differences)
            exact.append(pa.array(squares).cast(pa.decimal128(38, 0)) if squares.dtype != object else pa.array(squares.tolist(), pa.decimal128(38, 0)))
            white.append((differences / n).astype(np.float64) @ projection)
        flat = np.concatenate([w.ravel() for w in white]) if white else np.zeros(0)
        ends = np.arange(len(column) + 1, dtype=np.int32) * projection.shape[1]
        held = pa.chunked_array(exact, pa.decimal128(38, 0)).combine_chunks()
        return struct_of(deviation=(held, pa.decimal128(38, 0)), whitened=(pa.ListArray.from_arrays(ends, flat), pa.list_(pa.float64())))

    kept = [F.col(f"`{c}`") for c in without(rows, NUMBERS, "deviation", "whitened").columns]
    done = rows.select(*kept, arrow_column(projected, "struct<deviation:decimal(38,0),whitened:array<double>>", F.col(NUMBERS)).alias("_white"))
    return done.select(*kept, "_white.*")
