"""Whitening against a plain eigendecomposition, exact deviations against Python's numbers."""

from __future__ import annotations

import math

import numpy as np
import pytest

from __spark_entry__ import queries
from caseloom.llm import whitening

SF = "/root/testdata/sf0.001"


def frame(spark, vectors):
    return spark.createDataFrame([(i, None if v is None else [None if c is None else float(c) for c in v]) for i, v in enumerate(vectors)],
                                 "vec_id long, embedding array<double>")


def fitted(spark, vectors, **more):
    rows = whitening.prepare(frame(spark, vectors))
    model = whitening.fit(rows, **more)
    return rows, model, {r.vec_id: r for r in whitening.whiten(rows, model).collect()}


def plain(vectors):
    x = np.floor(1024 * np.array(vectors, float)) + 100_000
    c = x - x.mean(axis=0)
    return x.astype(int), np.linalg.eigh(c.T @ c / len(c))[0][::-1]


def test_query_agrees_with_a_plain_decomposition(spark):
    rows = queries()["op12_whitening"](spark, SF).collect()
    data = spark.read.parquet(f"{SF}/embeddings.parquet").collect()
    x, variances = plain([r.embedding for r in data])
    n, sums = len(x), x.sum(axis=0)
    exact = {r.vec_id: sum((n * int(a) - int(s)) ** 2 for a, s in zip(row, sums, strict=True)) for r, row in zip(data, x, strict=True)}
    c = x - x.mean(axis=0)
    vectors = np.linalg.eigh(c.T @ c / n)[1][:, ::-1]
    assert len(rows) == 8 * n and {r.component for r in rows} == set(range(1, 9))
    place = {r.vec_id: i for i, r in enumerate(data)}
    got = np.zeros((n, 8))
    for r in rows:
        assert (r.n, r.deviation) == (n, exact[r.vec_id])
        assert r.explained == pytest.approx(variances[r.component - 1] / variances.sum(), rel=1e-12)
        assert r.identity_error < 1e-10
        got[place[r.vec_id], r.component - 1] = r.whitened
    want = c @ vectors[:, :8] / np.sqrt(variances[:8])
    want *= np.sign((want * got).sum(axis=0))
    assert np.abs(want - got).max() < 1e-9


def test_equal_deviations_are_all_found(spark):
    """Corners of a cross-polytope: five equal deviations and three smaller, again equal, ones."""
    scale = [8, 8, 8, 8, 8, 2, 2, 2, 1, 1]
    vectors = [[s * sign if i == j else 0 for j in range(10)] for i, s in enumerate(scale) for sign in (1, -1)]
    _, model, rows = fitted(spark, vectors)
    _, variances = plain(vectors)
    assert np.allclose(model.variances, variances[:8], rtol=1e-12) and model.identity_error < 1e-10
    assert np.allclose(model.components.T @ model.components, np.eye(8), atol=1e-12)
    assert len(rows) == 20


def test_wide_spectra_and_large_offsets(spark):
    rng = np.random.default_rng(3)
    vectors = rng.standard_normal((300, 12)) * 10.0 ** -np.arange(12).clip(0, 3) * 50 + 1e6
    _, model, _ = fitted(spark, vectors.tolist())
    _, variances = plain(vectors)
    assert np.allclose(model.variances, variances[:8], rtol=1e-9) and model.identity_error < 1e-8


def test_numbers_beyond_64_bits_stay_exact(spark):
    vectors = [[2.0 ** 50, 0.5], [-(2.0 ** 50), 0.25], [2.0 ** 49, -1.0]]
    _, model, rows = fitted(spark, vectors)
    x = [[math.floor(1024 * c) + 100_000 for c in v] for v in vectors]
    for i, row in enumerate(x):
        assert int(rows[i].deviation) == sum((3 * a - sum(r[j] for r in x)) ** 2 for j, a in enumerate(row))
    assert len(model.variances) >= 1


def test_rows_that_take_no_part(spark):
    good = np.random.default_rng(1).standard_normal((20, 4)).tolist()
    bad = [None, [None, 1, 2, 3], [math.nan, 1, 2, 3], [math.inf, 1, 2, 3], [1e300, 0, 0, 0], [1.0, 2.0], []]
    _, model, rows = fitted(spark, [*good, *bad])
    assert model.n == 20 and sorted(rows) == list(range(20)) and len(model.variances) == 4


def test_few_rows_and_none(spark):
    _, model, rows = fitted(spark, [[1.0, 2.0, 3.0], [2.0, 0.0, 1.0], [1.0, 2.0, 3.0]])
    assert len(model.variances) == 1 and all(len(r.whitened) == 1 for r in rows.values()) and len(rows) == 3
    assert model.identity_error < 1e-12
    for vectors in ([], [[1.0, 2.0]], [[1.0, 2.0]] * 3, [None]):
        _, model, rows = fitted(spark, vectors)
        assert len(model.variances) == 0 and all(r.whitened == [] and r.deviation == 0 for r in rows.values())
    white = whitening.whiten(whitening.prepare(frame(spark, [])), whitening.fit(whitening.prepare(frame(spark, []))))
    assert white.columns == ["vec_id", "deviation", "whitened"]


def test_clashing_names_and_repeated_rows(spark):
    rows = spark.createDataFrame([(1, [1.0, 0.0], "a", 5), (1, [1.0, 0.0], "a", 5), (None, [0.0, 3.0], None, None)],
                                 "vec_id long, embedding array<float>, Whitened string, deviation int")
    kept = whitening.prepare(rows)
    out = whitening.whiten(kept, whitening.fit(kept))
    assert out.columns == ["vec_id", "deviation", "whitened"] and out.count() == 3
