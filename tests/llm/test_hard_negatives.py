"""Hard negatives against a plain search over all pairs, packed products against plain ones."""

from __future__ import annotations

import math
import random

import numpy as np
import pytest

from __spark_entry__ import queries
from caseloom.llm import hard_negatives
from caseloom.llm.hard_negatives import Best, Block


def plain(rows, is_anchor, positives=5, negatives=3):
    """(anchor, positive, rank, negative, scores) of (vec_id, label, vector) rows that all take part."""
    x = [[math.floor(256 * c) for c in v] for _, _, v in rows]
    out = []
    for a, (vec_id, label, _) in enumerate(rows):
        if not is_anchor(vec_id):
            continue
        score = [sum(p * q for p, q in zip(x[a], y, strict=True)) for y in x]
        order = sorted(range(len(rows)), key=lambda i: (-score[i], rows[i][0] is None, rows[i][0] or 0))
        same = [i for i in order if i != a and rows[i][1] == label][:positives]
        for p in same:
            fits = [i for i in order if rows[i][1] != label and 50 * score[p] <= 100 * score[i] <= 95 * score[p]][:negatives]
            out += [(vec_id, rows[p][0], rank, rows[i][0], score[p], score[i]) for rank, i in enumerate(fits, 1)]
    return sorted(out, key=repr)


def mined(rows, anchors, **more):
    got = hard_negatives.mine_hard_negatives(rows, anchors, **more).collect()
    return sorted(((r.anchor_id, r.positive_id, r["rank"], r.negative_id, int(r.positive_score), int(r.negative_score)) for r in got), key=repr)


def frame(spark, rows):
    return spark.createDataFrame([(i, l, None if v is None else [None if c is None else float(c) for c in v], "x", 1) for i, l, v in rows],
                                 "vec_id long, label int, embedding array<double>, X string, row int")


@pytest.mark.parametrize("size", [1, 100, 2.0 ** 21, 2.0 ** 40])
def test_packed_products_are_exact(size):
    rng = random.Random(size)
    for d in (1, 3, 65):
        y = [[rng.randrange(-int(size), int(size) + 1) for _ in range(d)] for _ in range(37)]
        a = [rng.randrange(-int(size), int(size) + 1) for _ in range(d)]
        corner = [[s * int(size)] * d for s in (1, -1)]
        block = Block.of(np.arange(39), np.arange(39), np.zeros(39), np.array(y + corner, np.int64), int(size))
        for anchor in (a, *corner, [0] * d):
            assert block.scores(anchor).tolist() == [sum(p * q for p, q in zip(anchor, v, strict=True)) for v in y + corner]


def test_best_keeps_order_and_ties():
    rng = np.random.default_rng(2)
    for kind in (np.int64, object):
        best, rows = Best(4), []
        for _ in range(20):
            scores, ids = rng.integers(0, 6, 50), rng.integers(0, 9, 50)
            at = np.arange(len(rows), len(rows) + 50)
            rows += list(zip((-scores).tolist(), ids.tolist(), at.tolist(), strict=True))
            best.add(scores.astype(kind), ids, at)
        assert best.held == sorted(rows)[:4]


def test_agrees_with_a_plain_search(spark):
    rng = random.Random(4)
    rows = [(i, rng.randrange(4), [rng.gauss(0.3, 0.4) for _ in range(6)]) for i in range(300)]
    rows += [(1000 + i, 2, rows[3][2]) for i in range(150)]  # a third of all rows alike
    rows += [(7, 1, rows[7][2])] * 3 + [(None, 1, rows[9][2]), (None, 3, rows[9][2]), (50, 0, rows[50][2])]
    data = hard_negatives.prepare(frame(spark, rows).repartition(7))
    want = plain(rows, lambda i: i is not None and i % 10 == 0)
    anchors = data.where("vec_id % 10 = 0")
    assert mined(data, anchors) == want and len(want) > 100
    assert mined(data, anchors, chunk=7) == want


def test_numbers_of_many_digits(spark):
    rng = random.Random(6)
    rows = [(i, i % 2, [rng.uniform(-1, 3) * 2.0 ** 40 for _ in range(4)]) for i in range(60)]
    data = hard_negatives.prepare(frame(spark, rows))
    want = plain(rows, lambda i: i % 5 == 0)
    assert mined(data, data.where("vec_id % 5 = 0")) == want and max(r[4] for r in want) > 1 << 63


def test_rows_that_take_no_part_and_few_partners(spark):
    rows = [(0, 1, [1.0, 0.0]), (1, 1, [0.9, 0.1]), (2, 2, [0.7, 0.3]), (3, 2, [0.1, 0.0]), (4, 3, [-1.0, 0.0])]
    bad = [(5, None, [0.5, 0.5]), (6, 2, None), (8, 2, [0.6, None]), (9, 2, [math.nan, 1.0]), (10, 2, [math.inf, 1.0]), (11, 2, [0.6]), (12, 2, [1e300, 0.0])]
    data = hard_negatives.prepare(frame(spark, rows + bad))
    want = plain(rows, lambda i: i == 0)
    assert want == [(0, 1, 1, 2, 230 * 256, 179 * 256)]
    assert mined(data, data.where("vec_id = 0")) == want
    assert mined(data, data.where("vec_id = 4")) == []  # an anchor without positives
    none = hard_negatives.prepare(frame(spark, []))
    assert mined(none, none) == [] and mined(data, data.limit(0)) == []


def test_query_on_whole_tables(spark):
    sf = "/root/testdata/sf0.001"
    data = [(r.vec_id, (r.label + 1) % 10 if r.vec_id % 7 == 0 else r.label, r.embedding) for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect()]
    got = queries()["op13_hard_negatives"](spark, sf)
    assert dict(got.dtypes)["rank"] == "int" and dict(got.dtypes)["negative_score"] == "bigint"
    rows = sorted(tuple(r[c] for c in hard_negatives.RESULT[:4]) + (r.positive_score, r.negative_score) for r in got.collect())
    assert rows == sorted(plain(data, lambda i: i % 50 == 0))
