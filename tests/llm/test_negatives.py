"""Mined negatives against every pair scored in plain Python; bounds against exact scores."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from monthwise.llm import negatives

SCHEMA = "vec_id long, label int, embedding array<float>, score string, a string, `g.h` string"


def plain(rows, every, n_positives=5, n_negatives=3, percent=(50, 95)):
    one = {}
    for vec_id, label, vector, *_ in rows:
        if vec_id is None or label is None or vector is None or any(x is None or not math.isfinite(x) for x in vector):
            continue
        v = [max(min(math.floor(x * 256), negatives.MOST), -negatives.MOST) for x in (float(np.float32(x)) for x in vector)]
        one[vec_id] = min(one.get(vec_id, (label, v)), (label, v))
    out = []
    for anchor, (label, v) in one.items():
        if anchor % every:
            continue
        scored = sorted((-sum(x * y for x, y in zip(v, w)), i, own == label) for i, (own, w) in one.items() if i != anchor)
        for s, i, _ in [x for x in scored if x[2]][:n_positives]:
            found = [(t, j) for t, j, same in scored if not same and percent[0] * -s <= 100 * -t <= percent[1] * -s][:n_negatives]
            out += [(anchor, i, k + 1, j, -s, -t) for k, (t, j) in enumerate(found)]
    return sorted(out)


def mined(spark, rows, every, **more):
    got = negatives.mine(spark.createDataFrame(rows, SCHEMA).repartition(3), F.col("vec_id") % every == 0, **more).collect()
    return sorted((r.anchor_id, r.positive_id, r.rank, r.negative_id, r.positive_score, r.negative_score) for r in got)


def table(seed, n, dims, labels=3, copies=0.3, spread=1.0):
    rng = random.Random(seed)
    centres = [[rng.gauss(0, spread) for _ in range(dims)] for _ in range(labels)]
    hot = [rng.gauss(0.2, 0.1) for _ in range(dims)]
    vector = lambda label: hot if rng.random() < copies else [c * 0.4 + rng.gauss(0, 0.2) for c in centres[label]]
    return [(i, label, vector(label), "s", "a", "h") for i in range(n) for label in [rng.randrange(labels)]]


@pytest.mark.parametrize("seed, dims, copies", [(1, 16, 0.0), (2, 8, 0.4), (3, 3, 0.0)])
def test_equals_every_pair(spark, seed, dims, copies):
    rows = table(seed, 700, dims, copies=copies)
    want = plain(rows, 20)
    assert mined(spark, rows, 20) == want and len(want) > 50


def test_small_blocks_and_other_numbers(spark, monkeypatch):
    for name, value in (("BLOCK_ROWS", 40), ("STEP", 16), ("ANCHORS", 7), ("GROUP_BYTES", 4000), ("PAIR_VALUES", 64)):
        monkeypatch.setattr(negatives, name, value)
    rows = table(5, 400, 6)
    assert mined(spark, rows, 10, n_positives=2, n_negatives=4, percent=(10, 80)) == plain(rows, 10, 2, 4, (10, 80))


def test_rows_that_take_no_part_lengths_and_repeats(spark):
    rows = table(6, 120, 4)
    rows += [(None, 1, [1.0] * 4, "", "", ""), (200, None, [1.0] * 4, "", "", ""), (210, 1, None, "", "", ""), (220, 1, [1.0, None], "", "", ""), (230, 1, [float("nan")] * 4, "", "", ""), (240, 2, [float("-inf")] * 4, "", "", "")]
    rows += [(250, 1, [], "", "", ""), (260, 0, [0.5] * 9, "", "", ""), (270, 0, [3e38, -3e38, 1.0], "", "", ""), (280, 2, [0.0] * 4, "", "", ""), (290, 77, [0.1] * 4, "", "", "")]
    rows += [rows[10], (20, 0, [9.0] * 4, "", "", ""), (20, 2, [-9.0] * 4, "", "", ""), (-30, 1, [0.3] * 4, "", "", "")]
    want = plain(rows, 10)
    assert mined(spark, rows, 10) == want and any(r[0] == -30 for r in want)


def test_bounds_hold_and_few_rows_are_scored():
    rng = np.random.default_rng(4)
    x = rng.normal(0, 40, (3000, 32)).astype(np.int32)
    lengths, starts = np.full(3000, 32), np.arange(3000) * 32
    block = negatives.Rows.of(negatives._block(0, 0, np.arange(3000), rng.integers(0, 4, 3000), np.zeros(3000, np.int8), x.ravel(), lengths, starts))
    anchors = negatives.Rows.of(negatives._block(0, 0, np.arange(20), block.labels[:20], np.ones(20, np.int8), x[:20].ravel(), lengths[:20], starts[:20]))
    scores = x.astype(np.int64) @ x[:20].T.astype(np.int64)
    for part, lower, upper in negatives.bounds(block, anchors):
        assert (lower <= scores[part]).all() and (scores[part] <= upper).all()
    asked = []
    count, negatives.exact = negatives.exact, lambda *a: (asked.append(len(a[2])), count(*a))[1]
    try:
        best = negatives.nearest(iter([block]), anchors, 5)
    finally:
        negatives.exact = count
    assert sum(asked) < 3000 * 20 / 20 and len(best.id) == 100


def test_empty_tables(spark):
    assert mined(spark, [], 10) == [] and mined(spark, [(1, 1, [1.0], "", "", "")], 10) == []
