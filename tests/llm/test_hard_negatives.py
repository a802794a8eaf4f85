import math
import os
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from ewpanel.llm.common import shared_dir
from ewpanel.llm.hard_negatives import Slots, mine

LONG = (1 << 63) - 1


def brute(rows, n_pos, n_neg, low):
    good = lambda v: v is not None and all(x is not None and math.isfinite(x) for x in v)
    kept = [(i, y, [math.floor(256 * x) for x in v]) for i, v, y in rows if i is not None and y is not None and good(v)]
    anchors = {}
    for i, y, v in kept:
        if i % 100 == 0:
            anchors[i] = min((v, y), anchors.get(i, (v, y)))
    cut = lambda s: max(-LONG - 1, min(LONG, s))
    out = []
    for i, (v, y) in anchors.items():
        scored = [(-cut(sum(a * b for a, b in zip(v, w))), j, z) for j, z, w in kept if j != i]
        for s, j, _ in sorted(t for t in scored if t[2] == y)[:n_pos]:
            window = sorted((t, k) for t, k, z in scored if z != y and low * -s <= 100 * -t <= 100 * -s)[:n_neg]
            out += [(i, j, r + 1, k, -s, -t) for r, (t, k) in enumerate(window)]
    return sorted(out)


@pytest.mark.parametrize("n, dims, spread", [(900, 16, 0.1), (700, 3, 0.3), (40, 5, 1.0)])
def test_against_all_pairs(spark, n, dims, spread):
    rng = random.Random(n)
    centres = [[rng.gauss(0, 1) for _ in range(dims)] for _ in range(8)]
    rows = [(i, [c + rng.gauss(0, spread) for c in centres[i % 8]], (i % 8 + rng.randint(0, 1)) // 2 - 1) for i in range(n)]
    rows += [(i + n, rows[7][1], rows[7][2] + i % 2) for i in range(n // 3)]  # a hot vector, ties
    rows += [(None, rows[0][1], 1), (10_000, None, 1), (10_100, [None] * dims, 1), (10_200, [float("nan")] * dims, 1), (10_300, [float("inf")] * dims, 1),
             (10_400, [], 1), (10_500, [0.5], 2), (10_600, rows[3][1], None), (0, rows[5][1], 0), (100, rows[1][1], rows[1][2]), (101, rows[1][1], 9), (101, rows[1][1], 9)]
    df = spark.createDataFrame([(i, v, y, "x", 1) for i, v, y in rows], "vec_id long, embedding array<double>, label int, slab string, block int")
    got = mine(df, block_rows=32, slab_rows=64)
    assert got.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"] and dict(got.dtypes)["rank"] == "int"
    assert sorted(map(tuple, got.collect())) == brute(rows, 5, 5, 80)


def test_scores_beyond_doubles_and_longs(spark):
    rng = random.Random(4)
    rows = [(i, [rng.choice((-1, 1)) * 10.0 ** rng.randint(0, 13), rng.random() * 1e9], i % 3) for i in range(0, 30)] + [(100, [1e8 + 1, 3.0], 1), (200, [1e14, 1e14], 0)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    assert sorted(map(tuple, mine(df, "vec_id % 100 = 0", 3, 4, block_rows=8).collect())) == brute(rows, 3, 4, 80)


def test_empty_and_without_anchors(spark):
    df = spark.createDataFrame([(1, [1.0], 1), (2, [1.0], 2)], "vec_id long, embedding array<double>, label int")
    assert mine(df).count() == 0 and mine(df.limit(0)).count() == 0
    assert mine(spark.createDataFrame([(0, [1.0], 1), (2, [1.0], 2)], df.schema)).count() == 0  # an anchor without positives


def test_bounds_hold_every_product_and_skip_far_blocks():
    rng = np.random.default_rng(2)
    a, block = rng.normal(size=(5, 6)) * 100, rng.normal(size=(40, 6)) * 100
    make = lambda known: Slots(np.arange(5), np.zeros(5, np.int64), a, np.zeros(5, np.int64), np.arange(5), np.full(5, -np.inf), np.full(5, np.inf), np.full(5, known), True, 3)
    below, above = make(-np.inf).bounds(block.min(0)[None, :], block.max(0)[None, :])
    assert (below <= (a @ block.T).min(1)[:, None]).all() and (above >= (a @ block.T).max(1)[:, None]).all()
    zone = (block.min(0)[None, :], block.max(0)[None, :], np.array([(1 << 64) - 1], np.uint64), np.array([0]), np.array([True]))
    assert make(-np.inf).wanted(*zone).all() and not make(1e9).wanted(*zone).any()


def test_only_the_result_stays(spark):
    folder = shared_dir(spark).removeprefix("file://")
    before = set(os.listdir(folder))
    df = spark.createDataFrame([(i, [float(i % 7), 1.0], i % 2) for i in range(0, 300)], "vec_id long, embedding array<double>, label int")
    mine(df).count()
    assert len(set(os.listdir(folder)) - before) == 1
    with pytest.raises(Exception):
        mine(df, F.col("vec_id") % F.raise_error(F.lit("stop")) == 0)
    assert len(set(os.listdir(folder)) - before) == 1
