"""Nearest neighbours by pivots against all pairs."""

import numpy as np
import pyarrow as pa
import pytest

from ewpanel.operators import retrieval
from ewpanel.operators.retrieval import PivotCells, _best, _in_own_cell, _points_of, nearest, visits


def brute(rows, k):
    out = []
    for i, v in rows:
        own = sorted((round(float(((np.array(v) - np.array(w)) ** 2).sum()), 9), j) for j, w in rows if j != i)[:k]
        out += [(i, j, d) for d, j in own]
    return sorted(out)


def clustered(n, dims, seed=1, clusters=12):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(clusters, dims)) * 10
    return [(i, (centres[i % clusters] + rng.normal(size=dims) * 0.3).round(3).tolist()) for i in range(n)]


@pytest.mark.parametrize("n, dims, k, block", [(400, 4, 5, 2048), (300, 8, 7, 16), (120, 2, 3, 8), (3, 2, 7, 4)])
def test_against_all_pairs(spark, n, dims, k, block):
    rows = clustered(n, dims)
    rows += [(n + i, rows[2][1]) for i in range(n // 3)]  # a hot vector
    rows += [(2 * n + i, [float(i % 3)] * dims) for i in range(20)]  # ties
    df = spark.createDataFrame(rows, "id long, x array<double>").repartition(5)
    got = nearest(df, "id", "x", k, block=block)
    assert got.columns == ["u", "w", "distance"]
    assert sorted(map(tuple, got.collect())) == brute(rows, k)


def test_nulls_and_empty(spark):
    df = spark.createDataFrame([(1, [0.0]), (2, None), (None, [1.0]), (3, [2.0]), (4, [2.5])], "id long, x array<double>")
    assert sorted(map(tuple, nearest(df, "id", "x", 1).collect())) == [(1, 3, 4.0), (3, 4, 0.25), (4, 3, 0.25)]
    assert nearest(df.limit(0), "id", "x", 2).count() == 0 and nearest(df.where("id = 1"), "id", "x", 2).count() == 0


def test_clusters_are_compared_among_themselves(spark):
    n, k = 3000, 8
    df = spark.createDataFrame(clustered(n, 6, clusters=30), "id long, x array<double>")
    cells = PivotCells(_points_of(df.selectExpr("id u", "x v"), k), None, 2048, 7)
    near = _best(_in_own_cell(cells, k), k).drop("_k")
    asked = {r["cell"]: r["count"] for r in visits(cells, near, k).groupBy("cell").count().collect()}
    compared = int((cells.count.astype(float) ** 2).sum()) + sum(m * int(cells.count[c]) for c, m in asked.items())
    assert cells.count.sum() == n and compared < n * n / 10


def test_points_without_clusters_are_compared_in_blocks(spark, monkeypatch):
    rows = [(i, v) for i, v in enumerate(np.random.default_rng(5).normal(size=(500, 24)).round(3).tolist())]
    monkeypatch.setattr(retrieval, "visits", None)  # a copy of a point for each cell is not made
    assert sorted(map(tuple, nearest(spark.createDataFrame(rows, "id long, x array<double>"), "id", "x", 7, block=64).collect())) == brute(rows, 7)


def test_a_batch_of_visits_stays_small(spark):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(np.random.default_rng(5).normal(size=(2000, 24)).tolist())], "id long, x array<double>").coalesce(1)
    cells = PivotCells(_points_of(df.selectExpr("id u", "x v"), 8), None, 2048, 7)
    near = _best(_in_own_cell(cells, 8), 8).drop("_k")
    assert retrieval._visits_of_cells(cells, near, 8).sum() == visits(cells, near, 8).count() > 10 * 2000
    sizes = visits(cells, near, 8).mapInArrow(lambda batches: (pa.RecordBatch.from_arrays([pa.array([b.num_rows])], ["n"]) for b in batches), "n long")
    assert sizes.agg({"n": "max"}).first()[0] <= 10000
