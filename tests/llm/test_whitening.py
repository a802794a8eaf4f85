import math

import numpy as np
import pytest

from ewpanel.llm.whitening import leading_eigenpairs, whiten


def expected(vectors, components):
    x = np.array([[math.floor(1024 * c) + 100_000 for c in v] for v in vectors], object)
    n, s = len(x), x.sum(0)
    centred = np.array([[float(n * a - b) / n for a, b in zip(r, s)] for r in x])
    values, axes = np.linalg.eigh(centred.T @ centred / n)
    values, axes = values[::-1], axes[:, ::-1]
    deviation = [int(sum((n * a - b) ** 2 for a, b in zip(r, s))) for r in x]
    k = min(components, int((values > 1e-12 * values[0]).sum()))
    return deviation, values[:k] / values.sum(), centred @ axes[:, :k] / np.sqrt(values[:k])


@pytest.mark.parametrize("n, dims", [(400, 40), (60, 5), (6, 12), (300, 64)])
def test_equals_a_whole_decomposition(spark, n, dims):
    rng = np.random.default_rng(n)
    v = (rng.normal(size=(n, dims)) * np.linspace(1, 0.2, dims)).astype(float)
    v[n // 2 :] = v[: n - n // 2] if n > 100 else v[n // 2 :]
    df = spark.createDataFrame([(i, r, 1.0, "x") for i, r in enumerate(v.tolist())], "vec_id long, embedding array<double>, whitened double, component string").repartition(3)
    rows = whiten(df).toPandas()
    assert list(rows.columns) == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]
    deviation, explained, values = expected(v.tolist(), 8)
    got = rows.pivot(index="vec_id", columns="component", values="whitened").to_numpy()
    sign = np.sign((got * values).sum(0))
    assert got.shape == values.shape and np.abs(got * sign - values).max() < 1e-8
    assert rows.groupby("vec_id")["deviation"].first().tolist() == deviation and (rows["n"] == n).all()
    assert np.allclose(rows.groupby("component")["explained"].first(), explained, rtol=1e-10) and rows["identity_error"].nunique() == 1 and rows["identity_error"].max() < 1e-6


def test_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    good = [(1, [0.1, 0.9, -3.0]), (1, [0.1, 0.9, -3.0]), (None, [0.5, 0.2, 7.0]), (4, [2.0]), (5, []), (6, [1e30, 0.0, -1e30])]
    bad = [(7, None), (8, [None, 1.0, 1.0]), (9, [nan, 1.0, 1.0]), (10, [1.0, -inf, 1.0])]
    rows = whiten(spark.createDataFrame(good + bad, "vec_id long, embedding array<double>")).collect()
    assert {r.vec_id for r in rows} == {1, None, 4, 5, 6} and {r.n for r in rows} == {6} and all(math.isfinite(r.whitened) for r in rows)
    assert max(r.deviation for r in rows) == (1 << 63) - 1  # beyond a long


def test_nothing_to_whiten(spark):
    of = lambda rows: whiten(spark.createDataFrame(rows, "vec_id long, embedding array<float>")).count()
    assert of([]) == 0 and of([(1, [])]) == 0 and of([(1, [1.0, 2.0])]) == 0 and of([(1, [1.0]), (2, [1.0])]) == 0
    assert of([(1, [1.0, 5.0]), (2, [2.0, 5.0])]) == 2  # one component of two


def test_filter_meets_close_and_equal_eigenvalues():
    rng = np.random.default_rng(3)
    q = np.linalg.qr(rng.normal(size=(200, 200)))[0]
    values = np.concatenate([[5, 5, 4, 3.999, 3.998, 3, 2.9, 2.89], np.linspace(2.88, 0, 192)])
    a, calls = (q * values) @ q.T, []
    got, axes, error = leading_eigenpairs(lambda x: (calls.append(1), a @ x)[1], 200, 8)
    assert np.abs(got - values[:8]).max() < 1e-12 and error < 1e-12 and np.abs(a @ axes - axes * got).max() < 1e-12
    assert len(calls) < 300
    with pytest.raises(ArithmeticError):
        leading_eigenpairs(lambda x: a @ x, 200, 8, rounds=1)


def test_deviation_near_the_greatest_long(spark):
    rows = [(i, [float(x)]) for i, x in enumerate([2_000_000, -2_000_000, 741_455.2, 741_455.1])]
    got = {r.vec_id: r.deviation for r in whiten(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()}
    x = [math.floor(1024 * v[0]) for _, v in rows]
    assert [got[i] for i in range(4)] == [min((1 << 63) - 1, (4 * a - sum(x)) ** 2) for a in x]
