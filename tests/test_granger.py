"""Granger tests by elimination on sums against least squares of the rows."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from ewpanel.operators import stats


def by_rows(a, b, k):
    n = len(a) - k
    own = np.column_stack([np.ones(n), *[a[k - i : len(a) - i] for i in range(1, k + 1)]])
    more = np.column_stack([own, *[b[k - i : len(b) - i] for i in range(1, k + 1)]])
    rss = [float(((a[k:] - m @ np.linalg.lstsq(m, a[k:], rcond=None)[0]) ** 2).sum()) for m in (own, more)]
    free = n - 2 * k - 1
    f = (rss[0] - rss[1]) / k / (rss[1] / free)
    return stats.f_tail(f, k, free), k, f, n


def test_tail_columns_equal_the_continued_fraction(spark):
    cases = [(f, b) for f in (0.0, 0.01, 0.7, 3.9, 25.0) for b in (1, 2, 3, 4, 7, 30, 401)]
    df = spark.createDataFrame([(f, float(b)) for f, b in cases], "f double, b double")
    for r in df.select("f", "b", stats.f_tail_column(F.col("f"), 1, F.col("b")).alias("one"), stats.f_tail_column(F.col("f"), 2, F.col("b")).alias("two")).collect():
        assert r.one == pytest.approx(stats.f_tail(r.f, 1, int(r.b)), abs=1e-12), (r.f, r.b)
        assert r.two == pytest.approx(stats.f_tail(r.f, 2, int(r.b)), abs=1e-12), (r.f, r.b)
    assert spark.range(1).select(stats.f_tail_column(F.lit(None).cast("double"), 1, F.lit(3.0))).first()[0] is None


def test_two_lags_equal_least_squares(spark):
    rng = np.random.default_rng(11)
    series = {}
    for e, n in (("a", 40), ("b", 12), ("c", 11), ("d", 90), ("high", 60)):
        x = rng.poisson(3, n).astype(float)
        y = np.zeros(n)
        for t in range(n):
            y[t] = 2 + (0.3 * y[t - 1] if t else 0) + (0.5 * x[t - 2] if t > 1 and e != "d" else 0) + rng.normal()
        series[e] = (y + (1e6 if e == "high" else 0), x)
    rows = [(e, i, float(y[i]), float(x[i])) for e, (y, x) in series.items() for i in range(len(y))]
    rows += [("flat", i, 5.0, float(i)) for i in range(30)] + [("holes", i, None if i % 3 else 1.0, 2.0) for i in range(30)] + [(None, 1, 1.0, 1.0)]
    got = {r.e: r for r in stats.ssr_granger(spark.createDataFrame(rows, "e string, t int, y double, x double"), "e", "t", "y", "x", 2).collect()}
    assert set(got) == {"a", "b", "d", "high"}  # c has 11 periods, flat no rest, holes 10 periods
    for e, r in got.items():
        p, k, f, n = min(by_rows(*series[e], k) for k in (1, 2))
        assert (r.lag, r.n) == (k, n) and r.f == pytest.approx(f, rel=1e-6) and math.isclose(r.p, p, rel_tol=1e-6, abs_tol=1e-12)


def test_a_constant_candidate_says_nothing(spark):
    rng = np.random.default_rng(2)
    rows = [("a", i, float(v), 4.0) for i, v in enumerate(rng.normal(size=30))]
    r = stats.ssr_granger(spark.createDataFrame(rows, "e string, t int, y double, x double"), "e", "t", "y", "x", 2).first()
    assert r.p == pytest.approx(1.0) and r.f == pytest.approx(0.0, abs=1e-9)
    assert stats.ssr_granger(spark.createDataFrame([], "e string, t int, y double, x double"), "e", "t", "y", "x", 2).count() == 0


def test_pooled_test_needs_twenty_rows(spark):
    rows = [(e, float(i), float(i % 3), float(i % 4)) for e in "ab" for i in range(9)]
    df = spark.createDataFrame(rows, "e string, y double, y1 double, x1 double")
    assert stats.pooled_effects_ftest(df, "e", "y", ["y1"], "x1") == {"f": None, "p": None, "r2": None, "coef": None, "n": 18}
    assert stats.pooled_effects_ftest(df, "e", "y", ["y1"], "x1", least=10)["p"] is not None
