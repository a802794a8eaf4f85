"""Fold fits from sums against a fit of each fold by least squares."""

import numpy as np
import pytest

from ewpanel.operators import linear

FEATURES = ["a", "b", "c"]


@pytest.fixture(scope="module")
def rows():
    rng = np.random.default_rng(3)
    out = []
    for e in range(6):
        for t in range(40):
            a, b = float(rng.normal()), float(rng.integers(0, 5))
            y = int(rng.random() < 1 / (1 + np.exp(-a - e / 3))) if e else 0  # the first entity has one class
            out.append((f"e{e}", t, a, b, 7.0, y))
    return out + [("e1", 3, None, 1.0, 7.0, 1), ("e2", 4, 1.0, 1.0, 7.0, None), ("small", 5, 1.0, 2.0, 7.0, 1), (None, 6, 0.5, 0.0, 7.0, 1)]


@pytest.fixture(scope="module")
def df(spark, rows):
    return spark.createDataFrame(rows, "e string, t int, a double, b double, c double, y int").repartition(3)


def whole(rows):
    return [r for r in rows if r[2] is not None and r[5] is not None]


def direct(train, penalty=1.0, balanced=True):
    """Weighted ridge on standardised features, the intercept free."""
    x, y = np.array([r[2:5] for r in train]), np.array([r[5] for r in train], float)
    w = np.where(y == 1, len(y) / (2 * y.sum()), len(y) / (2 * (1 - y).sum())) if balanced else np.ones(len(y))
    m, s = np.average(x, 0, w), np.sqrt(np.average((x - np.average(x, 0, w)) ** 2, 0, w))
    z = (x - m) / np.where(s > 1e-9, s, 1)
    ym = np.average(y, weights=w)
    g = np.linalg.solve(z.T @ (w[:, None] * z) / w.sum() + (penalty / len(y)) * np.eye(3) + np.diag((s <= 1e-9) * 1.0), z.T @ (w * (y - ym)) / w.sum())
    return lambda r: float(np.clip(ym + (np.array(r[2:5]) - m) / np.where(s > 1e-9, s, 1) @ g, 0, 1))


@pytest.mark.parametrize("balanced", [True, False])
def test_leave_one_out_is_a_fit_of_all_others(df, rows, balanced):
    got = linear.leave_one_out_scores(df, "e", FEATURES, "y", balanced=balanced).collect()
    assert {r.e for r in got} == {f"e{i}" for i in range(1, 6)} and len(got) == 200
    for e in ("e1", "e5"):
        model = direct([r for r in whole(rows) if r[0] != e], balanced=balanced)
        for r in [r for r in got if r.e == e]:
            assert abs(r.prob - model(tuple(r)[:6] if r[0] == "e" else (r.e, r.t, r.a, r.b, r.c, r.y))) < 1e-9 and r.train_rows == len([x for x in whole(rows) if x[0] != e])


@pytest.mark.parametrize("embargo", [0, 1, 3])
def test_rolling_fits_see_the_past_alone(df, rows, embargo):
    got = linear.rolling_scores(df, "t", FEATURES, "y", 10, embargo).collect()
    assert {r.t for r in got} == set(range(10, 40)) and all(r.fold_id == r.t for r in got)
    for t in (10, 25):
        train = [r for r in whole(rows) if r[1] < t - embargo]
        model = direct(train)
        for r in [r for r in got if r.t == t]:
            assert abs(r.prob - model((r.e, r.t, r.a, r.b, r.c, r.y))) < 1e-9 and (r.train_rows, r.train_pos) == (len(train), sum(x[5] for x in train))


def test_future_rows_change_no_earlier_score(spark, df):
    changed = df.selectExpr("e", "t", "CASE WHEN t > 20 THEN 100 * a ELSE a END a", "b", "c", "CASE WHEN t > 20 THEN 1 - y ELSE y END y")
    score = lambda d: {(r.e, r.t, r.a): r.prob for r in linear.rolling_scores(d, "t", FEATURES, "y", 10).where("t <= 20").collect()}
    assert score(df) == score(changed) != {}


def test_blocks_use_the_model_before_their_first_period(df, rows):
    got = linear.block_scores(df, "t", FEATURES, "y", 10, 3, embargo=1, least_train=20).collect()
    assert {r.t for r in got} == set(range(10, 40)) and {r.fold_id for r in got} == {0, 1, 2}
    for fold, t in ((0, 10), (2, 30)):
        model = direct([r for r in whole(rows) if r[1] < t - 1])
        assert all(abs(r.prob - model((r.e, r.t, r.a, r.b, r.c, r.y))) < 1e-9 for r in got if r.fold_id == fold)
    assert linear.block_scores(df, "t", FEATURES, "y", 10, 3, least_train=10_000).count() == 0


def test_jobs_do_not_follow_the_folds(spark, df):
    def jobs(d, group):
        spark.sparkContext.setJobGroup(group, group)
        linear.rolling_scores(d, "t", FEATURES, "y", 10).write.format("noop").mode("overwrite").save()
        return len(spark.sparkContext.statusTracker().getJobIdsForGroup(group))

    many = df.union(df.selectExpr("e", "t + 40", "a", "b", "c", "y")).union(df.selectExpr("e", "t + 80", "a", "b", "c", "y"))
    assert jobs(many, "many") < jobs(many.where("t < 13"), "few") + 10  # 110 folds and 3; adaptive plans differ by a few jobs


def test_empty_and_one_class(spark, df):
    assert linear.leave_one_out_scores(df.limit(0), "e", FEATURES, "y").count() == 0
    assert linear.rolling_scores(df.where("y = 0"), "t", FEATURES, "y", 1).count() == 0
