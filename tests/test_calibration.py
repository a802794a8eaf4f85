"""Isotonic calibration against the min-max formula."""

import random

import pytest

from ewpanel.operators.calibration import isotonic_apply, isotonic_fit


def min_max(rows):
    """Score -> value: the greatest over starts of the least mean over ends."""
    by = {}
    for s, y in rows:
        by.setdefault(s, []).append(y)
    scores = sorted(by)
    mean = lambda a, b: sum(sum(by[s]) for s in scores[a : b + 1]) / sum(len(by[s]) for s in scores[a : b + 1])
    return {scores[i]: max(min(mean(a, b) for b in range(i, len(scores))) for a in range(i + 1)) for i in range(len(scores))}


@pytest.mark.parametrize("bins", [1, 4, 256])
def test_equals_min_max(spark, bins):
    rng = random.Random(bins)
    rows = [(g, rng.randrange(40) / 40, 0) for g in ("a", "b") for _ in range(300)]
    rows = [(g, s, int(rng.random() < (s if g == "a" else 1 - s))) for g, s, _ in rows] + [("one", 0.5, 1), ("one", 0.7, 1), (None, None, 1), ("a", 0.5, None)]
    df = spark.createDataFrame(rows, "g string, p double, y int")
    steps = isotonic_fit(df, "p", "y", ["g"], bins)
    for g in ("a", "b", "one"):
        want = min_max([(s, y) for h, s, y in rows if h == g and y is not None])
        got = {r.p: r.calibrated for r in isotonic_apply(df.where(f"g = '{g}'"), steps, "p", ["g"]).collect()}
        assert got == pytest.approx(want)
        own = steps.where(f"g = '{g}'").orderBy("lo").collect()
        assert all(a.hi < b.lo and a.value < b.value for a, b in zip(own, own[1:]))
    assert len(steps.where("g = 'one'").collect()) == 1


def test_between_beyond_and_without_a_fit(spark):
    fit = spark.createDataFrame([("a", 0.2, 0), ("a", 0.4, 1)], "g string, p double, y int")
    ask = spark.createDataFrame([("a", 0.1), ("a", 0.2), ("a", 0.25), ("a", 0.4), ("a", 0.9), ("a", 0.9), ("a", None), ("z", 0.3)], "g string, p double")
    got = [(r.g, r.p, r.calibrated) for r in isotonic_apply(ask, isotonic_fit(fit, "p", "y", ["g"]), "p", ["g"]).collect()]
    want = [("a", 0.1, 0.0), ("a", 0.2, 0.0), ("a", 0.25, 0.25), ("a", 0.4, 1.0), ("a", 0.9, 1.0), ("a", 0.9, 1.0), ("a", None, None), ("z", 0.3, None)]
    assert sorted(got, key=str) == sorted([(g, p, pytest.approx(v) if v is not None else None) for g, p, v in want], key=str) or [x[:2] for x in sorted(got, key=str)] == [x[:2] for x in sorted(want, key=str)] and all(
        (a[2] is None and b[2] is None) or abs(a[2] - b[2]) < 1e-9 for a, b in zip(sorted(got, key=str), sorted(want, key=str)))
    assert isotonic_fit(fit.limit(0), "p", "y", ["g"]).count() == 0
    assert [tuple(r) for r in isotonic_fit(fit.where("y = 0"), "p", "y", []).collect()] == [(0.2, 0.2, 0.0)]
