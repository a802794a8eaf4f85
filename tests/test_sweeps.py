import threading
import time

import pytest

from ewpanel.operators import sweeps


def rows(df):
    return [tuple(r) for r in df.orderBy("position").select("name", "run", "value", "best_so_far").collect()]


CONFIGS = [{"name": n, "v": v} for n, v in (("a", 1), ("b", 4), ("c", 0), ("d", 2))]


def fit(c):
    return {"score": 1 / c["v"], "n": c["v"]}


def test_errors_are_rows_and_best_runs_on(spark, tmp_path):
    got = sweeps.sweep(spark, CONFIGS, fit, str(tmp_path / "log"), "score")
    assert rows(got) == [("a", 1, 1.0, 1.0), ("b", 1, 0.25, 1.0), ("c", 1, None, 1.0), ("d", 1, 0.5, 1.0)]
    (c,) = got.where("name = 'c'").collect()
    assert c.error.startswith("ZeroDivisionError") and c.metrics is None
    (b,) = got.where("name = 'b'").collect()
    assert b.metrics == {"score": 0.25, "n": 4.0} and b.error is None


def test_resumes_from_the_log(spark, tmp_path):
    path, ran = str(tmp_path / "log"), []
    sweeps.sweep(spark, CONFIGS[:2], fit, path, "score")
    got = sweeps.sweep(spark, CONFIGS, lambda c: ran.append(c["name"]) or fit(c), path, "score")
    assert sorted(ran) == ["c", "d"] and [r[1] for r in rows(got)] == [1, 1, 2, 2]
    assert sweeps.pending(spark, CONFIGS, path) == [] and [c["name"] for c in sweeps.pending(spark, CONFIGS, path, True)] == ["c"]
    got = sweeps.sweep(spark, CONFIGS, lambda c: {"score": 9}, path, "score", again=True)
    assert rows(got)[2] == ("c", 3, 9.0, 9.0) and rows(got)[3] == ("d", 2, 0.5, 9.0)


def test_what_ended_before_a_loss_is_logged(spark, tmp_path):
    path = str(tmp_path / "log")

    def lost(c):
        if c["name"] == "c":
            raise KeyboardInterrupt  # no Exception: ends the call
        return fit(c)

    with pytest.raises(KeyboardInterrupt):
        sweeps.sweep(spark, CONFIGS, lost, path, "score", side_by_side=1)
    done = {r.name for r in sweeps.read_log(spark, path).collect()}
    assert {"a", "b"} <= done and "c" not in done
    assert rows(sweeps.sweep(spark, CONFIGS, lambda c: {"score": c["v"]}, path, "score"))[2][1:3] == (2, 0.0)


def test_fits_run_side_by_side_in_pools(spark, tmp_path):
    seen, at_once, lock, now = set(), [], threading.Lock(), []

    def slow(c):
        with lock:
            now.append(1)
            at_once.append(len(now))
        seen.add(spark.sparkContext.getLocalProperty("spark.scheduler.pool"))
        n = spark.range(100).count()
        time.sleep(0.5)
        with lock:
            now.pop()
        return {"score": n}

    sweeps.sweep(spark, CONFIGS, slow, str(tmp_path / "log"), "score", side_by_side=2)
    assert max(at_once) == 2 and seen == {"sweep-0", "sweep-1"}
    assert spark.sparkContext.getLocalProperty("spark.scheduler.pool") is None


def test_odd_values_and_no_configurations(spark, tmp_path):
    path = str(tmp_path / "log")
    assert sweeps.sweep(spark, [], fit, path, "score").count() == 0
    got = sweeps.sweep(spark, [{"name": 'odd "name"\n, x'}], lambda c: {"score": None, "other": 1}, path, "score")
    assert rows(got) == [('odd "name"\n, x', 1, None, None)]
    with pytest.raises(ValueError):
        sweeps.sweep(spark, [{"name": "x"}, {"name": "x"}], fit, path, "score")
