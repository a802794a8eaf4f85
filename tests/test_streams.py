"""Streams over files that arrive: late rows, restarts, failures, state that ends."""

import math

import pytest
from pyspark.sql import functions as F

from ewpanel.streaming import feeds

DAY = 86400.0


@pytest.fixture
def feed(spark, tmp_path):
    """A folder to which files of (kind, day) rows are added."""
    folder = str(tmp_path / "feed")

    def add(*rows):
        df = spark.createDataFrame([(k, float(d)) for k, d in rows], "kind string, d double")
        df.select("kind", F.timestamp_seconds(F.lit(1_704_067_200) + F.col("d") * DAY).alias("ts")).coalesce(1).write.mode("append").parquet(folder)  # day 0 is a Monday
        return folder

    return add


def weeks(spark, folder, out):
    return {(r.kind, r.week.isoformat()[:10]): r.n_events for r in feeds.run_available(feeds.weekly_counts(feeds.read_stream(spark, folder), "kind", "ts"), ["kind", "week"], out).collect()}


def test_restart_goes_on_and_late_rows_are_dropped(spark, feed, tmp_path):
    out = str(tmp_path / "out")
    assert weeks(spark, feed(("a", 0), ("a", 1), ("b", 3)), out) == {("a", "2024-01-01"): 2, ("b", "2024-01-01"): 1}
    first = {("a", "2024-01-01"): 3, ("b", "2024-01-01"): 1, ("a", "2024-02-26"): 1}
    assert weeks(spark, feed(("a", 2), ("a", 60)), out) == first  # the old week is still open
    assert weeks(spark, feed(("a", 3), ("b", 4), ("a", 55)), out) == {**first, ("a", "2024-02-19"): 1}  # 14 days after its end it isn't
    assert weeks(spark, feed(), out) == {**first, ("a", "2024-02-19"): 1}  # nothing new


def intensity(spark, folder, out):
    return {r.kind: (r.intensity, r.n) for r in feeds.run_available(feeds.decaying_intensity(feeds.read_stream(spark, folder), "kind", "ts", DAY), ["kind"], out).collect()}


def level(days):
    return sum(0.5 ** (max(days) - d) for d in days)


def test_intensity_over_restarts_with_late_events_and_silence(spark, feed, tmp_path):
    out = str(tmp_path / "out")
    got = intensity(spark, feed(("a", 1), ("a", 2), ("b", 0), (None, 1)), out)
    assert got["a"] == (pytest.approx(level([1, 2])), 2) and got["b"] == (1.0, 1) and len(got) == 2
    got = intensity(spark, feed(("a", 4), ("a", 3), ("a", 1.5)), out)
    assert got["a"] == (pytest.approx(level([1, 2, 3, 4, 1.5])), 5) and got["b"] == (1.0, 1)
    intensity(spark, feed(("c", 200)), out)  # the watermark passes the timers of a and b
    got = intensity(spark, feed(("c", 201), ("a", 201)), out)
    assert got["a"] == (1.0, 1) and got["c"] == (pytest.approx(1.5), 2)


def test_failed_batch_is_run_again(spark, feed, tmp_path):
    out, folder = str(tmp_path / "out"), feed(("a", 0), ("a", 1))
    broken = feeds.read_stream(spark, folder).withColumn("ts", F.when(F.col("kind") == "a", F.raise_error(F.lit("stop"))).otherwise(F.col("ts")).cast("timestamp"))
    with pytest.raises(Exception):
        feeds.run_available(feeds.weekly_counts(broken, "kind", "ts"), ["kind", "week"], out)
    assert weeks(spark, folder, out) == {("a", "2024-01-01"): 2}
    assert math.isclose(level([0, 1]), 1.5)
