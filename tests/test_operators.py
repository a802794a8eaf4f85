"""Hand-computed boundaries and invariants."""

import datetime
import math

import pytest
from pyspark.sql import functions as F

from ewpanel.functions import keys, text
from ewpanel.operators import graph, joins, metrics, models, panel, windows

DAY = datetime.date


def one(df, *columns):
    return [tuple(r) for r in df.select(*columns).collect()]


def test_weeks_start_on_monday_and_end_on_sunday(spark):
    df = spark.createDataFrame([(DAY(2026, 8, 2),), (DAY(2026, 8, 3),)], "d date")
    assert one(df, keys.week_monday(F.col("d")), keys.week_sunday(F.col("d"))) == [(DAY(2026, 7, 27), DAY(2026, 8, 2)), (DAY(2026, 8, 3), DAY(2026, 8, 9))]


def test_age_windows_exclude_the_issue_day_and_end_at_their_length(spark):
    ages = [0, 1, 30, 31, 60, 61, 90, 91, 365, 366, -1, -10, -11]
    events = spark.createDataFrame([(1, 1000 - a, 1, 1000 - a, 3, 7, i) for i, a in enumerate(ages)], "g int, day long, w int, event_day long, type_of_violence long, best long, id long")
    issues = spark.createDataFrame([(1, 1000)], "g int, i long")
    cols = ["w", "event_day", "type_of_violence", "best", "id"]
    r = windows.around_issues(events, issues, "g", "day", "i", {**windows.age_counts((30, 60, 90, 365)), **windows.forward_labels((9, 10))}, cols).first()
    assert (r.count_30d, r.count_60d, r.count_90d, r.count_365d) == (2, 4, 6, 8)
    assert (r.label_9, r.type_10, r.severe_10) == (1, 3, 1)


def test_no_look_ahead(spark):
    events = spark.createDataFrame([(1, d, 1) for d in range(900, 1100, 7)], "g int, day long, w int")
    issues = spark.createDataFrame([(1, 1000)], "g int, i long")
    features = {**windows.age_counts((30, 365)), **windows.cusum_frames()}
    a = windows.around_issues(events, issues, "g", "day", "i", features, ["w"]).first()
    b = windows.around_issues(events.where("day < 1000"), issues, "g", "day", "i", features, ["w"]).first()
    assert a == b
    assert windows.hawkes(events, issues, "g", "day", "i").first() == windows.hawkes(events.where("day < 1000"), issues, "g", "day", "i").first()


def test_hawkes_bounds(spark):
    events = spark.createDataFrame([(1, 1000 - a) for a in (0, 1, 200, 201)], "g int, day long")
    got = windows.hawkes(events, spark.createDataFrame([(1, 1000), (2, 1000)], "g int, i long"), "g", "day", "i", (3,)).collect()
    assert {r.g: round(r.hawkes_3, 12) for r in got} == {1: round(2 ** (-1 / 3) + 2 ** (-200 / 3), 12), 2: 0.0}


def test_baseline_needs_four_and_zero_deviation_gives_no_label(spark):
    rows = [("a", DAY(2024, 1, 1) + datetime.timedelta(7 * k), v) for k, v in enumerate([2.0, 2.0, 2.0, 2.0, 9.0, 9.0])]
    df = panel.trailing(spark.createDataFrame(rows, "c string, week date, x double"), ["x"], "c", "week")
    got = one(df.orderBy("week"), "mean_x", panel.either(panel.zscore(F.col("x"), F.col("mean_x"), F.col("std_x")) > 1.5))
    assert [g[0] for g in got[:5]] == [None] * 4 + [2.0]
    assert [g[1] for g in got] == [0, 0, 0, 0, 0, 1]


def test_spine_fills_gaps_with_zero(spark):
    df = spark.createDataFrame([("a", DAY(2024, 1, 1), 3), ("a", DAY(2024, 1, 22), 4), ("b", DAY(2024, 1, 8), 1)], "c string, week date, n int")
    assert sorted(one(panel.dense(df, "c", "week", ["n"]), "c", "n")) == [("a", 0), ("a", 0), ("a", 3), ("a", 4), ("b", 1)]


def test_pair_stats_drop_loops_nulls_and_reversed_pairs(spark):
    df = spark.createDataFrame([(1, "a", "b"), (1, "b", "a"), (1, "a", "a"), (1, None, "c"), (1, "a", "c"), (2, None, None)], "k int, x string, y string")
    assert sorted(one(graph.pair_stats(df, ["k"], "x", "y"), "k", "n_edges", F.round("density", 6), "top_degree_share")) == [(1, 2, 0.666667, 0.5), (2, 0, 0.0, 0.0)]


def test_hyperedges_of_one_are_dropped_and_missing_columns_fail(spark):
    nodes = spark.createDataFrame([("n1", "a"), ("n2", "a"), ("n3", "b")], "node string, country string")
    assert sorted(one(graph.incidence(nodes, "node", {"country": ["country"]}), "node_id")) == [("n1",), ("n2",)]
    with pytest.raises(ValueError):
        graph.incidence(nodes, "node", {"region_week": ["region"]})


def test_rings_stop_at_the_edge_of_the_grid(spark):
    df = spark.createDataFrame([(720,), (100_000,)], "g long")
    sizes = one(df, F.size(keys.ring(F.col("g"), 1)), F.size(keys.ring(F.col("g"), 2)))
    assert sizes == [(5, 9), (8, 16)]


def test_terms_and_themes(spark):
    df = spark.createDataFrame([("Skill to kill. KILL! on Tuesday, tue", "a;b;a;;c;d;e;f;g;h;i;j;k")], "t string, th string")
    assert one(df, text.term_count(F.col("t"), ["kill", "tue"]), text.first_themes(F.col("th"))) == [(3, list("abcdefghi"))]


def test_nearest_event_ties_and_absence(spark):
    df = spark.createDataFrame([("a", DAY(2024, 1, 10)), ("b", DAY(2024, 1, 10)), ("c", DAY(2024, 1, 10))], "k string, d date")
    cal = spark.createDataFrame([("a", DAY(2024, 1, 15), 2), ("a", DAY(2024, 1, 5), 1), ("b", DAY(2024, 1, 15), 1), ("b", DAY(2024, 1, 5), 2)], "k string, e date, o int")
    assert sorted(one(joins.nearest_event(df, cal, "k", "d", "e", "o"), "k", "days_to_nearest", "near")) == [("a", -5, 1), ("b", 5, 1), ("c", 9999, 0)]


@pytest.mark.parametrize("rows, ap, auc", [
    ([(0.9, 1), (0.8, 0), (0.7, 1), (0.1, 0)], 5 / 6, 0.75), ([(0.5, 1), (0.5, 0)], 0.5, 0.5), ([(0.5, 0)], None, None), ([(0.5, 1)], None, None)])
def test_ranking_metrics(spark, rows, ap, auc):
    got = metrics.ranking(spark.createDataFrame(rows, "prob double, actual int"), []).first()
    assert (got.average_precision, got.roc_auc) == (pytest.approx(ap) if ap else None, pytest.approx(auc) if auc else None)


def test_threshold_rules(spark):
    df = spark.createDataFrame([(i, (100 - i) / 100, int(i % 3 == 0 or i < 6)) for i in range(30)], "id long, prob double, actual int")
    a = {r.target: r.threshold for r in metrics.lowest_reaching(df, [0.5, 0.999], []).collect()}
    assert a == {0.5: 0.73, 0.999: 0.94}  # 14 of 28 and 7 of 7
    b = metrics.lowest_or_closest(df.where("actual = 0"), 0.8, []).first()
    assert (b.reached, b.threshold) == (0, 0.93)
    c, strict = (metrics.scan_until_below(df, 0.6, [], "id", strict=s).first().threshold for s in (False, True))
    assert strict == pytest.approx(c + 0.01)


def test_model_finds_a_planted_signal(spark):
    rows = [(float(i % 10), float((i * 7) % 13), int(i % 10 >= 7)) for i in range(400)]
    df = spark.createDataFrame(rows, "a double, b double, y int")
    for kinds in (("logistic",), ("forest", "boosted")):
        scored = models.fit_score(df, df, ["a", "b"], "y", kinds, rounds=3, trees=5)
        low, high, auc = scored.agg(F.min("prob"), F.max("prob"), F.lit(1)).first()
        assert 0 <= low < high <= 1
        assert metrics.ranking(scored.select("prob", F.col("y").alias("actual")), []).first().roc_auc > 0.95


def test_stream_equals_batch(spark, tmp_path):
    from ewpanel.streaming import feeds

    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet").select("event_type", "ts")
    src = str(tmp_path / "src")
    events.orderBy("ts").coalesce(1).write.parquet(src)
    stream = spark.readStream.schema(events.schema).parquet(src)
    for k, f in enumerate((feeds.weekly_counts, feeds.sliding_counts)):
        q = f(stream, "event_type", "ts").writeStream.format("memory").queryName(f"counts{k}").outputMode("complete").option("checkpointLocation", str(tmp_path / f"c{k}")).start()
        q.processAllAvailable()
        q.stop()
        assert sorted(map(tuple, spark.table(f"counts{k}").collect())) == sorted(map(tuple, f(events, "event_type", "ts").collect()))
    for r in feeds.run_available(feeds.decaying_intensity(stream, "event_type", "ts", 86400.0), ["event_type"], str(tmp_path / "h")).collect():
        times = [x.t for x in events.where(F.col("event_type") == r.event_type).select(F.col("ts").cast("timestamp").cast("double").alias("t")).collect()]
        assert r.intensity == pytest.approx(sum(math.exp(-math.log(2) / 86400 * (max(times) - t)) for t in times))


def test_calibration_stacking_classes_and_sweep(spark):
    rows = [(i, float(i % 10), float((i * 7) % 13), int(i % 10 >= 7), int(i % 10 >= 7) + int(i % 10 == 9), (i % 10) / 20) for i in range(300)]
    df = spark.createDataFrame(rows, "id long, a double, b double, y int, y3 int, prob double")
    for kind in ("isotonic", "sigmoid"):
        out = models.calibrate(df, df, "y", kind)
        low, high = out.where("a = 0").first().prob, out.where("a = 9").first().prob
        assert low < 0.1 and high > 0.9
    assert models.calibrate(df.limit(0), df, "y").count() == 300
    folds = [(F.col("id") < 100, (F.col("id") >= 100) & (F.col("id") < 150)), (F.col("id") < 150, (F.col("id") >= 150) & (F.col("id") < 200))]
    stacked = models.stack(df.where("id < 200").drop("prob"), df.where("id >= 200").drop("prob"), folds, ["a", "b"], "y", ("logistic", "forest"), ["id"], trees=5)
    assert metrics.ranking(stacked.select("prob", F.col("y").alias("actual")), []).first().roc_auc > 0.95
    three = models.three_class(df.drop("prob"), df.drop("prob"), ["a", "b"], "y3", trees=10)
    assert three.where("a = 9").first().p_sev > 0.5 > three.where("a = 0").first().p_occ
    log = models.sweep([{"name": "p", "v": 1}, {"name": "q", "v": 0}, {"name": "r", "v": 4}], lambda c: 1 / c["v"])
    assert [r["best_so_far"] for r in log] == [1.0, 1.0, 1.0] and log[1]["error"]
    assert len(models.sweep([{"name": "p", "v": 5}], lambda c: c["v"], log)) == 3
