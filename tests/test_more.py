"""Encodings, distributed ranks, label spreading, model helpers and prompts on small rows."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from ewpanel.functions import text
from ewpanel.operators import encode, graph, metrics, models, ranks, retrieval, stats


def test_feature_columns_in_order_once_and_existing():
    registry = {"a": ["x", "y"], "b": ["y", "z", "gone"]}
    assert encode.feature_columns(["b", "a"], registry, ["x", "y", "z"]) == ["y", "z", "x"]
    with pytest.raises(KeyError):
        encode.feature_columns(["c"], registry, ["x"])


def test_one_hot_of_unseen_and_null_is_zero(spark):
    train = spark.createDataFrame([("b",), ("a",), ("a",), (None,)], "c string")
    got = encode.one_hot(train, spark.createDataFrame([("a",), ("b",), ("new",), (None,)], "c string"), "c").collect()
    assert [(r.c, r.flags) for r in got] == [("a", [1, 0]), ("b", [0, 1]), ("new", [0, 0]), (None, [0, 0])]
    with pytest.raises(ValueError):
        encode.one_hot(train, train, "c", most=1)


def test_adapted_columns_are_named_or_an_error(spark):
    df = spark.createDataFrame([(1, 2)], "a int, other int")
    assert encode.adapted(df, ["a", "b"], {"b": "other"}).first().b == 2
    with pytest.raises(ValueError):
        encode.adapted(df, ["b"], {})


@pytest.mark.parametrize("bins", [1, 4, 64])
def test_ranks_and_running_totals(spark, bins):
    rng = random.Random(bins)
    rows = [(i, rng.choice("ab"), rng.choice([None, 0.1, 0.2, rng.random()]), rng.randrange(3)) for i in range(300)]
    df = spark.createDataFrame(rows, "id long, g string, v double, n int")
    got = {r.id: (r.k, r.k_all) for r in ranks.ranked(df, ["g"], "v", ["id"], bins=bins).collect()}
    for g in "ab":
        order = sorted((r for r in rows if r[1] == g), key=lambda r: (r[2] is None, -(r[2] or 0), r[0]))
        assert [got[r[0]] for r in order] == [(k, len(order)) for k in range(1, len(order) + 1)]  # nulls last
    known = df.where("v is not null")
    got = {r.id: r.s for r in ranks.running(known, [], "v", {"s": F.col("n")}, False, ["id"], bins).collect()}
    total = 0
    for r in sorted((r for r in rows if r[2] is not None), key=lambda r: (r[2], r[0])):
        total += r[3]
        assert got[r[0]] == total


def test_quantiles_interpolate(spark):
    rng = np.random.default_rng(3)
    values = np.round(rng.normal(size=401), 2)
    df = spark.createDataFrame([(int(i % 2), float(v)) for i, v in enumerate(values)], "g int, v double")
    for r in ranks.quantiles(df, ["g"], "v", [0.0, 0.25, 0.9, 1.0], bins=16).collect():
        want = np.quantile(values[r.g::2], [0.0, 0.25, 0.9, 1.0])
        assert [r.q0, r.q1, r.q2, r.q3] == pytest.approx(want.tolist())


def test_f_tail_against_table_values():
    for f, a, b, p in ((4.9646, 1, 10, 0.05), (3.4928, 2, 20, 0.05), (1.0, 1, 1, 0.5), (0.0, 2, 9, 1.0)):
        assert stats.f_tail(f, a, b) == pytest.approx(p, abs=1e-5)


def test_granger_finds_the_lag(spark):
    rng = np.random.default_rng(5)
    x = rng.normal(size=80)
    y = np.append(0, 0.9 * x[:-1]) + 0.1 * rng.normal(size=80)
    rows = [("a", i, float(y[i]), float(x[i])) for i in range(80)] + [("short", i, 1.0, 2.0 * i) for i in range(6)]
    got = stats.ssr_granger(spark.createDataFrame(rows, "e string, t int, y double, x double"), "e", "t", "y", "x", 2).collect()
    assert [r.e for r in got] == ["a"] and got[0].p < 1e-10 and got[0].lag == 1


def test_nearest_in_blocks_equals_all_pairs(spark):
    rng = np.random.default_rng(1)
    v = rng.integers(0, 4, (60, 3)).astype(float)
    df = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "id long, v array<double>")
    got = {}
    for r in retrieval.nearest(df, "id", "v", 4, block=13).collect():
        got.setdefault(r.u, []).append((r.distance, r.w))
    for i in range(60):
        want = sorted((float(((v[i] - v[j]) ** 2).sum()), j) for j in range(60) if j != i)[:4]
        assert sorted(got[i]) == want


def test_labels_spread_along_a_chain(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(11)] + [(20, 21)], "u long, w long")
    nodes = spark.createDataFrame([(i, None if i in (5, 6) else int(i > 5)) for i in range(12)] + [(20, None), (21, None)], "node long, known int")
    p = {r.node: r.prob for r in graph.spread_labels(edges, nodes).collect()}
    assert p[0] < 0.1 and p[5] < 0.5 < p[6] and p[11] > 0.9 and p[20] == pytest.approx(0.5)
    few = {r.prob for r in graph.spread_labels(edges, nodes.where("node < 4")).collect()}
    assert few == {0.0}


def test_analogs_use_train_statistics_weights_and_recency(spark):
    train = spark.createDataFrame([("t1", "g", 1.0, 0.0, 1, 0.0), ("t2", "g", 0.0, 1.0, 0, 1.0)], "id string, g string, a double, b double, y int, r double")
    test = spark.createDataFrame([("q", "g", 1.0, 0.4)], "id string, g string, a double, b double")
    first = lambda **kw: retrieval.analogs(train, test, ["g"], ["a", "b"], "id", "id", "y", 1, **kw).first().analog_id
    assert (first(), first(weights={"a": 0.1}), first(recency="r", blend=0.9)) == ("t1", "t2", "t2")
    z = retrieval.standardise(spark.createDataFrame([("g", 100.0)], "g string, a double"), ["a"], ["g"], train.select("g", "a"))
    assert z.first().a == pytest.approx((100 - 0.5) / 0.5, rel=1e-6)  # the row itself has no part in the mean


def test_structure_counts_distinct_co_members(spark):
    nodes = spark.createDataFrame([("n1", "x", "p"), ("n2", "x", "p"), ("n3", "x", "q")], "node string, c string, r string")
    inc = graph.incidence(nodes, "node", {"c": ["c"], "r": ["r"]})
    got = {r.node_id: (r.degree, r.co_memberships, r.mean_co_degree) for r in graph.structural_features(inc).collect()}
    assert got == {"n1": (2, 3, 1.5), "n2": (2, 3, 1.5), "n3": (1, 2, 2.0)}


def test_model_helpers(spark):
    rows = [(i, float(i % 10), float((i * 7) % 13), int(i % 10 >= 7), f"2000-0{1 + i % 9}-03") for i in range(300)]
    df = spark.createDataFrame(rows, "id long, a double, b double, y int, d string").withColumn("d", F.to_date("d"))
    top = models.importances(df, ["a", "b"], "y", rounds=3).collect()
    assert [r.feature for r in top] == ["a", "b"] and top[0].importance > 0.9
    cal = models.calibrated_folds(df, df, ["id"], ["a", "b"], "y")
    assert metrics.ranking(cal.select("prob", F.col("y").alias("actual")), []).first().roc_auc > 0.95
    multi = models.multi_split(df, "d", ["2000-04-01", "2000-05-01"], "2000-08-01", ["id"], ["a", "b"], "y", 0.5)
    assert multi.count() == df.where("d >= date '2000-08-01'").count() and multi.select("threshold").distinct().count() == 1
    rare = df.withColumn("y", (F.col("id") < 4).cast("int"))
    assert {r.prob for r in models.fit_score(rare, df, ["a"], "y", least=5).collect()} == {4 / 300}
    assert models.random_configs({"k": [1, 2], "m": [3, 4]}, 3) == models.random_configs({"k": [1, 2], "m": [3, 4]}, 3)
    assert len(models.random_configs({"k": [1, 2]}, 9)) == 2


def test_prompts(spark):
    row = spark.range(1).select(
        text.cell_context(F.lit("7"), F.to_date(F.lit("2000-01-03")), *[F.lit(x) for x in (5, 2, 9, 8, 20, 3)]).alias("c"),
        text.prompt("json", F.lit("x"), F.array(text.analog_line(F.lit(1), F.lit("A"), F.lit(0.5), F.lit(1)))).alias("p"), text.prompt("plain", F.lit("x"), F.array().cast("array<string>")).alias("q"),
        text.country_context(F.lit("A"), F.lit(0.25), F.lit(-0.1), F.lit(2.0)).alias("k")).first()
    assert "5 events (2 in the 30 days before, rising, change +3)" in row.c and row.c.endswith("3.")
    assert row.p.endswith("Situation: x\n\nSimilar situations:\n1. A (similarity 0.50): escalated") and row.q.endswith("Situation: x")
    assert row.k == "A: conflict share 0.25 (-0.10), tone +2.0"
