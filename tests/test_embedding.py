"""Truncated SVD by block subspace iteration against numpy, and the weighted means of its vectors."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from ewpanel.operators import embedding
from ewpanel.plans import QUERIES
from ewpanel.plans.graphs import theme_frequency, tfidf

SF = "/root/testdata/sf0.001"


def by_numpy(m, k):
    u, s, vt = np.linalg.svd(m, full_matrices=False)
    return u[:, :k], s[:k], vt[:k].T


def matrix(df, size):
    out = np.zeros((size, len(df[0].vector)))
    for r in df:
        out[int(r.key)] = r.vector
    return out


def test_svd_equals_numpy(spark):
    rng = np.random.default_rng(3)
    m = (rng.random((60, 40)) < 0.2) * rng.random((60, 40)) + np.outer(np.arange(60) % 7, np.arange(40) % 5) / 9.0
    m[5], m[:, 7] = 0, 0
    entries = spark.createDataFrame([(f"{i}", f"{j}", float(m[i, j])) for i, j in zip(*np.nonzero(m))] + [(None, "1", 2.0), ("1", "1", None)], "r string, c string, x double")
    u, v, s = embedding.truncated_svd(entries, "r", "c", "x", 6, oversample=16)
    wu, ws, wv = by_numpy(m, 6)
    assert np.allclose(s, ws, rtol=1e-9)
    u, v = matrix(u.collect(), 60), matrix(v.collect(), 40)
    assert np.allclose(u.T @ u, np.eye(6), atol=1e-8) and np.allclose(v.T @ v, np.eye(6), atol=1e-8)
    assert np.abs(u * s @ v.T - wu * ws @ wv.T).max() < 1e-6
    assert all(c[np.abs(c).argmax()] > 0 for c in u.T)


def test_small_rank_and_nothing(spark):
    one = spark.createDataFrame([("a", "x", 3.0), ("b", "x", 4.0)], "r string, c string, v double")
    u, v, s = embedding.truncated_svd(one, "r", "c", "v", 2)
    assert s == pytest.approx([5.0]) and {r.key: [round(x, 9) for x in r.vector] for r in u.collect()} == {"a": [0.6], "b": [0.8]} and v.count() == 1
    u, v, s = embedding.truncated_svd(one.where("false"), "r", "c", "v", 2)
    assert s == [] and u.count() == v.count() == 0


def test_means_leave_unknown_keys_out(spark):
    rows = spark.createDataFrame([("g", "a", 1), ("g", "a", 2), ("g", "b", 1), ("g", "unknown", 9), ("h", "unknown", 1)], "g string, k string, n long")
    vectors = spark.createDataFrame([("a", [1.0, 0.0]), ("b", [5.0, 4.0])], "key string, vector array<double>")
    got = {(r.g, r.i): r.x for r in embedding.weighted_means(rows, vectors, ["g"], "k", "n").collect()}
    assert got == {("g", 0): 2.0, ("g", 1): 1.0}
    entries = spark.createDataFrame([("a", "p", 1.0), ("b", "p", 5.0), ("b", "q", 4.0)], "r string, c string, v double")
    got = {(r.g, r.c): r.x for r in embedding.weighted_row_means(rows, entries, ["g"], "k", "n", "r", "c", "v").collect()}
    assert got == {("g", "p"): 2.0, ("g", "q"): 1.0}


def test_theme_hypergraph_embedding_equals_numpy(spark):
    """Means of U * S, compared by their products, which signs don't change."""
    f = theme_frequency(spark, SF).withColumn("node", F.concat_ws("|", "country", F.col("week").cast("string")))
    w = tfidf(f).toPandas().pivot(index="theme", columns="node", values="weight").fillna(0.0)
    k = min(12, min(w.shape) - 1)
    u, s, _ = by_numpy(w.to_numpy(), k)
    emb = dict(zip(w.index, u * s))
    want = {}
    for (c, week), g in f.toPandas().groupby(["country", "week"]):
        g = g[g.theme.isin(emb)]
        if len(g):
            want[c, week] = np.average([emb[t] for t in g.theme], axis=0, weights=g.n)
    got = {}
    for r in QUERIES["theme_hypergraph_embedding"](spark, SF).collect():
        got.setdefault((r.country, r.week), np.zeros(k))[r.i] = r.x
    assert set(got) == set(want)
    keys = sorted(want)[:60]
    a, b = np.array([got[x] for x in keys]), np.array([want[x] for x in keys])
    assert np.abs(a @ a.T - b @ b.T).max() < 1e-6
