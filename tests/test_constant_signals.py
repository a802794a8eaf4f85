"""Correlations where one side is constant, as severe weeks are on large tables."""

import math

import duckdb

from ewpanel.operators.stats import correlation


def test_correlation_of_a_constant_is_nan_as_in_duckdb(spark):
    rows = [("a", 1.0, 2.0), ("a", 2.0, 4.5), ("a", 3.0, 5.0), ("a", None, 9.0), ("b", 1.0, 1.0), ("b", 2.0, 1.0), ("c", 0.1, 3.0), ("c", 0.1, 4.0), ("d", 5.0, 6.0), ("e", None, 1.0)]
    df = spark.createDataFrame(rows, "k string, x double, y double")
    got = {r.k: r.r for r in df.groupBy("k").agg(correlation("x", "y").alias("r")).collect()}
    con = duckdb.connect()
    con.execute("CREATE TABLE t (k varchar, x double, y double)")
    con.executemany("INSERT INTO t VALUES (?, ?, ?)", rows)
    want = dict(con.execute("SELECT k, corr(x, y) FROM t GROUP BY 1").fetchall())
    assert got.keys() == want.keys()
    for k, r in want.items():
        assert (got[k] is None) == (r is None)
        assert r is None or (math.isnan(r) and math.isnan(got[k])) or abs(r - got[k]) < 1e-12
