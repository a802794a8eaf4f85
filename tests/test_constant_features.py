"""The SQL of the ridge fits states the rule of ``linear.solve`` where a feature is constant, as n_conflicts is on large tables."""

import duckdb
import numpy as np
import pytest

from ewpanel.operators import linear
from ewpanel.plans.fits import NAMES, PROB_SQL, SUMS_SQL, solved_sql


@pytest.mark.parametrize("constant", [(0,), (2,), (0, 1), (0, 1, 2), ()])
def test_constant_feature_has_coefficient_zero_in_sql(constant):
    rng = np.random.default_rng(3)
    rows = [[int(rng.integers(0, 2)), *[5.0 if i in constant else float(rng.integers(0, 40)) for i in range(3)]] for _ in range(200)]
    con = duckdb.connect()
    con.execute("CREATE TABLE rw (y int, x0 double, x1 double, x2 double)")
    con.executemany("INSERT INTO rw VALUES (?, ?, ?, ?)", rows)
    con.execute(f"CREATE TABLE s AS SELECT 1 id, {SUMS_SQL} FROM rw")
    a, *b = con.execute(f"WITH {solved_sql('s', 'id')} SELECT a, b0, b1, b2 FROM ft").fetchone()
    sums = np.array(con.execute(f"SELECT {', '.join(NAMES)} FROM s").fetchone(), float)
    assert np.allclose([a, *b], linear.solve(sums, 3, 1.0, True), atol=1e-9)
    assert all(b[i] == 0 for i in constant)
    assert con.execute(f"WITH {solved_sql('s', 'id')} SELECT count(*) FROM rw, ft WHERE isnan({PROB_SQL})").fetchone() == (0,)
