"""Every registered query of the panel library against its SQL in DuckDB."""

import datetime
import decimal

import duckdb
import pytest

from ewpanel.plans import QUERIES, SQL

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(x):
    if x is None:
        return "~"
    if isinstance(x, (float, decimal.Decimal)):
        return f"{float(x):.6f}"
    if isinstance(x, bool):
        return str(int(x))
    if isinstance(x, datetime.datetime):
        return x.replace(tzinfo=None).isoformat(" ")
    if isinstance(x, (list, tuple)):
        return "[" + ",".join(map(plain, x)) + "]"
    return str(x)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_its_sql(spark, duck, name):
    got = QUERIES[name](spark, SF)
    want = duck.execute(SQL[name])
    columns = [c[0] for c in want.description]
    assert sorted(got.columns) == sorted(columns)
    order = sorted(columns)
    rows = sorted(tuple(plain(r[c]) for c in order) for r in got.collect())
    assert rows == sorted(tuple(plain(r[columns.index(c)]) for c in order) for r in want.fetchall())


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_query_without_sql_gives_rows(spark, name):
    cells = ("two_stage_severity", "unseen_type_auc", "cell_prompts")  # no cell has 15 events in the smallest tables
    assert QUERIES[name](spark, SF.replace("0.001", "0.01") if name in cells else SF).count() > 0


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() == 25
    assert set(QUERIES) <= set(__spark_entry__.queries()) and set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
