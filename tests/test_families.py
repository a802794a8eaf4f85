import glob
import os

import pytest
from pyspark.sql import functions as F

from ewpanel.sources.families import FamilyStore, replace_partitions

KEYS = ["cell", "day"]


def rows(spark, values, name):
    df = spark.createDataFrame(values, f"cell long, day date, {name} long") if values else spark.createDataFrame([], f"cell long, day date, {name} long")
    return df.withColumn("year", F.year("day"))


def frame(spark, n, name, step=1):
    df = spark.range(0, n, step).select((F.col("id") % 50).alias("cell"), F.expr("date_add(date '2000-01-01', cast(id as int) * 3)").alias("day"), F.col("id").alias(name))
    return df.withColumn("year", F.year("day"))


@pytest.fixture
def store(spark):
    with FamilyStore(spark, KEYS, "year", 3) as s:
        yield s


def plan(df):
    df.collect()
    return df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]


def test_merge_has_no_exchange_and_right_rows(spark, store):
    store.put("base", frame(spark, 400, "a"))
    for k, step in enumerate((1, 2, 3, 5, 7, 11)):
        store.put(f"f{k}", frame(spark, 400, f"x{k}", step))
    got = store.merged("base")
    assert "Exchange" not in plan(got) and plan(got).count("SortMergeJoin") == 6
    want = [{"a": i, **{f"x{k}": i if i % s == 0 else None for k, s in enumerate((1, 2, 3, 5, 7, 11))}} for i in range(400)]
    assert sorted((r.asDict() for r in got.drop("cell", "day", "year").collect()), key=lambda r: r["a"]) == want
    assert "Exchange" not in plan(store.repeated("f0"))


def test_one_file_a_bucket_and_partition(spark, store):
    store.put("base", frame(spark, 400, "a").repartition(7))
    for year in glob.glob(store.folder.removeprefix("file://").removeprefix("file:") + "/base/year=*"):
        assert len(glob.glob(f"{year}/*.parquet")) <= 3


def test_a_family_replaces_only_its_partitions(spark, store):
    store.put("base", rows(spark, [], "a"))
    store.put("f", frame(spark, 400, "x"))
    store.put("f", frame(spark, 400, "x").where("year = 2001").select("day", "cell", "year", (F.col("x") + 1000).alias("x")))
    got = {r.x for r in store.family("f").collect()}
    old = {r.id for r in spark.range(400).where("year(date_add(date '2000-01-01', cast(id as int) * 3)) != 2001").collect()}
    assert got == old | {i + 1000 for i in range(400) if i not in old}
    assert spark.conf.get("spark.sql.sources.partitionOverwriteMode").lower() == "static"


def test_repeated_keys_and_clashing_names_are_errors(spark, store):
    import datetime

    d = datetime.date(2000, 1, 3)
    with pytest.raises(ValueError, match="several rows"):
        store.put("twice", rows(spark, [(1, d, 1), (1, d, 2)], "x"))
    store.put("a", rows(spark, [(1, d, 1), (None, d, 2), (2, None, 3)], "x"))
    store.put("b", rows(spark, [(1, d, None)], "x"))
    assert store.family("a").count() == 1
    with pytest.raises(ValueError, match="repeats x"):
        store.merged("a", ["b"])


def test_empty_families(spark, store):
    store.put("base", rows(spark, [], "a"))
    store.put("f", rows(spark, [], "x"))
    assert store.merged("base").count() == 0 and set(store.merged("base").columns) == {"cell", "day", "a", "year", "x"}


def test_tables_and_files_go(spark):
    with pytest.raises(RuntimeError), FamilyStore(spark, KEYS, "year", 2) as s:
        s.put("base", frame(spark, 20, "a"))
        raise RuntimeError
    assert not [t for t in spark.catalog.listTables() if t.name.startswith(s.prefix)]
    assert not os.path.exists(s.folder.removeprefix("file://").removeprefix("file:"))


def test_wide_table_is_rewritten_by_year_and_read_pruned(spark, tmp_path):
    path = str(tmp_path / "wide")
    replace_partitions(frame(spark, 400, "a"), path, ["year"])
    stamp = {p: os.path.getmtime(p) for p in glob.glob(f"{path}/year=2000/*.parquet")}
    replace_partitions(frame(spark, 400, "a").where("year = 2002").withColumn("a", -F.col("a")), path, ["year"])
    assert stamp == {p: os.path.getmtime(p) for p in glob.glob(f"{path}/year=2000/*.parquet")}
    back = spark.read.parquet(path)
    assert back.count() == 400 and back.where("a < 0").select("year").distinct().collect()[0].year == 2002
    one = back.where("year = 2002")
    assert "PartitionFilters: [isnotnull(year" in plan(one)
