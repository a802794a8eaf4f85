import json

from ewpanel.sources import readers, writers


def test_panel_comes_back_by_partition(spark, tmp_path):
    df = spark.createDataFrame([("A", 2000, 1.5), ("A", 2001, None), ("B", 2000, 2.0)], "country string, year int, x double")
    writers.write_panel(df, str(tmp_path / "p"), ["year"])
    back = spark.read.parquet(str(tmp_path / "p"))
    assert sorted(map(str, (tuple(r[c] for c in df.columns) for r in back.collect()))) == sorted(map(str, map(tuple, df.collect())))
    assert (tmp_path / "p" / "year=2001").is_dir()


def test_result_documents_nest_rows(spark):
    a, b = spark.createDataFrame([(1, 0.5)], "n int, ap double"), spark.createDataFrame([("x", None)], "name string, v int")
    got = [json.loads(r.document) for r in writers.result_documents({"b": b, "a": a}).collect()]
    assert got == [{"part": "a", "result": {"n": 1, "ap": 0.5}}, {"part": "b", "result": {"name": "x"}}]


def test_split_flag(spark):
    got = writers.with_split(spark.createDataFrame([(1, 0)], "n int, y int"), spark.createDataFrame([(2,)], "n int")).collect()
    assert sorted((r.n, r.y, r.is_train) for r in got) == [(1, 0, True), (2, None, False)]


def test_malformed_lines_and_bad_dates_go(spark, tmp_path):
    (tmp_path / "e.csv").write_text("a,b\n1,2\nx,3\n4,5\n")
    assert sorted(tuple(r) for r in readers.large_csv(spark, str(tmp_path / "e.csv"), "a int, b int").collect()) == [(1, 2), (4, 5)]
    (tmp_path / "c.csv").write_text("country,event_date,event_type,source\nA,2024-01-05,vote,s\nB,soon,vote,s\n")
    (r,) = readers.event_calendar_csv(spark, str(tmp_path / "c.csv")).collect()
    assert (r.country, str(r.event_date)) == ("A", "2024-01-05")
