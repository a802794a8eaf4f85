"""No line of a feed is dropped unseen."""

from pyspark.sql import functions as F

from ewpanel.sources import readers

SCHEMA = "id bigint, day date, name string, n int"


def parsed(spark, lines, **more):
    return readers.lines_apart(spark.createDataFrame([(x,) for x in lines], "value string"), SCHEMA, **more)


def test_each_fault_is_named_and_kept(spark):
    lines = ["1\t2000-01-03\tx\t5", "2\t\t\t", "", "   ", None, "3\t2000-01-03\tx", "4\t2000-01-03\tx\t5\t6", "5\tsome day\tx\t5", "6\t2000-01-03\tx\tfive", "\t\t\t", '7\t2000-01-03\t"x\t8']
    got = parsed(spark, lines).collect()
    assert [r.fault for r in got] == [None, None, "blank", "blank", "blank", "width", "width", "value", "value", None, None]
    assert [r.line for r in got] == [x if f else None for x, f in zip(lines, [r.fault for r in got])]
    assert (got[0].id, str(got[0].day), got[0]["name"], got[0].n) == (1, "2000-01-03", "x", 5) and got[1].id == 2 and got[1].n is None
    assert all(r[c] is None for r in got if r.fault for c in ("id", "day", "name", "n"))
    assert got[9].id is None and got[10]["name"] == '"x' and got[10].n == 8


def test_faults_are_counted(spark):
    df = readers.faults(parsed(spark, ["1\t2000-01-03\tx\t5", "b\t", "a\t", ""]))
    assert {(r.fault, r.n, r.example) for r in df.collect()} == {(None, 1, None), ("width", 2, "a\t"), ("blank", 1, "")}


def test_other_separators_and_quotes(spark):
    assert [r.fault for r in parsed(spark, ["1|2000-01-03|x|5", "1|2"], separator="|").collect()] == [None, "width"]
    quoted = parsed(spark, ['1,2000-01-03,"x, y",5', "1,2000-01-03,x"], separator=",", quote='"').collect()
    assert quoted[0]["name"] == "x, y" and quoted[0].fault is None and quoted[1].fault == "value"
    assert parsed(spark, []).where(F.col("fault").isNotNull()).count() == 0
