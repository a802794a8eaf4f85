import datetime

from ewpanel.sources import readers

DAY = datetime.date


def write(tmp_path, name, text):
    path = tmp_path / name
    path.write_text(text, encoding="utf-8")
    return str(path)


def test_coded_lines(spark, tmp_path):
    def line(**fields):
        parts = [""] * 58
        for name, value in fields.items():
            parts[readers.CODED_FIELDS[name]] = value
        return "\t".join(parts)

    raw = "\n".join(["", "a\tb", line(GlobalEventID="1", SQLDATE="20240115", EventCode="193", QuadClass="4", AvgTone="x", ActionGeo_CountryCode="CG"),
                     line(GlobalEventID="2", SQLDATE="20240115", ActionGeo_CountryCode="US"), line(GlobalEventID="3", SQLDATE="19190101", ActionGeo_CountryCode="CG"),
                     line(GlobalEventID="4", SQLDATE="bad", ActionGeo_CountryCode="CG")])
    df = readers.coded_tsv(spark, write(tmp_path, "e.tsv", raw), ["CG"])
    assert sorted(r.GlobalEventID for r in df.collect()) == ["1", "3", "4"]
    (r,) = readers.coded_typed(df, "2020-01-01", "2025-01-01").collect()
    assert (r.GlobalEventID, r.day, r.root, r.QuadClass, r.AvgTone) == ("1", DAY(2024, 1, 15), "19", 4, None)


def test_theme_documents(spark, tmp_path):
    rows = "DATE\t1\t2\t3\t4\t5\t6\t7\nshort\n20240101\ta\tb\tB;A;;B\t1#x#CG#y;2#short\tc\td\t-1.5,2,3\n20240102\ta\tb\tC\t\tc\td\t\n"
    a, b = readers.theme_tsv(spark, write(tmp_path, "g.tsv", rows), ["A"]).orderBy("date").collect()
    assert (a.themes, a.places, a.tone, a.marked) == (["A", "B"], ["CG"], -1.5, True)
    assert (b.themes, b.places, b.tone, b.marked) == (["C"], [], None, False)


def test_small_tables(spark, tmp_path):
    months = readers.country_months_csv(spark, write(tmp_path, "m.csv", "Country,Year,Month,Events,Fatalities\nMali,2024,march,3,4\n")).first()
    assert (months.month, months.events) == (DAY(2024, 3, 1), 3.0)
    years = readers.country_years_json(spark, write(tmp_path, "y.json", '[{"country_full": "A", "year": 2020, "applied": "5"}, {"country_full": "A", "year": 2020, "applied": "*"}]')).first()
    assert (years.year, years.applied) == (2020, 5.0)
    climate = readers.climate_csv(spark, write(tmp_path, "c.csv", "country,city,date,precip_mm,temp_c\nA,x,2024-01-01,-999,3\n")).first()
    assert (climate.precip_mm, climate.temp_c) == (None, 3.0)
    head = "country,date,admin1,market,category,commodity,unit,pricetype,currency,price,usdprice\n"
    prices = readers.prices_csv(spark, [write(tmp_path, "p.csv", head + "A,#date,,,,,,,,,\nA,2025-02-01,,,,rice,,,,x,2\nA,2024-02-01,,,,rice,,,,1,2\n")]).collect()
    assert [(p.price, p.usdprice) for p in prices] == [(None, 2.0)]
    assert [r.day for r in readers.sundays(spark, "2024-01-07", "2024-01-20").collect()] == [DAY(2024, 1, 7), DAY(2024, 1, 14)]


def test_clips_and_events(spark, tmp_path):
    clip = readers.clips_csv(spark, [write(tmp_path, "r.csv", '﻿Date/Time,Station,Text,Language,Topics,Themes,Relevance Score,Content Type\n2026-05-01T10:00:00Z,s,"two\nlines","fr, en",a,b,3,News\n2026-05-01T11:00:00Z,s,,,,,x,News\n')]).orderBy("ts").collect()
    assert [(c.Text, c.Language, c["Relevance Score"]) for c in clip] == [("two\nlines", ["fr", "en"], 3), ("", [""], None)]
    head = "id,country,date_start,date_prec,where_prec,latitude,longitude,priogrid_gid,type_of_violence,side_a,side_b,best\n"
    body = "1,A,2014-01-01 00:00:00,1,1,1,2,3,1,a,b,5\n2,A,2014-01-01,3,1,1,2,3,1,a,b,5\n3,B,2014-01-01,1,1,1,2,3,1,a,b,5\n4,A,2012-01-01,1,1,1,2,3,1,a,b,5\n5,A,2014-01-01,1,1,1,2,,1,a,b,5\n"
    assert [r.id for r in readers.grid_events_csv(spark, write(tmp_path, "u.csv", head + body), ["A"]).collect()] == [1]


def test_resumable_log(spark, tmp_path):
    path = str(tmp_path / "log")
    rows = spark.createDataFrame([("a", 1.0), ("b", 2.0)], "name string, ap double")
    readers.append_new(None, rows.where("name = 'a'"), ["name"], path)
    readers.append_new(readers.experiment_log(spark, path, ["ap"]), rows, ["name"], path)
    assert sorted((r.name, r.ap) for r in readers.experiment_log(spark, path, ["ap"]).select("name", "ap").collect()) == [("a", 1.0), ("b", 2.0)]
