"""Readers of the raw feeds. Every schema is explicit, so no pass is spent on inference."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ewpanel.functions import text

#: Positions of the kept fields in a raw coded-event line (fixed by the feed's format).
CODED_FIELDS = {
    "GlobalEventID": 0, "SQLDATE": 1, "Actor1Code": 5, "Actor1Name": 6, "Actor1CountryCode": 7, "Actor2Code": 15, "Actor2Name": 16, "Actor2CountryCode": 17,
    "EventCode": 26, "QuadClass": 29, "GoldsteinScale": 30, "NumMentions": 31, "NumSources": 32, "NumArticles": 33, "AvgTone": 34,
    "ActionGeo_CountryCode": 51, "ActionGeo_Lat": 53, "ActionGeo_Long": 54,
}
CODED_WIDTH = 58
NUMBERS = ("QuadClass", "GoldsteinScale", "NumMentions", "NumSources", "NumArticles", "AvgTone", "ActionGeo_Lat", "ActionGeo_Long")


def fatality_csv(spark: SparkSession, path: str) -> DataFrame:
    """Fatality events: header CSV, dates parsed, a bad value is null."""
    schema = ("id bigint, type_of_violence int, conflict_name string, side_a string, side_b string, country string, region string, date_start string, date_end string, "
              "deaths_a int, deaths_b int, deaths_civilians int, deaths_unknown int, best int, latitude double, longitude double")
    df = spark.read.schema(schema).csv(path, header=True, multiLine=False)
    return df.withColumns({c: F.to_date(F.substring(c, 1, 10)) for c in ("date_start", "date_end")})


def grid_events_csv(spark: SparkSession, path: str, countries: list[str], first_day: str = "2013-01-01") -> DataFrame:
    """Grid events of some countries, precise enough in date (at most 2) and place (at most 3), with a cell and a date."""
    schema = ("id bigint, country string, date_start string, date_prec int, where_prec int, latitude double, longitude double, priogrid_gid bigint, "
              "type_of_violence int, side_a string, side_b string, best int")
    df = spark.read.schema(schema).csv(path, header=True).withColumn("date_start", F.to_date(F.substring("date_start", 1, 10)))
    df = df.where(F.col("country").isin(countries) & (F.col("date_prec") <= 2) & (F.col("where_prec") <= 3))
    return df.dropna(subset=["priogrid_gid", "date_start", "latitude", "longitude"]).where(F.col("date_start") >= F.lit(first_day).cast("date"))


def coded_tsv(spark: SparkSession, path: str, countries: list[str]) -> DataFrame:
    """Raw daily export: blank and short lines are dropped, the countries' lines kept, 18 fields named."""
    lines = spark.read.text(path).select(F.split("value", "\t").alias("f")).where((F.size("f") >= CODED_WIDTH) & F.col("f")[CODED_FIELDS["ActionGeo_CountryCode"]].isin(countries))
    return lines.select(*[F.col("f")[i].alias(name) for name, i in CODED_FIELDS.items()])


def coded_typed(df: DataFrame, first_day: str, last_day: str) -> DataFrame:
    """Types of a coded-event table: bad numbers are null, rows dated outside the window (mis-dated ones too) are dropped, root is the code's first two digits."""
    df = df.withColumns({c: F.col(c).try_cast("double") for c in NUMBERS})
    df = df.withColumns({"QuadClass": F.col("QuadClass").cast("int"), "day": F.try_to_timestamp(F.col("SQLDATE").cast("string"), F.lit("yyyyMMdd")).cast("date"), "root": F.substring("EventCode", 1, 2)})
    return df.where(F.col("day").between(F.lit(first_day).cast("date"), F.lit(last_day).cast("date")))


def theme_tsv(spark: SparkSession, path: str, markers: list[str]) -> DataFrame:
    """Theme documents: header and short lines dropped; themes, places, tone and whether a marker occurs."""
    f = F.split("value", "\t")
    lines = spark.read.text(path).select(f.alias("f")).where((F.size("f") >= 8) & (F.col("f")[0] != "DATE"))
    return lines.select(F.col("f")[0].alias("date"), text.first_themes(F.col("f")[3]).alias("themes"), text.location_codes(F.col("f")[4]).alias("places"),
                        text.first_number(F.col("f")[7]).alias("tone"), text.any_marker(F.col("f")[3], markers).alias("marked"))


def clips_csv(spark: SparkSession, paths: list[str]) -> DataFrame:
    """Text clips of several files: UTC timestamps (session zone UTC), null text as empty, lists split."""
    df = spark.read.csv(paths, header=True, multiLine=True, escape='"')
    df = df.toDF(*[c.lstrip("﻿") for c in df.columns])
    lists = {c: F.split(F.coalesce(F.col(c), F.lit("")), ", ") for c in ("Language", "Topics", "Themes") if c in df.columns}
    return df.withColumns({"ts": F.to_timestamp("Date/Time"), "Text": F.coalesce("Text", F.lit("")), "Relevance Score": F.col("Relevance Score").try_cast("int"), **lists})


def country_months_csv(spark: SparkSession, path: str) -> DataFrame:
    """Country-month counts with month names."""
    df = spark.read.schema("Country string, Year int, Month string, Events double, Fatalities double").csv(path, header=True)
    month = F.to_date(F.concat_ws(" ", F.lit("1"), F.initcap("Month"), F.col("Year").cast("string")), "d MMMM yyyy")
    return df.select(F.col("Country").alias("country"), month.alias("month"), F.col("Events").alias("events"), F.col("Fatalities").alias("fatalities"))


def country_years_json(spark: SparkSession, path: str, value: str = "applied") -> DataFrame:
    """A JSON array of country-year records; values that are no number count 0; summed."""
    df = spark.read.schema(f"country_full string, year string, {value} string").json(path, multiLine=True)
    number = F.coalesce(F.col(value).try_cast("double"), F.lit(0.0))
    return df.groupBy(F.col("country_full").alias("country"), F.col("year").cast("int").alias("year")).agg(F.sum(number).alias(value))


def climate_csv(spark: SparkSession, path: str) -> DataFrame:
    """Daily climate points; -999 means missing."""
    df = spark.read.schema("country string, city string, date date, precip_mm double, temp_c double").csv(path, header=True)
    return df.withColumns({c: F.nullif(c, F.lit(-999.0)) for c in ("precip_mm", "temp_c")})


def prices_csv(spark: SparkSession, paths: list[str], first_day: str = "2025-01-01") -> DataFrame:
    """Prices: the tag row (its date begins with #) is dropped, bad numbers are null."""
    schema = "country string, date string, admin1 string, market string, category string, commodity string, unit string, pricetype string, currency string, price string, usdprice string"
    df = spark.read.schema(schema).csv(paths, header=True).where(~F.col("date").startswith("#"))
    df = df.withColumns({"date": F.to_date("date"), "price": F.col("price").try_cast("double"), "usdprice": F.col("usdprice").try_cast("double")})
    return df.where(F.col("date") >= F.lit(first_day).cast("date"))


def experiment_log(spark: SparkSession, path: str, metrics: list[str]) -> DataFrame:
    """JSON lines of an experiment log with its known fields."""
    fields = ["n bigint", "n_pos bigint", "name string", "category string", "track string", "model_kind string", "blocks array<string>", *[f"{m} double" for m in metrics]]
    return spark.read.schema(", ".join(fields)).json(path)


def sundays(spark: SparkSession, first_day: str, last_day: str) -> DataFrame:
    """Every Sunday between two days, both included."""
    start = F.next_day(F.date_sub(F.lit(first_day).cast("date"), 1), "Sun")
    days = spark.range(1).select(F.explode(F.sequence(start, F.lit(last_day).cast("date"), F.expr("interval 7 days"))).alias("day"))
    return days.where(F.col("day") <= F.lit(last_day).cast("date"))


def append_new(log: DataFrame | None, rows: DataFrame, keys: list[str], path: str) -> None:
    """Append the rows whose key isn't logged yet."""
    (rows if log is None else rows.join(log.select(*keys).distinct(), keys, "left_anti")).write.mode("append").json(path)


def large_csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A large header CSV in narrow types: malformed lines are dropped, splits of the file are read side by side."""
    return spark.read.schema(schema).csv(path, header=True, mode="DROPMALFORMED")


def event_calendar_csv(spark: SparkSession, path: str) -> DataFrame:
    """Calendar of dated events by country; rows without a valid date are dropped."""
    df = spark.read.schema("country string, event_date string, event_type string, source string").csv(path, header=True)
    return df.withColumn("event_date", F.col("event_date").try_cast("date")).dropna(subset=["event_date"])


def lines_apart(lines: DataFrame, schema: str, separator: str = "\t", quote: str = "") -> DataFrame:
    """Lines (column value) parsed by ``schema`` with none dropped: its columns, fault and line.

    fault is null for a good line, else 'blank' (nothing but white space, or null), 'width' (another number of fields) or
    'value' (a field that isn't of its type); line is the whole text of a faulty one, whose columns are all null, so no half
    of it takes part in sums by accident. An empty field is null. Without ``quote`` a field can't hold
    the separator; with it, fields are counted by the parser, and 'width' is left to what it calls malformed ('value').
    """
    names = [f.name for f in lines.sparkSession.createDataFrame([], schema).schema]
    options = {"sep": separator, "mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt", "quote": quote}
    read = lines.select("value", F.from_csv("value", f"{schema}, _corrupt string", options).alias("_r"))
    blank = F.col("value").isNull() | (F.trim(F.col("value")) == "") & ~F.col("value").contains(separator)
    width = F.lit(False) if quote else F.size(F.split("value", f"\\Q{separator}\\E", -1)) != len(names)
    fault = F.when(blank, "blank").when(width, "width").when(F.col("_r._corrupt").isNotNull(), "value")
    read = read.withColumn("_fault", fault)
    good = F.col("_fault").isNull()
    return read.select(*[F.when(good, F.col("_r")[n]).alias(n) for n in names], F.col("_fault").alias("fault"), F.when(~good, F.col("value")).alias("line"))


def faults(parsed: DataFrame) -> DataFrame:
    """How many lines are good (fault null) or have which fault, with the smallest such line as an example."""
    return parsed.groupBy("fault").agg(F.count(F.lit(1)).alias("n"), F.min("line").alias("example"))
