"""The driver tables in the roles of event feeds, as DataFrames and as DuckDB common table expressions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _places(spark: SparkSession, d: str) -> DataFrame:
    customer = table(spark, d, "customer").select("c_custkey", "c_nationkey", "c_mktsegment", "c_acctbal")
    nation = table(spark, d, "nation").select("n_nationkey", "n_regionkey", F.col("n_name").alias("country"))
    region = table(spark, d, "region").select("r_regionkey", F.col("r_name").alias("region"))
    return customer.join(nation, F.col("c_nationkey") == F.col("n_nationkey")).join(region, F.col("n_regionkey") == F.col("r_regionkey"))


GID = "(180 + {k} % 12) * 720 + 360 + (cast(floor({k} / 12) as bigint)) % 12 + 1"


def conflict_events(spark: SparkSession, d: str) -> DataFrame:
    """Fatality-coded grid events: one order is one event."""
    orders = table(spark, d, "orders").select("o_orderkey", "o_custkey", "o_orderdate", "o_totalprice")
    return orders.join(_places(spark, d), F.col("o_custkey") == F.col("c_custkey")).select(
        F.col("o_orderkey").alias("id"), "country", "region", F.to_date("o_orderdate").alias("date_start"),
        F.expr("cast(1 + o_orderkey % 3 as bigint)").alias("type_of_violence"), F.col("c_mktsegment").alias("conflict_name"),
        F.expr("'A' || (o_custkey % 40)").alias("side_a"), F.expr("'B' || (o_orderkey % 25)").alias("side_b"),
        F.expr("cast(floor(o_totalprice / 50000) as bigint)").alias("best"),
        F.expr("cast(1 + o_orderkey % 4 as bigint)").alias("date_prec"), F.expr("cast(1 + o_custkey % 5 as bigint)").alias("where_prec"),
        F.expr(f"cast({GID.format(k='o_custkey')} as bigint)").alias("priogrid_gid"))


def coded_events(spark: SparkSession, d: str) -> DataFrame:
    """Coded events: one line item is one event. Orders meet their places first, so lines are shuffled once."""
    lines = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_shipdate", "l_suppkey", "l_partkey", "l_discount", "l_tax", "l_quantity")
    orders = table(spark, d, "orders").select("o_orderkey", "o_custkey")
    placed = orders.join(_places(spark, d), F.col("o_custkey") == F.col("c_custkey")).select("o_orderkey", "country", "region")
    joined = lines.join(placed, F.col("l_orderkey") == F.col("o_orderkey"))
    return joined.select(
        F.expr("l_orderkey * 10 + l_linenumber").alias("event_id"), F.to_date("l_shipdate").alias("day"), "country", "region",
        F.expr("case when l_suppkey % 11 = 0 then null else 'S' || l_suppkey end").alias("actor1"), F.expr("'P' || (l_partkey % 60)").alias("actor2"),
        F.expr("lpad(cast(1 + l_partkey % 20 as string), 2, '0') || '0'").alias("event_code"), F.expr("cast(1 + l_linenumber % 4 as bigint)").alias("quad_class"),
        F.expr("cast(round(l_discount * 200 - 10) as bigint)").alias("goldstein"), F.expr("cast(round(l_tax * 100 - 5) as bigint)").alias("tone"), F.expr("cast(l_quantity as bigint)").alias("mentions"))


def ledger(spark: SparkSession, d: str) -> DataFrame:
    """A prediction ledger with deterministic scores and many ties."""
    orders = table(spark, d, "orders").select("o_orderkey", "o_custkey", "o_orderdate", "o_orderstatus")
    return orders.join(_places(spark, d).select("c_custkey", "country"), F.col("o_custkey") == F.col("c_custkey")).select(
        F.col("o_orderkey").alias("id"), F.col("country").alias("entity"), F.expr("date_sub(to_date(o_orderdate), weekday(to_date(o_orderdate)))").alias("period"),
        F.expr("((o_orderkey * 7919 + 13) % 997) / 997.0D * 0.7D + case when o_orderstatus = 'F' then 0.25D else 0.0D end").alias("prob"),
        F.expr("cast(case when o_orderstatus = 'F' then 1 else 0 end as bigint)").alias("actual"))


#: The same roles for DuckDB, to be put after WITH.
CONFLICT_SQL = """fx_conflict AS (
 SELECT o.o_orderkey id, n.n_name country, r.r_name region, CAST(o.o_orderdate AS date) date_start, CAST(1 + o.o_orderkey % 3 AS bigint) type_of_violence,
        c.c_mktsegment conflict_name, 'A' || (o.o_custkey % 40) side_a, 'B' || (o.o_orderkey % 25) side_b, CAST(floor(o.o_totalprice / 50000) AS bigint) best,
        CAST(1 + o.o_orderkey % 4 AS bigint) date_prec, CAST(1 + o.o_custkey % 5 AS bigint) where_prec,
        CAST((180 + o.o_custkey % 12) * 720 + 360 + (o.o_custkey // 12) % 12 + 1 AS bigint) priogrid_gid
 FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey JOIN nation n ON c.c_nationkey = n.n_nationkey JOIN region r ON n.n_regionkey = r.r_regionkey)"""
CODED_SQL = """fx_coded AS (
 SELECT l.l_orderkey * 10 + l.l_linenumber event_id, CAST(l.l_shipdate AS date) AS day, n.n_name country, r.r_name region,
        CASE WHEN l.l_suppkey % 11 = 0 THEN NULL ELSE 'S' || l.l_suppkey END actor1, 'P' || (l.l_partkey % 60) actor2,
        lpad(CAST(1 + l.l_partkey % 20 AS varchar), 2, '0') || '0' event_code, CAST(1 + l.l_linenumber % 4 AS bigint) quad_class,
        CAST(round(l.l_discount * 200 - 10) AS bigint) goldstein, CAST(round(l.l_tax * 100 - 5) AS bigint) tone, CAST(l.l_quantity AS bigint) mentions
 FROM lineitem l JOIN orders o ON l.l_orderkey = o.o_orderkey JOIN customer c ON o.o_custkey = c.c_custkey JOIN nation n ON c.c_nationkey = n.n_nationkey
      JOIN region r ON n.n_regionkey = r.r_regionkey)"""
LEDGER_SQL = """fx_ledger AS (
 SELECT o_orderkey id, n.n_name entity, CAST(date_trunc('week', o_orderdate) AS date) period,
        CAST((o_orderkey * 7919 + 13) % 997 AS double) / CAST(997.0 AS double) * CAST(0.7 AS double) + CASE WHEN o_orderstatus = 'F' THEN CAST(0.25 AS double) ELSE CAST(0 AS double) END prob,
        CAST(CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END AS bigint) actual
 FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation n ON c_nationkey = n_nationkey)"""
