"""Ranks and running totals of large groups without a window over the whole group."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ewpanel.functions.staging import staged

BINS = 256


def binned(df: DataFrame, value: str, bins: int = BINS, descending: bool = False) -> DataFrame:
    """``df`` with _bin, the range of ``value`` a row lies in: equal-frequency ranges, equal values in one, nulls after all others.

    The bounds are approximate percentiles of the column, at most ``bins`` numbers, and
    stand as literals in the plan, so that every evaluation cuts alike.
    """
    cuts = df.agg(F.percentile_approx(value, [k / bins for k in range(1, bins)], 10_000)).first()[0] or []
    cuts = sorted(set(cuts))
    if not cuts:
        return df.withColumn("_bin", F.lit(0))
    bounds = F.array(*[F.lit(c) for c in cuts])
    place = F.array_size(F.filter(bounds, lambda c: c <= F.col(value)))
    return df.withColumn("_bin", F.when(F.col(value).isNull(), F.lit(-1 if descending else len(cuts) + 1)).otherwise(place))


def running(df: DataFrame, by: list[str], value: str, sums: dict[str, Column], descending: bool = True, ties: list[str] | None = None, bins: int = BINS) -> DataFrame:
    """Running totals of each group in the order of ``value`` (then ``ties``), and their whole totals as {name}_all.

    Rows are windowed within a group's bins, which hold about 1 / bins of all rows
    each; totals of the bins before come from a table of groups by bins.
    """
    rows = binned(staged(df.withColumns(sums)), value, bins, descending)  # read for the bounds, the totals and the result
    totals = rows.groupBy(*by, "_bin").agg(*[F.sum(k).alias(f"_t_{k}") for k in sums])
    order = F.desc("_bin") if descending else F.asc("_bin")
    whole = Window.partitionBy(*by)
    before = whole.orderBy(order).rowsBetween(Window.unboundedPreceding, -1)  # bins of one group
    totals = totals.select(*by, "_bin", *[F.coalesce(F.sum(f"_t_{k}").over(before), F.lit(0)).alias(f"_b_{k}") for k in sums], *[F.sum(f"_t_{k}").over(whole).alias(f"{k}_all") for k in sums])
    inner = Window.partitionBy(*by, "_bin").orderBy(F.desc_nulls_last(value) if descending else F.asc_nulls_last(value), *(ties or [])).rowsBetween(Window.unboundedPreceding, 0)
    joined = rows.join(totals, [*by, "_bin"])
    return joined.withColumns({k: F.col(f"_b_{k}") + F.sum(k).over(inner) for k in sums}).drop("_bin", *[f"_b_{k}" for k in sums])


def ranked(df: DataFrame, by: list[str], value: str, ties: list[str], descending: bool = True, bins: int = BINS) -> DataFrame:
    """``df`` with k (rank in its group from 1) and k_all (rows of the group)."""
    return running(df, by, value, {"k": F.lit(1).cast("long")}, descending, ties, bins)


def quantiles(df: DataFrame, by: list[str], value: str, shares: list[float], bins: int = BINS) -> DataFrame:
    """Exact interpolated quantiles: q0, q1, ... of each group, from ranks of its distinct values.

    The quantile of share s lies at position s * (n - 1); the values at its floor and
    its ceiling are looked up by running counts.
    """
    counts = df.where(F.col(value).isNotNull()).groupBy(*by, F.col(value).cast("double").alias("_v")).agg(F.count(F.lit(1)).alias("_n"))
    r = running(counts, by, "_v", {"c": F.col("_n")}, False, None, bins)
    out = []
    for i, s in enumerate(shares):
        at = F.lit(s) * (F.col("c_all") - 1)
        holds = lambda p: (F.col("c") > p) & (F.col("c") - F.col("_n") <= p)
        low, high = F.max(F.when(holds(F.floor(at)), F.col("_v"))), F.max(F.when(holds(F.ceil(at)), F.col("_v")))
        share = F.max(at - F.floor(at))
        out.append((low + share * (high - low)).alias(f"q{i}"))
    return r.groupBy(*by).agg(*out)
