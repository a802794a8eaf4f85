"""Windows around issue dates: ages, kernels, change points, forward labels."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

PAST = (Window.unboundedPreceding, -1)


def around_issues(events: DataFrame, issues: DataFrame, key: str, day: str, issue_day: str, features: dict[str, tuple], columns: list[str]) -> DataFrame:
    """Features of each (key, issue day) over frames of event days around it.

    ``features``: name -> (aggregate over the events' ``columns``, (first, last) day
    relative to the issue day, and perhaps a function of what the frame gives). Events and issues are one sorted stream for each key,
    so all frames share one shuffle and one sort. Day columns are long day numbers.
    """
    own = [c for c in issues.columns if c not in (key, issue_day)]
    e = events.select(key, F.col(day).alias("_day"), *columns, *[F.lit(None).cast(issues.schema[c].dataType).alias(c) for c in own], F.lit(False).alias("_issue"))
    i = issues.select(key, F.col(issue_day).alias("_day"), *[F.lit(None).cast(events.schema[c].dataType).alias(c) for c in columns], *own, F.lit(True).alias("_issue"))
    w = Window.partitionBy(key).orderBy("_day")
    both = e.unionByName(i)
    value = lambda v, frame, then=lambda x: x: then(v.over(w.rangeBetween(*frame)))
    return (both.select("*", *[value(*f).alias(k) for k, f in features.items()])
            .where("_issue").drop("_issue", *columns).withColumnRenamed("_day", issue_day))


def or_zero(x: Column) -> Column:
    return F.coalesce(x, F.lit(0))


def age_counts(lengths: tuple[int, ...], column: str = "w") -> dict[str, tuple]:
    """count_{n}d: events with issue - n <= day < issue."""
    return {f"count_{n}d": (F.sum(column), (-n, -1), or_zero) for n in lengths}


def momentum(c30: Column, c30_prior: Column, c90: Column, c90_prior: Column) -> dict[str, Column]:
    return {"delta_30d": c30 - c30_prior, "delta_90d": c90 - c90_prior, "momentum": c30 / (c90 / 3 + 0.1)}


def hawkes(events: DataFrame, issues: DataFrame, key: str, day: str, issue_day: str, half_lives: tuple[int, ...] = (3, 14, 30), most: int = 200, weight: str | None = None) -> DataFrame:
    """Decaying intensity at each issue: the sum over ages 1..most of exp(-ln2 / half life * age).

    Daily counts (sums of ``weight``, if given) meet the issues by buckets of ``most`` days: an issue looks into two.
    """
    daily = events.groupBy(key, F.col(day).alias("_d")).agg((F.sum(weight) if weight else F.count(F.lit(1))).alias("_n")).withColumn("_b", F.floor(F.col("_d") / most))
    probe = issues.withColumn("_b", F.explode(F.array(F.floor(F.col(issue_day) / most), F.floor(F.col(issue_day) / most) - 1)))
    age = F.col(issue_day) - F.col("_d")
    joined = probe.join(daily, [key, "_b"], "left").withColumn("_age", F.when((age >= 1) & (age <= most), age))
    sums = {f"hawkes_{h}": F.coalesce(F.sum(F.col("_n") * F.exp(-math.log(2) / h * F.col("_age"))), F.lit(0.0)) for h in half_lives}
    return joined.groupBy(key, issue_day).agg(*[v.alias(k) for k, v in sums.items()])


def cusum_frames(column: str = "w") -> dict[str, tuple]:
    """Counts of the four last weeks (w1 the newest) and of weeks 5 to 16 back."""
    return {**{f"w{k}": (F.sum(column), (-7 * k, -7 * k + 6), or_zero) for k in (1, 2, 3, 4)}, "base": (F.sum(column), (-112, -29), or_zero)}


def cusum(df: DataFrame) -> DataFrame:
    """Running excess over the weekly baseline, newest week first: its highest and lowest value, and the ratio of recent to baseline."""
    level = F.col("base") / 12
    steps, run = [], F.lit(0.0)
    for k in (1, 2, 3, 4):
        run = run + (F.col(f"w{k}") - level)
        steps.append(run)
    recent = (F.col("w1") + F.col("w2") + F.col("w3") + F.col("w4")) / 4
    return df.withColumns({"cusum_up": F.greatest(F.lit(0.0), *steps), "cusum_down": F.least(F.lit(0.0), *steps), "cusum_ratio": recent / (level + 0.1)})


def forward_labels(horizons: tuple[int, ...] = (10, 14), severe: int = 5) -> dict[str, tuple]:
    """Event, type of the first event and severe event within (issue, issue + h]."""
    out = {}
    for h in horizons:
        out[f"label_{h}"] = (F.sum("w"), (1, h), lambda x: (or_zero(x) > 0).cast("int"))
        out[f"type_{h}"] = (F.min_by("type_of_violence", F.when(F.col("w") == 1, F.struct("event_day", "id"))), (1, h), or_zero)
        out[f"severe_{h}"] = (F.max("best"), (1, h), lambda x: (or_zero(x) >= severe).cast("int"))
    return out


def first_seen(events: DataFrame, key: str, actors: list[str], day: str) -> DataFrame:
    """One row for each (key, actor) on the day it first appears: expanding distinct counts become sums."""
    each = events.select(key, F.explode(F.array(*actors)).alias("actor"), day).where("actor is not null")
    return each.groupBy(key, "actor").agg(F.min(day).alias(day))


def anomaly(df: DataFrame, column: str, key: str, period: str, strict: bool = True) -> DataFrame:
    """Last value and deviation from the series mean; strict means from earlier values only."""
    w = Window.partitionBy(key).orderBy(period)
    mean = F.avg(column).over(w.rowsBetween(*PAST)) if strict else F.avg(column).over(Window.partitionBy(key))
    return df.withColumns({f"{column}_lag1": F.lag(column, 1).over(w), f"{column}_anomaly": F.col(column) - mean})


def best_so_far(df: DataFrame, group: list[str], order: str, value: str) -> DataFrame:
    """Running maximum and whether the row sets a new one."""
    w = Window.partitionBy(*group).orderBy(order)
    before = F.max(value).over(w.rowsBetween(*PAST))
    return df.withColumns({"best_so_far": F.max(value).over(w.rowsBetween(Window.unboundedPreceding, 0)), "new_best": (before.isNull() | (F.col(value) > before)).cast("int")})
