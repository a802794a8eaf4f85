"""Entity-week panels: aggregation, spine, baselines, labels and lags."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ewpanel.functions.keys import calendar_spine, week_monday


def share(num: Column, den: Column) -> Column:
    """num / den with a denominator of at least one."""
    return num / F.greatest(den, F.lit(1))


def fatality_panel(events: DataFrame, entity: str = "country", day: str = "date_start") -> DataFrame:
    """Counts, deaths, types and distinct conflicts of each entity and week."""
    kind = lambda k: F.count_if(F.col("type_of_violence") == k)
    return events.groupBy(entity, week_monday(F.col(day)).alias("week")).agg(
        F.count(F.lit(1)).alias("n_events"), F.sum("best").alias("deaths"), kind(1).alias("n_state"), kind(2).alias("n_nonstate"),
        kind(3).alias("n_onesided"), F.countDistinct("conflict_name").alias("n_conflicts"))


def coded_panel(events: DataFrame, entity: str = "country", day: str = "day") -> DataFrame:
    """Coded-event weeks: class and root counts, means, actors over both sides and ordered pairs.

    A null tone counts as not negative; n_coded counts rows with a class only. Counts are combined before they move; the
    distinct pairs of actors are shuffled on their own, without them, and the distinct actors are taken from these pairs.
    """
    root = F.substring("event_code", 1, 2)
    keyed = events.withColumn("week", week_monday(F.col(day)))
    counts = keyed.groupBy(entity, "week").agg(
        F.count(F.lit(1)).alias("n_events"), F.count("quad_class").alias("n_coded"), *[F.count_if(F.col("quad_class") == q).alias(f"n_quad{q}") for q in (1, 2, 3, 4)],
        F.count_if(root.isin("18", "19", "20")).alias("n_severe"), F.count_if(root.isin("14", "17")).alias("n_coerce_protest"),
        F.avg("goldstein").alias("mean_goldstein"), F.avg("tone").alias("mean_tone"), F.avg(F.when(F.col("tone") < 0, 1.0).otherwise(0.0)).alias("tone_neg_share"),
        F.sum("mentions").alias("mentions"))
    side = lambda c: [F.coalesce(c, F.lit("")).alias(c), F.col(c).isNotNull().alias(f"_{c}")]
    pairs = keyed.select(entity, "week", *side("actor1"), *side("actor2")).groupBy(entity, "week", "actor1", "actor2").agg(F.bool_or("_actor1").alias("_actor1"), F.bool_or("_actor2").alias("_actor2"))
    who = pairs.select(entity, "week", F.explode(F.array(*[F.when(F.col(f"_{c}"), F.col(c)) for c in ("actor1", "actor2")])).alias("actor"))
    actors = who.where("actor is not null").distinct().groupBy(entity, "week").agg(F.count(F.lit(1)).alias("distinct_actors"))
    n_pairs = pairs.groupBy(F.col(entity).alias("_entity"), F.col("week").alias("_week")).agg(F.count(F.lit(1)).alias("n_actor_pairs"))
    out = counts.join(n_pairs, F.col(entity).eqNullSafe(F.col("_entity")) & F.col("week").eqNullSafe(F.col("_week"))).drop("_entity", "_week")  # weeks without a day stay
    return out.join(actors, [entity, "week"], "left").withColumn("distinct_actors", F.coalesce("distinct_actors", F.lit(0)))


def dense(panel: DataFrame, entity: str, period: str, zero: list[str]) -> DataFrame:
    """Fill the calendar between each entity's first and last period; counts become zero."""
    return calendar_spine(panel, entity, period).join(panel, [entity, period], "left").fillna(0, zero)


def trailing(df: DataFrame, columns: list[str], entity: str, period: str, least: int = 4) -> DataFrame:
    """Mean and sample deviation over strictly earlier rows, null with fewer than ``least`` values."""
    past = Window.partitionBy(entity).orderBy(period).rowsBetween(Window.unboundedPreceding, -1)
    enough = lambda c, v: F.when(F.count(c).over(past) >= least, v.over(past))
    return df.withColumns({k: v for c in columns for k, v in ((f"mean_{c}", enough(c, F.avg(c))), (f"std_{c}", enough(c, F.stddev_samp(c))))})


def zscore(x: Column, mean: Column, std: Column) -> Column:
    return (x - mean) / F.nullif(std, F.lit(0.0))


def either(*conditions: Column) -> Column:
    """1 if any condition holds; a null condition does not."""
    hit = F.lit(False)
    for c in conditions:
        hit = hit | F.coalesce(c, F.lit(False))
    return hit.cast("int")


def with_lags(df: DataFrame, columns: list[str], entity: str, period: str, lags: int = 2) -> DataFrame:
    """lag 1..n and the change from lag 1."""
    w = Window.partitionBy(entity).orderBy(period)
    df = df.withColumns({f"{c}_lag{k}": F.lag(c, k).over(w) for c in columns for k in range(1, lags + 1)})
    return df.withColumns({f"{c}_delta": F.col(c) - F.col(f"{c}_lag1") for c in columns})


def with_leads(df: DataFrame, label: str, horizons: tuple[int, ...], entity: str, period: str) -> DataFrame:
    """The label ``h`` periods ahead."""
    w = Window.partitionBy(entity).orderBy(period)
    return df.withColumns({f"label_{h}": F.lead(label, h).over(w) for h in horizons})


def fatality_escalation(events: DataFrame, entity: str = "country", z: float = 1.5, horizons: tuple[int, ...] = (1, 2, 4)) -> DataFrame:
    """The whole weekly chain: panel, calendar, baselines, escalation, forward labels, lags."""
    p = dense(fatality_panel(events, entity), entity, "week", ["n_events", "deaths", "n_state", "n_nonstate", "n_onesided", "n_conflicts"])
    p = p.withColumns({"deaths_per_event": share(F.col("deaths"), F.col("n_events")), "state_share": share(F.col("n_state"), F.col("n_events"))})
    p = trailing(p, ["deaths", "n_events"], entity, "week")
    p = p.withColumns({f"z_{c}": zscore(F.col(c), F.col(f"mean_{c}"), F.col(f"std_{c}")) for c in ("deaths", "n_events")})
    p = p.withColumn("escalation", either(F.col("z_deaths") > z, F.col("z_n_events") > z))
    return with_lags(with_leads(p, "escalation", horizons, entity, "week"), ["n_events", "deaths"], entity, "week")


def coded_escalation(events: DataFrame, entity: str = "country", z: float = 1.5, drop: float = 2.0) -> DataFrame:
    """Coded weeks (observed weeks only) with two labels: by conflict share and by severe roots."""
    p = coded_panel(events, entity).withColumns({"conflict_share": share(F.col("n_quad4"), F.col("n_events")), "severe_share": share(F.col("n_severe"), F.col("n_events"))})
    p = trailing(p, ["conflict_share", "severe_share", "mean_goldstein"], entity, "week")
    fall = (F.col("mean_mean_goldstein") - F.col("mean_goldstein")) > drop
    label = lambda c: either(zscore(F.col(c), F.col(f"mean_{c}"), F.col(f"std_{c}")) > z, fall)
    return p.withColumns({"escalation_quad": label("conflict_share"), "escalation_root": label("severe_share")})
