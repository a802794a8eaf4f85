"""Grid-cell candidate tables: age windows, rings, kernels, change points, labels, diffusion."""

from __future__ import annotations

from pyspark.sql import functions as F

from ewpanel.functions import keys
from ewpanel.operators import graph, windows
from ewpanel.plans.registry import query
from ewpanel.sources.fixtures import CODED_SQL, CONFLICT_SQL, coded_events, conflict_events

FIRST, LAST = "1996-01-01", "2001-07-09"

CAND_SQL = f"""{CONFLICT_SQL},
 ev AS (SELECT *, CAST(date_start - DATE '1970-01-01' AS bigint) d FROM fx_conflict WHERE date_prec <= 2 AND where_prec <= 3),
 cells AS (SELECT priogrid_gid FROM ev GROUP BY 1 HAVING count(*) >= 15),
 mondays AS (SELECT CAST(unnest(generate_series(DATE '{FIRST}', DATE '{LAST}', INTERVAL 7 DAY)) AS date) AS issue_date),
 cand AS (SELECT priogrid_gid, issue_date, CAST(issue_date - DATE '1970-01-01' AS bigint) i FROM cells, mondays),
 ce AS (SELECT e.* FROM ev e JOIN cells USING (priogrid_gid))"""


def grid_events(spark, d):
    e = conflict_events(spark, d).where("date_prec <= 2 and where_prec <= 3")
    return e.withColumns({"day": keys.day_number(F.col("date_start")), "w": F.lit(1)})


def cells_of(events):
    return events.groupBy("priogrid_gid").agg(F.count(F.lit(1)).alias("_n")).where("_n >= 15").select("priogrid_gid")


def candidates(events):
    """Active cells by issue Mondays, the cells exploded over the calendar."""
    mondays = F.explode(F.expr(f"sequence(date '{FIRST}', date '{LAST}', interval 7 days)"))
    return cells_of(events).select("priogrid_gid", mondays.alias("issue_date")).withColumn("issue_day", keys.day_number(F.col("issue_date")))


def _age(lo, hi, cond="true"):
    return f"count(*) FILTER (i - d BETWEEN {lo} AND {hi} AND {cond})"


@query("candidate_age_windows", f"""WITH {CAND_SQL}
 SELECT c.priogrid_gid, c.issue_date, {_age(1, 30)} count_30d, {_age(1, 60)} count_60d, {_age(1, 90)} count_90d, {_age(1, 365)} count_365d, {_age(31, 60)} prior_30d, {_age(91, 180)} prior_90d,
        round({_age(1, 30)} / ({_age(1, 90)} / 3.0 + 0.1), 6) momentum, i - max(d) FILTER (d < i) days_since_last, count(*) FILTER (d < i) n_hist,
        round(count(*) FILTER (d < i AND type_of_violence = 1) / count(*) FILTER (d < i), 6) share_state,
        round(count(*) FILTER (d < i AND type_of_violence = 3) / count(*) FILTER (d < i), 6) share_one_sided
 FROM cand c JOIN ce e ON e.priogrid_gid = c.priogrid_gid GROUP BY c.priogrid_gid, c.issue_date, i HAVING count(*) FILTER (d < i) > 0""")
def candidate_age_windows(spark, d):
    e = grid_events(spark, d)
    past = windows.PAST
    features = {
        **windows.age_counts((30, 60, 90, 365)), "prior_30d": (F.sum("w"), (-60, -31), windows.or_zero), "prior_90d": (F.sum("w"), (-180, -91), windows.or_zero),
        "last_day": (F.max("event_day"), past), "n_hist": (F.sum("w"), past, windows.or_zero), **{n: (F.sum(F.when(F.col("type_of_violence") == k, 1)), past, windows.or_zero) for n, k in (("n_state", 1), ("n_one_sided", 3))}}
    e = e.withColumn("event_day", F.col("day"))
    out = windows.around_issues(e, candidates(e), "priogrid_gid", "day", "issue_day", features, ["w", "event_day", "type_of_violence"])
    # events of cells that are not active have no issues and vanish with the filter on issues
    out = out.where("n_hist > 0").withColumns({**windows.momentum(F.col("count_30d"), F.col("prior_30d"), F.col("count_90d"), F.col("prior_90d")), "days_since_last": F.col("issue_day") - F.col("last_day"), "share_state": F.round(F.col("n_state") / F.col("n_hist"), 6), "share_one_sided": F.round(F.col("n_one_sided") / F.col("n_hist"), 6)})
    return out.select("priogrid_gid", "issue_date", "count_30d", "count_60d", "count_90d", "count_365d", "prior_30d", "prior_90d", F.round("momentum", 6).alias("momentum"), "days_since_last", "n_hist", "share_state", "share_one_sided")


@query("candidate_forward_labels", f"""WITH {CAND_SQL}
 SELECT c.priogrid_gid, c.issue_date, CAST({_age(-10, -1)} > 0 AS int) label_10, coalesce(arg_min(type_of_violence, d * 10000000 + id) FILTER (i - d BETWEEN -10 AND -1), 0) type_10,
        CAST(coalesce(max(best) FILTER (i - d BETWEEN -10 AND -1), 0) >= 5 AS int) severe_10, CAST({_age(-14, -1)} > 0 AS int) label_14,
        coalesce(arg_min(type_of_violence, d * 10000000 + id) FILTER (i - d BETWEEN -14 AND -1), 0) type_14, CAST(coalesce(max(best) FILTER (i - d BETWEEN -14 AND -1), 0) >= 5 AS int) severe_14,
        CASE WHEN {_age(-10, -1)} = 0 THEN 0 WHEN max(best) FILTER (i - d BETWEEN -10 AND -1) >= 5 THEN 2 ELSE 1 END class3,
        CASE WHEN coalesce(arg_min(type_of_violence, d * 10000000 + id) FILTER (i - d BETWEEN -10 AND -1), 0) = 3 THEN 0 ELSE CAST({_age(-10, -1)} > 0 AS int) END masked_10
 FROM cand c JOIN ce e ON e.priogrid_gid = c.priogrid_gid GROUP BY c.priogrid_gid, c.issue_date, i""")
def candidate_forward_labels(spark, d):
    e = grid_events(spark, d).withColumn("event_day", F.col("day"))
    out = windows.around_issues(e, candidates(e), "priogrid_gid", "day", "issue_day", windows.forward_labels(), ["w", "event_day", "id", "type_of_violence", "best"])
    return out.select("priogrid_gid", "issue_date", "label_10", "type_10", "severe_10", "label_14", "type_14", "severe_14",
                      F.when(F.col("label_10") == 0, 0).when(F.col("severe_10") == 1, 2).otherwise(1).alias("class3"), F.when(F.col("type_10") == 3, 0).otherwise(F.col("label_10")).alias("masked_10"))


@query("candidate_actor_diversity", f"""WITH {CAND_SQL}, a AS (SELECT priogrid_gid, actor, min(d) d FROM (SELECT priogrid_gid, unnest([side_a, side_b]) actor, d FROM ev) GROUP BY 1, 2)
 SELECT c.priogrid_gid, c.issue_date, count(*) FILTER (d < i) actor_diversity FROM cand c JOIN a USING (priogrid_gid) GROUP BY 1, 2""")
def candidate_actor_diversity(spark, d):
    e = grid_events(spark, d)
    seen = windows.first_seen(e, "priogrid_gid", ["side_a", "side_b"], "day").withColumn("w", F.lit(1))
    return windows.around_issues(seen, candidates(e), "priogrid_gid", "day", "issue_day", {"actor_diversity": (F.sum("w"), windows.PAST, windows.or_zero)}, ["w"]).select("priogrid_gid", "issue_date", "actor_diversity")


def _ring_sql(distance):
    steps = [f"({r}, {c})" for r in range(-distance, distance + 1) for c in range(-distance, distance + 1) if max(abs(r), abs(c)) == distance]
    return f"(SELECT e.d, e.priogrid_gid + s.r * 720 + s.c AS priogrid_gid FROM ev e, (VALUES {', '.join(steps)}) s(r, c) WHERE (e.priogrid_gid - 1) % 720 + s.c BETWEEN 0 AND 719)"


@query("candidate_rings", f"""WITH {CAND_SQL}, r1 AS {_ring_sql(1)}, r2 AS {_ring_sql(2)},
 a AS (SELECT c.priogrid_gid, c.issue_date, {_age(1, 30)} ring1_30d FROM cand c LEFT JOIN r1 USING (priogrid_gid) GROUP BY 1, 2), b AS (SELECT c.priogrid_gid, c.issue_date, {_age(1, 30)} ring2_30d FROM cand c LEFT JOIN r2 USING (priogrid_gid) GROUP BY 1, 2)
 SELECT priogrid_gid, issue_date, ring1_30d, ring2_30d FROM a JOIN b USING (priogrid_gid, issue_date)""")
def candidate_rings(spark, d):
    e = grid_events(spark, d)
    issues = candidates(e)
    active = cells_of(e)
    for distance in (1, 2):
        near = e.select(F.explode(keys.ring(F.col("priogrid_gid"), distance)).alias("priogrid_gid"), "day", "w").join(active, "priogrid_gid", "left_semi")
        found = windows.around_issues(near, issues.select("priogrid_gid", "issue_day"), "priogrid_gid", "day", "issue_day", {f"ring{distance}_30d": (F.sum("w"), (-30, -1), windows.or_zero)}, ["w"])
        issues = issues.join(found, ["priogrid_gid", "issue_day"])
    return issues.drop("issue_day")


@query("country_recent_counts", f"""WITH {CAND_SQL}, m AS (SELECT DISTINCT country FROM ev) SELECT m.country, mondays.issue_date, count(*) FILTER (issue_date - date_start BETWEEN 1 AND 30) count_30d
 FROM m CROSS JOIN mondays JOIN ev e ON e.country = m.country GROUP BY 1, 2""")
def country_recent_counts(spark, d):
    e = grid_events(spark, d)
    issues = e.select("country").distinct().select("country", F.explode(F.expr(f"sequence(date '{FIRST}', date '{LAST}', interval 7 days)")).alias("issue_date")).withColumn("issue_day", keys.day_number(F.col("issue_date")))
    daily = e.groupBy("country", "day").agg(F.sum("w").alias("w"))  # a row for each day before anything is windowed
    return windows.around_issues(daily, issues, "country", "day", "issue_day", windows.age_counts((30,)), ["w"]).select("country", "issue_date", "count_30d")


@query("hawkes_intensity", f"""WITH {CAND_SQL} SELECT c.priogrid_gid, c.issue_date,
 {", ".join(f"round(coalesce(sum(exp(-ln(2.0) / {h} * (i - d))) FILTER (i - d BETWEEN 1 AND 200), 0), 6) hawkes_{h}" for h in (3, 14, 30))}
 FROM cand c JOIN ce e ON e.priogrid_gid = c.priogrid_gid GROUP BY 1, 2""")
def hawkes_intensity(spark, d):
    e = grid_events(spark, d)
    issues = candidates(e)
    h = windows.hawkes(e, issues.select("priogrid_gid", "issue_day"), "priogrid_gid", "day", "issue_day")
    return issues.join(h, ["priogrid_gid", "issue_day"]).select("priogrid_gid", "issue_date", *[F.round(f"hawkes_{k}", 6).alias(f"hawkes_{k}") for k in (3, 14, 30)])


@query("hawkes_ring1", f"""WITH {CAND_SQL}, r1 AS {_ring_sql(1)} SELECT c.priogrid_gid, c.issue_date,
 {", ".join(f"round(coalesce(sum(exp(-ln(2.0) / {h} * (i - d))) FILTER (i - d BETWEEN 1 AND 200), 0), 6) hawkes_{h}" for h in (3, 14, 30))}
 FROM cand c LEFT JOIN r1 USING (priogrid_gid) GROUP BY 1, 2""")
def hawkes_ring1(spark, d):
    """The intensity of all events in the eight neighbouring cells together."""
    e = grid_events(spark, d)
    issues = candidates(e)
    daily = e.groupBy("priogrid_gid", "day").agg(F.sum("w").alias("w"))  # before each day is copied to eight cells
    near = daily.select(F.explode(keys.ring(F.col("priogrid_gid"), 1)).alias("priogrid_gid"), "day", "w").join(cells_of(e), "priogrid_gid", "left_semi")
    h = windows.hawkes(near, issues.select("priogrid_gid", "issue_day"), "priogrid_gid", "day", "issue_day", weight="w")
    return issues.join(h, ["priogrid_gid", "issue_day"]).select("priogrid_gid", "issue_date", *[F.round(f"hawkes_{k}", 6).alias(f"hawkes_{k}") for k in (3, 14, 30)])


@query("cusum", f"""WITH {CAND_SQL}, k AS (SELECT c.priogrid_gid, c.issue_date, {_age(1, 7)} w1, {_age(8, 14)} w2, {_age(15, 21)} w3, {_age(22, 28)} w4, {_age(29, 112)} / 12.0 b FROM cand c JOIN ce e ON e.priogrid_gid = c.priogrid_gid GROUP BY 1, 2)
 SELECT priogrid_gid, issue_date, round(greatest(0, w1 - b, w1 + w2 - 2 * b, w1 + w2 + w3 - 3 * b, w1 + w2 + w3 + w4 - 4 * b), 5) cusum_up, round(least(0, w1 - b, w1 + w2 - 2 * b, w1 + w2 + w3 - 3 * b, w1 + w2 + w3 + w4 - 4 * b), 5) cusum_down,
        round((w1 + w2 + w3 + w4) / 4.0 / (b + 0.1), 5) cusum_ratio FROM k""")
def cusum(spark, d):
    e = grid_events(spark, d)
    out = windows.cusum(windows.around_issues(e, candidates(e), "priogrid_gid", "day", "issue_day", windows.cusum_frames(), ["w"]))
    return out.select("priogrid_gid", "issue_date", *[F.round(c, 5).alias(c) for c in ("cusum_up", "cusum_down", "cusum_ratio")])


@query("month_anomaly", f"""WITH {CODED_SQL}, m AS (SELECT country, CAST(date_trunc('month', day) AS date) AS month, count(*) n FROM fx_coded GROUP BY 1, 2)
 SELECT country, month, lag(n) OVER w n_lag1, round(n - avg(n) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 5) n_anomaly FROM m WINDOW w AS (PARTITION BY country ORDER BY month)""")
def month_anomaly(spark, d):
    m = coded_events(spark, d).groupBy("country", F.to_date(F.trunc("day", "month")).alias("month")).agg(F.count(F.lit(1)).alias("n"))
    return windows.anomaly(m, "n", "country", "month").select("country", "month", "n_lag1", F.round("n_anomaly", 5).alias("n_anomaly"))


@query("grid_diffusion", f"""WITH {CAND_SQL},
 c30 AS (SELECT m.issue_date AS issue, e.priogrid_gid g, CAST(count(*) AS double) x FROM ev e JOIN mondays m ON m.issue_date - e.date_start BETWEEN 1 AND 30 GROUP BY 1, 2),
 allc AS (SELECT DISTINCT priogrid_gid g FROM ev), adj AS (SELECT a.g, b.g nb FROM allc a JOIN allc b ON abs((a.g - 1) // 720 - (b.g - 1) // 720) <= 1 AND abs((a.g - 1) % 720 - (b.g - 1) % 720) <= 1 AND a.g <> b.g),
 deg AS (SELECT g, count(*) k FROM adj GROUP BY 1),
 h1 AS (SELECT issue, g, sum(v) x FROM (SELECT issue, g, x / 2 v FROM c30 UNION ALL SELECT issue, adj.g, x / 2 / k FROM c30 JOIN adj ON adj.nb = c30.g JOIN deg ON deg.g = adj.g) GROUP BY 1, 2),
 h2 AS (SELECT issue, g, sum(v) x FROM (SELECT issue, g, x / 2 v FROM h1 UNION ALL SELECT issue, adj.g, x / 2 / k FROM h1 JOIN adj ON adj.nb = h1.g JOIN deg ON deg.g = adj.g) GROUP BY 1, 2),
 h3 AS (SELECT issue, g, sum(v) x FROM (SELECT issue, g, x / 2 v FROM h2 UNION ALL SELECT issue, adj.g, x / 2 / k FROM h2 JOIN adj ON adj.nb = h2.g JOIN deg ON deg.g = adj.g) GROUP BY 1, 2)
 SELECT c30.issue, c30.g priogrid_gid, round(h1.x, 9) hop_1, round(h2.x, 9) hop_2, round(h3.x, 9) hop_3 FROM c30 JOIN h1 USING (issue, g) JOIN h2 USING (issue, g) JOIN h3 USING (issue, g)""")
def grid_diffusion(spark, d):
    e = grid_events(spark, d)
    mondays = F.transform(F.sequence(F.lit(0), F.lit(4)), lambda k: F.date_add(F.next_day("date_start", "Mon"), (k * 7).cast("int")))
    ahead = e.select("priogrid_gid", "date_start", F.explode(mondays).alias("issue")).where("datediff(issue, date_start) between 1 and 30").where(f"issue between date '{FIRST}' and date '{LAST}'")
    counts = ahead.groupBy("issue", "priogrid_gid").agg(F.count(F.lit(1)).alias("x"))
    cells = e.select("priogrid_gid").distinct()
    adjacency = cells.select("priogrid_gid", F.explode(keys.ring(F.col("priogrid_gid"), 1)).alias("neighbour")).join(cells.withColumnRenamed("priogrid_gid", "neighbour"), "neighbour", "left_semi")
    return graph.diffuse(counts, adjacency, "issue", "priogrid_gid", "x", 3).withColumns({c: F.round(c, 9) for c in ("hop_1", "hop_2", "hop_3")})
