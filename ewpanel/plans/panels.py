"""Panel, projection, join and aggregation queries."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ewpanel.functions import keys, text
from ewpanel.functions.staging import staged
from ewpanel.operators import joins, panel, ranks
from ewpanel.plans.registry import query
from ewpanel.sources.fixtures import CODED_SQL, CONFLICT_SQL, LEDGER_SQL, coded_events, conflict_events, ledger, table

WEEK = "CAST(date_trunc('week', {}) AS date)"

PANEL_SQL = f"""{CONFLICT_SQL},
 obs AS (SELECT country, {WEEK.format('date_start')} AS week, count(*) n_events, CAST(sum(best) AS bigint) deaths, count(*) FILTER (type_of_violence = 1) n_state,
                count(*) FILTER (type_of_violence = 2) n_nonstate, count(*) FILTER (type_of_violence = 3) n_onesided, count(DISTINCT conflict_name) n_conflicts
         FROM fx_conflict GROUP BY 1, 2),
 ends AS (SELECT country, min(week) lo, max(week) hi FROM obs GROUP BY 1),
 spine AS (SELECT country, CAST(unnest(generate_series(lo, hi, INTERVAL 7 DAY)) AS date) AS week FROM ends),
 p AS (SELECT s.country, s.week, coalesce(n_events, 0) n_events, coalesce(deaths, 0) deaths, coalesce(n_state, 0) n_state, coalesce(n_nonstate, 0) n_nonstate,
              coalesce(n_onesided, 0) n_onesided, coalesce(n_conflicts, 0) n_conflicts FROM spine s LEFT JOIN obs o USING (country, week)),
 b AS (SELECT *, CASE WHEN count(*) OVER pw >= 4 THEN avg(deaths) OVER pw END m_d, CASE WHEN count(*) OVER pw >= 4 THEN stddev_samp(deaths) OVER pw END s_d,
              CASE WHEN count(*) OVER pw >= 4 THEN avg(n_events) OVER pw END m_e, CASE WHEN count(*) OVER pw >= 4 THEN stddev_samp(n_events) OVER pw END s_e
       FROM p WINDOW pw AS (PARTITION BY country ORDER BY week ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
 l AS (SELECT *, CAST(coalesce((deaths - m_d) / nullif(s_d, 0) > 1.5, false) OR coalesce((n_events - m_e) / nullif(s_e, 0) > 1.5, false) AS int) escalation FROM b)"""


@query("panel_escalation", f"""WITH {PANEL_SQL}
 SELECT country, week, n_events, deaths, n_state, n_nonstate, n_onesided, n_conflicts, round(deaths / greatest(n_events, 1), 6) deaths_per_event,
        round(m_d, 6) mean_deaths, round(s_d, 6) std_deaths, escalation, lead(escalation, 1) OVER w label_1, lead(escalation, 2) OVER w label_2, lead(escalation, 4) OVER w label_4,
        lag(n_events, 1) OVER w n_events_lag1, lag(deaths, 2) OVER w deaths_lag2, deaths - lag(deaths, 1) OVER w deaths_delta
 FROM l WINDOW w AS (PARTITION BY country ORDER BY week)""")
def panel_escalation(spark, d):
    p = panel.fatality_escalation(conflict_events(spark, d))
    return p.select("country", "week", "n_events", "deaths", "n_state", "n_nonstate", "n_onesided", "n_conflicts", F.round("deaths_per_event", 6).alias("deaths_per_event"),
                    F.round("mean_deaths", 6).alias("mean_deaths"), F.round("std_deaths", 6).alias("std_deaths"), "escalation", "label_1", "label_2", "label_4",
                    "n_events_lag1", "deaths_lag2", "deaths_delta")


@query("positive_rate_by_entity", f"""WITH {PANEL_SQL}, f AS (SELECT *, lead(escalation, 1) OVER (PARTITION BY country ORDER BY week) label_1 FROM l)
 SELECT country, count(*) n_weeks, count(label_1) n_labelled, CAST(sum(label_1) AS bigint) n_pos, round(avg(label_1), 6) positive_rate FROM f GROUP BY 1""")
def positive_rate_by_entity(spark, d):
    p = panel.fatality_escalation(conflict_events(spark, d))
    return p.groupBy("country").agg(F.count(F.lit(1)).alias("n_weeks"), F.count("label_1").alias("n_labelled"), F.sum("label_1").alias("n_pos"), F.round(F.avg("label_1"), 6).alias("positive_rate"))


CODED_PANEL_SQL = f"""{CODED_SQL},
 k AS (SELECT *, {WEEK.format('day')} AS week, substr(event_code, 1, 2) root FROM fx_coded),
 a AS (SELECT country, week, count(DISTINCT actor) distinct_actors FROM (SELECT country, week, unnest([actor1, actor2]) actor FROM k) WHERE actor IS NOT NULL GROUP BY 1, 2),
 c AS (SELECT country, week, count(*) n_events, count(quad_class) n_coded, count(*) FILTER (quad_class = 1) n_quad1, count(*) FILTER (quad_class = 2) n_quad2,
              count(*) FILTER (quad_class = 3) n_quad3, count(*) FILTER (quad_class = 4) n_quad4, count(*) FILTER (root IN ('18', '19', '20')) n_severe,
              count(*) FILTER (root IN ('14', '17')) n_coerce_protest, avg(goldstein) mean_goldstein, avg(tone) mean_tone, avg(CASE WHEN tone < 0 THEN 1.0 ELSE 0.0 END) tone_neg_share,
              CAST(sum(mentions) AS bigint) mentions, count(DISTINCT coalesce(actor1, '') || '|' || coalesce(actor2, '')) n_actor_pairs FROM k GROUP BY 1, 2)"""


@query("coded_panel", f"""WITH {CODED_PANEL_SQL}
 SELECT country, week, n_events, n_coded, n_quad1, n_quad2, n_quad3, n_quad4, n_severe, n_coerce_protest, round(mean_goldstein, 6) mean_goldstein, round(mean_tone, 6) mean_tone,
        round(tone_neg_share, 6) tone_neg_share, mentions, n_actor_pairs, coalesce(distinct_actors, 0) distinct_actors FROM c LEFT JOIN a USING (country, week)""")
def coded_panel(spark, d):
    p = panel.coded_panel(coded_events(spark, d))
    return p.withColumns({c: F.round(c, 6) for c in ("mean_goldstein", "mean_tone", "tone_neg_share")})


@query("coded_escalation", f"""WITH {CODED_PANEL_SQL},
 s AS (SELECT *, n_quad4 / greatest(n_events, 1) cs, n_severe / greatest(n_events, 1) ss FROM c),
 b AS (SELECT *, CASE WHEN count(*) OVER pw >= 4 THEN avg(cs) OVER pw END mc, CASE WHEN count(*) OVER pw >= 4 THEN stddev_samp(cs) OVER pw END sc,
              CASE WHEN count(*) OVER pw >= 4 THEN avg(ss) OVER pw END ms, CASE WHEN count(*) OVER pw >= 4 THEN stddev_samp(ss) OVER pw END sd,
              CASE WHEN count(*) OVER pw >= 4 THEN avg(mean_goldstein) OVER pw END mg
       FROM s WINDOW pw AS (PARTITION BY country ORDER BY week ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))
 SELECT country, week, CAST(coalesce((cs - mc) / nullif(sc, 0) > 1.5, false) OR coalesce(mg - mean_goldstein > 2, false) AS int) escalation_quad,
        CAST(coalesce((ss - ms) / nullif(sd, 0) > 1.5, false) OR coalesce(mg - mean_goldstein > 2, false) AS int) escalation_root FROM b""")
def coded_escalation(spark, d):
    return panel.coded_escalation(coded_events(spark, d)).select("country", "week", "escalation_quad", "escalation_root")


@query("global_summary", f"""WITH {CONFLICT_SQL} SELECT count(*) n_rows, count(DISTINCT country) n_countries, min(date_start) first_day, max(date_start) last_day, CAST(sum(best) AS bigint) total_best FROM fx_conflict""")
def global_summary(spark, d):
    return conflict_events(spark, d).agg(F.count(F.lit(1)).alias("n_rows"), F.countDistinct("country").alias("n_countries"), F.min("date_start").alias("first_day"), F.max("date_start").alias("last_day"), F.sum("best").alias("total_best"))


CELLS_SQL = """cells AS (SELECT priogrid_gid, count(*) n_events_total FROM fx_conflict WHERE date_prec <= 2 AND where_prec <= 3 GROUP BY 1 HAVING count(*) >= 15)"""


@query("active_cells", f"""WITH {CONFLICT_SQL}, {CELLS_SQL},
 m AS (SELECT priogrid_gid, country, count(*) n, row_number() OVER (PARTITION BY priogrid_gid ORDER BY count(*) DESC, country) r FROM fx_conflict WHERE date_prec <= 2 AND where_prec <= 3 GROUP BY 1, 2)
 SELECT c.priogrid_gid, m.country, c.n_events_total, round(((c.priogrid_gid - 1) // 720) / 2.0 - 90 + 0.25, 6) lat, round(((c.priogrid_gid - 1) % 720) / 2.0 - 180 + 0.25, 6) lon
 FROM cells c JOIN m ON m.priogrid_gid = c.priogrid_gid AND r = 1""")
def active_cells(spark, d):
    e = conflict_events(spark, d).where("date_prec <= 2 and where_prec <= 3 and priogrid_gid is not null and date_start is not null")
    cells = e.groupBy("priogrid_gid").agg(F.mode("country", True).alias("country"), F.count(F.lit(1)).alias("n_events_total")).where("n_events_total >= 15")
    return cells.withColumns({"lat": F.expr("round(floor((priogrid_gid - 1) / 720) / 2.0D - 90 + 0.25D, 6)"), "lon": F.expr("round(((priogrid_gid - 1) % 720) / 2.0D - 180 + 0.25D, 6)")})


@query("grid_id_round_trip", """WITH c AS (SELECT c_custkey, ((c_custkey % 170) - 85) + 0.1 lat, ((c_custkey * 7) % 350) - 175 + 0.3 lon FROM customer), g AS (SELECT *, CAST(floor((lat + 90) * 2) * 720 + floor((lon + 180) * 2) + 1 AS bigint) gid FROM c)
 SELECT c_custkey, gid, round(((gid - 1) // 720) / 2.0 - 89.75, 6) lat, round(((gid - 1) % 720) / 2.0 - 179.75, 6) lon, 1 same FROM g""")
def grid_id_round_trip(spark, d):
    """The cell of a point, the cell's centre, and whether the centre lies in the same cell again."""
    c = table(spark, d, "customer").select("c_custkey", keys.grid_id(F.expr("((c_custkey % 170) - 85) + 0.1D"), F.expr("((c_custkey * 7) % 350) - 175 + 0.3D")).alias("gid"))
    lat, lon = keys.grid_centre(F.col("gid"))
    c = c.withColumns({"lat": lat, "lon": lon})
    return c.select("c_custkey", "gid", F.round("lat", 6).alias("lat"), F.round("lon", 6).alias("lon"), (keys.grid_id(F.col("lat"), F.col("lon")) == F.col("gid")).cast("int").alias("same"))


@query("weekly_resample_sunday", f"""WITH {CONFLICT_SQL}, o AS (SELECT CAST(date_trunc('week', date_start) AS date) + 6 AS week_end, * FROM fx_conflict),
 g AS (SELECT week_end, count(*) n, CAST(sum(best) AS bigint) total, avg(best) m, count(DISTINCT country) n_countries FROM o GROUP BY 1),
 s AS (SELECT CAST(unnest(generate_series(min(week_end), max(week_end), INTERVAL 7 DAY)) AS date) AS week_end FROM g)
 SELECT s.week_end, coalesce(n, 0) n, coalesce(total, 0) total, round(m, 6) mean_best, coalesce(n_countries, 0) n_countries FROM s LEFT JOIN g USING (week_end)""")
def weekly_resample_sunday(spark, d):
    g = conflict_events(spark, d).groupBy(keys.week_sunday(F.col("date_start")).alias("week_end")).agg(F.count(F.lit(1)).alias("n"), F.sum("best").alias("total"), F.round(F.avg("best"), 6).alias("mean_best"), F.countDistinct("country").alias("n_countries"))
    return keys.calendar_spine(g.withColumn("k", F.lit(1)), "k", "week_end").drop("k").join(g, "week_end", "left").fillna(0, ["n", "total", "n_countries"])


@query("n_week_periods", f"""WITH {CONFLICT_SQL} SELECT country, CAST(date_trunc('week', date_start) AS date) - CAST((CAST(date_trunc('week', date_start) AS date) - DATE '1970-01-05') % 14 AS int) AS period, count(*) n FROM fx_conflict GROUP BY 1, 2""")
def n_week_periods(spark, d):
    return conflict_events(spark, d).groupBy("country", keys.period_key(F.col("date_start"), 2).alias("period")).agg(F.count(F.lit(1)).alias("n"))


@query("price_two_level", f"""WITH {CODED_SQL}, a AS (SELECT country, actor2 commodity, {WEEK.format('day')} AS week, avg(mentions) price FROM fx_coded GROUP BY 1, 2, 3),
 b AS (SELECT *, CASE WHEN count(price) OVER w >= 3 THEN avg(price) OVER w END base FROM a WINDOW w AS (PARTITION BY country, commodity ORDER BY week ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))
 SELECT country, week, round(avg((price - base) / nullif(base, 0)), 6) price_deviation, count(DISTINCT commodity) n_commodities FROM b GROUP BY 1, 2""")
def price_two_level(spark, d):
    a = coded_events(spark, d).groupBy("country", F.col("actor2").alias("commodity"), keys.week_monday(F.col("day")).alias("week")).agg(F.avg("mentions").alias("price"))
    w = Window.partitionBy("country", "commodity").orderBy("week").rowsBetween(Window.unboundedPreceding, -1)
    b = a.withColumn("base", F.when(F.count("price").over(w) >= 3, F.avg("price").over(w)))
    return b.groupBy("country", "week").agg(F.round(F.avg((F.col("price") - F.col("base")) / F.nullif("base", F.lit(0.0))), 6).alias("price_deviation"), F.countDistinct("commodity").alias("n_commodities"))


@query("climate_weekly", f"""WITH {CODED_SQL} SELECT country, {WEEK.format('day')} AS week, coalesce(CAST(sum(nullif(goldstein, -10)) AS bigint), 0) precip, round(avg(nullif(tone, -5)), 6) temp FROM fx_coded GROUP BY 1, 2""")
def climate_weekly(spark, d):
    e = coded_events(spark, d).withColumns({"p": F.nullif("goldstein", F.lit(-10)), "t": F.nullif("tone", F.lit(-5))})
    return e.groupBy("country", keys.week_monday(F.col("day")).alias("week")).agg(F.coalesce(F.sum("p"), F.lit(0)).alias("precip"), F.round(F.avg("t"), 6).alias("temp"))


@query("smoothed_ratio", f"""WITH {CODED_SQL} SELECT country, year(day) AS year, round((sum(CASE WHEN quad_class = 4 THEN 1 ELSE 0 END) + 1) / (count(*) + 1), 6) ratio, CAST(sum(mentions) AS bigint) year_mentions FROM fx_coded GROUP BY 1, 2""")
def smoothed_ratio(spark, d):
    return coded_events(spark, d).groupBy("country", F.year("day").cast("long").alias("year")).agg(F.round((F.count_if(F.col("quad_class") == 4) + 1) / (F.count(F.lit(1)) + 1), 6).alias("ratio"), F.sum("mentions").alias("year_mentions"))


@query("indicators_latest_wide", f"""WITH {CODED_SQL}, y AS (SELECT country, quad_class indicator, year(day) AS year, CAST(sum(mentions) AS bigint) AS value FROM fx_coded GROUP BY 1, 2, 3)
 SELECT country, max(CASE WHEN indicator = 1 THEN v END) ind_1, max(CASE WHEN indicator = 2 THEN v END) ind_2, max(CASE WHEN indicator = 1 THEN yr END) ind_1_year, max(CASE WHEN indicator = 2 THEN yr END) ind_2_year
 FROM (SELECT country, indicator, arg_max(value, year) v, max(year) yr FROM y GROUP BY 1, 2) GROUP BY 1""")
def indicators_latest_wide(spark, d):
    y = coded_events(spark, d).groupBy("country", F.col("quad_class").alias("indicator"), F.year("day").cast("long").alias("year")).agg(F.sum("mentions").alias("value"))
    latest = y.groupBy("country").pivot("indicator", [1, 2]).agg(F.max_by("value", "year").alias("v"), F.max("year").alias("y"))
    return latest.select("country", F.col("1_v").alias("ind_1"), F.col("2_v").alias("ind_2"), F.col("1_y").alias("ind_1_year"), F.col("2_y").alias("ind_2_year"))


ISSUES_SQL = f"""{CONFLICT_SQL}, ci AS (SELECT DISTINCT country, {WEEK.format('date_start')} AS issue FROM fx_conflict WHERE date_start >= DATE '1996-01-01')"""


def issue_weeks(spark, d):
    e = conflict_events(spark, d).where("date_start >= date '1996-01-01'")
    return e.select("country", keys.week_monday(F.col("date_start")).alias("issue")).distinct()


@query("asof_prior_week", f"""WITH {ISSUES_SQL}, {CODED_SQL}, c AS (SELECT country, {WEEK.format('day')} AS week, count(*) n_coded FROM fx_coded GROUP BY 1, 2)
 SELECT i.country, i.issue, c.n_coded FROM ci i LEFT JOIN c ON c.country = i.country AND c.week = i.issue - 7""")
def asof_prior_week(spark, d):
    weekly = coded_events(spark, d).groupBy("country", keys.week_monday(F.col("day")).alias("week")).agg(F.count(F.lit(1)).alias("n_coded"))
    return joins.prior_week(issue_weeks(spark, d), weekly, ["country"], "issue")


@query("asof_prior_month", f"""WITH {ISSUES_SQL}, {CODED_SQL}, c AS (SELECT country, CAST(date_trunc('month', day) AS date) AS month, count(*) n_month, CAST(sum(mentions) AS bigint) m_month FROM fx_coded GROUP BY 1, 2)
 SELECT i.country, i.issue, CAST(date_trunc('month', date_trunc('month', i.issue) - INTERVAL 1 DAY) AS date) AS month, coalesce(n_month, 0) n_month, coalesce(m_month, 0) m_month
 FROM ci i LEFT JOIN c ON c.country = i.country AND c.month = CAST(date_trunc('month', date_trunc('month', i.issue) - INTERVAL 1 DAY) AS date)""")
def asof_prior_month(spark, d):
    monthly = coded_events(spark, d).groupBy("country", F.to_date(F.trunc("day", "month")).alias("month")).agg(F.count(F.lit(1)).alias("n_month"), F.sum("mentions").alias("m_month"))
    return joins.prior_month(issue_weeks(spark, d), monthly, ["country"], "issue", "month", ["n_month", "m_month"])


@query("asof_running_month", f"""WITH {ISSUES_SQL}, {CODED_SQL}, c AS (SELECT country, CAST(date_trunc('month', day) AS date) AS month, count(*) n_month FROM fx_coded GROUP BY 1, 2)
 SELECT i.country, i.issue, CAST(date_trunc('month', i.issue - 1) AS date) AS month, coalesce(n_month, 0) n_month FROM ci i LEFT JOIN c ON c.country = i.country AND c.month = CAST(date_trunc('month', i.issue - 1) AS date)""")
def asof_running_month(spark, d):
    monthly = coded_events(spark, d).groupBy("country", F.to_date(F.trunc("day", "month")).alias("month")).agg(F.count(F.lit(1)).alias("n_month"))
    return joins.prior_month(issue_weeks(spark, d), monthly, ["country"], "issue", "month", ["n_month"], strict=False)


@query("asof_prior_year", f"""WITH {ISSUES_SQL}, {CODED_SQL}, c AS (SELECT country, year(day) AS year, count(*) applied FROM fx_coded GROUP BY 1, 2)
 SELECT i.country, i.issue, year(i.issue) - 1 AS year, applied FROM ci i LEFT JOIN c ON c.country = i.country AND c.year = year(i.issue) - 1""")
def asof_prior_year(spark, d):
    yearly = coded_events(spark, d).groupBy("country", F.year("day").alias("year")).agg(F.count(F.lit(1)).alias("applied"))
    return joins.prior_year(issue_weeks(spark, d), yearly, ["country"], "issue", "year")


@query("nearest_event", f"""WITH {ISSUES_SQL}, cal AS (SELECT country, date_start AS event_day, min(id) AS o FROM fx_conflict WHERE best = 5 AND country < 'R' GROUP BY 1, 2),
 x AS (SELECT i.country, i.issue, arg_min(event_day - i.issue, abs(event_day - i.issue) * 100000000 + o) n FROM ci i LEFT JOIN cal ON cal.country = i.country GROUP BY 1, 2)
 SELECT country, issue, coalesce(n, 9999) days_to_nearest, CAST(abs(coalesce(n, 9999)) <= 28 AS int) near FROM x""")
def nearest_event(spark, d):
    cal = conflict_events(spark, d).where("best = 5 and country < 'R'").select("country", F.col("date_start").alias("event_day"), "id")
    out = joins.nearest_event(issue_weeks(spark, d), cal, "country", "issue", "event_day", "id")
    return out.withColumn("days_to_nearest", F.col("days_to_nearest").cast("long"))


@query("forward_filled_spine", f"""WITH {CONFLICT_SQL}, w AS (SELECT country, {WEEK.format('date_start')} AS week, max(best) worst FROM fx_conflict WHERE best >= 7 GROUP BY 1, 2),
 r AS (SELECT min(week) lo, max(week) hi FROM w), k AS (SELECT DISTINCT country FROM w), s AS (SELECT country, CAST(unnest(generate_series(lo, hi, INTERVAL 7 DAY)) AS date) AS week FROM k, r),
 j AS (SELECT s.country, s.week, w.worst FROM s LEFT JOIN w USING (country, week))
 SELECT country, week, last_value(worst IGNORE NULLS) OVER (PARTITION BY country ORDER BY week) AS worst FROM j""")
def forward_filled_spine(spark, d):
    w = conflict_events(spark, d).where("best >= 7").groupBy("country", keys.week_monday(F.col("date_start")).alias("week")).agg(F.max("best").alias("worst"))
    ends = w.agg(F.min("week").alias("lo"), F.max("week").alias("hi"))
    spine = w.select("country").distinct().crossJoin(F.broadcast(ends)).select("country", F.explode(F.expr("sequence(lo, hi, interval 7 days)")).alias("week"))  # one row of ends
    return joins.forward_filled(spine, w, ["country", "week"], "country", "week", ["worst"])


@query("static_cell_attribute", f"""WITH {CONFLICT_SQL}, {CELLS_SQL}, a AS (SELECT CAST((180 + c_custkey % 12) * 720 + 360 + (c_custkey // 12) % 12 + 1 AS bigint) priogrid_gid, round(sum(c_acctbal), 2) pop FROM customer GROUP BY 1)
 SELECT c.priogrid_gid, n_events_total, round(CAST(pop AS double), 2) pop FROM cells c LEFT JOIN a USING (priogrid_gid)""")
def static_cell_attribute(spark, d):
    e = conflict_events(spark, d).where("date_prec <= 2 and where_prec <= 3").groupBy("priogrid_gid").agg(F.count(F.lit(1)).alias("n_events_total")).where("n_events_total >= 15")
    gid = F.expr("cast((180 + c_custkey % 12) * 720 + 360 + cast(floor(c_custkey / 12) as bigint) % 12 + 1 as bigint)")
    a = table(spark, d, "customer").groupBy(gid.alias("priogrid_gid")).agg(F.round(F.sum("c_acctbal").cast("double"), 2).alias("pop"))
    return e.join(a, "priogrid_gid", "left")


@query("zonal_statistics", """WITH px AS (SELECT (c_custkey % 40) / 4.0 + 0.1 AS lat, (c_custkey % 36) / 4.0 + 0.05 AS lon, CAST(c_acctbal AS double) AS value FROM customer),
 cells AS (SELECT DISTINCT floor(lat * 2) / 2 + 0.25 AS y, floor(lon * 2) / 2 + 0.25 AS x FROM px)
 SELECT CAST(floor((y + 90) * 2) * 720 + floor((x + 180) * 2) + 1 AS bigint) priogrid_gid, round(avg(CASE WHEN value > -1 THEN value END), 3) mean_value, round(sum(greatest(value, 0)), 3) sum_value, count(*) n_pixels
 FROM cells JOIN px ON abs(lat - y) <= 0.25 AND abs(lon - x) <= 0.25 GROUP BY y, x""")
def zonal_statistics(spark, d):
    px = table(spark, d, "customer").select(F.expr("(c_custkey % 40) / 4.0D + 0.1D").alias("lat"), F.expr("(c_custkey % 36) / 4.0D + 0.05D").alias("lon"), F.col("c_acctbal").cast("double").alias("value"))
    cells = px.select((F.floor(F.col("lat") * 2) / 2 + 0.25).alias("lat"), (F.floor(F.col("lon") * 2) / 2 + 0.25).alias("lon")).distinct()
    cells = cells.withColumn("priogrid_gid", keys.grid_id(F.col("lat"), F.col("lon")))
    return joins.zonal(px, cells).withColumns({"mean_value": F.round("mean_value", 3), "sum_value": F.round("sum_value", 3)})


@query("covariate_blocks_joined", f"""WITH {CONFLICT_SQL}, {CODED_SQL}, a AS (SELECT country, {WEEK.format('date_start')} AS week, count(*) n_events FROM fx_conflict GROUP BY 1, 2),
 b AS (SELECT country, {WEEK.format('day')} AS week, count(*) n_coded FROM fx_coded GROUP BY 1, 2), r AS (SELECT DISTINCT country, region FROM fx_conflict)
 SELECT country, region, week, n_events, coalesce(n_coded, 0) n_coded FROM a LEFT JOIN b USING (country, week) JOIN r USING (country)""")
def covariate_blocks_joined(spark, d):
    e = conflict_events(spark, d)
    a = e.groupBy("country", keys.week_monday(F.col("date_start")).alias("week")).agg(F.count(F.lit(1)).alias("n_events"))
    b = coded_events(spark, d).groupBy("country", keys.week_monday(F.col("day")).alias("week")).agg(F.count(F.lit(1)).alias("n_coded"))
    return a.join(b, ["country", "week"], "left").fillna(0, ["n_coded"]).join(e.select("country", "region").distinct(), "country")


@query("historical_rate", f"""WITH {LEDGER_SQL}, h AS (SELECT entity, avg(actual) r FROM fx_ledger WHERE period < DATE '1998-01-05' AND entity < 'M' GROUP BY 1), g AS (SELECT avg(actual) r FROM fx_ledger WHERE period < DATE '1998-01-05' AND entity < 'M')
 SELECT e.entity, round(coalesce(h.r, g.r), 6) rate FROM (SELECT DISTINCT entity FROM fx_ledger) e LEFT JOIN h USING (entity) CROSS JOIN g""")
def historical_rate(spark, d):
    led = ledger(spark, d)
    past = led.where("period < date '1998-01-05' and entity < 'M'")
    each = led.select("entity").distinct().join(past.groupBy("entity").agg(F.avg("actual").alias("own")), "entity", "left")
    return each.crossJoin(F.broadcast(past.agg(F.avg("actual").alias("overall")))).select("entity", F.round(F.coalesce("own", "overall"), 6).alias("rate"))  # one row


@query("imputation", f"""WITH {CODED_SQL}, g AS (SELECT country, {WEEK.format('day')} AS week, avg(CASE WHEN quad_class = 4 AND goldstein < -5 THEN tone END) x FROM fx_coded GROUP BY 1, 2),
 s AS (SELECT avg(x) m, median(x) md FROM g)
 SELECT country, week, round(coalesce(x, m), 6) x_mean, round(coalesce(x, md), 6) x_median, CAST(x IS NOT NULL AS int) covered, round(coalesce(x, 0), 6) x_zero FROM g, s""")
def imputation(spark, d):
    g = coded_events(spark, d).groupBy("country", keys.week_monday(F.col("day")).alias("week")).agg(F.avg(F.when((F.col("quad_class") == 4) & (F.col("goldstein") < -5), F.col("tone"))).alias("x"))
    g = staged(g)  # a row for each country-week, read for the mean, the median and the result
    s = g.agg(F.avg("x").alias("m")).crossJoin(ranks.quantiles(g, [], "x", [0.5]).withColumnRenamed("q0", "md"))  # one row each
    return g.crossJoin(F.broadcast(s)).select("country", "week", F.round(F.coalesce("x", "m"), 6).alias("x_mean"), F.round(F.coalesce("x", "md"), 6).alias("x_median"), F.col("x").isNotNull().cast("int").alias("covered"), F.round(F.coalesce("x", F.lit(0.0)), 6).alias("x_zero"))  # one row


@query("recency_and_systematic_sample", f"""WITH {LEDGER_SQL}, r AS (SELECT *, row_number() OVER (PARTITION BY entity ORDER BY period, id) a, row_number() OVER (PARTITION BY entity ORDER BY period DESC, id DESC) z, count(*) OVER (PARTITION BY entity) n FROM fx_ledger)
 SELECT id, entity, CAST(z <= 20 AS int) latest_20, round((a - 1) / greatest(1, n - 1), 6) recency FROM r WHERE (a - 1) % 5 = 0""")
def recency_and_systematic_sample(spark, d):
    r = ranks.ranked(ledger(spark, d).withColumn("_d", F.unix_date("period")), ["entity"], "_d", ["id"], descending=False).withColumnsRenamed({"k": "a", "k_all": "n"})
    return r.where("(a - 1) % 5 = 0").select("id", "entity", (F.col("n") - F.col("a") < 20).cast("int").alias("latest_20"), F.round((F.col("a") - 1) / F.greatest(F.lit(1), F.col("n") - 1), 6).alias("recency"))


@query("standardised_features", f"""WITH {CONFLICT_SQL}, g AS (SELECT country, {WEEK.format('date_start')} AS week, count(*) x, CAST(sum(best) AS double) y FROM fx_conflict GROUP BY 1, 2), s AS (SELECT country, avg(x) mx, stddev_pop(x) sx, avg(y) my, stddev_pop(y) sy FROM g GROUP BY 1)
 SELECT country, week, round((x - mx) / (sx + 1e-9), 5) x, round((y - my) / (sy + 1e-9), 5) y FROM g JOIN s USING (country)""")
def standardised_features(spark, d):
    from ewpanel.operators.retrieval import standardise

    g = conflict_events(spark, d).groupBy("country", keys.week_monday(F.col("date_start")).alias("week")).agg(F.count(F.lit(1)).cast("double").alias("x"), F.sum("best").cast("double").alias("y"))
    return standardise(g, ["x", "y"], ["country"]).select("country", "week", F.round("x", 5).alias("x"), F.round("y", 5).alias("y"))


@query("vocabulary_sets", f"""WITH {CONFLICT_SQL} SELECT DISTINCT name FROM (SELECT side_a AS name FROM fx_conflict UNION SELECT side_b FROM fx_conflict) EXCEPT (SELECT side_a FROM fx_conflict WHERE best > 8 INTERSECT SELECT side_a FROM fx_conflict WHERE best < 1)""")
def vocabulary_sets(spark, d):
    e = conflict_events(spark, d)
    names = e.select(F.col("side_a").alias("name")).union(e.select("side_b")).distinct()
    return names.subtract(e.where("best > 8").select("side_a").intersect(e.where("best < 1").select("side_a")))


@query("resumable_log", """WITH c AS (SELECT o_orderkey AS config FROM orders WHERE o_orderkey % 7 = 0), done AS (SELECT o_orderkey AS config FROM orders WHERE o_orderkey % 3 = 0) SELECT config FROM c WHERE config NOT IN (SELECT config FROM done)""")
def resumable_log(spark, d):
    o = table(spark, d, "orders")
    return o.where("o_orderkey % 7 = 0").select(F.col("o_orderkey").alias("config")).join(o.where("o_orderkey % 3 = 0").select(F.col("o_orderkey").alias("config")), "config", "left_anti")


@query("json_properties", """SELECT event_type, count(*) n, CAST(sum(CAST(json_extract(props, '$.k') AS bigint)) AS bigint) k_total FROM events GROUP BY 1""")
def json_properties(spark, d):
    e = table(spark, d, "events").withColumn("k", F.from_json("props", "k bigint")["k"])
    return e.groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("k").alias("k_total"))


@query("text_terms", """SELECT doc_id, CAST(len(regexp_extract_all(text, '(?i)\\b(?:the|of|and)\\b')) AS int) n_common,  CAST(regexp_matches(text, '(?i)tion|ment') AS int) has_suffix, CAST(length(text) AS int) n_chars FROM documents""")
def text_terms(spark, d):
    t = F.col("text")
    return table(spark, d, "documents").select("doc_id", text.term_count(t, ["the", "of", "and"]).alias("n_common"),
                                               text.contains_any(t, ["tion", "ment"]).cast("int").alias("has_suffix"), F.length("text").alias("n_chars"))


@query("clip_weekly_features", """WITH c AS (SELECT *, DATE '2026-05-01' + CAST(doc_id % 99 AS int) AS day, 1 + doc_id % 3 AS relevance, len(regexp_extract_all(text, '(?i)\\b(?:the|of|and)\\b')) n_common FROM documents)
 SELECT CAST(date_trunc('week', day) AS date) AS week, count(*) n_clips, round(avg(relevance), 6) mean_relevance, round(avg(CASE WHEN n_common > 0 THEN 1.0 ELSE 0.0 END), 6) share_hit, round(avg(n_common), 6) mean_hits,
 count(DISTINCT source) n_stations, round(avg(CASE WHEN lang = 'en' THEN 1.0 ELSE 0.0 END), 6) share_en, round(avg(length(text)), 6) mean_length FROM c WHERE relevance >= 2 GROUP BY 1""")
def clip_weekly_features(spark, d):
    c = table(spark, d, "documents").withColumns({"day": F.expr("date_add(date '2026-05-01', cast(doc_id % 99 as int))"), "relevance": F.expr("1 + doc_id % 3"), "n_common": text.term_count(F.col("text"), ["the", "of", "and"])})
    flag = lambda x: F.round(F.avg(F.when(x, 1.0).otherwise(0.0)), 6)
    return c.where("relevance >= 2").groupBy(keys.week_monday(F.col("day")).alias("week")).agg(
        F.count(F.lit(1)).alias("n_clips"), F.round(F.avg("relevance"), 6).alias("mean_relevance"), flag(F.col("n_common") > 0).alias("share_hit"), F.round(F.avg("n_common"), 6).alias("mean_hits"),
        F.countDistinct("source").alias("n_stations"), flag(F.col("lang") == "en").alias("share_en"), F.round(F.avg(F.length("text")), 6).alias("mean_length"))
