"""Models under temporal validation, regression tests and stream twins (no SQL where it cannot say them)."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ewpanel.functions import keys
from ewpanel.functions.staging import staged
from ewpanel.operators import embedding, graph, metrics, models, panel, retrieval, stats
from ewpanel.plans.candidates import candidate_age_windows, candidate_forward_labels
from ewpanel.plans.graphs import DOCS_SQL, hyper, smoothed, tfidf, theme_docs, theme_frequency
from ewpanel.plans.panels import PANEL_SQL
from ewpanel.plans.registry import query
from ewpanel.sources.fixtures import CONFLICT_SQL, conflict_events, table
from ewpanel.streaming import feeds

FEATURES = ["n_events", "deaths", "n_events_lag1", "deaths_lag1", "n_events_lag2"]


def labelled_panel(spark, d):
    """The panel that the fits read again and again: staged, a row for each country-week."""
    p = panel.fatality_escalation(conflict_events(spark, d))
    return staged(p.select("country", "week", *FEATURES, F.col("label_1").alias("actual")))


@query("ensemble_frozen_threshold")
def ensemble_frozen_threshold(spark, d):
    """Mean of logistic and forest scores fitted before 1999, threshold chosen on 1999, reported on later weeks."""
    p = labelled_panel(spark, d).where("actual is not null")
    scored = models.fit_score(p.where("week < date '1999-01-04'"), p.where("week >= date '1999-01-04'"), FEATURES, "actual", ("logistic", "forest"))
    scored = scored.select("country", "week", "prob", F.col("actual").cast("long").alias("actual"))
    chosen = metrics.lowest_or_closest(scored.where("week < date '2000-01-03'"), 0.3, [])
    later = scored.where("week >= date '2000-01-03'").crossJoin(F.broadcast(chosen))  # one row
    return metrics.f1_fpr_mcc(metrics.confusion(later, F.col("threshold"), ["threshold"]))


@query("out_of_fold_ranking")
def out_of_fold_ranking(spark, d):
    """Rolling blocks of a year: boosted trees fitted on earlier years (one period embargo), average precision and AUC by country."""
    p = labelled_panel(spark, d).where("actual is not null")
    cuts = ["1998-01-05", "1999-01-04", "2000-01-03"]
    folds = [(F.date_add("week", 14) <= F.lit(a).cast("date"), (F.col("week") >= F.lit(a).cast("date")) & (F.col("week") < F.lit(b).cast("date"))) for a, b in zip(cuts, [*cuts[1:], "2001-01-01"])]
    scored = models.out_of_fold(p, folds, FEATURES, "actual", kinds=("boosted",), rounds=5)
    return metrics.ranking(scored.select("country", "prob", F.col("actual").cast("long").alias("actual")), ["country"])


@query("two_stage_severity")
def two_stage_severity(spark, d):
    """P(event) * P(severe | event) on candidate cells, each stage fitted on issues before 2000."""
    f = labelled_cells(spark, d)
    features = ["count_30d", "count_90d", "count_365d", "n_hist", "momentum"]
    past, later = f.where("issue_date < date '2000-01-03'"), f.where("issue_date >= date '2000-01-17'")
    one = models.fit_score(past, later, features, "label_14").select("priogrid_gid", "issue_date", F.col("prob").alias("p_event"), "severe_14")
    two = models.fit_score(past.where("label_14 = 1"), later, features, "severe_14", least=5).select("priogrid_gid", "issue_date", F.col("prob").alias("p_severe"))
    both = one.join(two, ["priogrid_gid", "issue_date"]).withColumns({"prob": F.col("p_event") * F.col("p_severe"), "actual": F.col("severe_14").cast("long")})
    return metrics.ranking(both.withColumn("year", F.year("issue_date")), ["year"])


def _eliminate_sql(source, names, pivots, keep, tag):
    """CTEs of Gaussian elimination of the pivots, one a step, on columns m_a_b; the last is {tag}."""
    at = lambda a, b: f"m_{a}_{b}" if names.index(a) <= names.index(b) else f"m_{b}_{a}"
    left, steps = list(names), []
    for i, p in enumerate(pivots):
        left.remove(p)
        cells = ", ".join(f"{at(a, b)} - {at(p, a)} * {at(p, b)} / {at(p, p)} AS {at(a, b)}" for k, a in enumerate(left) for b in left[k:])
        name = tag if i == len(pivots) - 1 else f"{tag}_{i}"
        steps.append(f"{name} AS (SELECT {keep}, {cells} FROM {source})")
        source = name
    return ", ".join(steps)


def _granger_sql():
    tests = {k: ["one", *[f"y{i}" for i in range(1, k + 1)], *[f"x{i}" for i in range(1, k + 1)], "y0"] for k in (1, 2)}
    parts = []
    for k, names in tests.items():
        cells = ", ".join(f"sum({a} * {b}) m_{a}_{b}" for i, a in enumerate(names) for b in names[i:])
        parts.append(f"s{k} AS (SELECT country, count(*) n, {cells} FROM lg WHERE y{k} IS NOT NULL GROUP BY 1 HAVING any_value(np) >= 12)")
        own, rest = names[: k + 1], names[k + 1 :]
        parts.append(_eliminate_sql(f"s{k}", names, own, "country, n", f"o{k}"))
        parts.append(f"b{k} AS (SELECT *, m_y0_y0 rss0 FROM o{k})")
        parts.append(_eliminate_sql(f"b{k}", rest, rest[:-1], "country, n, rss0", f"u{k}"))
        parts.append(f"g{k} AS (SELECT country, n, {k} AS lag, CAST(n - {2 * k + 1} AS double) fr, (rss0 - m_y0_y0) / {k} / (m_y0_y0 / (n - {2 * k + 1})) f FROM u{k} WHERE n > {2 * k + 1})")
    tail = """t1 AS (SELECT *, CASE WHEN fr % 2 = 0 THEN 1 - sqrt(f / (fr + f)) * (SELECT sum(exp(lgamma(j + 0.5) - lgamma(0.5) - lgamma(j + 1)) * (fr / (fr + f)) ** j) FROM range(CAST(fr / 2 AS bigint)) r(j))
        ELSE 1 - 2 / pi() * (atan(sqrt(f / fr)) + sqrt(f / (fr + f)) * coalesce((SELECT sum(exp(lgamma(j + 1) + lgamma(1.5) - lgamma(j + 1.5)) * (fr / (fr + f)) ** (j + 0.5)) FROM range(CAST((fr - 1) / 2 AS bigint)) r(j)), 0)) END p FROM g1),
 t2 AS (SELECT *, (fr / (fr + 2 * f)) ** (fr / 2) p FROM g2), a AS (SELECT country, n, lag, f, p FROM t1 UNION ALL SELECT country, n, lag, f, p FROM t2)"""
    return f"""WITH {PANEL_SQL}, c AS (SELECT country, week, n_events - avg(n_events) OVER k x0, deaths - avg(deaths) OVER k y0, count(*) OVER k np FROM p WINDOW k AS (PARTITION BY country)),
 lg AS (SELECT *, 1.0 one, lag(y0) OVER o y1, lag(y0, 2) OVER o y2, lag(x0) OVER o x1, lag(x0, 2) OVER o x2 FROM c WINDOW o AS (PARTITION BY country ORDER BY week)),
 {', '.join(parts)}, {tail}
 SELECT country, round(f, 4) f, round(p, 6) p, lag, n FROM (SELECT *, row_number() OVER (PARTITION BY country ORDER BY p, lag) k FROM a) WHERE k = 1"""


@query("granger_by_country", _granger_sql())
def granger_by_country(spark, d):
    """Do the events of the weeks before help to predict deaths? The better of the tests with one and two lags, by country."""
    p = panel.dense(panel.fatality_panel(conflict_events(spark, d)), "country", "week", ["n_events", "deaths"])
    return stats.ssr_granger(p, "country", "week", "deaths", "n_events", 2).withColumns({"f": F.round("f", 4), "p": F.round("p", 6)})


POOLED = ["y1", "y2", "x1", "y0"]


@query("pooled_effects_ftest", f"""WITH {CONFLICT_SQL}, o AS (SELECT country, CAST(date_trunc('week', date_start) AS date) AS week, CAST(count(*) AS double) x, CAST(sum(best) AS double) y FROM fx_conflict GROUP BY 1, 2),
 l AS (SELECT country, y y0, lag(y) OVER w y1, lag(y, 2) OVER w y2, lag(x) OVER w x1 FROM o WINDOW w AS (PARTITION BY country ORDER BY week)),
 c AS (SELECT country, {', '.join(f'{v} - avg({v}) OVER k {v}' for v in POOLED)} FROM l WHERE y2 IS NOT NULL WINDOW k AS (PARTITION BY country)),
 s AS (SELECT count(*) n, count(DISTINCT country) e, {', '.join(f'sum({a} * {b}) m_{a}_{b}' for i, a in enumerate(POOLED) for b in POOLED[i:])}, sum(y0 * y0) vv FROM c),
 {_eliminate_sql('s', POOLED, POOLED[:2], 'n, e, vv', 'r')}, q AS (SELECT n, n - e - 3 fr, vv, m_y0_y0 rss0, m_y0_y0 - m_x1_y0 * m_x1_y0 / m_x1_x1 rss1, m_x1_y0 / m_x1_x1 coef FROM r),
 z AS (SELECT *, CAST(fr AS double) b, (rss0 - rss1) / (rss1 / fr) f FROM q)
 SELECT n, round(f, 4) f, round(CASE WHEN fr % 2 = 0 THEN 1 - sqrt(f / (b + f)) * (SELECT sum(exp(lgamma(j + 0.5) - lgamma(0.5) - lgamma(j + 1)) * (b / (b + f)) ** j) FROM range(CAST(b / 2 AS bigint)) r(j))
   ELSE 1 - 2 / pi() * (atan(sqrt(f / b)) + sqrt(f / (b + f)) * (SELECT sum(exp(lgamma(j + 1) + lgamma(1.5) - lgamma(j + 1.5)) * (b / (b + f)) ** (j + 0.5)) FROM range(CAST((b - 1) / 2 AS bigint)) r(j))) END, 6) p,
   round(1 - rss1 / vv, 6) r2, round(coef, 6) coef FROM z""")
def pooled_effects_ftest(spark, d):
    """Country effects and two own lags of deaths, with and without last week's events: F, p, share explained within countries."""
    o = conflict_events(spark, d).groupBy("country", keys.week_monday(F.col("date_start")).alias("week")).agg(F.count(F.lit(1)).cast("double").alias("x"), F.sum("best").cast("double").alias("y"))
    w = Window.partitionBy("country").orderBy("week")
    r = stats.pooled_effects_ftest(o.withColumns({"y1": F.lag("y").over(w), "y2": F.lag("y", 2).over(w), "x1": F.lag("x").over(w)}), "country", "y", ["y1", "y2"], "x1")
    cut = lambda v, k: None if v is None else round(v, k)
    return spark.createDataFrame([(r["n"], cut(r["f"], 4), cut(r["p"], 6), cut(r["r2"], 6), cut(r["coef"], 6))], "n long, f double, p double, r2 double, coef double")


def theme_vectors(spark, d):
    """U * sqrt(S) of the theme PPMI matrix, at most twelve components and two fewer than themes."""
    edges = graph.ppmi(graph.co_occurrence(theme_docs(spark, d), "themes"))
    n = edges.select("theme_a").distinct().count()
    if n < 3:
        return spark.createDataFrame([], "key string, vector array<double>")
    u, _, s = embedding.truncated_svd(edges, "theme_a", "theme_b", "ppmi", min(12, n - 2))
    return embedding.scaled(u, [x**0.5 for x in s])


@query("theme_svd_embedding")
def theme_svd_embedding(spark, d):
    """Truncated SVD of the theme PPMI matrix: U * sqrt(S), signs set so that the largest component is positive."""
    return theme_vectors(spark, d).withColumnRenamed("key", "theme")


@query("country_week_theme_vectors")
def country_week_theme_vectors(spark, d):
    """Theme rows joined with the theme vectors: count-weighted mean by country and week."""
    return embedding.weighted_means(theme_frequency(spark, d), theme_vectors(spark, d), ["country", "week"], "theme", "n")


@query("country_week_theme_profile", f"""WITH {DOCS_SQL}, f AS (SELECT n_name country, CAST(date_trunc('week', o_orderdate) AS date) AS week, th theme, count(*) n FROM (SELECT doc, unnest(themes) th FROM docs) JOIN orders ON o_orderkey = doc JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY 1, 2, 3),
 t AS (SELECT doc, unnest(themes) th FROM docs), e AS (SELECT a.th a, b.th b, count(*) w FROM t a JOIN t b ON a.doc = b.doc AND a.th < b.th GROUP BY 1, 2 HAVING count(*) >= 2), s AS (SELECT a, b, w FROM e UNION ALL SELECT b, a, w FROM e),
 r AS (SELECT a, greatest(sum(w), 1) r FROM s GROUP BY 1), v AS (SELECT * FROM (SELECT s.a, s.b, ln(w * (SELECT sum(w) FROM s) / (r1.r * r2.r) + 1e-9) p FROM s JOIN r r1 ON r1.a = s.a JOIN r r2 ON r2.a = s.b) WHERE p > 0),
 k AS (SELECT * FROM f WHERE theme IN (SELECT a FROM v)), g AS (SELECT country, week, sum(n) total FROM k GROUP BY 1, 2)
 SELECT country, week, b theme_b, round(sum(n * p) / any_value(total), 6) x FROM k JOIN v ON v.a = k.theme JOIN g USING (country, week) GROUP BY 1, 2, 3""")
def country_week_theme_profile(spark, d):
    """The same mean of the whole PPMI rows, before any component is cut: how near each theme is to what a country-week writes about."""
    edges = graph.ppmi(graph.co_occurrence(theme_docs(spark, d), "themes"))
    m = embedding.weighted_row_means(theme_frequency(spark, d), edges, ["country", "week"], "theme", "n", "theme_a", "theme_b", "ppmi")
    return m.withColumn("x", F.round("x", 6))


@query("theme_hypergraph_embedding")
def theme_hypergraph_embedding(spark, d):
    """Themes by country-weeks, log1p(count) * ln(N / df), themes of three occurrences at least: U * S of twelve components, then the count-weighted mean by country and week."""
    f = theme_frequency(spark, d).withColumn("node", F.concat_ws("|", "country", F.col("week").cast("string")))
    weights = staged(tfidf(f))
    n = weights.select("theme").distinct().count()
    k = min(12, min(n, weights.select("node").distinct().count()) - 1)
    if k < 1:
        return spark.createDataFrame([], "country string, week date, i int, x double")
    u, _, s = embedding.truncated_svd(weights, "theme", "node", "weight", k)
    return embedding.weighted_means(f, embedding.scaled(u, s), ["country", "week"], "theme", "n")


def _spread_sql():
    steps = []
    for k in range(5):
        steps.append(f"f{k + 1} AS (SELECT y.u, y.y0 + coalesce(sum(s * f.f0), 0) f0, y.y1 + coalesce(sum(s * f.f1), 0) f1 FROM y LEFT JOIN st ON st.u = y.u LEFT JOIN f{k} f ON f.u = st.w GROUP BY y.u, y.y0, y.y1)")
    return ", ".join(steps)


@query("label_spreading", f"""WITH x AS (SELECT vec_id, label % 2 y, generate_subscripts(embedding, 1) i, CAST(unnest(embedding) AS double) v FROM embeddings), m AS (SELECT i, avg(v) a, stddev_pop(v) s FROM x GROUP BY 1),
 z AS (SELECT vec_id u, list((v - a) / CASE WHEN s = 0 THEN 1 ELSE s END ORDER BY i) e FROM x JOIN m USING (i) GROUP BY 1), p AS (SELECT a.u, b.u w, round(list_distance(a.e, b.e) ** 2, 9) d FROM z a JOIN z b ON a.u <> b.u),
 n AS (SELECT u, w FROM (SELECT *, row_number() OVER (PARTITION BY u ORDER BY d, w) k FROM p) WHERE k <= 7), g AS (SELECT u, w FROM n UNION SELECT w, u FROM n), deg AS (SELECT u, count(*) k FROM g GROUP BY 1),
 st AS (SELECT g.u, g.w, 0.2 / sqrt(a.k * b.k) s FROM g JOIN deg a ON a.u = g.u JOIN deg b ON b.u = g.w), y AS (SELECT vec_id u, CASE WHEN vec_id % 2 = 0 AND label % 2 = 0 THEN 0.8 ELSE 0.0 END y0, CASE WHEN vec_id % 2 = 0 AND label % 2 = 1 THEN 0.8 ELSE 0.0 END y1 FROM embeddings),
 f0 AS (SELECT u, y0 f0, y1 f1 FROM y), {_spread_sql()}
 SELECT u vec_id, round(CASE WHEN f0 + f1 > 0 THEN f1 / (f0 + f1) ELSE (SELECT avg(CAST(label % 2 AS double)) FROM embeddings WHERE vec_id % 2 = 0) END, 6) prob FROM f5""")
def label_spreading(spark, d):
    """Labels of half the vectors spread over the graph of the seven nearest standardised neighbours, five rounds."""
    v = table(spark, d, "embeddings").select("vec_id", "label", "embedding")
    each = v.select("vec_id", F.posexplode("embedding").alias("i", "x")).withColumn("x", F.col("x").cast("double"))
    stats = each.groupBy("i").agg(F.avg("x").alias("a"), F.stddev_pop("x").alias("s"))
    z = each.join(F.broadcast(stats), "i")  # a row for each dimension
    z = z.groupBy("vec_id").agg(F.array_sort(F.collect_list(F.struct("i", ((F.col("x") - F.col("a")) / F.when(F.col("s") == 0, 1.0).otherwise(F.col("s"))).alias("z")))).alias("p")).select("vec_id", F.col("p.z").alias("z"))
    nodes = v.select(F.col("vec_id").alias("node"), F.when(F.col("vec_id") % 2 == 0, F.col("label") % 2).alias("known"))
    return graph.spread_labels(retrieval.nearest(z, "vec_id", "z", 7), nodes).select(F.col("node").alias("vec_id"), F.round("prob", 6).alias("prob"))


CELL = ["count_30d", "count_90d", "count_365d", "n_hist", "momentum"]


def labelled_cells(spark, d):
    """Candidate cells with their windows and labels, staged for the fits."""
    return staged(candidate_age_windows(spark, d).join(candidate_forward_labels(spark, d), ["priogrid_gid", "issue_date"]))


@query("multi_split_ensemble")
def multi_split_ensemble(spark, d):
    """Logistic models of three split dates on the common latest window, mean score and mean threshold."""
    p = labelled_panel(spark, d).where("actual is not null")
    scored = models.multi_split(p, "week", ["1998-01-05", "1998-07-06", "1999-01-04"], "2000-01-03", ["country", "week"], FEATURES, "actual", 0.3)
    return metrics.f1_fpr_mcc(metrics.confusion(scored.select("prob", "threshold", F.col("actual").cast("long").alias("actual")), F.col("threshold"), ["threshold"]))


@query("unseen_type_auc")
def unseen_type_auc(spark, d):
    """Each event type hidden from the training labels in turn: ranking of its later events against quiet cells."""
    f = labelled_cells(spark, d)
    past, later = f.where("issue_date < date '1999-01-04'"), f.where("issue_date >= date '1999-01-18'")
    parts = []
    for kind in (1, 2, 3):
        masked = past.withColumn("y", F.when(F.col("type_14") == kind, 0).otherwise(F.col("label_14")))
        test = later.where((F.col("type_14") == kind) | (F.col("label_14") == 0))
        scored = models.fit_score(masked, test, CELL, "y")
        parts.append(scored.select(F.lit(kind).alias("hidden_type"), "prob", F.col("label_14").cast("long").alias("actual")))
    return metrics.ranking(parts[0].union(parts[1]).union(parts[2]), ["hidden_type"])


@query("walk_forward_signal")
def walk_forward_signal(spark, d):
    """Country-week probabilities, each year scored by a model of the years before, as a feature of the week after."""
    p = labelled_panel(spark, d)
    cuts = ["1998-01-05", "1999-01-04", "2000-01-03", "2001-01-01"]
    folds_ = [(F.date_add("week", 14) <= F.lit(a).cast("date"), (F.col("week") >= F.lit(a).cast("date")) & (F.col("week") < F.lit(b).cast("date"))) for a, b in zip(cuts, cuts[1:])]
    scored = models.out_of_fold(p, folds_, FEATURES, "actual")
    return scored.select("country", F.date_add("week", 7).alias("issue_date"), F.col("prob").alias("signal"))


@query("structural_classifier")
def structural_classifier(spark, d):
    """A classifier of hypergraph degrees and smoothed signals of country-weeks, fitted once on earlier weeks; severe weeks ranked by year."""
    x = smoothed(spark, d).join(graph.structural_features(hyper(spark, d)), "node_id").cache()  # a row for each country-week, read by every fit
    features = ["gx", "ggx", "degree", "co_memberships", "mean_co_degree"]
    scored = models.fit_score(x.where("week < '1999-01-04'"), x.where("week >= '1999-01-04'"), features, "y", ("boosted",), rounds=5)
    return metrics.ranking(scored.select(F.substring("week", 1, 4).alias("year"), "prob", F.col("y").cast("long").alias("actual")), ["year"])


@query("feature_importances")
def feature_importances(spark, d):
    """Gain importances of boosted trees fitted on the last fold's training weeks, highest first."""
    p = labelled_panel(spark, d).where("actual is not null and week < date '2000-01-03'")
    return models.importances(p, FEATURES, "actual", rounds=10)


@query("stream_weekly_counts", """SELECT event_type, CAST(date_trunc('week', ts) AS timestamp) AS week, count(*) n_events FROM events GROUP BY 1, 2""")
def stream_weekly_counts(spark, d):
    """The table read as a stream, counted by week under a watermark, run to its end and read back."""
    return feeds.run_available(feeds.weekly_counts(feeds.read_stream(spark, f"{d}/events.parquet"), "event_type", "ts"), ["event_type", "week"])


@query("stream_sliding_counts", """WITH e AS (SELECT event_type, ts, CAST(date_trunc('week', ts) AS timestamp) wk FROM events), x AS (SELECT event_type, ts, wk + (k * 7) * INTERVAL 1 DAY AS issue FROM e, range(1, 6) r(k))
 SELECT event_type, issue, count(*) n_events FROM x WHERE ts < issue AND ts >= issue - INTERVAL 30 DAY GROUP BY 1, 2""")
def stream_sliding_counts(spark, d):
    return feeds.run_available(feeds.sliding_counts(feeds.read_stream(spark, f"{d}/events.parquet"), "event_type", "ts"), ["event_type", "issue"])


@query("stream_intensity", """WITH l AS (SELECT event_type, max(ts) last FROM events GROUP BY 1)
 SELECT event_type, round(epoch(any_value(last)), 3) "at", round(sum(exp(-ln(2) / 86400 * (epoch(last) - epoch(ts)))), 6) intensity, count(*) n FROM events JOIN l USING (event_type) GROUP BY 1""")
def stream_intensity(spark, d):
    """Decaying intensity by type at its last event, half life a day, from state that a stream keeps."""
    r = feeds.run_available(feeds.decaying_intensity(feeds.read_stream(spark, f"{d}/events.parquet"), "event_type", "ts", 86400.0), ["event_type"])
    return r.select("event_type", F.round("at", 3).alias("at"), F.round("intensity", 6).alias("intensity"), "n")
