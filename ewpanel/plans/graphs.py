"""Graph, theme, text and retrieval queries."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ewpanel.functions import keys, text
from ewpanel.operators import graph, retrieval, stats
from ewpanel.plans.registry import query
from ewpanel.sources.fixtures import CODED_SQL, CONFLICT_SQL, coded_events, conflict_events, table

WEEK = "CAST(date_trunc('week', {}) AS date)"

DOCS_SQL = """docs AS (SELECT l_orderkey doc, list_sort(list(DISTINCT p_brand)) themes FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1)"""


def theme_docs(spark, d):
    """One order as a document, the brands of its lines as themes."""
    lines = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("doc"), "l_partkey")
    return lines.join(table(spark, d, "part").select("p_partkey", "p_brand"), F.col("l_partkey") == F.col("p_partkey")).groupBy("doc").agg(F.array_sort(F.collect_set("p_brand")).alias("themes"))


@query("knowledge_graph", f"""WITH {CONFLICT_SQL} SELECT 'EVT:' || id src, 'LOC:' || country dst, 'OCCURRED_AT' kind FROM fx_conflict
 UNION ALL SELECT DISTINCT 'ACT:' || a, 'EVT:' || id, 'PARTICIPATED_IN' FROM (SELECT id, unnest([side_a, side_b]) a FROM fx_conflict) WHERE a IS NOT NULL AND trim(a) <> ''""")
def knowledge_graph(spark, d):
    return graph.knowledge_graph(conflict_events(spark, d), "id", "country", ["side_a", "side_b"])


@query("actor_pair_stats", f"""WITH {CODED_SQL}, k AS (SELECT country, {WEEK.format('day')} AS week, actor1 a, actor2 b FROM fx_coded), e AS (SELECT DISTINCT country, week, least(a, b) u, greatest(a, b) v FROM k WHERE a IS NOT NULL AND b IS NOT NULL AND a <> b),
 g AS (SELECT country, week, node, count(*) deg FROM (SELECT country, week, unnest([u, v]) node FROM e) GROUP BY 1, 2, 3), s AS (SELECT country, week, CAST(sum(deg) // 2 AS bigint) m, count(*) n, max(deg) top FROM g GROUP BY 1, 2)
 SELECT k.country, k.week, coalesce(m, 0) n_edges, round(coalesce(m / (n * (n - 1) / 2), 0), 6) density, round(coalesce(top / (2 * m), 0), 6) top_degree_share FROM (SELECT DISTINCT country, week FROM k) k LEFT JOIN s USING (country, week)""")
def actor_pair_stats(spark, d):
    e = coded_events(spark, d).withColumn("week", keys.week_monday(F.col("day")))
    g = graph.pair_stats(e, ["country", "week"], "actor1", "actor2")
    return g.withColumns({"density": F.round("density", 6), "top_degree_share": F.round("top_degree_share", 6)})


def _inc_sql(kinds):
    week = f"CAST({WEEK.format('date_start')} AS varchar)"
    parts = {
        "country": "SELECT node node_id, 'country' edge_type, country edge_id FROM n WHERE week IN (SELECT week FROM recent)",
        "region_week": "SELECT node, 'region_week', region || '|' || week FROM n", "week": "SELECT node, 'week', week FROM n",
        "actor": "SELECT DISTINCT node, 'actor', side_a FROM e WHERE week IN (SELECT week FROM recent)",
        "conflict": "SELECT DISTINCT node, 'conflict', conflict_name FROM e WHERE week IN (SELECT week FROM recent)"}
    return f"""{CONFLICT_SQL}, e AS (SELECT *, country || '|' || {week} node, {week} AS week FROM fx_conflict), n AS (SELECT DISTINCT node, country, region, week FROM e),
 recent AS (SELECT DISTINCT week FROM e ORDER BY week DESC LIMIT 156), raw AS ({' UNION ALL '.join(parts[k] for k in kinds)}),
 inc AS (SELECT * FROM (SELECT *, count(*) OVER (PARTITION BY edge_type, edge_id) edge_size FROM raw) WHERE edge_size >= 2)"""


EDGES = ("country", "region_week", "week", "actor", "conflict")
INC_SQL = _inc_sql(EDGES)


def country_weeks(spark, d):
    e = conflict_events(spark, d).withColumn("week", keys.week_monday(F.col("date_start")).cast("string"))
    return e.withColumn("node", F.concat_ws("|", "country", "week"))


def hyper(spark, d, kinds=EDGES):
    """Country-weeks as nodes; country, actor and conflict edges reach back 156 distinct weeks."""
    e = country_weeks(spark, d)
    recent = e.select("week").distinct().orderBy(F.desc("week")).limit(156)
    lately = e.join(recent, "week", "left_semi")
    own = {"region_week": ["region", "week"], "week": ["week"]}
    members = {k: lately.select("node", F.col(c).alias("value")) for k, c in (("country", "country"), ("actor", "side_a"), ("conflict", "conflict_name"))}
    return graph.incidence(e.select("node", "country", "region", "week").distinct(), "node", {k: v for k, v in own.items() if k in kinds}, {k: v for k, v in members.items() if k in kinds})


@query("hypergraph_incidence", f"""WITH {INC_SQL} SELECT edge_type, edge_id, node_id, edge_size FROM inc""")
def hypergraph_incidence(spark, d):
    return hyper(spark, d)


@query("hypergraph_structure", f"""WITH {INC_SQL}, g AS (SELECT node_id, count(*) AS degree, CAST(sum(edge_size) - count(*) AS bigint) co_memberships FROM inc GROUP BY 1),
 p AS (SELECT DISTINCT a.node_id, b.node_id other FROM inc a JOIN inc b USING (edge_type, edge_id) WHERE a.node_id <> b.node_id), m AS (SELECT p.node_id, avg(g.degree) m FROM p JOIN g ON g.node_id = p.other GROUP BY 1)
 SELECT node_id, degree, co_memberships, round(m, 6) mean_co_degree FROM g JOIN m USING (node_id)""")
def hypergraph_structure(spark, d):
    return graph.structural_features(hyper(spark, d)).withColumn("mean_co_degree", F.round("mean_co_degree", 6))


@query("hypergraph_propagation", f"""WITH {INC_SQL}, deg AS (SELECT node_id, count(*) g FROM inc GROUP BY 1), x AS (SELECT node_id, CAST(length(node_id) % 5 + 1 AS double) x FROM deg),
 s AS (SELECT edge_type, edge_id, sum(x / sqrt(g)) / max(edge_size) ex, sum(x) / max(edge_size) ea FROM inc JOIN deg USING (node_id) JOIN x USING (node_id) GROUP BY 1, 2)
 SELECT node_id, round(sum(ex / sqrt(g)), 6) x_symmetric, round(sum(ea / g), 6) x_asymmetric FROM inc JOIN s USING (edge_type, edge_id) JOIN deg USING (node_id) GROUP BY 1""")
def hypergraph_propagation(spark, d):
    inc = hyper(spark, d)
    x = country_weeks(spark, d).select(F.col("node").alias("node_id")).distinct().withColumn("x", (F.length("node_id") % 5 + 1).cast("double"))
    return graph.propagate(inc, x, ["x"], None).select("node_id", F.round("x_symmetric", 6).alias("x_symmetric"), F.round("x_asymmetric", 6).alias("x_asymmetric"))


def node_signal(spark, d):
    return country_weeks(spark, d).groupBy(F.col("node").alias("node_id")).agg(F.count(F.lit(1)).cast("double").alias("x"), (F.sum("best") >= 12).cast("int").alias("y"), F.min("week").alias("week"))


def smoothed(spark, d):
    """The signal of each node and its first and second smoothing: features for a linear head."""
    inc, own = hyper(spark, d), node_signal(spark, d)
    one = graph.propagate(inc, own.select("node_id", "x"), ["x"]).withColumnRenamed("x", "gx")
    two = graph.propagate(inc, one, ["gx"]).withColumnRenamed("gx", "ggx")
    return own.join(one, "node_id").join(two, "node_id")


STEP = "{b} AS (SELECT node_id, sum(m / sqrt(g)) x FROM inc JOIN (SELECT edge_type, edge_id, sum(x / sqrt(g)) / max(edge_size) m FROM inc JOIN deg USING (node_id) JOIN {a} USING (node_id) GROUP BY 1, 2) USING (edge_type, edge_id) JOIN deg USING (node_id) GROUP BY 1)"


@query("hypergraph_smoothed_features", f"""WITH {INC_SQL}, deg AS (SELECT node_id, count(*) g FROM inc GROUP BY 1), s0 AS (SELECT node node_id, CAST(count(*) AS double) x FROM e GROUP BY 1), {STEP.format(a='s0', b='s1')}, {STEP.format(a='s1', b='s2')}
 SELECT node_id, s0.x, round(s1.x, 6) gx, round(s2.x, 6) ggx FROM s0 JOIN s1 USING (node_id) JOIN s2 USING (node_id)""")
def hypergraph_smoothed_features(spark, d):
    return smoothed(spark, d).select("node_id", "x", F.round("gx", 6).alias("gx"), F.round("ggx", 6).alias("ggx"))


@query("hypergraph_edge_ablation", f"""WITH {INC_SQL}, o AS (SELECT unnest(['none', {', '.join(f"'{k}'" for k in EDGES)}]) omitted), i2 AS (SELECT * FROM inc, o WHERE edge_type <> omitted), deg AS (SELECT omitted, node_id, count(*) g FROM i2 GROUP BY 1, 2),
 own AS (SELECT node node_id, CAST(count(*) AS double) x, CAST(sum(best) >= 12 AS double) y FROM e GROUP BY 1),
 m AS (SELECT omitted, edge_type, edge_id, sum(x / sqrt(g)) / max(edge_size) ms, sum(x) / max(edge_size) ma FROM i2 JOIN deg USING (omitted, node_id) JOIN own USING (node_id) GROUP BY 1, 2, 3),
 p AS (SELECT omitted, node_id, sum(ms / sqrt(g)) s, sum(ma / g) a FROM i2 JOIN m USING (omitted, edge_type, edge_id) JOIN deg USING (omitted, node_id) GROUP BY 1, 2)
 SELECT omitted, count(*) n, round(corr(s, y), 6) r_symmetric, round(corr(a, y), 6) r_asymmetric FROM p JOIN own USING (node_id) GROUP BY 1""")
def hypergraph_edge_ablation(spark, d):
    """Each edge type left out in turn, both propagation modes: correlation of the smoothed signal with a severe week."""
    inc = hyper(spark, d).withColumn("omitted", F.explode(F.array(*[F.lit(k) for k in ("none", *EDGES)]))).where("edge_type != omitted")
    own = node_signal(spark, d)
    p = graph.propagate(inc, own.select("node_id", "x"), ["x"], None, ["omitted"]).join(own.select("node_id", F.col("y").cast("double").alias("y")), "node_id")
    return p.groupBy("omitted").agg(F.count(F.lit(1)).alias("n"), F.round(stats.correlation("x_symmetric", "y"), 6).alias("r_symmetric"), F.round(stats.correlation("x_asymmetric", "y"), 6).alias("r_asymmetric"))


@query("theme_co_occurrence", f"""WITH {DOCS_SQL}, t AS (SELECT doc, unnest(themes) th FROM docs) SELECT a.th theme_a, b.th theme_b, count(*) weight FROM t a JOIN t b ON a.doc = b.doc AND a.th < b.th GROUP BY 1, 2 HAVING count(*) >= 2""")
def theme_co_occurrence(spark, d):
    return graph.co_occurrence(theme_docs(spark, d), "themes")


@query("theme_ppmi", f"""WITH {DOCS_SQL}, t AS (SELECT doc, unnest(themes) th FROM docs), e AS (SELECT a.th a, b.th b, count(*) w FROM t a JOIN t b ON a.doc = b.doc AND a.th < b.th GROUP BY 1, 2 HAVING count(*) >= 2),
 s AS (SELECT a, b, w FROM e UNION ALL SELECT b, a, w FROM e), r AS (SELECT a, greatest(sum(w), 1) r FROM s GROUP BY 1), v AS (SELECT s.a, s.b, ln(w * (SELECT sum(w) FROM s) / (r1.r * r2.r) + 1e-9) p FROM s JOIN r r1 ON r1.a = s.a JOIN r r2 ON r2.a = s.b)
 SELECT a theme_a, b theme_b, round(p, 6) ppmi FROM v WHERE p > 0""")
def theme_ppmi(spark, d):
    return graph.ppmi(graph.co_occurrence(theme_docs(spark, d), "themes")).withColumn("ppmi", F.round("ppmi", 6))


@query("theme_frequency", f"""WITH {DOCS_SQL} SELECT n_name country, {WEEK.format('o_orderdate')} AS week, th theme, count(*) n FROM (SELECT doc, unnest(themes) th FROM docs) JOIN orders ON o_orderkey = doc JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY 1, 2, 3""")
def theme_frequency(spark, d):
    e = conflict_events(spark, d).select(F.col("id").alias("doc"), "country", keys.week_monday(F.col("date_start")).alias("week"))
    return e.join(theme_docs(spark, d), "doc").select("country", "week", F.explode("themes").alias("theme")).groupBy("country", "week", "theme").agg(F.count(F.lit(1)).alias("n"))


@query("theme_tfidf", f"""WITH {DOCS_SQL}, f AS (SELECT n_name || '|' || CAST({WEEK.format('o_orderdate')} AS varchar) node, th theme, count(*) n FROM (SELECT doc, unnest(themes) th FROM docs) JOIN orders ON o_orderkey = doc JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY 1, 2),
 t AS (SELECT * FROM (SELECT *, sum(n) OVER (PARTITION BY theme) total, count(*) OVER (PARTITION BY theme) df FROM f) WHERE total >= 3)
 SELECT node, theme, round(ln(1 + n) * ln((SELECT count(DISTINCT node) FROM t) / df), 6) weight FROM t""")
def theme_tfidf(spark, d):
    """log1p(count) * ln(N / df) over country-weeks, of themes that occur three times at least."""
    e = country_weeks(spark, d).select(F.col("id").alias("doc"), "node").join(theme_docs(spark, d), "doc")
    t = e.select("node", F.explode("themes").alias("theme")).groupBy("node", "theme").agg(F.count(F.lit(1)).alias("n"))
    return tfidf(t).withColumn("weight", F.round("weight", 6))


def tfidf(counts, least=3):
    """(node, theme, weight) from (node, theme, n)."""
    df = counts.groupBy("theme").agg(F.sum("n").alias("total"), F.count(F.lit(1)).alias("df")).where(F.col("total") >= least)
    kept = counts.join(df, "theme")
    nodes = kept.agg(F.countDistinct("node").alias("nodes"))
    return kept.crossJoin(F.broadcast(nodes)).select("node", "theme", (F.log1p("n") * F.ln(F.col("nodes") / F.col("df"))).alias("weight"))  # one row


@query("weighted_mean_embedding", """WITH v AS (SELECT label, CAST(1 + vec_id % 3 AS double) w, unnest(embedding) x, generate_subscripts(embedding, 1) - 1 i FROM embeddings) SELECT label, CAST(i AS int) i, round(sum(CAST(x AS double) * w) / sum(w), 6) x FROM v GROUP BY 1, 2""")
def weighted_mean_embedding(spark, d):
    v = table(spark, d, "embeddings").select("label", F.expr("cast(1 + vec_id % 3 as double)").alias("w"), F.posexplode("embedding").alias("i", "x"))
    return v.groupBy("label", "i").agg(F.round(F.sum(F.col("x").cast("double") * F.col("w")) / F.sum("w"), 6).alias("x"))


@query("theme_list_parsing", """WITH k AS (SELECT l_orderkey, string_agg(CAST(l_partkey % 9 AS varchar), ';' ORDER BY l_linenumber, l_partkey, l_suppkey) themes, string_agg('1#x#' || (l_suppkey % 5) || '#z', ';' ORDER BY l_linenumber, l_partkey, l_suppkey) locs, any_value(o_totalprice) tone FROM lineitem JOIN orders ON o_orderkey = l_orderkey GROUP BY 1)
 SELECT l_orderkey, list_sort(list_distinct(list_slice(string_split(themes, ';'), 1, 10))) themes, list_sort(list_distinct(list_transform(string_split(locs, ';'), lambda x: string_split(x, '#')[3]))) places, CAST(contains(themes, '3') OR contains(themes, '7') AS int) marked FROM k""")
def theme_list_parsing(spark, d):
    li = table(spark, d, "lineitem")
    rows = li.groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey", "l_suppkey", F.expr("cast(l_partkey % 9 as string)").alias("t"), F.expr("'1#x#' || (l_suppkey % 5) || '#z'").alias("p")))).alias("r"))
    rows = rows.select("l_orderkey", F.array_join(F.col("r.t"), ";").alias("themes"), F.array_join(F.col("r.p"), ";").alias("locs"))
    return rows.select("l_orderkey", text.first_themes(F.col("themes")).alias("themes"), F.array_sort(text.location_codes(F.col("locs"))).alias("places"), text.any_marker(F.col("themes"), ["3", "7"]).cast("int").alias("marked"))


@query("answer_parsing", """SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN round((c_custkey % 100) / 100.0, 2) WHEN c_custkey % 3 = 1 THEN round((c_custkey % 50) / 50.0, 2) END probability FROM customer""")
def answer_parsing(spark, d):
    c = table(spark, d, "customer").select("c_custkey", F.expr("""case when c_custkey % 3 = 0 then concat('Sure: {"reasoning": "x", "probability": ', round((c_custkey % 100) / 100.0D, 2), '} done')
        when c_custkey % 3 = 1 then concat('It seems so.\\nPROBABILITY: ', round((c_custkey % 50) / 50.0D, 2)) else 'no idea' end""").alias("answer"))
    return c.select("c_custkey", F.round(text.answer_probability(F.col("answer")), 2).alias("probability"))


@query("context_lines", f"""WITH {CONFLICT_SQL}, g AS (SELECT country, year(date_start) AS year, count(*) n, sum(best) b FROM fx_conflict GROUP BY 1, 2), l AS (SELECT *, n - lag(n) OVER (PARTITION BY country ORDER BY year) delta FROM g)
 SELECT country, year, printf('%s %d: events=%d change=%+d', country, CAST(year AS bigint), n, coalesce(delta, 0)) context, CASE WHEN coalesce(delta, 0) > 2 THEN 'rising' WHEN coalesce(delta, 0) < -2 THEN 'falling' ELSE 'flat' END trend FROM l""")
def context_lines(spark, d):
    g = conflict_events(spark, d).groupBy("country", F.year("date_start").alias("year")).agg(F.count(F.lit(1)).alias("n"))
    g = g.withColumn("delta", F.coalesce(F.col("n") - F.lag("n").over(Window.partitionBy("country").orderBy("year")), F.lit(0)))
    return g.select("country", F.col("year").cast("long").alias("year"), F.format_string("%s %d: events=%d change=%+d", "country", "year", "n", "delta").alias("context"), text.trend(F.col("delta")).alias("trend"))


SPLIT = "2000-07-03"
ANALOG_SQL = f"""{CONFLICT_SQL}, g AS (SELECT region, country, {WEEK.format('date_start')} AS week, CAST(count(*) AS double) n, CAST(sum(best) AS double) b, CAST(count(DISTINCT side_a) AS double) a FROM fx_conflict GROUP BY 1, 2, 3),
 k AS (SELECT *, country || '|' || week id, CAST(b >= 12 AS int) y FROM g), s AS (SELECT region, avg(n) mn, stddev_pop(n) sn, avg(b) mb, stddev_pop(b) sb, avg(a) ma, stddev_pop(a) sa FROM k WHERE week < DATE '{SPLIT}' GROUP BY 1),
 z AS (SELECT k.*, (n - mn) / (sn + 1e-9) zn, (b - mb) / (sb + 1e-9) zb, (a - ma) / (sa + 1e-9) za FROM k JOIN s USING (region)),
 p AS (SELECT q.id qid, t.id tid, t.y, round((q.zn * t.zn + q.zb * t.zb + q.za * t.za) / (sqrt(q.zn ** 2 + q.zb ** 2 + q.za ** 2) * sqrt(t.zn ** 2 + t.zb ** 2 + t.za ** 2) + 1e-9), 9) sim FROM z q JOIN z t USING (region) WHERE q.week >= DATE '{SPLIT}' AND t.week < DATE '{SPLIT}')"""


@query("analog_rates", f"""WITH {ANALOG_SQL}, r AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY sim DESC, tid) k FROM p) SELECT qid id, count(*) n_analogs, round(avg(round(sim, 5)), 6) mean_similarity, round(avg(y), 6) analog_rate FROM r WHERE k <= 5 GROUP BY 1""")
def analog_rates(spark, d):
    """Weeks since the split ask; all earlier ones are the index, and they alone give mean and deviation."""
    g = conflict_events(spark, d).groupBy("region", "country", keys.week_monday(F.col("date_start")).alias("week")).agg(
        F.count(F.lit(1)).cast("double").alias("n"), F.sum("best").cast("double").alias("b"), F.countDistinct("side_a").cast("double").alias("a"))
    k = g.withColumns({"id": F.concat_ws("|", "country", "week"), "y": (F.col("b") >= 12).cast("int")})
    past = F.col("week") < F.lit(SPLIT).cast("date")
    z = retrieval.standardise(k, ["n", "b", "a"], ["region"], k.where(past))
    found = retrieval.analogs(z.where(past), z.where(~past), ["region"], ["n", "b", "a"], "id", "id", "y")
    return found.groupBy("id").agg(F.count(F.lit(1)).alias("n_analogs"), F.round(F.avg(F.round("similarity", 5)), 6).alias("mean_similarity"), F.round(F.avg("analog_label"), 6).alias("analog_rate"))


@query("analog_heuristic_score", """SELECT c_custkey, round(least(1.0, greatest(0.0, 0.5 * ((c_custkey % 10) / 10.0) + 0.5 * (0.5 + 0.5 * (0.5 * tanh(3 * ((c_custkey % 7) - 3) / 10.0) + 0.3 * tanh(-((c_custkey % 11) - 5) / 3.0) + 0.2 * tanh(((c_custkey % 13) - 6) / 5.0))))), 6) score FROM customer""")
def analog_heuristic_score(spark, d):
    e = lambda x: F.expr(x)
    return table(spark, d, "customer").select("c_custkey", F.round(retrieval.analog_score(e("(c_custkey % 10) / 10.0D"), e("((c_custkey % 7) - 3) / 10.0D"), e("cast((c_custkey % 11) - 5 as double)"), e("cast((c_custkey % 13) - 6 as double)")), 6).alias("score"))
