"""Document statistics, text ablations, prompts, encodings and review tables."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ewpanel.functions import keys, text
from ewpanel.functions.staging import shared_folder
from ewpanel.operators import encode, metrics, ranks, retrieval
from ewpanel.plans.candidates import CAND_SQL, candidate_age_windows, grid_events
from ewpanel.plans.registry import query
from ewpanel.sources import readers
from ewpanel.sources.fixtures import CODED_SQL, CONFLICT_SQL, LEDGER_SQL, coded_events, conflict_events, ledger, table

WEEK = "CAST(date_trunc('week', {}) AS date)"
SPLIT = "2000-07-03"


@query("one_hot_from_train", f"""WITH {CONFLICT_SQL}, c AS (SELECT list(DISTINCT side_a ORDER BY side_a) cs FROM fx_conflict WHERE date_start < DATE '1995-01-10')
 SELECT id, list_transform(cs, lambda x: CAST(x = side_a AS int)) flags FROM fx_conflict, c WHERE date_start >= DATE '1995-01-10'""")
def one_hot_from_train(spark, d):
    e = conflict_events(spark, d)
    first = F.col("date_start") < F.lit("1995-01-10").cast("date")
    return encode.one_hot(e.where(first), e.where(~first), "side_a").select("id", "flags")


@query("standardised_from_train", f"""WITH {CONFLICT_SQL}, g AS (SELECT country, {WEEK.format('date_start')} AS week, CAST(count(*) AS double) x, CAST(sum(best) AS double) y FROM fx_conflict GROUP BY 1, 2), s AS (SELECT country, avg(x) mx, stddev_pop(x) sx, avg(y) my, stddev_pop(y) sy FROM g WHERE week < DATE '{SPLIT}' GROUP BY 1)
 SELECT country, week, round((x - mx) / (sx + 1e-9), 5) x, round((y - my) / (sy + 1e-9), 5) y FROM g JOIN s USING (country) WHERE week >= DATE '{SPLIT}'""")
def standardised_from_train(spark, d):
    """Later weeks by the mean and deviation of the earlier ones alone."""
    g = conflict_events(spark, d).groupBy("country", keys.week_monday(F.col("date_start")).alias("week")).agg(F.count(F.lit(1)).cast("double").alias("x"), F.sum("best").cast("double").alias("y"))
    past = F.col("week") < F.lit(SPLIT).cast("date")
    return retrieval.standardise(g.where(~past), ["x", "y"], ["country"], g.where(past)).select("country", "week", F.round("x", 5).alias("x"), F.round("y", 5).alias("y"))


@query("covered_subset", f"""WITH {CONFLICT_SQL}, c AS (SELECT DISTINCT CAST((180 + c_custkey % 12) * 720 + 360 + (c_custkey // 12) % 12 + 1 AS bigint) priogrid_gid FROM customer WHERE c_acctbal > 9000) SELECT country, count(*) n FROM fx_conflict WHERE priogrid_gid IN (SELECT priogrid_gid FROM c) GROUP BY 1""")
def covered_subset(spark, d):
    """Events of cells that have the covariate."""
    cell = F.expr("cast((180 + c_custkey % 12) * 720 + 360 + (cast(floor(c_custkey / 12) as bigint)) % 12 + 1 as bigint)")
    covered = table(spark, d, "customer").where("c_acctbal > 9000").select(cell.alias("priogrid_gid")).distinct()
    return conflict_events(spark, d).join(covered, "priogrid_gid", "left_semi").groupBy("country").agg(F.count(F.lit(1)).alias("n"))


@query("signal_on_candidates", f"""WITH {CAND_SQL}, m AS (SELECT priogrid_gid, country FROM (SELECT priogrid_gid, country, row_number() OVER (PARTITION BY priogrid_gid ORDER BY count(*) DESC, country) k FROM ev GROUP BY 1, 2) WHERE k = 1),
 s AS (SELECT country, {WEEK.format('date_start')} AS week, count(*) n FROM ev GROUP BY 1, 2)
 SELECT c.priogrid_gid, c.issue_date, m.country, coalesce(a.n, 0) same_week, coalesce(b.n, 0) week_before FROM cand c JOIN m USING (priogrid_gid) LEFT JOIN s a ON a.country = m.country AND a.week = c.issue_date LEFT JOIN s b ON b.country = m.country AND b.week = c.issue_date - 7""")
def signal_on_candidates(spark, d):
    """A country-week signal on cells by their mode country: of the issue week itself (which looks ahead) and of the week before."""
    from ewpanel.plans.candidates import candidates

    e = grid_events(spark, d)
    counts = e.groupBy("priogrid_gid", "country").agg(F.count(F.lit(1)).alias("n"))
    mode = counts.groupBy("priogrid_gid").agg(F.min_by("country", F.struct(-F.col("n"), "country")).alias("country"))
    s = e.groupBy("country", keys.week_monday(F.col("date_start")).alias("week")).agg(F.count(F.lit(1)).alias("n"))
    both = s.select("country", F.explode(F.array(F.struct(F.col("week").alias("at"), F.lit(0).alias("late")), F.struct(F.date_add("week", 7).alias("at"), F.lit(1).alias("late")))).alias("p"), "n")
    shifted = both.groupBy("country", F.col("p.at").alias("issue_date")).agg(F.sum(F.when(F.col("p.late") == 0, F.col("n"))).alias("same_week"), F.sum(F.when(F.col("p.late") == 1, F.col("n"))).alias("week_before"))
    return candidates(e).drop("issue_day").join(mode, "priogrid_gid").join(shifted, ["country", "issue_date"], "left").fillna(0, ["same_week", "week_before"])


@query("document_stats", f"""WITH k AS (SELECT o_orderkey, n_name country, {WEEK.format('o_orderdate')} AS week, string_agg(p_type, ';') themes, any_value(CASE WHEN o_orderkey % 5 = 0 THEN NULL ELSE CAST(floor(o_totalprice / 1000) AS double) END) tone
   FROM orders JOIN lineitem ON l_orderkey = o_orderkey JOIN part ON p_partkey = l_partkey JOIN customer ON c_custkey = o_custkey JOIN nation ON n_nationkey = c_nationkey GROUP BY 1, 2, 3)
 SELECT country, week, count(*) n_docs, round(avg(CASE WHEN contains(themes, 'BRASS') OR contains(themes, 'TIN') OR contains(themes, 'ECONOMY') THEN 1.0 ELSE 0.0 END), 6) fragility_share, round(avg(tone), 4) mean_tone FROM k GROUP BY 1, 2""")
def document_stats(spark, d):
    """Documents, share with any marker in their theme string and mean parseable tone by (country, week)."""
    lines = table(spark, d, "lineitem").select("l_orderkey", "l_partkey").join(table(spark, d, "part").select("p_partkey", "p_type"), F.col("l_partkey") == F.col("p_partkey"))
    themes = lines.groupBy("l_orderkey").agg(F.array_join(F.collect_list("p_type"), ";").alias("themes"))  # a document's own list
    tone = table(spark, d, "orders").select("o_orderkey", F.when(F.col("o_orderkey") % 5 != 0, F.floor(F.col("o_totalprice") / 1000)).cast("string").alias("vector"))
    e = conflict_events(spark, d).select("id", "country", keys.week_monday(F.col("date_start")).alias("week"))
    rows = e.join(themes, F.col("id") == F.col("l_orderkey")).join(tone, F.col("id") == F.col("o_orderkey"))
    hit = text.any_marker(F.col("themes"), ["BRASS", "TIN", "ECONOMY"])
    return rows.groupBy("country", "week").agg(F.count(F.lit(1)).alias("n_docs"), F.round(F.avg(F.when(hit, 1.0).otherwise(0.0)), 6).alias("fragility_share"), F.round(F.avg(text.first_number(F.col("vector"))), 4).alias("mean_tone"))


@query("list_value_counts", """WITH e AS (SELECT unnest(string_split(CAST(p_type AS varchar) || ' ' || p_brand, ' ')) item FROM part) SELECT item, count(*) n FROM e WHERE item NOT IN ('TIN', 'OTHER') GROUP BY 1""")
def list_value_counts(spark, d):
    """Entries of a list column counted, some values apart."""
    each = table(spark, d, "part").select(F.explode(F.split(F.concat_ws(" ", "p_type", "p_brand"), " ")).alias("item"))
    return each.where(~F.col("item").isin("TIN", "OTHER")).groupBy("item").agg(F.count(F.lit(1)).alias("n"))


GROUPS = {"actor": ["the", "that"], "location": ["with", "from"], "violence": ["of", "for"], "diplomacy": ["and", "this"]}
HITS_SQL = ", ".join(f"len(regexp_extract_all(coalesce(text, ''), '(?i)\\b(?:{'|'.join(t)})\\b')) {g}" for g, t in GROUPS.items())
CLIPS_SQL = f"c AS (SELECT doc_id, source, lang, length(text) len, DATE '2026-05-01' + CAST(doc_id % 99 AS int) AS day, 1 + doc_id % 3 AS relevance, {HITS_SQL} FROM documents)"


def clips(spark, d):
    docs = table(spark, d, "documents")
    return docs.select("doc_id", "source", "lang", F.length("text").alias("len"), F.expr("date_add(date '2026-05-01', cast(doc_id % 99 as int))").alias("day"), F.expr("1 + doc_id % 3").alias("relevance"),
                       *[text.term_count(F.col("text"), t).alias(g) for g, t in GROUPS.items()])


@query("clip_term_groups", f"""WITH {CLIPS_SQL}, w AS (SELECT {WEEK.format('day')} AS week, count(*) n_clips, avg(CASE WHEN actor + location + violence > 0 THEN 1.0 ELSE 0.0 END) s, avg(actor) a, avg(location) l, avg(violence) v, avg(diplomacy) p, (sum(violence) + 1) / (sum(diplomacy) + 1) r FROM c GROUP BY 1)
 SELECT week, n_clips, round(s, 6) conflict_share, round(a, 6) actor_hits, round(l, 6) location_hits, round(v, 6) violence_hits, round(p, 6) diplomacy_hits, round(r, 6) violence_to_diplomacy, n_clips - lag(n_clips) OVER (ORDER BY week) n_clips_delta, round(v - lag(v) OVER (ORDER BY week), 6) violence_hits_delta FROM w""")
def clip_term_groups(spark, d):
    """Weekly means of four term groups from one scan, with changes from the week before (a window over weeks)."""
    mean = {"conflict_share": F.when(F.col("actor") + F.col("location") + F.col("violence") > 0, 1.0).otherwise(0.0), **{f"{g}_hits": F.col(g) for g in GROUPS}}
    w = clips(spark, d).groupBy(keys.week_monday(F.col("day")).alias("week")).agg(F.count(F.lit(1)).alias("n_clips"), *[F.avg(v).alias(k) for k, v in mean.items()], ((F.sum("violence") + 1) / (F.sum("diplomacy") + 1)).alias("violence_to_diplomacy"))
    order = Window.orderBy("week")
    w = w.withColumns({f"{k}_delta": F.col(k) - F.lag(k).over(order) for k in ("n_clips", "violence_hits")})
    return w.select("week", "n_clips", "n_clips_delta", *[F.round(k, 6).alias(k) for k in (*mean, "violence_to_diplomacy", "violence_hits_delta")])


MASK_SQL = " + ".join(f"CASE WHEN mask & {1 << i} > 0 THEN {g} ELSE 0 END" for i, g in enumerate(GROUPS))


@query("term_group_ablation", f"""WITH {CLIPS_SQL}, m AS (SELECT CAST(range AS int) mask FROM range(1, 16)), r AS (SELECT CAST(range AS int) least FROM range(1, 4)),
 x AS (SELECT mask, least, {MASK_SQL} hits, CAST(lang = 'en' AS double) y FROM c, m, r WHERE relevance >= least) SELECT mask, least, count(*) n, round(avg(hits), 6) mean_hits, round(avg(CASE WHEN hits > 0 THEN 1.0 ELSE 0.0 END), 6) share_hit, round(corr(hits, y), 6) r FROM x GROUP BY 1, 2""")
def term_group_ablation(spark, d):
    """All 15 combinations of four term groups by three relevance floors from one scan of the texts.

    Counts of equal (relevance, language, four hit counts) are summed before they are
    copied to the combinations.
    """
    c = clips(spark, d).groupBy("relevance", (F.col("lang") == "en").cast("double").alias("y"), *GROUPS).agg(F.count(F.lit(1)).alias("n"))
    c = c.withColumn("mask", F.explode(F.array(*[F.lit(m) for m in range(1, 16)]))).withColumn("least", F.explode(F.array(F.lit(1), F.lit(2), F.lit(3)))).where("relevance >= least")
    hits = sum((F.when(F.col("mask").bitwiseAND(F.lit(1 << i)) > 0, F.col(g)).otherwise(0) for i, g in enumerate(GROUPS)), F.lit(0))
    c = c.withColumn("h", hits.cast("double"))
    known = F.col("y").isNotNull()
    s = c.groupBy("mask", "least").agg(
        F.sum("n").alias("n"), (F.sum(F.col("h") * F.col("n")) / F.sum("n")).alias("mean"), (F.sum(F.when(F.col("h") > 0, F.col("n")).otherwise(0)) / F.sum("n")).alias("share"),
        F.sum(F.when(known, F.col("n"))).alias("k"), *[F.sum(F.when(known, v * F.col("n"))).alias(a) for a, v in (("sh", F.col("h")), ("sy", F.col("y")), ("shh", F.col("h") ** 2), ("syy", F.col("y") ** 2), ("shy", F.col("h") * F.col("y")))])
    r = (F.col("k") * F.col("shy") - F.col("sh") * F.col("sy")) / F.nullif(F.sqrt(F.col("k") * F.col("shh") - F.col("sh") ** 2) * F.sqrt(F.col("k") * F.col("syy") - F.col("sy") ** 2), F.lit(0.0))
    return s.select("mask", "least", "n", F.round("mean", 6).alias("mean_hits"), F.round("share", 6).alias("share_hit"), F.round(r, 6).alias("r"))


@query("self_consistency", f"""WITH {LEDGER_SQL} SELECT entity, period, count(*) n_samples, round(avg(prob), 6) prob FROM fx_ledger GROUP BY 1, 2""")
def self_consistency(spark, d):
    """Several sampled answers to one question count as their mean."""
    return ledger(spark, d).groupBy("entity", "period").agg(F.count(F.lit(1)).alias("n_samples"), F.round(F.avg("prob"), 6).alias("prob"))


@query("review_sample", f"""WITH {LEDGER_SQL}, b AS (SELECT *, CASE WHEN prob >= 0.6 AND actual = 1 THEN 'hit' WHEN prob >= 0.6 THEN 'false_alarm' WHEN prob >= 0.5 THEN 'just_below' END bucket FROM fx_ledger),
 r AS (SELECT *, row_number() OVER (PARTITION BY bucket ORDER BY prob DESC, id) k FROM b WHERE bucket IS NOT NULL) SELECT bucket, CAST(k AS int) k, id, round(prob, 6) prob FROM r WHERE k <= 10""")
def review_sample(spark, d):
    """The ten highest of hits, false alarms and scores within 0.1 under the threshold."""
    p = F.col("prob")
    bucket = F.when((p >= 0.6) & (F.col("actual") == 1), "hit").when(p >= 0.6, "false_alarm").when(p >= 0.5, "just_below")
    w = Window.partitionBy("bucket").orderBy(F.desc("prob"), "id")
    return ledger(spark, d).withColumn("bucket", bucket).where("bucket is not null").withColumn("k", F.row_number().over(w)).where("k <= 10").select("bucket", "k", "id", F.round("prob", 6).alias("prob"))


@query("review_comparison", f"""WITH {LEDGER_SQL}, c AS (SELECT *, prob >= 0.6 a, CASE WHEN id % 11 = 0 THEN NULL ELSE prob * 0.7 + (id % 10) / 30.0 >= 0.6 END b FROM fx_ledger)
 SELECT entity, count(*) n_cases, round(avg(CAST(a = (actual = 1) AS int)), 6) accuracy_a, round(avg(CAST(b = (actual = 1) AS int)), 6) accuracy_b, count(*) FILTER (actual = 0 AND a AND NOT b) false_alarms_corrected, count(*) FILTER (actual = 1 AND a AND NOT b) hits_lost FROM c GROUP BY 1""")
def review_comparison(spark, d):
    """Two callers on the same cases: accuracy of each over the cases it answers, false alarms the second corrects and hits it loses."""
    c = ledger(spark, d).withColumns({"a": F.col("prob") >= 0.6, "b": F.when(F.col("id") % 11 != 0, F.expr("prob * 0.7D + (id % 10) / 30.0D") >= 0.6)})
    return metrics.compare_callers(c, ["entity"], "a", "b")


@query("row_index_split", f"""WITH {LEDGER_SQL}, r AS (SELECT *, row_number() OVER (ORDER BY period, id) k, count(*) OVER () n FROM fx_ledger) SELECT entity, CASE WHEN k <= floor(n * 0.6) THEN 'select' ELSE 'holdout' END part, count(*) n, min(period) first_period, max(period) last_period FROM r GROUP BY 1, 2""")
def row_index_split(spark, d):
    """The first 60% of the rows in order, which may cut inside a week."""
    led = ledger(spark, d).withColumn("_d", F.unix_date("period"))
    r = ranks.ranked(led, [], "_d", ["id"], descending=False)
    part = F.when(F.col("k") <= F.floor(F.col("k_all") * 0.6), "select").otherwise("holdout")
    return r.groupBy("entity", part.alias("part")).agg(F.count(F.lit(1)).alias("n"), F.min("period").alias("first_period"), F.max("period").alias("last_period"))


@query("recipe_selection", f"""WITH {LEDGER_SQL}, s AS (SELECT id % 12 recipe, avg(prob) ap, avg(actual) recall, count(*) n FROM fx_ledger GROUP BY 1) SELECT recipe, round(ap, 6) ap, round(recall, 6) recall FROM s WHERE recall >= 0.3 ORDER BY ap DESC, recipe LIMIT 1""")
def recipe_selection(spark, d):
    """The best recipe of a result table among those that keep a floor."""
    s = ledger(spark, d).groupBy(F.expr("id % 12").alias("recipe")).agg(F.avg("prob").alias("ap"), F.avg("actual").alias("recall"))
    return s.where("recall >= 0.3").orderBy(F.desc("ap"), "recipe").limit(1).select("recipe", F.round("ap", 6).alias("ap"), F.round("recall", 6).alias("recall"))


@query("map_points", f"""WITH {CONFLICT_SQL}, g AS (SELECT priogrid_gid, count(*) n, -90 + ((priogrid_gid - 1) // 720) * 0.5 + 0.25 lat, -180 + ((priogrid_gid - 1) % 720) * 0.5 + 0.25 lon FROM fx_conflict GROUP BY 1), b AS (SELECT min(lat) s, max(lat) n, min(lon) w, max(lon) e, max(n) top FROM g)
 SELECT priogrid_gid, round(20 + (lon - w) / (e - w) * 720, 4) x, round(500 - (lat - s) / (b.n - s) * 480, 4) y, round(1.5 + 7 * sqrt(g.n / top), 4) radius FROM g, b""")
def map_points(spark, d):
    """Cells in the picture's coordinates, radius by the root of their events."""
    gid = F.col("priogrid_gid") - 1
    g = conflict_events(spark, d).groupBy("priogrid_gid").agg(F.count(F.lit(1)).alias("n")).withColumns({"lat": F.floor(gid / 720) * 0.5 - 89.75, "lon": (gid % 720) * 0.5 - 179.75})
    b = g.agg(F.min("lat").alias("s"), F.max("lat").alias("t"), F.min("lon").alias("w"), F.max("lon").alias("e"), F.max("n").alias("top"))
    j = g.crossJoin(F.broadcast(b))  # one row
    x, y = encode.projected(F.col("lon"), F.col("lat"), F.col("w"), F.col("e"), F.col("s"), F.col("t"))
    return j.select("priogrid_gid", F.round(x, 4).alias("x"), F.round(y, 4).alias("y"), F.round(1.5 + 7 * F.sqrt(F.col("n") / F.col("top")), 4).alias("radius"))


@query("cell_prompts", None)
def cell_prompts(spark, d):
    """A prompt for each candidate cell and issue date; the text form has no SQL of its own, its parts are tested on small rows."""
    c = candidate_age_windows(spark, d)
    context = text.cell_context(F.col("priogrid_gid").cast("string"), F.col("issue_date"), F.col("count_30d"), F.col("prior_30d"), F.col("count_90d"), F.col("prior_90d"), F.col("count_365d"), F.col("days_since_last"))
    return c.select("priogrid_gid", "issue_date", text.prompt("plain", context).alias("prompt"))


@query("summary_bundle", f"""WITH {LEDGER_SQL}, s AS (SELECT entity, prob, count(*) n, sum(actual) pos FROM fx_ledger GROUP BY 1, 2), c AS (SELECT *, sum(n) OVER w flags, sum(pos) OVER w hits, sum(n) OVER (PARTITION BY entity) n_all, sum(pos) OVER (PARTITION BY entity) pos_all FROM s WINDOW w AS (PARTITION BY entity ORDER BY prob DESC)),
 r AS (SELECT entity, round(CASE WHEN max(pos_all) BETWEEN 1 AND max(n_all) - 1 THEN sum(pos * hits / flags) / max(pos_all) END, 6) average_precision FROM c GROUP BY 1)
 SELECT entity, count(*) n, CAST(sum(actual) AS bigint) n_pos, round(avg((prob - actual) ** 2), 6) brier, round(count(*) FILTER (prob >= 0.5 AND actual = 1) / greatest(1, count(*) FILTER (prob >= 0.5)), 6) "precision", round(count(*) FILTER (prob >= 0.5 AND actual = 1) / greatest(1, sum(actual)), 6) recall, any_value(average_precision) average_precision FROM fx_ledger JOIN r USING (entity) GROUP BY 1""")
def summary_bundle(spark, d):
    m = metrics.bundle(ledger(spark, d), ["entity"], "id")
    return m.select("entity", "n", "n_pos", *[F.round(c, 6).alias(c) for c in ("brier", "precision", "recall", "average_precision")])


EXPORT = "event_id bigint, day date, country string, actor1 string, actor2 string, event_code string, quad_class int, goldstein int, mentions int"
_FAULT = "CASE WHEN event_id % 101 = 0 THEN 'blank' WHEN event_id % 53 = 0 THEN 'width' WHEN event_id % 37 = 0 THEN 'value' END"


@query("export_lines_read_back", f"""WITH {CODED_SQL}, k AS (SELECT *, {_FAULT} fault FROM fx_coded)
 SELECT CASE WHEN fault IS NULL THEN country END country, fault, count(*) n, count(CASE WHEN fault IS NULL THEN actor1 END) n_actor1, CAST(sum(CASE WHEN fault IS NULL THEN mentions END) AS bigint) mentions,
  max(CASE WHEN fault IS NULL THEN "day" END) last_day FROM k GROUP BY 1, 2""")
def export_lines_read_back(spark, d):
    """Coded events written as tab-separated lines, some of them blank, cut short or with a word for a number, and read back: good lines by country, the others by fault."""
    e = coded_events(spark, d).withColumn("fault", F.expr(_FAULT))
    fields = [f.split()[0] for f in EXPORT.split(", ")]
    text_of = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    whole, short = F.concat_ws("\t", *map(text_of, fields)), F.concat_ws("\t", *map(text_of, fields[:-2]))
    wrong = F.concat_ws("\t", *map(text_of, fields[:-1]), F.lit("many"))
    line = F.when(F.col("fault") == "blank", "").when(F.col("fault") == "width", short).when(F.col("fault") == "value", wrong).otherwise(whole)
    folder = shared_folder(spark, "export-lines")
    e.select(line.alias("value")).write.text(folder)
    read = readers.lines_apart(spark.read.text(folder), EXPORT)
    return read.groupBy("country", "fault").agg(F.count(F.lit(1)).alias("n"), F.count("actor1").alias("n_actor1"), F.sum("mentions").alias("mentions"), F.max("day").alias("last_day"))
