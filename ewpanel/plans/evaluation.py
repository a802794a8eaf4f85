"""Ledger queries: metrics, thresholds, rankings, folds, leaderboards."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ewpanel.operators import folds, metrics, ranks, stats
from ewpanel.operators.windows import best_so_far
from ewpanel.plans.registry import query
from ewpanel.sources.fixtures import LEDGER_SQL, ledger

GRID = [round(0.05 * k, 2) for k in range(1, 20)]

COUNTS = """count(*) FILTER (prob >= t AND actual = 1) tp, count(*) FILTER (prob >= t AND actual = 0) fp, count(*) FILTER (prob < t AND actual = 1) fn, count(*) FILTER (prob < t AND actual = 0) tn"""
RATES = """round(tp / greatest(1, tp + fp), 6) "precision", round(tp / greatest(1, tp + fn), 6) recall, round(tn / greatest(1, tn + fp), 6) specificity, round((tp + tn) / greatest(1, tp + fp + fn + tn), 6) accuracy, round((tp + fp) / greatest(1, tp + fp + fn + tn), 6) coverage"""
SCORES = """s AS (SELECT entity, prob, count(*) n, sum(actual) pos FROM fx_ledger GROUP BY 1, 2),
 c AS (SELECT *, sum(n) OVER w flags, sum(pos) OVER w hits, sum(n) OVER (PARTITION BY entity) n_all, sum(pos) OVER (PARTITION BY entity) pos_all FROM s WINDOW w AS (PARTITION BY entity ORDER BY prob DESC))"""


def rounded(df, *columns, digits=6):
    return df.withColumns({c: F.round(c, digits) for c in columns})


@query("confusion_by_entity", f"""WITH {LEDGER_SQL}, k AS (SELECT entity, {COUNTS.replace('t ', '0.5 ')} FROM fx_ledger GROUP BY 1)
 SELECT entity, tp, fp, fn, tn, {RATES}, round(2 * tp / greatest(1, 2 * tp + fp + fn), 6) f1, round(fp / greatest(1, fp + tn), 6) fpr,
        round(CASE WHEN (tp + fp) * (tp + fn) * (tn + fp) * (tn + fn) = 0 THEN 0 ELSE (CAST(tp AS double) * tn - CAST(fp AS double) * fn) / sqrt(CAST(tp + fp AS double) * (tp + fn) * (tn + fp) * (tn + fn)) END, 6) mcc FROM k""")
def confusion_by_entity(spark, d):
    m = metrics.f1_fpr_mcc(metrics.confusion(ledger(spark, d), F.lit(0.5), ["entity"]))
    return rounded(m, "precision", "recall", "specificity", "accuracy", "coverage", "f1", "fpr", "mcc")


@query("losses_by_entity", f"""WITH {LEDGER_SQL} SELECT entity, count(*) n, CAST(sum(actual) AS bigint) n_pos, round(avg((prob - actual) ** 2), 6) brier,
 round(avg(CASE WHEN actual = 1 THEN -ln(least(greatest(prob, 1e-6), 1 - 1e-6)) ELSE -ln(1 - least(greatest(prob, 1e-6), 1 - 1e-6)) END), 6) log_loss,
 round(avg(actual) * (1 - avg(actual)) - avg((prob - actual) ** 2), 6) brier_gain FROM fx_ledger GROUP BY 1""")
def losses_by_entity(spark, d):
    return rounded(metrics.losses(ledger(spark, d), ["entity"]), "brier", "log_loss", "brier_gain")


@query("average_precision_and_auc", f"""WITH {LEDGER_SQL}, {SCORES}
 SELECT entity, round(CASE WHEN max(pos_all) BETWEEN 1 AND max(n_all) - 1 THEN sum(pos * hits / flags) / max(pos_all) END, 6) average_precision,
        round(CASE WHEN max(pos_all) BETWEEN 1 AND max(n_all) - 1 THEN sum(pos * ((n_all - pos_all) - (flags - hits) + (n - pos) / 2.0)) / (max(pos_all) * (max(n_all) - max(pos_all))) END, 6) roc_auc FROM c GROUP BY 1""")
def average_precision_and_auc(spark, d):
    return rounded(metrics.ranking(ledger(spark, d), ["entity"]), "average_precision", "roc_auc")


@query("threshold_curve", f"""WITH {LEDGER_SQL}, k AS (SELECT entity, t, {COUNTS} FROM fx_ledger, (SELECT unnest([{', '.join(map(str, GRID))}]::double[]) t) GROUP BY 1, 2) SELECT entity, t threshold, tp, fp, fn, tn, {RATES} FROM k""")
def threshold_curve(spark, d):
    return rounded(metrics.threshold_curve(ledger(spark, d), GRID, ["entity"]), "precision", "recall", "specificity", "accuracy", "coverage")


@query("precision_recall_curve", f"""WITH {LEDGER_SQL}, {SCORES} SELECT entity, round(prob, 9) threshold, round(hits / flags, 6) "precision", round(hits / greatest(1, pos_all), 6) recall FROM c""")
def precision_recall_curve(spark, d):
    return rounded(metrics.precision_recall_curve(ledger(spark, d), ["entity"]), "precision", "recall").withColumn("threshold", F.round("threshold", 9))


@query("threshold_rule_a", f"""WITH {LEDGER_SQL}, {SCORES} SELECT entity, t target, round(min(prob) FILTER (hits / flags >= t AND flags >= 5), 9) threshold FROM c, (SELECT unnest([0.5, 0.6, 0.65, 0.7, 0.75, 0.8, 0.85, 0.9]::double[]) t) GROUP BY 1, 2""")
def threshold_rule_a(spark, d):
    return metrics.lowest_reaching(ledger(spark, d), [0.5, 0.6, 0.65, 0.7, 0.75, 0.8, 0.85, 0.9], ["entity"]).withColumn("threshold", F.round("threshold", 9))


@query("threshold_rule_b", f"""WITH {LEDGER_SQL}, {SCORES} SELECT entity, round(coalesce(min(prob) FILTER (hits / flags >= 0.85), first(prob ORDER BY abs(hits / flags - 0.85), prob DESC)), 9) threshold,
 CAST(min(prob) FILTER (hits / flags >= 0.85) IS NOT NULL AS int) reached FROM c GROUP BY 1""")
def threshold_rule_b(spark, d):
    return metrics.lowest_or_closest(ledger(spark, d), 0.85, ["entity"]).withColumn("threshold", F.round("threshold", 9))


@query("threshold_rule_c", f"""WITH {LEDGER_SQL}, r AS (SELECT *, row_number() OVER w k, sum(actual) OVER (w ROWS UNBOUNDED PRECEDING) h FROM fx_ledger WINDOW w AS (PARTITION BY entity ORDER BY prob DESC, id))
 SELECT entity, round(coalesce(arg_min(prob, k) FILTER (k >= 10 AND h / k < 0.5), min(prob)), 9) threshold FROM r GROUP BY 1""")
def threshold_rule_c(spark, d):
    return metrics.scan_until_below(ledger(spark, d), 0.5, ["entity"], "id").withColumn("threshold", F.round("threshold", 9))


@query("frozen_threshold_validation", f"""WITH {LEDGER_SQL}, p AS (SELECT period, row_number() OVER (ORDER BY period) - 1 i, count(*) OVER () n FROM (SELECT DISTINCT period FROM fx_ledger)),
 l AS (SELECT f.*, CASE WHEN i < floor(n * 0.6) THEN 'select' ELSE 'holdout' END part FROM fx_ledger f JOIN p USING (period)),
 s AS (SELECT prob, count(*) n, sum(actual) pos FROM l WHERE part = 'select' GROUP BY 1), c AS (SELECT *, sum(n) OVER w flags, sum(pos) OVER w hits FROM s WINDOW w AS (ORDER BY prob DESC)),
 th AS (SELECT min(prob) t FROM c WHERE hits / flags >= 0.7 AND flags >= 5), k AS (SELECT part, t, {COUNTS} FROM l, th WHERE t IS NOT NULL GROUP BY 1, 2)
 SELECT part, round(t, 9) threshold, tp, fp, fn, tn, {RATES} FROM k""")
def frozen_threshold_validation(spark, d):
    parts = folds.split_by_periods(ledger(spark, d), "period", [0.6], ["select", "holdout"])
    m = metrics.frozen(parts.where("part = 'select'").drop("part"), parts.where("part = 'holdout'").drop("part"), 0.7, [])
    return rounded(m.drop("f1", "fpr", "mcc"), "precision", "recall", "specificity", "accuracy", "coverage").withColumn("threshold", F.round("threshold", 9))


@query("support_sliced_metrics", f"""WITH {LEDGER_SQL}, h AS (SELECT *, count(*) OVER (PARTITION BY entity ORDER BY period RANGE BETWEEN UNBOUNDED PRECEDING AND INTERVAL 1 DAY PRECEDING) support FROM fx_ledger),
 k AS (SELECT lvl, {COUNTS.replace('t ', '0.6 ')} FROM h, (SELECT unnest([30, 50, 75, 100, 125, 150, 175]) lvl) WHERE support >= lvl GROUP BY 1) SELECT lvl support_level, tp, fp, fn, tn, {RATES} FROM k""")
def support_sliced_metrics(spark, d):
    led = ledger(spark, d).withColumn("_d", F.unix_date("period"))
    led = led.withColumn("support", F.count(F.lit(1)).over(Window.partitionBy("entity").orderBy("_d").rangeBetween(Window.unboundedPreceding, -1)))
    each = led.withColumn("support_level", F.explode(F.array(*[F.lit(v) for v in (30, 50, 75, 100, 125, 150, 175)]))).where("support >= support_level")
    return rounded(metrics.confusion(each, F.lit(0.6), ["support_level"]), "precision", "recall", "specificity", "accuracy", "coverage")


@query("precision_at_positives", f"""WITH {LEDGER_SQL}, r AS (SELECT *, row_number() OVER (PARTITION BY entity ORDER BY prob DESC, id) k, greatest(1, sum(actual) OVER (PARTITION BY entity)) n FROM fx_ledger)
 SELECT entity, CAST(max(n) AS bigint) top_n, round(avg(actual), 6) precision_at_n FROM r WHERE k <= n GROUP BY 1""")
def precision_at_positives(spark, d):
    return rounded(metrics.precision_at_positives(ledger(spark, d), ["entity"], "id"), "precision_at_n")


@query("entity_breakdown", f"""WITH {LEDGER_SQL} SELECT entity, count(*) n, CAST(sum(actual) AS bigint) n_pos, round(avg(prob), 6) mean_prob FROM fx_ledger GROUP BY 1 HAVING count(*) >= 30 AND sum(actual) >= 1""")
def entity_breakdown(spark, d):
    g = ledger(spark, d).groupBy("entity").agg(F.count(F.lit(1)).alias("n"), F.sum("actual").alias("n_pos"), F.round(F.avg("prob"), 6).alias("mean_prob"))
    return g.where("n >= 30 and n_pos >= 1")


@query("score_distribution", f"""WITH {LEDGER_SQL} SELECT actual, round(avg(prob), 6) mean_prob, round(quantile_cont(prob, 0.5), 6) p50, round(quantile_cont(prob, 0.9), 6) p90, round(quantile_cont(prob, 0.99), 6) p99 FROM fx_ledger GROUP BY 1""")
def score_distribution(spark, d):
    led = ledger(spark, d)
    q = ranks.quantiles(led, ["actual"], "prob", [0.5, 0.9, 0.99])
    return led.groupBy("actual").agg(F.round(F.avg("prob"), 6).alias("mean_prob")).join(q, "actual").select("actual", "mean_prob", *[F.round(f"q{i}", 6).alias(n) for i, n in enumerate(("p50", "p90", "p99"))])


@query("correlations", f"""WITH {LEDGER_SQL} SELECT entity, round(corr(prob, actual), 6) r FROM fx_ledger GROUP BY 1""")
def correlations(spark, d):
    return ledger(spark, d).groupBy("entity").agg(F.round(stats.correlation("prob", "actual"), 6).alias("r"))


@query("case_studies", f"""WITH {LEDGER_SQL}, b AS (SELECT *, CASE WHEN actual = 1 AND prob >= 0.5 THEN 'hit' WHEN actual = 1 THEN 'miss' WHEN prob >= 0.65 THEN 'false_alarm' END bucket FROM fx_ledger),
 r AS (SELECT *, row_number() OVER (PARTITION BY bucket ORDER BY CASE WHEN bucket = 'miss' THEN prob ELSE -prob END, id) k FROM b WHERE bucket IS NOT NULL) SELECT bucket, CAST(k AS int) k, id, round(prob, 6) prob FROM r WHERE k <= 8""")
def case_studies(spark, d):
    bucket = F.when((F.col("actual") == 1) & (F.col("prob") >= 0.5), "hit").when(F.col("actual") == 1, "miss").when(F.col("prob") >= 0.65, "false_alarm")
    b = ledger(spark, d).withColumn("bucket", bucket).where("bucket is not null")
    w = Window.partitionBy("bucket").orderBy(F.when(F.col("bucket") == "miss", F.col("prob")).otherwise(-F.col("prob")), "id")
    return b.withColumn("k", F.row_number().over(w)).where("k <= 8").select("bucket", "k", "id", F.round("prob", 6).alias("prob"))


@query("model_disagreement", f"""WITH {LEDGER_SQL}, m AS (SELECT id, entity, actual, prob a, prob * 0.5 + (id % 10) / 20.0 b, (id % 7) / 7.0 c FROM fx_ledger), s AS (SELECT *, greatest(a, b, c) - least(a, b, c) spread, CAST(actual = 1 AND greatest(a, b, c) < 0.3 AS int) all_missed FROM m),
 r AS (SELECT *, row_number() OVER (PARTITION BY entity ORDER BY spread DESC, id) k FROM s) SELECT entity, id, round(spread, 6) spread, all_missed, round((a + b + c) / 3, 6) ensemble, round(0.65 * a + 0.35 * b, 6) weighted FROM r WHERE k <= 10 OR all_missed = 1""")
def model_disagreement(spark, d):
    m = ledger(spark, d).select("id", "entity", "actual", F.col("prob").alias("a"), F.expr("prob * 0.5D + (id % 10) / 20.0D").alias("b"), F.expr("(id % 7) / 7.0D").alias("c"))
    top = F.greatest("a", "b", "c")
    s = m.withColumns({"spread": top - F.least("a", "b", "c"), "all_missed": ((F.col("actual") == 1) & (top < 0.3)).cast("int")})
    r = s.withColumn("k", F.row_number().over(Window.partitionBy("entity").orderBy(F.desc("spread"), "id")))
    return r.where("k <= 10 or all_missed = 1").select("entity", "id", F.round("spread", 6).alias("spread"), "all_missed", F.round((F.col("a") + F.col("b") + F.col("c")) / 3, 6).alias("ensemble"), F.round(0.65 * F.col("a") + 0.35 * F.col("b"), 6).alias("weighted"))


@query("leaderboard_cube", f"""WITH {LEDGER_SQL}, l AS (SELECT id % 4 model, id % 3 category, entity track, prob ap FROM fx_ledger) SELECT model, category, count(*) n, round(avg(ap), 6) mean_ap, round(max(ap) - min(ap), 6) spread, round(avg(ap) FILTER (track < 'M'), 6) ap_first_half FROM l GROUP BY CUBE (model, category)""")
def leaderboard_cube(spark, d):
    x = ledger(spark, d).select(F.expr("id % 4").alias("model"), F.expr("id % 3").alias("category"), F.col("entity").alias("track"), F.col("prob").alias("ap"))
    return x.cube("model", "category").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("ap"), 6).alias("mean_ap"), F.round(F.max("ap") - F.min("ap"), 6).alias("spread"), F.round(F.avg(F.when(F.col("track") < "M", F.col("ap"))), 6).alias("ap_first_half"))


@query("leaderboard_top_and_best_so_far", f"""WITH {LEDGER_SQL}, b AS (SELECT entity, id, prob, max(prob) OVER (PARTITION BY entity ORDER BY id) best, max(prob) OVER (PARTITION BY entity ORDER BY id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) prev, row_number() OVER (PARTITION BY entity ORDER BY prob DESC, id) k FROM fx_ledger)
 SELECT entity, id, round(best, 6) best_so_far, CAST(prev IS NULL OR prob > prev AS int) new_best, CAST(k AS int) k FROM b WHERE k <= 15 OR prev IS NULL OR prob > prev""")
def leaderboard_top_and_best_so_far(spark, d):
    b = best_so_far(ranks.ranked(ledger(spark, d), ["entity"], "prob", ["id"]), ["entity"], "id", "prob").withColumn("k", F.col("k").cast("int"))
    return b.where("k <= 15 or new_best = 1").select("entity", "id", F.round("best_so_far", 6).alias("best_so_far"), "new_best", "k")


@query("naive_scores", f"""WITH {LEDGER_SQL}, p AS (SELECT entity, period, count(*) n, max(actual) a FROM fx_ledger GROUP BY 1, 2) SELECT entity, period, round(n / (max(n) OVER (PARTITION BY entity) + 1e-9), 6) frequency_score, coalesce(lag(a) OVER (PARTITION BY entity ORDER BY period), 0) persistence FROM p""")
def naive_scores(spark, d):
    p = ledger(spark, d).groupBy("entity", "period").agg(F.count(F.lit(1)).alias("n"), F.max("actual").alias("a"))
    return p.select("entity", "period", F.round(F.col("n") / (F.max("n").over(Window.partitionBy("entity")) + 1e-9), 6).alias("frequency_score"), F.coalesce(F.lag("a").over(Window.partitionBy("entity").orderBy("period")), F.lit(0)).alias("persistence"))


@query("curve_downsample", f"""WITH {LEDGER_SQL}, s AS (SELECT DISTINCT entity, prob FROM fx_ledger), r AS (SELECT *, row_number() OVER (PARTITION BY entity ORDER BY prob) - 1 i, count(*) OVER (PARTITION BY entity) n FROM s)
 SELECT entity, round(prob, 6) prob, CAST(i AS bigint) i FROM r WHERE list_contains(list_transform(range(60), lambda j: CAST(floor(j * (n - 1) / 59.0) AS bigint)), i)""")
def curve_downsample(spark, d):
    w = Window.partitionBy("entity")
    r = ledger(spark, d).select("entity", "prob").distinct().withColumns({"i": F.row_number().over(w.orderBy("prob")).cast("long") - 1, "n": F.count(F.lit(1)).over(w)})
    points = F.transform(F.sequence(F.lit(0), F.lit(59)), lambda j: F.floor(j * (F.col("n") - 1) / F.lit(59.0)))
    return r.where(F.array_contains(points, F.col("i"))).select("entity", F.round("prob", 6).alias("prob"), "i")


@query("ledger_comparison", f"""WITH {LEDGER_SQL}, a AS (SELECT entity, period, avg(prob) p, max(actual) y FROM fx_ledger WHERE id % 2 = 0 GROUP BY 1, 2), b AS (SELECT entity, period, avg(prob) p, max(actual) y FROM fx_ledger WHERE id % 2 = 1 GROUP BY 1, 2)
 SELECT entity, count(*) n_common, round(avg((a.p - a.y) ** 2), 6) loss_a, round(avg((b.p - b.y) ** 2), 6) loss_b, count(*) FILTER ((b.p - b.y) ** 2 < (a.p - a.y) ** 2) improved, count(*) FILTER (a.y <> b.y) label_mismatch FROM a JOIN b USING (entity, period) GROUP BY 1""")
def ledger_comparison(spark, d):
    side = lambda k, n: ledger(spark, d).where(f"id % 2 = {k}").groupBy("entity", "period").agg(F.avg("prob").alias(f"p{n}"), F.max("actual").alias(f"y{n}"))
    j = side(0, "a").join(side(1, "b"), ["entity", "period"])
    la, lb = (F.col("pa") - F.col("ya")) ** 2, (F.col("pb") - F.col("yb")) ** 2
    return j.groupBy("entity").agg(F.count(F.lit(1)).alias("n_common"), F.round(F.avg(la), 6).alias("loss_a"), F.round(F.avg(lb), 6).alias("loss_b"), F.count_if(lb < la).alias("improved"), F.count_if(F.col("ya") != F.col("yb")).alias("label_mismatch"))


PERIODS_SQL = "p AS (SELECT period, row_number() OVER (ORDER BY period) - 1 idx, count(*) OVER () np FROM (SELECT DISTINCT period FROM fx_ledger))"


@query("expanding_folds", f"""WITH {LEDGER_SQL}, {PERIODS_SQL}, c AS (SELECT period, count(*) n, CAST(sum(actual) AS bigint) pos FROM fx_ledger GROUP BY 1)
 SELECT a.idx fold_id, a.period, CAST(sum(cb.n) AS bigint) train_rows, CAST(sum(cb.pos) AS bigint) train_pos, any_value(ca.n) test_rows, any_value(ca.pos) test_pos FROM p a JOIN c ca ON ca.period = a.period JOIN p b ON b.idx + 2 < a.idx + 1 JOIN c cb ON cb.period = b.period WHERE a.idx >= 52 GROUP BY 1, 2""")
def expanding_folds(spark, d):
    return folds.expanding_folds(ledger(spark, d), "period", "actual", 52, embargo=1)


@query("block_folds", f"""WITH {LEDGER_SQL}, {PERIODS_SQL} SELECT period, CAST(floor((idx - 52) / greatest(1, floor((np - 52) / 10.0))) AS bigint) fold_id, idx period_index FROM p WHERE idx >= 52 AND floor((idx - 52) / greatest(1, floor((np - 52) / 10.0))) < 10""")
def block_folds(spark, d):
    return folds.block_folds(ledger(spark, d), "period", 52, 10)


@query("trailing_folds", f"""WITH {LEDGER_SQL}, {PERIODS_SQL}, c AS (SELECT period, count(*) n FROM fx_ledger GROUP BY 1), t AS (SELECT p.*, c.n, coalesce(sum(c.n) OVER (ORDER BY idx ROWS BETWEEN 200 PRECEDING AND 1 PRECEDING), 0) tr FROM p JOIN c USING (period)),
 k AS (SELECT *, row_number() OVER (ORDER BY idx) - 1 f FROM t WHERE period >= DATE '1999-01-04' AND tr >= 500) SELECT f fold_id, period, CAST(tr AS bigint) train_rows, n test_rows FROM k WHERE f % 4 = 0""")
def trailing_folds(spark, d):
    return folds.trailing_folds(ledger(spark, d), "period", 200, "1999-01-04", 500, 4)


@query("three_way_split", f"""WITH {LEDGER_SQL}, {PERIODS_SQL} SELECT CASE WHEN idx < floor(np * 0.48) THEN 'fit' WHEN idx < floor(np * 0.6) THEN 'calibrate' ELSE 'holdout' END part, count(*) n, CAST(sum(actual) AS bigint) pos, min(period) first_period FROM fx_ledger JOIN p USING (period) GROUP BY 1""")
def three_way_split(spark, d):
    s = folds.split_by_periods(ledger(spark, d), "period", [0.48, 0.6], ["fit", "calibrate", "holdout"])
    return s.groupBy("part").agg(F.count(F.lit(1)).alias("n"), F.sum("actual").alias("pos"), F.min("period").alias("first_period"))


@query("leave_one_entity_out", f"""WITH {LEDGER_SQL}, c AS (SELECT entity, count(*) n, CAST(sum(actual) AS bigint) pos FROM fx_ledger GROUP BY 1), t AS (SELECT CAST(sum(n) AS bigint) n, CAST(sum(pos) AS bigint) pos FROM c)
 SELECT entity, c.n test_rows, c.pos test_pos, t.n - c.n train_rows, t.pos - c.pos train_pos FROM c, t WHERE t.n - c.n >= 30 AND c.n >= 5 AND c.pos > 0 AND c.pos < c.n""")
def leave_one_entity_out(spark, d):
    return folds.leave_one_out(ledger(spark, d), "entity", "actual")
