"""Ledgers of models that are fitted for every fold at once from sums, and what they say by entity."""

from __future__ import annotations

from pyspark.sql import functions as F

from ewpanel.operators import calibration, folds, linear, metrics, panel
from ewpanel.plans.evaluation import PERIODS_SQL
from ewpanel.plans.panels import PANEL_SQL
from ewpanel.plans.registry import query
from ewpanel.sources.fixtures import LEDGER_SQL, conflict_events, ledger

LAGGED = ["n_events", "n_events_lag1", "deaths_lag1"]


def labelled(spark, d):
    """Country-weeks with next week's escalation as the label."""
    return panel.fatality_escalation(conflict_events(spark, d)).select("country", "week", *LAGGED, F.col("label_1").alias("actual"))


ROWS_SQL = f"""{PANEL_SQL}, w AS (SELECT country, week, CAST(n_events AS double) x0, CAST(lag(n_events, 1) OVER v AS double) x1, CAST(lag(deaths, 1) OVER v AS double) x2, lead(escalation, 1) OVER v y FROM l WINDOW v AS (PARTITION BY country ORDER BY week)),
 rw AS (SELECT * FROM w WHERE y IS NOT NULL AND x1 IS NOT NULL AND x2 IS NOT NULL)"""
_TERMS = {"n": "1.0", **{f"s{i}": f"x{i}" for i in range(3)}, **{f"p{i}{j}": f"x{i} * x{j}" for i in range(3) for j in range(i, 3)}}
SUMS_SQL = ", ".join(f"coalesce(sum({t}) FILTER (y = {c}), 0) {n}_{c}" for c in (0, 1) for n, t in _TERMS.items())
NAMES = [f"{n}_{c}" for c in (0, 1) for n in _TERMS]


def solved_sql(source: str, keys: str, penalty: str = "1") -> str:
    """Balanced ridge (standardised) of three features by Cramer's rule, for each row of sums; a constant feature has coefficient 0."""
    both = lambda n: f"(w0 * {n}_0 + w1 * {n}_1) / tot"
    flat = lambda *a: " OR ".join(f"f{i}" for i in dict.fromkeys(a))
    return f"""q0 AS (SELECT *, n_0 + n_1 tot, (n_0 + n_1) / (2 * n_0) w0, (n_0 + n_1) / (2 * n_1) w1 FROM {source} WHERE n_0 > 0 AND n_1 > 0),
 q1 AS (SELECT *, w1 * n_1 / tot ym, {', '.join(f'{both(f"s{i}")} m{i}' for i in range(3))} FROM q0),
 qa AS (SELECT *, {', '.join(f'{both(f"p{i}{j}")} - m{i} * m{j} c{i}{j}' for i in range(3) for j in range(i, 3))}, {', '.join(f'w1 * s{i}_1 / tot - m{i} * ym r{i}' for i in range(3))} FROM q1),
 qb AS (SELECT *, {', '.join(f'c{i}{i} <= 1e-12 * greatest({both(f"p{i}{i}")}, 1e-300) f{i}' for i in range(3))} FROM qa),
 q2 AS (SELECT * REPLACE ({', '.join(f'CASE WHEN {flat(i, j)} THEN {1 if i == j else 0} ELSE c{i}{j} END AS c{i}{j}' for i in range(3) for j in range(i, 3))}, {', '.join(f'CASE WHEN f{i} THEN 0 ELSE r{i} END AS r{i}' for i in range(3))}) FROM qb),
 q3 AS (SELECT * REPLACE ({', '.join(f'c{i}{i} * (1 + {penalty} / tot) AS c{i}{i}' for i in range(3))}) FROM q2),
 q4 AS (SELECT *, c00 * (c11 * c22 - c12 * c12) - c01 * (c01 * c22 - c02 * c12) + c02 * (c01 * c12 - c02 * c11) det FROM q3),
 q5 AS (SELECT *, (r0 * (c11 * c22 - c12 * c12) - c01 * (r1 * c22 - c12 * r2) + c02 * (r1 * c12 - c11 * r2)) / det b0, (c00 * (r1 * c22 - c12 * r2) - r0 * (c01 * c22 - c02 * c12) + c02 * (c01 * r2 - r1 * c02)) / det b1,
        (c00 * (c11 * r2 - r1 * c12) - c01 * (c01 * r2 - r1 * c02) + r0 * (c01 * c12 - c02 * c11)) / det b2 FROM q4),
 ft AS (SELECT {keys}, CAST(tot AS bigint) train_rows, CAST(n_1 AS bigint) train_pos, ym - b0 * m0 - b1 * m1 - b2 * m2 a, b0, b1, b2 FROM q5)"""


PROB_SQL = "least(1.0, greatest(0.0, a + b0 * x0 + b1 * x1 + b2 * x2))"
LOCO_SQL = f"""{ROWS_SQL}, own AS (SELECT country, {SUMS_SQL} FROM rw GROUP BY 1), al AS (SELECT {', '.join(f'sum({n}) a_{n}' for n in NAMES)} FROM own),
 fd AS (SELECT country, {', '.join(f'a_{n} - {n} AS {n}' for n in NAMES)} FROM own, al WHERE n_0 + n_1 >= 5 AND n_0 > 0 AND n_1 > 0 AND a_n_0 + a_n_1 - n_0 - n_1 >= 30),
 {solved_sql('fd', 'country')}, fx_loco AS (SELECT country, week, y actual, {PROB_SQL} prob, train_rows, train_pos FROM rw JOIN ft USING (country))"""
CAL_SQL = f"""{ROWS_SQL}, cal AS (SELECT week, row_number() OVER (ORDER BY week) - 1 idx, count(*) OVER () np FROM (SELECT DISTINCT week FROM l)), ps AS (SELECT week, {SUMS_SQL} FROM rw GROUP BY 1),
 pf AS (SELECT week, idx, np, {', '.join(f'coalesce(sum({n}) OVER o, 0) {n}' for n in NAMES)} FROM cal LEFT JOIN ps USING (week) WINDOW o AS (ORDER BY idx ROWS BETWEEN UNBOUNDED PRECEDING AND 2 PRECEDING)),
 {solved_sql('pf', 'week, idx')}"""


@query("loco_scores", f"""WITH {LOCO_SQL} SELECT country, week, CAST(actual AS bigint) actual, round(prob, 6) prob, train_rows, train_pos FROM fx_loco""")
def loco_scores(spark, d):
    """Each country's weeks scored by a model of all other countries."""
    s = linear.leave_one_out_scores(labelled(spark, d), "country", LAGGED, "actual")
    return s.select("country", "week", F.col("actual").cast("long").alias("actual"), F.round("prob", 6).alias("prob"), "train_rows", "train_pos")


@query("loco_by_entity", f"""WITH {LOCO_SQL}, r AS (SELECT country, round(prob, 6) prob, actual FROM fx_loco), u AS (SELECT * FROM r UNION ALL SELECT 'ALL', prob, actual FROM r),
 lo AS (SELECT country, count(*) n, CAST(sum(actual) AS bigint) n_pos, round(avg((prob - actual) ** 2), 6) brier FROM u GROUP BY 1), s AS (SELECT country, prob, count(*) n, sum(actual) pos FROM u GROUP BY 1, 2),
 c AS (SELECT *, sum(n) OVER w flags, sum(pos) OVER w hits, sum(n) OVER (PARTITION BY country) n_all, sum(pos) OVER (PARTITION BY country) pos_all FROM s WINDOW w AS (PARTITION BY country ORDER BY prob DESC)),
 k AS (SELECT country, round(CASE WHEN max(pos_all) BETWEEN 1 AND max(n_all) - 1 THEN sum(pos * hits / flags) / max(pos_all) END, 6) average_precision,
        round(CASE WHEN max(pos_all) BETWEEN 1 AND max(n_all) - 1 THEN sum(pos * ((n_all - pos_all) - (flags - hits) + (n - pos) / 2.0)) / (max(pos_all) * (max(n_all) - max(pos_all))) END, 6) roc_auc FROM c GROUP BY 1)
 SELECT country, n, n_pos, brier, average_precision, roc_auc FROM lo JOIN k USING (country)""")
def loco_by_entity(spark, d):
    """Out-of-country Brier score, average precision and AUC of each country and of all pooled."""
    s = loco_scores(spark, d).select("country", "prob", "actual")
    pooled = s.union(s.withColumn("country", F.lit("ALL")))
    r = metrics.ranking(pooled, ["country"]).select("country", F.round("average_precision", 6).alias("average_precision"), F.round("roc_auc", 6).alias("roc_auc"))
    return metrics.losses(pooled, ["country"]).select("country", "n", "n_pos", F.round("brier", 6).alias("brier")).join(r, "country")


@query("rolling_origin_ledger", f"""WITH {CAL_SQL} SELECT country, week, CAST(idx AS bigint) fold_id, CAST(y AS bigint) actual, round({PROB_SQL}, 6) prob, train_rows, train_pos FROM rw JOIN ft USING (week) WHERE idx >= 52""")
def rolling_origin_ledger(spark, d):
    """Every week from the 53rd scored by a model of all weeks before the last (embargo of one: its label reaches over the cutoff)."""
    s = linear.rolling_scores(labelled(spark, d), "week", LAGGED, "actual", 52, embargo=1)
    return s.select("country", "week", "fold_id", F.col("actual").cast("long").alias("actual"), F.round("prob", 6).alias("prob"), "train_rows", "train_pos")


@query("block_fold_ledger", f"""WITH {CAL_SQL}, bl AS (SELECT week, idx, CAST(floor((idx - 52) / greatest(1, floor((np - 52) / 10.0))) AS bigint) fold_id FROM cal WHERE idx >= 52), fi AS (SELECT fold_id, min(idx) idx FROM bl WHERE fold_id < 10 GROUP BY 1)
 SELECT rw.country, rw.week, fi.fold_id, CAST(y AS bigint) actual, round({PROB_SQL}, 6) prob, train_rows, train_pos FROM rw JOIN bl ON bl.week = rw.week JOIN fi ON fi.fold_id = bl.fold_id JOIN ft ON ft.idx = fi.idx WHERE train_rows >= 200""")
def block_fold_ledger(spark, d):
    """Ten blocks of weeks, each scored by one model of what lies before the block."""
    s = linear.block_scores(labelled(spark, d), "week", LAGGED, "actual", 52, 10, embargo=1)
    return s.select("country", "week", F.col("fold_id").cast("long").alias("fold_id"), F.col("actual").cast("long").alias("actual"), F.round("prob", 6).alias("prob"), "train_rows", "train_pos")


@query("isotonic_frozen", f"""WITH {LEDGER_SQL}, {PERIODS_SQL}, r AS (SELECT entity, floor(prob * 100) / 100 s, actual, CASE WHEN idx < floor(np * 0.48) THEN 'fit' WHEN idx < floor(np * 0.6) THEN 'calibrate' ELSE 'holdout' END part FROM fx_ledger JOIN p USING (period)),
 f AS (SELECT entity, s, count(*) n, sum(actual) pos FROM r WHERE part = 'calibrate' GROUP BY 1, 2), c AS (SELECT *, sum(n) OVER w cn, sum(pos) OVER w cp, row_number() OVER w i FROM f WINDOW w AS (PARTITION BY entity ORDER BY s)),
 m AS (SELECT a.entity, a.i a, b.i b, (b.cp - a.cp + a.pos) / (b.cn - a.cn + a.n) mean FROM c a JOIN c b ON a.entity = b.entity AND b.i >= a.i), o AS (SELECT c.entity, c.i, c.s, m.a, min(m.mean) least FROM c JOIN m ON m.entity = c.entity AND m.a <= c.i AND m.b >= c.i GROUP BY 1, 2, 3, 4),
 v AS (SELECT entity, s, max(least) v FROM o GROUP BY 1, 2), h AS (SELECT entity, s, count(*) n, CAST(sum(actual) AS bigint) n_pos FROM r WHERE part = 'holdout' GROUP BY 1, 2),
 k AS (SELECT h.*, l.s ls, l.v lv, u.s us, u.v uv FROM h ASOF LEFT JOIN v l ON h.entity = l.entity AND h.s >= l.s ASOF LEFT JOIN v u ON h.entity = u.entity AND h.s <= u.s)
 SELECT entity, s prob, n, n_pos, round(CASE WHEN ls IS NULL THEN uv WHEN us IS NULL OR us = ls THEN lv ELSE lv + (uv - lv) * (s - ls) / (us - ls) END, 6) calibrated FROM k""")
def isotonic_frozen(spark, d):
    """Scores (in hundredths) calibrated once by country on the weeks from 48 to 60 hundredths of the calendar, frozen, on all later weeks."""
    rows = folds.split_by_periods(ledger(spark, d), "period", [0.48, 0.6], ["fit", "calibrate", "holdout"]).withColumn("prob", F.floor(F.col("prob") * 100) / 100)
    steps = calibration.isotonic_fit(rows.where("part = 'calibrate'"), "prob", "actual", ["entity"])
    later = rows.where("part = 'holdout'").groupBy("entity", "prob").agg(F.count(F.lit(1)).alias("n"), F.sum("actual").alias("n_pos"))
    return calibration.isotonic_apply(later, steps, "prob", ["entity"]).select("entity", "prob", "n", "n_pos", F.round("calibrated", 6).alias("calibrated"))
