"""A sweep of rolling-origin fits: a curated grid and a seeded random search, stopped and resumed."""

from __future__ import annotations

from pyspark.sql import functions as F

from ewpanel.functions.staging import shared_folder, staged
from ewpanel.operators import linear, metrics, models, panel, sweeps
from ewpanel.plans.fits import NAMES, PROB_SQL, SUMS_SQL, solved_sql
from ewpanel.plans.panels import PANEL_SQL
from ewpanel.plans.registry import query
from ewpanel.sources.fixtures import conflict_events

#: Blocks of three features each, by name.
BLOCKS = {
    "lagged": ["n_events", "n_events_lag1", "deaths_lag1"],
    "deaths": ["deaths", "deaths_lag1", "deaths_lag2"],
    "types": ["n_state", "n_nonstate", "n_onesided"],
    "spread": ["n_conflicts", "n_events_lag1", "deaths_lag2"],
}
_OF_SQL = {**{c: c for c in ("n_events", "deaths", "n_state", "n_nonstate", "n_onesided", "n_conflicts")}, "n_events_lag1": "lag(n_events, 1) OVER v", "deaths_lag1": "lag(deaths, 1) OVER v", "deaths_lag2": "lag(deaths, 2) OVER v"}
MIN_TRAIN = 52


def _named(c):
    return {"name": f"{c['block']}/{c['penalty']}/{c['embargo']}", **c}


def configurations() -> list[dict]:
    """Each block at penalty 1 and embargo 1, a block that no table has, then six seeded random ones not among these."""
    curated = [_named({"block": b, "penalty": 1, "embargo": 1}) for b in [*BLOCKS, "absent"]]
    names = {c["name"] for c in curated}
    drawn = [_named({k: c[k] for k in ("block", "penalty", "embargo")}) for c in models.random_configs({"block": list(BLOCKS), "penalty": [1, 30, 1000], "embargo": [1, 4, 13]}, 12)]
    return curated + [c for c in drawn if c["name"] not in names][:6]


CONFIGS = configurations()
FIRST_RUN = 4

_CFG = ", ".join(f"('{c['name']}', {i}, '{c['block']}', {c['penalty']}.0, {c['embargo']})" for i, c in enumerate(CONFIGS))
_ROWS = " UNION ALL ".join(f"SELECT '{b}' block, country, week, CAST(\"{x[0]}\" AS double) x0, CAST(\"{x[1]}\" AS double) x1, CAST(\"{x[2]}\" AS double) x2, y FROM w" for b, x in BLOCKS.items())


@query("config_sweep", f"""WITH {PANEL_SQL}, w AS (SELECT country, week, {', '.join(f'{e} "{n}"' for n, e in _OF_SQL.items())}, lead(escalation, 1) OVER v y FROM l WINDOW v AS (PARTITION BY country ORDER BY week)),
 rw AS (SELECT * FROM ({_ROWS}) WHERE y IS NOT NULL AND x0 IS NOT NULL AND x1 IS NOT NULL AND x2 IS NOT NULL),
 cfg(name, position, block, pen, embargo) AS (VALUES {_CFG}), cal AS (SELECT week, row_number() OVER (ORDER BY week) - 1 idx FROM (SELECT DISTINCT week FROM l)),
 ps AS (SELECT block, week, {SUMS_SQL} FROM rw GROUP BY 1, 2), bl AS (SELECT DISTINCT block FROM rw),
 cum AS (SELECT block, idx, {', '.join(f'coalesce(sum({n}) OVER o, 0) {n}' for n in NAMES)} FROM bl CROSS JOIN cal LEFT JOIN ps USING (block, week) WINDOW o AS (PARTITION BY block ORDER BY idx)),
 pf AS (SELECT cfg.name, cfg.pen, cal.week, {', '.join(f'c.{n}' for n in NAMES)} FROM cfg JOIN cal ON cal.idx >= {MIN_TRAIN} JOIN cum c ON c.block = cfg.block AND c.idx = cal.idx - 1 - cfg.embargo),
 {solved_sql('pf', 'name, week', 'pen')},
 sc AS (SELECT cfg.name, round({PROB_SQL}, 6) prob, y actual FROM rw JOIN cfg USING (block) JOIN ft ON ft.name = cfg.name AND ft.week = rw.week),
 lo AS (SELECT name, count(*) n, CAST(sum(actual) AS bigint) n_pos, avg((prob - actual) ** 2) brier FROM sc GROUP BY 1), s AS (SELECT name, prob, count(*) n, sum(actual) pos FROM sc GROUP BY 1, 2),
 c AS (SELECT *, sum(n) OVER v flags, sum(pos) OVER v hits, sum(pos) OVER (PARTITION BY name) pos_all FROM s WINDOW v AS (PARTITION BY name ORDER BY prob DESC)),
 k AS (SELECT name, sum(pos * hits / flags) / max(pos_all) ap FROM c GROUP BY 1)
 SELECT cfg.name, CAST(position AS bigint) AS position, CAST(CASE WHEN position < {FIRST_RUN} THEN 1 ELSE 2 END AS bigint) run, n, n_pos, round(brier, 6) brier, round(ap, 6) average_precision,
        round(max(ap) OVER (ORDER BY position), 6) best_so_far, lo.name IS NULL failed FROM cfg LEFT JOIN lo ON lo.name = cfg.name LEFT JOIN k ON k.name = cfg.name""")
def config_sweep(spark, d):
    """Every configuration's pooled out-of-fold scores of next week's escalation; the sweep stops after four and is resumed from its log.

    The panel is staged once; each fit is one pass of sums over it, four at a time.
    """
    lagged = panel.fatality_escalation(conflict_events(spark, d)).select("country", "week", *sorted({f for b in BLOCKS.values() for f in b}), F.col("label_1").alias("actual"))
    rows = staged(lagged)

    def fit(c):
        ledger = linear.rolling_scores(rows, "week", BLOCKS[c["block"]], "actual", MIN_TRAIN, embargo=c["embargo"], penalty=float(c["penalty"])).withColumn("prob", F.round("prob", 6))
        ledger = ledger.select(F.lit(c["name"]).alias("name"), "prob", "actual")
        loss, order = metrics.losses(ledger, ["name"]).first(), metrics.ranking(ledger, ["name"]).first()
        return {"n": loss["n"], "n_pos": loss["n_pos"], "brier": loss["brier"], "average_precision": order["average_precision"]}

    path = shared_folder(spark, "sweep-log")
    sweeps.sweep(spark, CONFIGS[:FIRST_RUN], fit, path, "average_precision")
    log = sweeps.sweep(spark, CONFIGS, fit, path, "average_precision")
    m = lambda k: F.col("metrics")[k]
    return log.select("name", "position", "run", m("n").cast("long").alias("n"), m("n_pos").cast("long").alias("n_pos"), F.round(m("brier"), 6).alias("brier"),
                      F.round(m("average_precision"), 6).alias("average_precision"), F.round("best_so_far", 6).alias("best_so_far"), F.col("error").isNotNull().alias("failed"))
