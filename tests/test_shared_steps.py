"""Panels that several passes read are computed once; lines and distinct actors move no more than they must."""

import datetime
import re

from ewpanel.operators import panel
from ewpanel.plans import QUERIES
from ewpanel.plans.modelling import labelled_cells, labelled_panel
from ewpanel.sources.fixtures import coded_events

SF = "/root/testdata/sf0.001"


def optimized(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_fits_read_a_staged_panel(spark):
    for staged in (labelled_panel(spark, SF), labelled_cells(spark, SF.replace("0.001", "0.01"))):
        assert "Join" not in optimized(staged) and "Relation" not in optimized(staged)


def test_imputation_reads_its_weeks_once(spark):
    assert "Relation" not in optimized(QUERIES["imputation"](spark, SF))


def test_lines_are_shuffled_for_one_join(spark):
    plan = optimized(coded_events(spark, SF)).splitlines()
    at = next(i for i, line in enumerate(plan) if "l_shipdate" in line and "Relation" in line)
    depth = lambda line: len(re.match(r"[\s:+-]*", line)[0])
    above = [line for i, line in enumerate(plan[:at]) if "Join" in line and not any(depth(x) <= depth(line) for x in plan[i + 1 : at + 1])]
    assert len(above) == 1


def test_pairs_of_actors_carry_no_counts(spark):
    plan = QUERIES["coded_panel"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    counted = [line for line in plan.splitlines() if "sum(mentions" in line and "Aggregate" in line]
    assert counted and not any("actor" in line for line in counted)


def test_coded_weeks_without_a_day_or_actors_stay(spark):
    day = datetime.date(1998, 1, 7)
    rows = [("a", day, "x", "y"), ("a", day, "x", None), ("a", day, "x", ""), ("a", day, "x", "y"), ("a", None, "x", "z"), ("b", day, None, None)]
    events = spark.createDataFrame([(*r, "010", 1, 2, 3, 4) for r in rows], "country string, day date, actor1 string, actor2 string, event_code string, quad_class long, goldstein long, tone long, mentions long")
    got = {(r.country, str(r.week)): (r.n_events, r.mentions, r.n_actor_pairs, r.distinct_actors) for r in panel.coded_panel(events).collect()}
    assert got == {("a", "1998-01-05"): (4, 16, 2, 3), ("a", "None"): (1, 4, 1, 0), ("b", "1998-01-05"): (1, 4, 1, 0)}
