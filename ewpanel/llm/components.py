"""Connected components by DataFrame operations only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ewpanel.llm.common import Stages, stage_table


def components(edges: DataFrame, a: str = "a", b: str = "b", within: Stages | None = None) -> DataFrame:
    """The component of every node that has an edge: node, component (its smallest node).

    Alternates large-star and small-star steps (each node is linked to the smallest
    node it sees) until all edges form stars; each step is a grouped minimum and a join,
    written to the shared folder. Only one truth value a round comes to the driver, and a
    round's tables go with the next. Self-loops, repeated and reversed edges and edges
    with a null end don't matter; without edges the result is empty. The result is one
    of the tables of ``within``, if given.
    """
    stages, last = Stages(edges.sparkSession), "edges-0"
    current = stages.table(
        edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v"), F.col(a).alias("a"), F.col(b).alias("b"))
        .where("u > v and a is not null and b is not null").select("u", "v").distinct(),
        last,
    )
    turn = 0
    while not _stars(current):
        turn += 1
        both = current.union(current.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u > v").distinct()
        large = stages.table(large, "large-star")
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e"))
        current = stages.table(small.select("e.u", "e.v").where("u > v").distinct(), f"edges-{turn}")
        stages.drop("large-star", last)
        last = f"edges-{turn}"
    found = (current.select(F.col("u").alias("node"), F.col("v").alias("component"))
             .union(current.select(F.col("v").alias("node"), F.col("v").alias("component"))).distinct())
    found = within.table(found, "components") if within else stage_table(found, "components")
    stages.close()
    return found


def _stars(edges: DataFrame) -> bool:
    """Whether every node is either a centre or has one edge, to a centre that is its smallest: then the steps change nothing."""
    node = F.explode(F.array(F.struct(F.col("u").alias("n"), F.lit(1).alias("up"), F.lit(0).alias("centre")), F.struct(F.col("v").alias("n"), F.lit(0).alias("up"), F.lit(1).alias("centre"))))
    seen = edges.select(node.alias("e")).groupBy("e.n").agg(F.sum("e.up").alias("up"), F.max("e.centre").alias("centre"))
    return not seen.where((F.col("up") > 1) | ((F.col("up") > 0) & (F.col("centre") > 0))).take(1)


def more_links(nodes: DataFrame, links: DataFrame, within: Stages, name: str) -> DataFrame:
    """``nodes`` (node, component) with further ``links`` (a, b), whose ends may be new: only links between components are followed."""
    side = lambda k: nodes.select(F.col("node").alias(k), F.col("component").alias(f"{k}_in"))
    mapped = links.select("a", "b").join(side("a"), "a", "left").join(side("b"), "b", "left")
    mapped = within.table(mapped.select("a", "b", F.coalesce("a_in", "a").alias("x"), F.coalesce("b_in", "b").alias("y")), "mapped-links")
    inner = Stages(nodes.sparkSession)
    joined = components(mapped, "x", "y", inner).select(F.col("node").alias("component"), F.col("component").alias("least"))
    new = mapped.select(F.explode(F.array("a", "b")).alias("node")).distinct().join(nodes, "node", "left_anti").select("node", F.col("node").alias("component"))
    out = within.table(nodes.select("node", "component").union(new).join(joined, "component", "left").select("node", F.coalesce("least", "component").alias("component")), name)
    within.drop("mapped-links")
    inner.close()
    return out
