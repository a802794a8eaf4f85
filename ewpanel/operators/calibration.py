"""Isotonic calibration: pooled adjacent violators by ranges of the score, frozen, and applied by interpolation."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.window import Window

from ewpanel.functions.staging import staged
from ewpanel.operators.ranks import binned


def pool(steps: list, step: tuple) -> None:
    """Adds the next step (lo, hi, n, pos) in the order of the score; neighbours are pooled until their rates rise."""
    lo, hi, n, pos = step
    while steps and steps[-1][3] * n >= pos * steps[-1][2]:
        last = steps.pop()
        lo, n, pos = last[0], last[2] + n, last[3] + pos
    steps.append((lo, hi, n, pos))


def _pooled(df: DataFrame, keys: list[str]) -> DataFrame:
    """The steps of each group of ``keys``; a task streams its groups in order and holds the steps of one."""
    schema = df.select(*keys, "lo", "hi", "n", "pos").schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, steps, done = None, [], []
        for batch in batches:
            for *key, lo, hi, n, pos in zip(*(c.to_pylist() for c in batch.columns)):
                if key != group:
                    done += [(*group, *s) for s in steps] if steps else []
                    group, steps = key, []
                pool(steps, (lo, hi, n, pos))
            yield rows(done)
            done = []
        yield rows([(*group, *s) for s in steps] if steps else [])

    def rows(of: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in of], kind) for i, kind in enumerate(kinds)], schema.names)

    kinds = to_arrow_schema(schema).types
    ordered = df.select(*schema.names).repartition(*keys) if keys else df.select(*schema.names).coalesce(1)
    return ordered.sortWithinPartitions(*keys, "lo").mapInArrow(run, schema)


def isotonic_fit(df: DataFrame, prob: str, actual: str, by: list[str], bins: int = 256) -> DataFrame:
    """The rising step function of the score nearest to a 0/1 outcome in squares: by, lo, hi, value of each step.

    Rows are collapsed to distinct scores, which are pooled inside ranges of the score first
    (pooling neighbours that fall never has to be undone), then what is left by one task a group. That is the lower
    convex hull of a chain of lattice points, so of N rows at most in the order of N**(2/3) steps are left in a
    range, and in practice a few thousand. Null scores and outcomes count nowhere; one class gives one step.
    """
    scores = df.where(F.col(prob).isNotNull() & F.col(actual).isNotNull()).groupBy(*by, F.col(prob).cast("double").alias("lo")).agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.col(actual).cast("long")).alias("pos"))
    ranged = binned(staged(scores), "lo", bins).withColumn("hi", F.col("lo"))
    whole = _pooled(_pooled(ranged, [*by, "_bin"]), by)
    return staged(whole.select(*by, "lo", "hi", (F.col("pos") / F.col("n")).alias("value")))


def isotonic_apply(df: DataFrame, steps: DataFrame, prob: str, by: list[str], out: str = "calibrated") -> DataFrame:
    """``df`` with the frozen step function at its scores: linear between steps, constant beyond the first and last.

    Neighbouring steps are found inside ranges of the score; those outside of a range come from a table of ranges,
    so no window holds a group. Groups without a fit, and null scores, get null.
    """
    knots = steps.select(*by, F.explode(F.array_distinct(F.array("lo", "hi"))).alias("_s"), F.col("value").alias("_v"))
    asked = df.where(F.col(prob).isNotNull()).select(*by, F.col(prob).cast("double").alias("_s"), F.lit(None).cast("double").alias("_v"))
    rows = binned(staged(asked.union(knots).groupBy(*by, "_s").agg(F.max("_v").alias("_v"))), "_s")
    knot = F.when(F.col("_v").isNotNull(), F.struct("_s", "_v"))
    order = Window.partitionBy(*by).orderBy("_bin")
    ranges = rows.groupBy(*by, "_bin").agg(F.max(knot).alias("_l"), F.min(knot).alias("_f"))
    ranges = ranges.select(*by, "_bin", F.last("_l", True).over(order.rowsBetween(Window.unboundedPreceding, -1)).alias("_before"), F.first("_f", True).over(order.rowsBetween(1, Window.unboundedFollowing)).alias("_after"))
    inner = Window.partitionBy(*by, "_bin").orderBy("_s")
    rows = rows.join(ranges, [*by, "_bin"]).select(
        *by, "_s", F.coalesce(F.last(knot, True).over(inner.rowsBetween(Window.unboundedPreceding, 0)), "_before").alias("_l"),
        F.coalesce(F.first(knot, True).over(inner.rowsBetween(0, Window.unboundedFollowing)), "_after").alias("_h"))
    low, high = F.col("_l"), F.col("_h")
    between = low["_v"] + (high["_v"] - low["_v"]) * (F.col("_s") - low["_s"]) / (high["_s"] - low["_s"])
    value = F.when(low.isNull(), high["_v"]).when(high.isNull() | (low["_s"] == high["_s"]), low["_v"]).otherwise(between)
    table = rows.select(*[F.col(c).alias(f"_k_{c}") for c in by], "_s", value.alias(out))
    on = F.col(prob).cast("double") == F.col("_s")
    for c in by:
        on = on & (F.col(c) == F.col(f"_k_{c}"))
    return df.join(table, on, "left").drop("_s", *[f"_k_{c}" for c in by])
