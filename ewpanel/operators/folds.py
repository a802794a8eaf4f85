"""Temporal validation: folds over distinct periods, splits and embargo."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def periods(df: DataFrame, period: str) -> DataFrame:
    """Each distinct period with its index from 0 and the number of periods.

    The windows run over distinct periods only (a calendar, not the data).
    """
    w = Window.orderBy(period)
    return df.select(period).distinct().withColumns({"idx": F.row_number().over(w) - 1, "n_periods": F.count(F.lit(1)).over(Window.partitionBy())})


def expanding_folds(df: DataFrame, period: str, label: str, min_train: int, embargo: int = 0) -> DataFrame:
    """One fold for each period from index ``min_train``: sizes of its test period and of its strictly earlier, labelled training rows.

    ``embargo`` leaves out training rows whose label reaches over the cutoff (their
    period plus ``embargo`` periods must lie before it).
    """
    rows = df.where(F.col(label).isNotNull()).groupBy(period).agg(F.count(F.lit(1)).alias("n"), F.sum(label).alias("pos"))
    p = periods(df, period).join(rows, period, "left").fillna(0, ["n", "pos"])
    w = Window.orderBy("idx").rowsBetween(Window.unboundedPreceding, -1 - embargo)
    folds = p.withColumns({"train_rows": F.coalesce(F.sum("n").over(w), F.lit(0)), "train_pos": F.coalesce(F.sum("pos").over(w), F.lit(0))})
    return folds.where((F.col("idx") >= min_train) & (F.col("train_rows") > 0) & (F.col("n") > 0)).select(
        F.col("idx").alias("fold_id"), period, "train_rows", "train_pos", F.col("n").alias("test_rows"), F.col("pos").alias("test_pos"))


def block_folds(df: DataFrame, period: str, min_train: int, n_folds: int) -> DataFrame:
    """fold_id of each test period; blocks of max(1, (n - min_train) // n_folds) periods, the remainder unused."""
    p = periods(df, period)
    step = F.greatest(F.lit(1), F.floor((F.col("n_periods") - min_train) / n_folds))
    p = p.withColumn("fold_id", F.floor((F.col("idx") - min_train) / step))
    return p.where((F.col("idx") >= min_train) & (F.col("fold_id") < n_folds)).select(period, "fold_id", F.col("idx").alias("period_index"))


def trailing_folds(df: DataFrame, period: str, window: int, start: str, least: int, stride: int = 1) -> DataFrame:
    """Test periods from ``start`` with training on the ``window`` periods before, every ``stride``-th."""
    rows = df.groupBy(period).agg(F.count(F.lit(1)).alias("n"))
    p = periods(df, period).join(rows, period)
    w = Window.orderBy("idx").rowsBetween(-window, -1)
    p = p.withColumn("train_rows", F.coalesce(F.sum("n").over(w), F.lit(0))).where((F.col(period) >= F.lit(start).cast("date")) & (F.col("train_rows") >= least))
    p = p.withColumn("fold_id", F.row_number().over(Window.orderBy("idx")) - 1)
    return p.where(F.col("fold_id") % stride == 0).select("fold_id", period, "train_rows", F.col("n").alias("test_rows"))


def split_by_periods(df: DataFrame, period: str, fractions: list[float], names: list[str]) -> DataFrame:
    """The part of each row: cuts at int(n * fraction) of the distinct periods."""
    p = periods(df, period)
    part = F.lit(names[-1])
    for f, name in reversed(list(zip(fractions, names))):
        part = F.when(F.col("idx") < F.floor(F.col("n_periods") * f), name).otherwise(part)
    return df.join(p.select(period, part.alias("part")), period)


def leave_one_out(df: DataFrame, entity: str, label: str, least_train: int = 30, least_test: int = 5) -> DataFrame:
    """For each entity: sizes of its rows and of all others, where both are large enough and its rows have both classes."""
    each = df.where(F.col(label).isNotNull()).groupBy(entity).agg(F.count(F.lit(1)).alias("test_rows"), F.sum(label).alias("test_pos"))
    total = each.agg(F.sum("test_rows").alias("all_rows"), F.sum("test_pos").alias("all_pos"))
    out = each.crossJoin(F.broadcast(total)).select(  # one row
        entity, "test_rows", "test_pos", (F.col("all_rows") - F.col("test_rows")).alias("train_rows"), (F.col("all_pos") - F.col("test_pos")).alias("train_pos"))
    return out.where((F.col("train_rows") >= least_train) & (F.col("test_rows") >= least_test) & (F.col("test_pos") > 0) & (F.col("test_pos") < F.col("test_rows")))
