"""Ridge models of many folds from one pass of sums: leave-one-entity-out and rolling-origin fits without a fit for each fold."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ewpanel.operators.folds import block_folds, periods


def sum_names(k: int) -> list[str]:
    """Sums of one class after another: rows, each feature, each product of two features."""
    return [f"_{c}_{name}" for c in (0, 1) for name in ["n", *[f"s{i}" for i in range(k)], *[f"p{i}_{j}" for i in range(k) for j in range(i, k)]]]


def class_sums(df: DataFrame, features: list[str], label: str, by: list[str]) -> DataFrame:
    """One grouped aggregate of ``df``: the sums of ``sum_names`` for each group. Rows with a null feature or label count nowhere."""
    x = [F.col(c).cast("double") for c in features]
    whole = F.col(label).isNotNull()
    for c in features:
        whole = whole & F.col(c).isNotNull()
    terms = [F.lit(1.0), *x, *[x[i] * x[j] for i in range(len(x)) for j in range(i, len(x))]]
    sums = [F.sum(F.when(whole & (F.col(label) == c), t).otherwise(0.0)) for c in (0, 1) for t in terms]
    return df.groupBy(*by).agg(*[s.alias(n) for s, n in zip(sums, sum_names(len(features)))])


def solve(sums: np.ndarray, k: int, penalty: float, balanced: bool) -> np.ndarray | None:
    """Intercept and coefficients of the ridge fit of a 0/1 label from one fold's sums, or None without both classes.

    Features count as standardised: (C + penalty / n * diag C) b = c with C and c the
    weighted covariances; a constant feature has coefficient 0. ``balanced`` weighs a class n / (2 n_class).
    """
    half = len(sums) // 2
    n = sums[[0, half]]
    if n.min() <= 0:
        return None
    weight = n.sum() / (2 * n) if balanced else np.ones(2)
    total = float((weight * n).sum())
    means = np.zeros(k)
    products = np.zeros((k, k))
    for c, w in enumerate(weight):
        own = sums[c * half : (c + 1) * half]
        means += w * own[1 : k + 1] / total
        upper = np.zeros((k, k))
        upper[np.triu_indices(k)] = own[k + 1 :]
        products += w * (upper + np.triu(upper, 1).T) / total
    y = weight[1] * n[1] / total
    cov = products - np.outer(means, means)
    cross = weight[1] * sums[half + 1 : half + k + 1] / total - means * y
    spread = np.diag(cov).copy()
    flat = spread <= 1e-12 * np.maximum(np.diag(products), 1e-300)
    cov[np.diag_indices(k)] += np.where(flat, 1.0, penalty / n.sum() * spread)
    cov[flat, :], cov[:, flat] = 0, 0
    cov[flat, flat] = 1
    cross[flat] = 0
    b = np.linalg.lstsq(cov, cross, rcond=None)[0]
    return np.concatenate([[y - b @ means], b])


def fitted(folds: DataFrame, k: int, penalty: float, balanced: bool) -> DataFrame:
    """``folds`` (a row of sums each) with its coefficients and numbers of training rows; folds of one class are left out."""
    names = sum_names(k)
    keep = [f for f in folds.schema.fields if f.name not in names]
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in keep] + ["_b array<double>", "train_rows long", "train_pos long"])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            sums = pdf[names].to_numpy(float)
            b = [solve(s, k, penalty, balanced) for s in sums]
            out = pdf[[f.name for f in keep]].copy()
            out["_b"], out["train_rows"], out["train_pos"] = b, (sums[:, 0] + sums[:, len(names) // 2]).astype("int64"), sums[:, len(names) // 2].astype("int64")
            yield out[[x is not None for x in b]]

    return folds.mapInPandas(run, schema)


def _score(features: list[str]) -> Column:
    b = F.col("_b")
    out = b[0]
    for i, c in enumerate(features):
        out = out + b[i + 1] * F.col(c).cast("double")
    return F.least(F.lit(1.0), F.greatest(F.lit(0.0), out))


def _complete(df: DataFrame, features: list[str], label: str) -> DataFrame:
    return df.dropna(subset=[*features, label])


def leave_one_out_scores(df: DataFrame, entity: str, features: list[str], label: str, penalty: float = 1.0, balanced: bool = True, least_train: int = 30, least_test: int = 5) -> DataFrame:
    """Complete rows of ``df`` with prob, the score of a model fitted on all other entities, and train_rows, train_pos.

    One aggregate gives each entity's sums; those of all, less the entity's own, are the sums of its
    fold. Entities with fewer than ``least_test`` rows or one class alone, or whose others are fewer than
    ``least_train``, are left out.
    """
    k = len(features)
    names = sum_names(k)
    own = class_sums(df, features, label, [entity])
    total = own.agg(*[F.sum(n).alias(f"_all{n}") for n in names])
    neg, pos = F.col("_0_n"), F.col("_1_n")
    large = (neg + pos >= least_test) & (neg > 0) & (pos > 0) & (F.col("_all_0_n") + F.col("_all_1_n") - neg - pos >= least_train)
    folds = own.crossJoin(F.broadcast(total)).where(large).select(entity, *[(F.col(f"_all{n}") - F.col(n)).alias(n) for n in names])  # one row
    return _complete(df, features, label).join(fitted(folds, k, penalty, balanced), entity).withColumn("prob", _score(features)).drop("_b")


def fits_before(df: DataFrame, period: str, features: list[str], label: str, embargo: int = 0, penalty: float = 1.0, balanced: bool = True) -> DataFrame:
    """For each period (with its idx) the model of all rows that lie more than ``embargo`` periods before it.

    One aggregate by period, one window of running sums over the calendar (a row for each period), one
    solve a row: the number of jobs does not follow the number of folds.
    """
    names = sum_names(len(features))
    each = periods(df, period).select(period, "idx").join(class_sums(df, features, label, [period]), period)
    before = Window.orderBy("idx").rowsBetween(Window.unboundedPreceding, -1 - embargo)
    folds = each.select(period, F.col("idx").cast("long").alias("idx"), *[F.coalesce(F.sum(n).over(before), F.lit(0.0)).alias(n) for n in names])
    return fitted(folds, len(features), penalty, balanced)


def rolling_scores(df: DataFrame, period: str, features: list[str], label: str, min_train: int, embargo: int = 0, penalty: float = 1.0, balanced: bool = True) -> DataFrame:
    """Out-of-fold ledger of one-period folds: every complete row from period index ``min_train`` on, with fold_id, prob, train_rows, train_pos."""
    fits = fits_before(df, period, features, label, embargo, penalty, balanced).where(F.col("idx") >= min_train).withColumnRenamed("idx", "fold_id")
    return _complete(df, features, label).join(fits, period).withColumn("prob", _score(features)).drop("_b")


def block_scores(df: DataFrame, period: str, features: list[str], label: str, min_train: int, n_folds: int, embargo: int = 0, penalty: float = 1.0, balanced: bool = True, least_train: int = 200) -> DataFrame:
    """Out-of-fold ledger of block folds: a block's rows by the model of what lies before the block's first period.

    Blocks are those of ``folds.block_folds``; those with fewer than ``least_train`` training rows, or one class, are left out.
    """
    blocks = block_folds(df, period, min_train, n_folds)
    first = blocks.groupBy("fold_id").agg(F.min("period_index").cast("long").alias("idx"))
    fits = fits_before(df, period, features, label, embargo, penalty, balanced).drop(period)
    fits = fits.where(F.col("train_rows") >= least_train).join(first, "idx").drop("idx")
    rows = _complete(df, features, label).join(blocks.select(period, "fold_id"), period)
    return rows.join(fits, "fold_id").withColumn("prob", _score(features)).drop("_b")
