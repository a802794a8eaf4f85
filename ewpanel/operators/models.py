"""Spark ML models under a (fit, score) protocol on ledgers: features in, prob out."""

from __future__ import annotations

import random

from pyspark.ml import Pipeline
from pyspark.ml.classification import GBTClassifier, LogisticRegression, MultilayerPerceptronClassifier, RandomForestClassifier
from pyspark.ml.feature import StandardScaler, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ewpanel.operators.metrics import lowest_or_closest


def balanced_weight(df: DataFrame, label: str) -> Column:
    """N / (2 n_class), from one aggregate."""
    n, pos = df.agg(F.count(F.lit(1)), F.sum(label)).first()
    pos = max(1, pos or 0)
    neg = max(1, n - pos)
    return F.when(F.col(label) == 1, n / (2 * pos)).otherwise(n / (2 * neg))


def estimator(kind: str, seed: int = 7, **options):
    """logistic, forest or boosted, each with features, label and weight columns set."""
    common = {"featuresCol": "_features", "labelCol": "_label", "weightCol": "_weight"}
    if kind == "logistic":
        return LogisticRegression(**common, maxIter=options.get("max_iter", 50), regParam=options.get("reg", 1e-3))
    if kind == "forest":
        return RandomForestClassifier(**common, numTrees=options.get("trees", 40), maxDepth=options.get("depth", 5), seed=seed)
    if kind == "perceptron":
        return MultilayerPerceptronClassifier(featuresCol="_features", labelCol="_label", layers=[options["inputs"], 32, 16, 2], maxIter=options.get("max_iter", 100), seed=seed)
    if kind == "boosted":
        return GBTClassifier(**common, maxIter=options.get("rounds", 20), maxDepth=options.get("depth", 3), stepSize=options.get("rate", 0.1), seed=seed)
    raise ValueError(kind)


def positive_weight(df: DataFrame, label: str) -> Column:
    """negatives / positives for positives, 1 for negatives."""
    n, pos = df.agg(F.count(F.lit(1)), F.sum(label)).first()
    return F.when(F.col(label) == 1, max(1, n - (pos or 0)) / max(1, pos or 0)).otherwise(1.0)


def fit_score(train: DataFrame, test: DataFrame, features: list[str], label: str, kinds: tuple[str, ...] = ("logistic",), least: int = 1, **options) -> DataFrame:
    """Fit each kind on train (nulls as 0) and add prob, the mean of their scores, to test.

    Rows weigh balanced, those of boosted trees by negatives / positives. With fewer
    than ``least`` training rows of either class prob is the training rate (0 without rows).
    """
    n, pos = train.agg(F.count(F.lit(1)), F.sum(label)).first()
    if min(pos or 0, n - (pos or 0)) < max(1, least):
        return test.withColumn("prob", F.lit((pos or 0) / n if n else 0.0))
    train, test = train.fillna(0, features), test.fillna(0, features)
    ready = train.withColumns({"_label": F.col(label).cast("double"), "_weight": balanced_weight(train, label)})
    prepare = Pipeline(stages=[VectorAssembler(inputCols=features, outputCol="_raw"), StandardScaler(inputCol="_raw", outputCol="_features", withMean=True)]).fit(ready)
    ready, out = prepare.transform(ready).cache(), prepare.transform(test)
    cached = ready
    for k, kind in enumerate(kinds):
        if kind == "boosted":
            ready = ready.withColumn("_weight", positive_weight(train, label))
        model = estimator(kind, **options, **({"inputs": len(features)} if kind == "perceptron" else {})).fit(ready)
        out = model.transform(out).withColumn(f"_p{k}", vector_to_array("probability")[1]).drop("rawPrediction", "probability", "prediction")
    cached.unpersist()
    mean = sum((F.col(f"_p{k}") for k in range(len(kinds))), F.lit(0.0)) / len(kinds)
    return out.withColumn("prob", mean).drop("_raw", "_features", *[f"_p{k}" for k in range(len(kinds))])


def out_of_fold(df: DataFrame, folds: list[tuple[Column, Column]], features: list[str], label: str, **options) -> DataFrame:
    """Pooled out-of-fold scores: for each (train, test) condition a fit and the scored test rows."""
    parts = [fit_score(df.where(a & F.col(label).isNotNull()), df.where(b), features, label, **options).withColumn("fold_id", F.lit(i)) for i, (a, b) in enumerate(folds)]
    whole = parts[0]
    for p in parts[1:]:
        whole = whole.unionByName(p)
    return whole


def calibrate(scores: DataFrame, other: DataFrame, label: str, kind: str = "isotonic") -> DataFrame:
    """Fit a map from prob to label on ``scores`` (isotonic, or sigmoid by a logistic of one feature) and replace prob in ``other``.

    Scores outside the fitted range take its ends. Without scores ``other`` is returned as it is.
    """
    from pyspark.ml.regression import IsotonicRegression

    ready = scores.select(F.col("prob").alias("_x"), F.col(label).cast("double").alias("_label"))
    if ready.isEmpty():
        return other
    if kind == "isotonic":
        model = IsotonicRegression(featuresCol="_x", labelCol="_label").fit(ready)
        return model.transform(other.withColumn("_x", F.col("prob"))).withColumn("prob", F.col("prediction")).drop("_x", "prediction")
    to = VectorAssembler(inputCols=["_x"], outputCol="_v")
    model = LogisticRegression(featuresCol="_v", labelCol="_label", regParam=1e-6).fit(to.transform(ready))
    out = model.transform(to.transform(other.withColumn("_x", F.col("prob"))))
    return out.withColumn("prob", vector_to_array("probability")[1]).drop("_x", "_v", "rawPrediction", "probability", "prediction")


def stack(select_: DataFrame, holdout: DataFrame, folds: list[tuple[Column, Column]], features: list[str], label: str, kinds: tuple[str, ...], key: list[str], **options) -> DataFrame:
    """Out-of-fold base scores on the select window feed a balanced logistic; bases refitted on all of it score the holdout."""
    names = [f"base_{k}" for k in kinds]

    def joined(parts: list[DataFrame], base: DataFrame) -> DataFrame:
        for name, p in zip(names, parts):
            base = base.join(p.select(*key, F.col("prob").alias(name)), key)
        return base

    oof = joined([out_of_fold(select_, folds, features, label, kinds=(k,), **options) for k in kinds], select_)
    final = joined([fit_score(select_, holdout, features, label, (k,), **options) for k in kinds], holdout)
    return fit_score(oof, final, names, label)


def three_class(train: DataFrame, test: DataFrame, features: list[str], label: str, trees: int = 40, depth: int = 4, seed: int = 7) -> DataFrame:
    """One forest for none, event, severe (0, 1, 2): p_occ and p_sev."""
    to = VectorAssembler(inputCols=features, outputCol="_features")
    model = RandomForestClassifier(featuresCol="_features", labelCol="_label", numTrees=trees, maxDepth=depth, seed=seed).fit(
        to.transform(train.fillna(0, features).withColumn("_label", F.col(label).cast("double"))))
    p = vector_to_array("probability")
    out = model.transform(to.transform(test.fillna(0, features))).withColumns({"p_occ": 1 - p[0], "p_sev": p[2] if model.numClasses > 2 else F.lit(0.0)})
    return out.drop("_features", "rawPrediction", "probability", "prediction")


def sweep(configs: list[dict], run, log: list[dict] | None = None) -> list[dict]:
    """Run each configuration that isn't in ``log`` (by name); an error is a row, not an end; best_so_far runs over the metric."""
    done = {r["name"] for r in log or []}
    rows = list(log or [])
    for c in configs:
        if c["name"] in done:
            continue
        try:
            rows.append({"name": c["name"], "value": run(c), "error": None})
        except Exception as e:  # noqa: BLE001
            rows.append({"name": c["name"], "value": None, "error": str(e)[:200]})
    best = None
    for r in rows:
        if r["value"] is not None and (best is None or r["value"] > best):
            best = r["value"]
        r["best_so_far"] = best
    return rows


def importances(train: DataFrame, features: list[str], label: str, kind: str = "boosted", **options) -> DataFrame:
    """feature, importance of a tree model fitted on train, highest first (ties by name); a number for each feature."""
    ready = train.fillna(0, features).withColumns({"_label": F.col(label).cast("double"), "_weight": positive_weight(train, label) if kind == "boosted" else balanced_weight(train, label)})
    model = estimator(kind, **options).fit(VectorAssembler(inputCols=features, outputCol="_features").transform(ready))
    rows = [(f, float(v)) for f, v in zip(features, model.featureImportances.toArray())]
    return train.sparkSession.createDataFrame(rows, "feature string, importance double").orderBy(F.desc("importance"), "feature")


def calibrated_folds(train: DataFrame, test: DataFrame, key: list[str], features: list[str], label: str, kind: str = "sigmoid", folds: int = 3, kinds: tuple[str, ...] = ("logistic",), **options) -> DataFrame:
    """Cross-fitted calibration: each of ``folds`` parts (by a hash of ``key``) calibrates a model of the others; prob is the mean over parts."""
    part = F.pmod(F.xxhash64(*key), F.lit(folds))
    out = test
    for k in range(folds):
        rest, own = train.where(part != k), train.where(part == k)
        scores = fit_score(rest, own, features, label, kinds, **options)
        one = calibrate(scores, fit_score(rest, test, features, label, kinds, **options), label, kind)
        out = out.join(one.select(*key, F.col("prob").alias(f"_c{k}")), key)
    return out.withColumn("prob", sum((F.col(f"_c{k}") for k in range(folds)), F.lit(0.0)) / folds).drop(*[f"_c{k}" for k in range(folds)])


def multi_split(df: DataFrame, period: str, cuts: list[str], last: str, key: list[str], features: list[str], label: str, target: float, kinds: tuple[str, ...] = ("logistic",), **options) -> DataFrame:
    """Models of several split dates on the common latest window: mean score and mean threshold.

    For each cut a model is fitted before it and its threshold chosen (lowest score
    with precision >= ``target``, else the closest) between the cut and ``last``; rows
    from ``last`` on get prob and threshold, the means over the cuts.
    """
    at = lambda d: F.lit(d).cast("date")
    latest = df.where(F.col(period) >= at(last))
    out, thresholds = latest, None
    for k, cut in enumerate(cuts):
        train = df.where((F.col(period) < at(cut)) & F.col(label).isNotNull())
        scored = fit_score(train, df.where(F.col(period) >= at(cut)), features, label, kinds, **options)
        chosen = lowest_or_closest(scored.where(F.col(period) < at(last)).select("prob", F.col(label).cast("long").alias("actual")).where("actual is not null"), target, [])
        thresholds = chosen.select("threshold") if thresholds is None else thresholds.union(chosen.select("threshold"))
        out = out.join(scored.where(F.col(period) >= at(last)).select(*key, F.col("prob").alias(f"_s{k}")), key)
    out = out.withColumn("prob", sum((F.col(f"_s{k}") for k in range(len(cuts))), F.lit(0.0)) / len(cuts)).drop(*[f"_s{k}" for k in range(len(cuts))])
    return out.crossJoin(F.broadcast(thresholds.agg(F.avg("threshold").alias("threshold"))))  # one row


def random_configs(space: dict[str, list], n: int, seed: int = 7) -> list[dict]:
    """n seeded random configurations of a parameter space, each once, with a name."""
    rng, out = random.Random(seed), {}
    for _ in range(20 * n):
        c = {k: rng.choice(v) for k, v in sorted(space.items())}
        out.setdefault(",".join(f"{k}={v}" for k, v in c.items()), c)
        if len(out) == n:
            break
    return [{"name": name, **c} for name, c in out.items()]
