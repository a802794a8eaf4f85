"""Exact metrics and threshold rules over a prediction ledger (prob, actual), by group.

``by`` names group columns; an empty list is the whole ledger. Scores are collapsed to
distinct values before any cumulative window, so a window sorts distinct scores only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ewpanel.operators.ranks import running


def confusion(df: DataFrame, threshold: Column, by: list[str]) -> DataFrame:
    """tp, fp, fn, tn, precision, recall, specificity, accuracy, coverage at prob >= threshold."""
    hit, yes = F.col("prob") >= threshold, F.col("actual") == 1
    out = df.groupBy(*by).agg(
        F.count_if(hit & yes).alias("tp"), F.count_if(hit & ~yes).alias("fp"), F.count_if(~hit & yes).alias("fn"), F.count_if(~hit & ~yes).alias("tn"))
    n = F.col("tp") + F.col("fp") + F.col("fn") + F.col("tn")
    return out.withColumns({
        "precision": F.col("tp") / F.greatest(F.lit(1), F.col("tp") + F.col("fp")), "recall": F.col("tp") / F.greatest(F.lit(1), F.col("tp") + F.col("fn")),
        "specificity": F.col("tn") / F.greatest(F.lit(1), F.col("tn") + F.col("fp")), "accuracy": (F.col("tp") + F.col("tn")) / F.greatest(F.lit(1), n),
        "coverage": (F.col("tp") + F.col("fp")) / F.greatest(F.lit(1), n)})


def f1_fpr_mcc(df: DataFrame) -> DataFrame:
    """F1, false-positive rate and Matthews correlation (0 where undefined) from confusion counts."""
    tp, fp, fn, tn = (F.col(c).cast("double") for c in ("tp", "fp", "fn", "tn"))
    root = F.sqrt((tp + fp) * (tp + fn) * (tn + fp) * (tn + fn))
    return df.withColumns({
        "f1": 2 * tp / F.greatest(F.lit(1.0), 2 * tp + fp + fn), "fpr": fp / F.greatest(F.lit(1.0), fp + tn),
        "mcc": F.when(root == 0, 0.0).otherwise((tp * tn - fp * fn) / root)})


def clipped(p: Column, eps: float = 1e-6) -> Column:
    return F.least(F.greatest(p, F.lit(eps)), F.lit(1 - eps))


def losses(df: DataFrame, by: list[str]) -> DataFrame:
    """Brier score, its gain over the base rate, and log loss."""
    p = clipped(F.col("prob"))
    out = df.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"), F.sum("actual").alias("n_pos"), F.avg((F.col("prob") - F.col("actual")) ** 2).alias("brier"),
        F.avg(F.when(F.col("actual") == 1, -F.ln(p)).otherwise(-F.ln(1 - p))).alias("log_loss"), F.avg("actual").alias("_rate"))
    return out.withColumn("brier_gain", F.col("_rate") * (1 - F.col("_rate")) - F.col("brier")).drop("_rate")


def by_score(df: DataFrame, by: list[str]) -> DataFrame:
    """n and positives of each distinct score, with running totals from the highest score down."""
    scores = df.groupBy(*by, "prob").agg(F.count(F.lit(1)).alias("n"), F.sum("actual").alias("pos"))
    return running(scores, by, "prob", {"flags": F.col("n"), "hits": F.col("pos")}).withColumnsRenamed({"flags_all": "n_all", "hits_all": "pos_all"})


def ranking(df: DataFrame, by: list[str]) -> DataFrame:
    """Average precision (ties grouped) and ROC AUC (ties half); null where a class is missing."""
    s = by_score(df, by)
    above = (F.col("n_all") - F.col("pos_all")) - (F.col("flags") - F.col("hits"))  # negatives below this score
    neg = F.col("n") - F.col("pos")
    out = s.groupBy(*by).agg(
        F.sum(F.col("pos") * (F.col("hits") / F.col("flags"))).alias("_ap"), F.sum(F.col("pos") * (above + neg / 2)).alias("_u"),
        F.max("pos_all").alias("_p"), F.max("n_all").alias("_n"))
    both = (F.col("_p") > 0) & (F.col("_p") < F.col("_n"))
    return out.select(*by, F.when(both, F.col("_ap") / F.col("_p")).alias("average_precision"), F.when(both, F.col("_u") / (F.col("_p") * (F.col("_n") - F.col("_p")))).alias("roc_auc"))


def threshold_curve(df: DataFrame, thresholds: list[float], by: list[str]) -> DataFrame:
    """Confusion at each threshold of a fixed grid, in one pass."""
    each = df.withColumn("threshold", F.explode(F.array(*[F.lit(t) for t in thresholds])))
    return confusion(each, F.col("threshold"), [*by, "threshold"])


def precision_recall_curve(df: DataFrame, by: list[str]) -> DataFrame:
    s = by_score(df, by)
    return s.select(*by, F.col("prob").alias("threshold"), (F.col("hits") / F.col("flags")).alias("precision"), (F.col("hits") / F.greatest(F.lit(1), F.col("pos_all"))).alias("recall"))


def lowest_reaching(df: DataFrame, targets: list[float], by: list[str], min_flags: int = 5) -> DataFrame:
    """Rule A: the lowest score with precision >= target and at least ``min_flags`` flags; null if none."""
    s = by_score(df, by).withColumn("target", F.explode(F.array(*[F.lit(t) for t in targets])))
    reached = (F.col("hits") / F.col("flags") >= F.col("target")) & (F.col("flags") >= min_flags)
    return s.groupBy(*by, "target").agg(F.min(F.when(reached, F.col("prob"))).alias("threshold"))


def lowest_or_closest(df: DataFrame, target: float, by: list[str]) -> DataFrame:
    """Rule B: the lowest score with precision >= target, else the closest (the highest such score); whether it was reached."""
    s = by_score(df, by).withColumn("precision", F.col("hits") / F.col("flags"))
    return s.groupBy(*by).agg(
        F.min(F.when(F.col("precision") >= target, F.col("prob"))).alias("_a"),
        F.min_by("prob", F.struct(F.abs(F.col("precision") - target), -F.col("prob"))).alias("_b"),
    ).select(*by, F.coalesce("_a", "_b").alias("threshold"), F.col("_a").isNotNull().cast("int").alias("reached"))


def scan_until_below(df: DataFrame, target: float, by: list[str], tie: str, first: int = 10, strict: bool = False) -> DataFrame:
    """Rule C: from the highest score down, the score at the first rank k >= ``first`` whose top-k precision is below target.

    ``strict`` returns the score before it. Without a breach the lowest score. Ranks
    are by (score desc, ``tie``), counted by ranges of scores.
    """
    r = running(df, by, "prob", {"k": F.lit(1).cast("long"), "_hits": F.col("actual")}, True, [tie])
    breach = (F.col("k") >= first) & (F.col("_hits") / F.col("k") < target)
    found = r.groupBy(*by).agg(F.min(F.when(breach, F.col("k"))).alias("_at"), F.min("prob").alias("_lowest"))
    r = r.select(*by, "k", "prob")
    at = F.col("_at") - 1 if strict else F.col("_at")
    joined = found.withColumn("k", at).join(r, [*by, "k"], "left")
    return joined.select(*by, F.coalesce("prob", F.when(F.col("_at").isNull(), F.col("_lowest"))).alias("threshold"))


def precision_at_positives(df: DataFrame, by: list[str], tie: str) -> DataFrame:
    """Precision of the top N, N the number of positives (at least one)."""
    r = running(df, by, "prob", {"_k": F.lit(1).cast("long"), "_pos": F.col("actual")}, True, [tie]).withColumn("_n", F.greatest(F.lit(1), F.col("_pos_all")))
    return r.where("_k <= _n").groupBy(*by).agg(F.max("_n").alias("top_n"), F.avg("actual").alias("precision_at_n"))


def frozen(select_: DataFrame, holdout: DataFrame, target: float, by: list[str], min_flags: int = 5) -> DataFrame:
    """Choose a threshold by rule A on one window and report it, unchanged, on both."""
    chosen = lowest_reaching(select_, [target], by, min_flags).drop("target")
    parts = select_.withColumn("part", F.lit("select")).unionByName(holdout.withColumn("part", F.lit("holdout")))
    joined = parts.join(chosen, by) if by else parts.crossJoin(F.broadcast(chosen))  # one row
    return f1_fpr_mcc(confusion(joined.where("threshold is not null"), F.col("threshold"), [*by, "part", "threshold"]))


def compare_callers(df: DataFrame, by: list[str], a: str, b: str) -> DataFrame:
    """Accuracy of two boolean callers (null: no answer) and what the second changes of the first's alarms."""
    right = lambda c: F.avg((F.col(c) == (F.col("actual") == 1)).cast("int"))
    changed = F.col(a) & ~F.col(b)
    return df.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n_cases"), F.round(right(a), 6).alias("accuracy_a"), F.round(right(b), 6).alias("accuracy_b"),
        F.count_if(changed & (F.col("actual") == 0)).alias("false_alarms_corrected"), F.count_if(changed & (F.col("actual") == 1)).alias("hits_lost"))


def bundle(df: DataFrame, by: list[str], tie: str, threshold: float = 0.5) -> DataFrame:
    """All metrics of a ledger in one row for each group: confusion rates, F1, MCC, losses, ranking and precision at the positives."""
    out = f1_fpr_mcc(confusion(df, F.lit(threshold), by))
    for part in (losses(df, by), ranking(df, by), precision_at_positives(df, by, tie)):
        out = out.join(part, by) if by else out.crossJoin(F.broadcast(part))  # one row
    return out
