"""Regression tests from distributed sufficient statistics."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def correlation(x: str, y: str) -> Column:
    """Pearson's r of two columns as an aggregate; NaN where either is constant (``corr`` divides by zero there)."""
    x, y = F.when(F.col(y).isNotNull(), F.col(x)), F.when(F.col(x).isNotNull(), F.col(y))
    spread = F.stddev_pop(x) * F.stddev_pop(y)
    return F.when(spread.isNotNull(), F.coalesce(F.try_divide(F.covar_pop(x, y), spread), F.lit(float("nan"))))


def pooled_effects_ftest(df: DataFrame, entity: str, y: str, own: list[str], candidate: str, least: int = 20) -> dict[str, float | None]:
    """F-test of one more regressor in a model with entity effects.

    Variables are demeaned within entities, so dummies never appear; X'X, X'y and y'y
    are one aggregate of k * k numbers, solved on the driver. Returns f, p, r2 (within entities), coef, n;
    all but n are None with fewer than ``least`` complete rows, without a degree of freedom or a rest.
    """
    names = [y, *own, candidate]
    rows = df.dropna(subset=names)
    means = rows.groupBy(entity).agg(*[F.avg(c).alias(f"_m{i}") for i, c in enumerate(names)])
    centred = rows.join(means, entity).select(*[(F.col(c) - F.col(f"_m{i}")).alias(f"v{i}") for i, c in enumerate(names)])
    k = len(names)
    sums = centred.agg(F.count(F.lit(1)).alias("n"), *[F.sum(F.col(f"v{i}") * F.col(f"v{j}")).alias(f"s{i}_{j}") for i in range(k) for j in range(i, k)]).first()
    entities = means.count()
    m = np.zeros((k, k))
    for i in range(k):
        for j in range(i, k):
            m[i, j] = m[j, i] = sums[f"s{i}_{j}"] or 0.0

    def residual(cols: list[int]) -> tuple[float, np.ndarray]:
        beta = np.linalg.lstsq(m[np.ix_(cols, cols)], m[cols, 0], rcond=None)[0]
        return float(m[0, 0] - m[cols, 0] @ beta), beta

    base, _ = residual(list(range(1, k - 1)))
    full, beta = residual(list(range(1, k)))
    free = sums["n"] - entities - (k - 1)
    if sums["n"] < least or free < 1 or not full > 0:
        return {"f": None, "p": None, "r2": None, "coef": None, "n": int(sums["n"])}
    f = float((base - full) / (full / free))
    return {"f": f, "p": f_tail(f, 1, free), "r2": float(1 - full / m[0, 0]), "coef": float(beta[-1]), "n": int(sums["n"])}


def f_tail(f: float, a: int, b: int) -> float:
    """P(F > f) with a and b degrees of freedom: a regularised incomplete beta function by its continued fraction."""
    if not f > 0 or b <= 0:
        return 1.0
    x, p, q = b / (b + a * f), b / 2, a / 2
    front = math.exp(math.lgamma(p + q) - math.lgamma(p) - math.lgamma(q) + p * math.log(x) + q * math.log1p(-x)) if 0 < x < 1 else 0.0

    def fraction(x: float, p: float, q: float) -> float:
        value, c, d = 1.0, 1.0, 0.0
        for i in range(400):
            m = i // 2
            if i == 0:
                step = 1.0
            elif i % 2 == 0:
                step = m * (q - m) * x / ((p + 2 * m - 1) * (p + 2 * m))
            else:
                step = -(p + m) * (p + q + m) * x / ((p + 2 * m) * (p + 2 * m + 1))
            d = 1 / (1 + step * d or 1e-300)
            c = 1 + step / c or 1e-300
            value *= c * d
            if abs(1 - c * d) < 1e-14:
                break
        return value - 1

    if x < (p + 1) / (p + q + 2):
        return front * fraction(x, p, q) / p
    return 1 - front * fraction(1 - x, q, p) / q


def f_tail_column(f: Column, a: int, b: Column) -> Column:
    """P(F > f) for one or two numerator degrees of freedom and a whole number ``b`` of others, as a column.

    Two have a closed form; one is the two-sided tail of Student's t, a finite sum of about b / 2 terms
    in the angle atan(sqrt(f / b)). Exact to about 1e-14 (absolute); null where f is null or b < 1.
    """
    x = b / (b + a * f)
    if a == 2:
        out = F.pow(x, b / 2)
    elif a == 1:
        even = b % 2 == 0
        terms = F.floor((b - 1) / 2).cast("int")  # after the first
        first = F.when(even, F.lit(1.0)).otherwise(F.sqrt(x))
        none = F.struct(first.alias("term"), first.alias("total"))

        def add(s: Column, j: Column) -> Column:
            term = s["term"] * x * F.when(even, (2 * j - 1) / (2 * j)).otherwise(2 * j / (2 * j + 1))
            return F.struct(term.alias("term"), (s["total"] + term).alias("total"))

        steps = F.when(even, b / 2 - 1).otherwise(terms - 1).cast("int")
        total = F.aggregate(F.when(steps >= 1, F.sequence(F.lit(1), steps)).otherwise(F.array().cast("array<int>")), none, add)["total"]
        sine, angle = F.sqrt(1 - x), F.atan(F.sqrt(f / b))
        odd = 1 - 2 / math.pi * (angle + F.when(b == 1, 0.0).otherwise(sine * total))
        out = F.when(even, 1 - sine * total).otherwise(odd)
    else:
        raise ValueError("one or two numerator degrees of freedom")
    return F.when((b >= 1) & f.isNotNull(), F.when(f <= 0, 1.0).otherwise(F.greatest(F.lit(0.0), out)))


def _eliminated(sums: DataFrame, names: list[str], pivots: list[str], keep: list[str]) -> DataFrame:
    """Gaussian elimination of ``pivots`` from symmetric matrices of columns m_{a}_{b} (a before b in ``names``), one row a matrix.

    After it, m_{y}_{y} is the residual sum of squares of y on the pivots. A pivot that
    is a linear combination of those before it changes nothing.
    """
    at = lambda a, b: f"m_{a}_{b}" if names.index(a) <= names.index(b) else f"m_{b}_{a}"
    left = list(names)
    for pivot in pivots:
        left.remove(pivot)
        d = F.col(at(pivot, pivot))
        inverse = F.when(d > 1e-10 * F.col(f"d_{pivot}"), 1 / d).otherwise(0.0)
        sums = sums.withColumn("_inv", inverse).select(
            *keep, *[f"d_{n}" for n in names],
            *[(F.col(at(a, b)) - F.col(at(pivot, a)) * F.col(at(pivot, b)) * F.col("_inv")).alias(at(a, b)) for i, a in enumerate(left) for b in left[i:]])
    return sums


def ssr_granger(df: DataFrame, entity: str, period: str, y: str, x: str, lags: int = 1, least: int = 12) -> DataFrame:
    """Per entity: for 1 to ``lags`` (at most 2) lags of x added to an autoregression of y the F-test with the smallest p.

    One window for the lags, one grouped aggregate of products (of values less the entity's
    mean), then elimination by column expressions: no rows of an entity leave the JVM or meet in
    one buffer. Returns f, p, lag and n of that test (ties: the smaller lag); entities with fewer
    than ``least`` periods, none of whose tests has a degree of freedom, or whose y is fitted without rest have none.
    """
    if not 1 <= lags <= 2:
        raise ValueError("one or two lags")
    whole, order = Window.partitionBy(entity), Window.partitionBy(entity).orderBy(period)
    rows = df.select(entity, period, F.col(y).cast("double").alias("y0"), F.col(x).cast("double").alias("x0")).dropna(subset=[entity, "y0", "x0"])
    rows = rows.withColumns({"y0": F.col("y0") - F.avg("y0").over(whole), "x0": F.col("x0") - F.avg("x0").over(whole)})
    rows = rows.withColumns({f"{v}{k}": F.lag(f"{v}0", k).over(order) for v in "yx" for k in range(1, lags + 1)}).withColumn("one", F.lit(1.0))
    tests = {k: ["one", *[f"y{i}" for i in range(1, k + 1)], *[f"x{i}" for i in range(1, k + 1)], "y0"] for k in range(1, lags + 1)}
    products = []
    for k, names in tests.items():
        there = F.col(f"y{k}").isNotNull()
        products.append(F.count(F.when(there, 1)).alias(f"n{k}"))
        products += [F.sum(F.when(there, F.col(a) * F.col(b))).alias(f"t{k}_{a}_{b}") for i, a in enumerate(names) for b in names[i:]]
    sums = rows.groupBy(entity).agg(F.count(F.lit(1)).alias("_rows"), *products).where(F.col("_rows") >= least)
    found = []
    for k, names in tests.items():
        m = sums.select(entity, F.col(f"n{k}").alias("n"), *[F.col(f"t{k}_{a}_{a}").alias(f"d_{a}") for a in names],
                        *[F.col(f"t{k}_{a}_{b}").alias(f"m_{a}_{b}") for i, a in enumerate(names) for b in names[i:]])
        own, more = names[: k + 1], names[k + 1 : -1]
        base = _eliminated(m, names, own, [entity, "n"]).withColumn("rss0", F.col("m_y0_y0"))
        full = _eliminated(base, [c for c in names if c not in own], more, [entity, "n", "rss0", "d_one"])
        free = (F.col("n") - 2 * k - 1).cast("double")
        f = (F.col("rss0") - F.col("m_y0_y0")) / k / (F.col("m_y0_y0") / F.col("free"))
        usable = (F.col("free") >= 1) & (F.col("m_y0_y0") > 1e-12 * F.col("d_y0"))
        full = full.withColumn("free", free).where(usable).withColumn("f", f)
        found.append(full.select(entity, "f", f_tail_column(F.col("f"), k, F.col("free")).alias("p"), F.lit(k).alias("lag"), "n"))
    best = found[0] if lags == 1 else found[0].unionByName(found[1])
    first = best.groupBy(entity).agg(F.min(F.struct("p", "lag", "f", "n")).alias("t"))
    return first.select(entity, "t.f", "t.p", "t.lag", "t.n")
