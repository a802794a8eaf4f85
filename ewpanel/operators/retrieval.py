"""Retrieval of similar historical situations."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ewpanel.functions.staging import staged


def standardise(df: DataFrame, columns: list[str], by: list[str], train: DataFrame | None = None) -> DataFrame:
    """Each feature by the mean and population deviation (+1e-9) of its group in ``train`` (``df`` itself if none), from one grouped aggregate."""
    stats = (df if train is None else train).groupBy(*by).agg(*[f(c).alias(f"_{n}_{c}") for c in columns for n, f in (("m", F.avg), ("s", F.stddev_pop))])
    out = df.join(stats, by)
    return out.withColumns({c: (F.col(c) - F.col(f"_m_{c}")) / (F.col(f"_s_{c}") + 1e-9) for c in columns}).drop(*stats.columns[len(by):])


def cosine(pairs: list[tuple[Column, Column]]) -> Column:
    dot, a, b = F.lit(0.0), F.lit(0.0), F.lit(0.0)
    for x, y in pairs:
        dot, a, b = dot + x * y, a + x * x, b + y * y
    return dot / (F.sqrt(a) * F.sqrt(b) + 1e-9)


def analogs(train: DataFrame, test: DataFrame, by: list[str], columns: list[str], train_id: str, test_id: str, label: str, k: int = 5, weights: dict[str, float] | None = None, recency: str | None = None, blend: float = 0.0) -> DataFrame:
    """The k most similar training rows (cosine of standardised features) of each test row within its group.

    An equi-join on the group; ranks keep k rows of each test row before they move
    (window group limit). Ties go to the smaller training id. ``weights`` scale
    features; with ``recency`` (a column of the training rows, 0 to 1) the similarity
    is blended with it by ``blend``.
    """
    scale = lambda c: F.col(c) * (weights or {}).get(c, 1.0)
    a = test.select(*by, F.col(test_id).alias("_q"), *[scale(c).alias(f"q_{c}") for c in columns])
    b = train.select(*by, F.col(train_id).alias("_t"), F.col(label).alias("_y"), (F.col(recency) if recency else F.lit(0.0)).alias("_r"), *[scale(c).alias(f"t_{c}") for c in columns])
    pairs = a.join(b, by).withColumn("similarity", F.round(recency_blend(cosine([(F.col(f"q_{c}"), F.col(f"t_{c}")) for c in columns]), F.col("_r"), blend), 9))
    w = Window.partitionBy("_q").orderBy(F.desc("similarity"), "_t")
    return pairs.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select(F.col("_q").alias(test_id), F.col("_t").alias(f"analog_{train_id}"), "rank", "similarity", F.col("_y").alias("analog_label"))


def analog_score(rate: Column, d_share: Column, d_goldstein: Column, d_actors: Column) -> Column:
    """clip(rate / 2 + (1/2 + change / 2) / 2) with the change of share, tone and actors, each through tanh."""
    # fixed values: the weights and scales of the three changes
    change = 0.5 * F.tanh(3 * d_share) + 0.3 * F.tanh(-d_goldstein / 3) + 0.2 * F.tanh(d_actors / 5)
    return F.least(F.lit(1.0), F.greatest(F.lit(0.0), 0.5 * rate + 0.5 * (0.5 + 0.5 * change)))


def recency_blend(similarity: Column, recency: Column, weight: float) -> Column:
    return (1 - weight) * similarity + weight * recency


def _compare(queries: pd.DataFrame, members: pd.DataFrame, k: int, at_once: int = 256) -> pd.DataFrame:
    """For each query point the k best (id, squared distance) among the members' ids, ties to the smaller id.

    A matrix product finds the members that may be among the k best (its error is far below the slack), exact distances
    decide. A column ``bound`` of the queries leaves out what is farther.
    """
    out = []
    if len(queries) and len(members):
        y, first = np.stack(members["v"]), members["p"].to_numpy()
        ids, yy = members["ids"].tolist(), (y**2).sum(1)
        points, bounds = queries["p"].tolist(), queries["bound"].tolist() if "bound" in queries else [float("inf")] * len(queries)
        for start in range(0, len(queries), at_once):
            q = np.stack(queries["v"].iloc[start : start + at_once])
            qq = (q**2).sum(1)
            rough = qq[:, None] + yy[None, :] - 2 * (q @ y.T)
            most = np.minimum(np.partition(rough, k - 1, 1)[:, k - 1] if len(yy) > k else np.inf, bounds[start : start + at_once]) + 4e-9 + 1e-10 * (qq + yy.max())
            for i, v in enumerate(q):
                bound, near = bounds[start + i], np.flatnonzero(rough[i] <= most[i])
                d = np.round(((y[near] - v) ** 2).sum(1), 9)
                order = np.lexsort((first[near], d))[:k]  # a point after k others gives none of the k best
                best = sorted((d[j], w) for j in order if d[j] <= bound for w in ids[near[j]])[:k]
                out += [(points[start + i], w, x) for x, w in best]
    return pd.DataFrame(out, columns=["p", "w", "distance"]).astype({"p": "int64", "w": "int64", "distance": "float64"})


class PivotCells:
    """Points (p, v, ids) in the cells of their nearest pivots, and what is known of each cell.

    ``pivots`` is a matrix of bounded size; ``radius`` holds the least and greatest distance of a cell's points from its
    pivot, ``count`` their number and ``subs`` the number of blocks they are dealt to.
    """

    def __init__(self, points: DataFrame, pivots: int | None, block: int, seed: int, most_bytes: int = 16 << 20):
        n, width = points.agg(F.count(F.lit(1)), F.max(F.size("v"))).first()
        wanted = max(1, min(pivots or min(1024, int(n ** 0.5)), most_bytes // (8 * max(1, width or 1))))
        chosen = points.select("p", "v").orderBy(F.xxhash64("p", F.lit(seed)), "p").limit(wanted).collect()
        self.pivots = np.array([r["v"] for r in chosen], float).reshape(len(chosen), -1)
        matrix, kinds = self.pivots, ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in points.schema.fields)

        def assign(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for pdf in batches:
                d = distances(pdf["v"], matrix)
                cell = d.argmin(1)
                yield pdf.assign(cell=cell.astype("int32"), away=d[np.arange(len(d)), cell])

        self.points = staged(points.mapInPandas(assign, f"{kinds}, cell int, away double"))
        self.count, self.radius = np.zeros(len(chosen), np.int64), np.zeros((len(chosen), 2))
        for r in self.points.groupBy("cell").agg(F.count(F.lit(1)).alias("n"), F.min("away").alias("lo"), F.max("away").alias("hi")).collect():  # a row for each pivot
            self.count[r["cell"]], self.radius[r["cell"]] = r["n"], (r["lo"], r["hi"])
        self.subs = np.maximum(1, -(-self.count // block))

    def of_cell(self, numbers: np.ndarray):
        """A number for each cell as a column over ``cell``."""
        return F.element_at(F.array(*[F.lit(int(x)) for x in numbers] or [F.lit(1)]), F.col("cell") + 1)

    def dealt(self) -> DataFrame:
        return self.points.withColumn("sub", F.pmod(F.xxhash64("p"), self.of_cell(self.subs)).cast("int"))


def distances(vectors, pivots: np.ndarray) -> np.ndarray:
    v = np.stack(vectors) if len(vectors) else np.zeros((0, pivots.shape[1]))
    return np.sqrt(np.maximum(((v[:, None, :] - pivots[None, :, :]) ** 2).sum(2) if v.size * len(pivots) < 1 << 22 else np.stack([((v - p) ** 2).sum(1) for p in pivots], 1), 0))


def open_cells(d: np.ndarray, own: np.ndarray, bound: np.ndarray, pivots: np.ndarray, radius: np.ndarray, count: np.ndarray) -> np.ndarray:
    """Points by cells but their own: may the cell hold a point within ``bound`` (a squared distance, rounded at 9 digits)?

    ``d`` are the points' distances from all pivots. A cell's points are no nearer than the cell's ring allows, and lie
    on its pivot's side of the plane between it and the pivot of the point's own cell.
    """
    between = np.stack([np.sqrt(((pivots - p) ** 2).sum(1)) for p in pivots])
    here = d[np.arange(len(d)), own]
    plane = (d ** 2 - here[:, None] ** 2) / np.maximum(2 * between[own], 1e-300)
    least = np.maximum(np.maximum(d - radius[None, :, 1], radius[None, :, 0] - d), np.where(between[own] > 0, plane, 0.0))
    least = np.maximum(least - 1e-9 * (1 + d), 0)
    out = (least ** 2 <= bound[:, None] * (1 + 1e-9) + 1e-8) & (count > 0)[None, :]
    out[np.arange(len(d)), own] = False
    return out


def _best(found: DataFrame, k: int) -> DataFrame:
    w = Window.partitionBy("p").orderBy("distance", "w")
    return found.withColumn("_k", F.row_number().over(w)).where(F.col("_k") <= k)


def nearest(df: DataFrame, id_col: str, vector: str, k: int, block: int = 2048, pivots: int | None = None, seed: int = 7) -> DataFrame:
    """The k nearest other rows (Euclidean, ties to the smaller id) of every row: u, w, distance (squared, 9 digits).

    Exact, by pivots. Equal vectors are one point with its k + 1 smallest ids, so that a hot vector is compared once. Each
    point lies in the cell of its nearest pivot. It first meets its own cell, which bounds its last distance; a second
    round sends it to those cells alone that the triangle inequality leaves within that bound (``open_cells``). Cells meet in
    blocks of about ``block`` points, two blocks a task, so no task holds a cell. Without clusters (many dimensions, no
    structure) the bounds leave most cells: then, as soon as it sends fewer copies of points, all pairs of blocks are compared, four
    times as large, and the work grows with the square of the points, the memory of a task does not.

    Every task gets the ``pivots`` (the root of the number of points by default, at most 1,024 and 16 MB) and three numbers
    of each cell. Rows with a null id or vector take no part; vectors have one length and ids are distinct.
    """
    rows = df.select(F.col(id_col).cast("long").alias("u"), F.col(vector).cast("array<double>").alias("v")).where("u is not null and v is not null")
    points = staged(_points_of(rows, k + 1))
    if points.isEmpty():
        return df.sparkSession.createDataFrame([], "u long, w long, distance double")
    cells = PivotCells(points, pivots, block, seed)
    near = staged(_best(_in_own_cell(cells, k + 1), k + 1).drop("_k"))
    sizes = _visits_of_cells(cells, near, k + 1)
    n, wide = int(cells.count.sum()), 4 * block
    if int((sizes * cells.subs).sum()) > n * -(-n // wide):
        every = PivotCells(points, 1, wide, seed)
        found = _best(_in_own_cell(every, k + 1), k + 1)
    else:
        found = _best(near.union(_in_open_cells(cells, near, sizes, k + 1, block)), k + 1)
    lists = rows.join(points.select("p", "v"), "v").select("u", "p").join(found.select("p", "w", "distance"), "p").where("u <> w")
    rank = F.row_number().over(Window.partitionBy("u").orderBy("distance", "w"))
    return lists.withColumn("_k", rank).where(F.col("_k") <= k).select("u", "w", "distance")


def _points_of(rows: DataFrame, k: int) -> DataFrame:
    """Distinct vectors with their k smallest ids, of which p is the first; ranks are cut before they move."""
    first = rows.withColumn("_k", F.row_number().over(Window.partitionBy("v").orderBy("u"))).where(F.col("_k") <= k)
    return first.groupBy("v").agg(F.min("u").alias("p"), F.array_sort(F.collect_list("u")).alias("ids")).select("p", "v", "ids")


def _in_own_cell(cells: PivotCells, k: int) -> DataFrame:
    """Candidates (p, w, distance) of each point from its own cell, two blocks of the cell a task."""
    pairs = cells.dealt().withColumn("other", F.explode(F.sequence(F.lit(0), cells.of_cell(cells.subs) - 1)))
    pairs = pairs.select("cell", F.least("sub", "other").alias("i"), F.greatest("sub", "other").alias("j"), "sub", "p", "v", "ids")

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        a, b = pdf[pdf["sub"] == pdf["i"].iloc[0]], pdf[pdf["sub"] == pdf["j"].iloc[0]]
        return _compare(a, b, k) if len(a) == len(b) == len(pdf) else pd.concat([_compare(a, b, k), _compare(b, a, k)])

    return pairs.groupBy("cell", "i", "j").applyInPandas(run, "p long, w long, distance double")


SENT = 4096  # visits of one batch


def _open(pdf: pd.DataFrame, pivots: np.ndarray, radius: np.ndarray, count: np.ndarray) -> Iterator[tuple[pd.DataFrame, np.ndarray]]:
    """Rows of ``pdf`` a few at a time, so that with all pivots they stay small, with the cells open to each."""
    step = max(1, (1 << 18) // max(1, len(count)))
    for start in range(0, len(pdf), step):
        part = pdf.iloc[start : start + step]
        yield part, open_cells(distances(part["v"], pivots), part["cell"].to_numpy(), part["bound"].to_numpy(), pivots, radius, count)


def _bounded(cells: PivotCells, near: DataFrame, k: int) -> DataFrame:
    last = near.groupBy("p").agg(F.when(F.count(F.lit(1)) >= k, F.max("distance")).otherwise(float("inf")).alias("bound"))
    return cells.points.join(last, "p").select("p", "v", "cell", "bound")


def visits(cells: PivotCells, near: DataFrame, k: int) -> DataFrame:
    """(cell, p, v, bound) of each point with each further cell that it must meet, given its candidates so far."""
    known = cells.pivots, cells.radius, cells.count

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for part, left in _open(pdf, *known):
                at, cell = np.nonzero(left)
                for i in range(0, len(at), SENT):  # a point's vector goes to every cell: a batch of all would be as large
                    own = at[i : i + SENT]
                    yield pd.DataFrame({"cell": cell[i : i + SENT].astype("int32"), **{c: part[c].to_numpy()[own] for c in ("p", "v", "bound")}})

    return _bounded(cells, near, k).mapInPandas(run, "cell int, p long, v array<double>, bound double")


def _visits_of_cells(cells: PivotCells, near: DataFrame, k: int) -> np.ndarray:
    """How many points each cell will be met by; no vector is sent for that."""
    known = cells.pivots, cells.radius, cells.count

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            n = sum((left.sum(0) for _, left in _open(pdf, *known)), np.zeros(len(known[2]), np.int64))
            yield pd.DataFrame({"cell": np.flatnonzero(n).astype("int32"), "n": n[n > 0].astype("int64")})

    sizes = np.zeros(len(cells.count), np.int64)
    counted = _bounded(cells, near, k).mapInPandas(run, "cell int, n long").groupBy("cell").agg(F.sum("n").alias("n"))
    for r in counted.collect():  # a row for each pivot
        sizes[r["cell"]] = r["n"]
    return sizes


def _in_open_cells(cells: PivotCells, near: DataFrame, sizes: np.ndarray, k: int, block: int) -> DataFrame:
    chunks = np.maximum(1, -(-sizes // block))
    asks = visits(cells, near, k).withColumns({"chunk": F.pmod(F.xxhash64("p"), cells.of_cell(chunks)).cast("int"), "sub": F.explode(F.sequence(F.lit(0), cells.of_cell(cells.subs) - 1))})
    members = cells.dealt().where(cells.of_cell(sizes) > 0).withColumn("chunk", F.explode(F.sequence(F.lit(0), cells.of_cell(chunks) - 1)))
    key = ["cell", "sub", "chunk"]
    return asks.groupBy(*key).cogroup(members.select(*key, "p", "v", "ids").groupBy(*key)).applyInPandas(lambda a, b: _compare(a, b, k), "p long, w long, distance double")
