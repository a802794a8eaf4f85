"""Whitening of vectors by Chebyshev-filtered subspace iteration over distributed covariance products."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ewpanel.llm.common import Stages
from ewpanel.llm.topk_search import _dense

LONG = 1 << 63
SMALLEST = 1e-12  # of the greatest eigenvalue: components below are not whitened


def _pack(width: int, most_bytes: int = 4 << 20):
    """Rows to blocks of integers in one matrix; missing components are those of zero."""
    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = max(1, most_bytes // (8 * width))
        for batch in batches:
            for a in range(0, batch.num_rows, rows):
                piece = batch.slice(a, rows)
                lists = piece.column("x")
                x = np.zeros((len(lists), width), np.int64)
                sizes = np.diff(lists.offsets.to_numpy())
                x[np.arange(width)[None, :] < sizes[:, None]] = lists.flatten().to_numpy()
                yield pa.RecordBatch.from_arrays([pa.array([piece.column("id").to_pylist()], pa.list_(pa.int64())), pa.array([x.tobytes()])], ["ids", "x"])

    return pack


def _sums(width: int, shift: int):
    """Exact sums of each dimension over a partition."""
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, total = 0, [0] * width
        for x in _matrices(batches, width):
            x = x + shift
            n += len(x)
            part = x.sum(0).tolist() if float(np.abs(x).max(initial=0)) * len(x) < LONG else [sum(c) for c in x.T.tolist()]
            total = [a + b for a, b in zip(total, part)]
        if n:
            yield pa.RecordBatch.from_arrays([pa.array(range(width), pa.int32()), pa.array([n] * width, pa.int64()), pa.array(total, pa.decimal128(38, 0))], ["dim", "n", "s"])

    return task


def _matrices(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[np.ndarray]:
    for batch in batches:
        for x in batch.column("x"):
            yield np.frombuffer(x.as_buffer(), np.int64).reshape(-1, width)


class Centre:
    """Centres rows of integers at their exact mean, sums / n.

    A dimension's mean is a whole part and a rest below one, so that integers are subtracted exactly first.
    """

    def __init__(self, n: int, sums: list[int]):
        self.n, self.sums = n, sums
        self.whole = np.array([s // n for s in sums], np.int64)
        self.rest = np.array([float(Fraction(s % n, n)) for s in sums])

    def __call__(self, x: np.ndarray) -> np.ndarray:
        return (x - self.whole).astype(np.float64) - self.rest


class Blocks:
    """Staged integer blocks and sums over their centred rows. The shift, which changes no centred value, is left out."""

    def __init__(self, table: DataFrame, width: int, centred: Centre):
        self.table, self.width, self.centred = table, width, centred

    def total(self, of: Callable[[np.ndarray], np.ndarray], size: int) -> np.ndarray:
        """The sum of ``of(centred block)``, a vector of ``size`` numbers, over all blocks.

        Added up in each partition, then by Spark position by position; the driver gets ``size`` numbers.
        """
        width, centred = self.width, self.centred

        def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            sum_, any_ = np.zeros(size), False
            for x in _matrices(batches, width):
                sum_ += of(centred(x))
                any_ = True
            if any_:
                yield pa.RecordBatch.from_arrays([pa.array(range(size), pa.int32()), pa.array(sum_)], ["at", "value"])

        rows = self.table.select("x").mapInArrow(task, "at int, value double").groupBy("at").agg(F.sum("value").alias("value")).toArrow()
        out = np.zeros(size)
        out[rows.column("at").to_numpy()] = rows.column("value").to_numpy()
        return out

    def product(self, q: np.ndarray) -> np.ndarray:
        """The covariance times ``q``, as X'(Xq)/n over the centred rows; no covariance matrix is formed."""
        return self.total(lambda x: (x.T @ (x @ q)).ravel(), q.size).reshape(q.shape) / self.centred.n


def leading_eigenpairs(product: Callable[[np.ndarray], np.ndarray], width: int, wanted: int, extra: int = 16, degree: int = 8,
                       tolerance: float = 2e-14, rounds: int = 60, seed: int = 1) -> tuple[np.ndarray, np.ndarray, float]:
    """The greatest eigenvalues, their unit vectors (columns) and the greatest residual, relative to the greatest value.

    ``product`` multiplies a symmetric non-negative matrix of order ``width`` by a block of vectors. Each round
    applies a Chebyshev polynomial of ``degree``, which stays within -1 and 1 from zero to the least Ritz value of
    the block and grows fast beyond, so that the unwanted spectrum is damped; then QR and Rayleigh-Ritz. The block
    has ``extra`` vectors more than are wanted; where it spans the whole space one round is exact. Ends when all wanted
    residuals are within ``tolerance``, or no longer fall once they are within a thousand times that; else raises.
    """
    size = min(width, wanted + extra)
    wanted = min(wanted, width)
    q = np.linalg.qr(np.random.default_rng(seed).standard_normal((width, size)))[0] if size < width else np.eye(width)
    before = np.inf
    for _ in range(rounds):
        aq = product(q)
        values, turn = np.linalg.eigh((q.T @ aq + aq.T @ q) / 2)
        values, turn = values[::-1], turn[:, ::-1]
        q, aq = q @ turn, aq @ turn
        top = max(values[0], 0.0)
        error = float(np.sqrt(((aq - q * values) ** 2).sum(0))[:wanted].max()) / top if top > 0 else 0.0
        if error <= tolerance or error > before / 2 and error <= 1000 * tolerance:
            return values[:wanted], q[:, :wanted], error
        before = error
        # on the scale where [0, cut] becomes [-1, 1]; divided as it grows by its value at the greatest Ritz value
        half = max(values[-1], top * 1e-10) / 2
        sigma = first = half / (top - half) if top > half else 1.0
        last, now = q, (aq - half * q) * (first / half)
        for _ in range(degree - 1):
            following = 1 / (2 / first - sigma)
            last, now = now, (product(now) - half * now) * (2 * following / half) - last * (sigma * following)
            sigma = following
        q = np.linalg.qr(now)[0]
    raise ArithmeticError(f"no convergence in {rounds} rounds: relative residual {error:.3g}")


def whiten(vectors: DataFrame, components: int = 8, scale: int = 1024, shift: int = 100_000, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """The leading whitened components of every vector: id_col, component, n, deviation, whitened, explained, identity_error.

    A component c of a vector counts as floor(scale * c) + shift. All n vectors are the fit list (divisor n). Component j is
    the centred vector's product with the j-th unit eigenvector of the covariance (greatest eigenvalue first, its
    largest entry positive), over the root of the eigenvalue; ``explained`` is the eigenvalue's share of the
    trace; ``deviation`` the exact sum of (n*x - S)**2, saturating at a long; ``identity_error`` the largest
    departure of the whitened values' covariance, measured over all rows, from the identity.

    Rows whose vector is null, or holds null or non-finite components, take no part; a null id does, and
    repeated rows count as often as they stand. A shorter vector counts as padded with zero components; floors
    saturate at +-2**53. Components with eigenvalues not above 1e-12 of the greatest (fewer dimensions or rows than
    components, constant columns) can't be whitened and give no rows; so equal vectors alone, or an empty table,
    give an empty result. With equal eigenvalues any orthonormal basis of their space may come out. Only
    the two columns named are read.

    Rows are staged as blocks of one matrix each; every product with the covariance is a Spark job that sums
    X'(XQ) over them. The driver holds (dimensions x block) numbers, the size of the model, and nothing of any row.
    """
    spark = vectors.sparkSession
    stages, kept = Stages(spark), ()
    schema = f"{id_col} long, component int, n long, deviation long, whitened double, explained double, identity_error double"
    fine = vectors.where(F.col(vector_col).isNotNull()).where(
        F.forall(vector_col, lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < float("inf"))))
    bound = float(1 << 53)
    rows = fine.select(F.col(id_col).cast("long").alias("id"), F.transform(
        vector_col, lambda x: F.floor(F.least(F.greatest(F.floor(x.cast("double") * scale).cast("double"), F.lit(-bound)), F.lit(bound))).cast("long")).alias("x"))
    try:
        width = rows.agg(F.max(F.size("x"))).first()[0] or 0
        if not width:
            return spark.createDataFrame([], schema)
        table = stages.table(rows.mapInArrow(_pack(width), "ids array<long>, x binary"), "vectors", 64 << 20)
        sums = {r["dim"]: r for r in table.select("x").mapInArrow(_sums(width, shift), "dim int, n long, s decimal(38,0)").groupBy("dim").agg(F.sum("n").alias("n"), F.sum("s").cast("decimal(38,0)").alias("s")).collect()}
        n = sums[0]["n"]
        shifted = [int(sums[i]["s"]) for i in range(width)]
        centre = Centre(n, [s - n * shift for s in shifted])
        blocks = Blocks(table, width, centre)
        trace = float(blocks.total(lambda x: (x ** 2).sum(0), width).sum()) / n
        if trace <= 0:
            return spark.createDataFrame([], schema)
        values, axes, _ = leading_eigenpairs(blocks.product, width, components)
        good = values > SMALLEST * values[0]
        values, axes = values[good], axes[:, good]
        axes = axes * np.sign(axes[np.abs(axes).argmax(0), np.arange(len(values))])
        map_, k = axes / np.sqrt(values), len(values)
        moments = blocks.total(lambda x: np.concatenate([(w := x @ map_).sum(0), (w.T @ w).ravel()]), k + k * k) / n
        covariance = moments[k:].reshape(k, k) - np.outer(moments[:k], moments[:k])
        identity_error, explained = float(np.abs(covariance - np.eye(k)).max()), values / trace

        def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for ids, raw in zip(batch.column("ids"), batch.column("x")):
                    x = np.frombuffer(raw.as_buffer(), np.int64).reshape(-1, width)
                    centred, m = centre(x), len(x)
                    deviation = np.repeat(_deviation(x, n, centre.sums, centred), k)
                    yield pa.RecordBatch.from_arrays([
                        ids.values.take(pa.array(np.repeat(np.arange(m), k))), pa.array(np.tile(np.arange(1, k + 1), m), pa.int32()), pa.array(np.full(m * k, n, np.int64)), pa.array(deviation),
                        pa.array((centred @ map_).ravel()), pa.array(np.tile(explained, m)), pa.array(np.full(m * k, identity_error))],
                        [id_col, "component", "n", "deviation", "whitened", "explained", "identity_error"])

        kept = ("vectors",)
        return table.mapInArrow(task, schema)
    finally:
        stages.close(*kept)


def _deviation(x: np.ndarray, n: int, sums: list[int], centred: np.ndarray) -> np.ndarray:
    """Sum of (n*x - S)**2 of each row, exact, at most the greatest long.

    Arithmetic modulo 2**64 is exact for what fits a long; an estimate tells which rows fit, and
    those too near the limit are summed in Python integers.
    """
    about = ((centred * n) ** 2).sum(1)
    wrap = np.array([s & 0xFFFFFFFFFFFFFFFF for s in sums], np.uint64)
    part = x.view(np.uint64) * np.uint64(n) - wrap
    out = (part * part).sum(1, dtype=np.uint64).view(np.int64).copy()
    out[about >= LONG] = LONG - 1
    for i in np.flatnonzero(np.abs(about - LONG) < LONG * 1e-6):
        out[i] = min(LONG - 1, sum((n * int(v) - s) ** 2 for v, s in zip(x[i].tolist(), sums)))
    return out
