"""Truncated SVD of a sparse matrix given as a table of entries, and weighted means of the vectors it gives."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ewpanel.functions.staging import staged


def _columns(width: int) -> list[str]:
    return [f"v{i}" for i in range(width)]


def _times(entries: DataFrame, block: DataFrame, out: str, over: str, width: int) -> DataFrame:
    """The sparse matrix times a block of vectors: one join and one grouped aggregate."""
    names = _columns(width)
    return entries.join(block.withColumnRenamed("key", over), over).groupBy(F.col(out).alias("key")).agg(*[F.sum(F.col("value") * F.col(c)).alias(c) for c in names])


def _numbers(batch: pa.RecordBatch, width: int) -> np.ndarray:
    return np.column_stack([batch.column(c).to_numpy(zero_copy_only=False) for c in _columns(width)])


def _gram(block: DataFrame, width: int) -> np.ndarray:
    """The products of a block's columns: a small matrix from each task, added up by place; width * width rows reach the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((width, width))
        for batch in batches:
            v = _numbers(batch, width)
            total += v.T @ v
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(width * width), pa.int32()), pa.array(total.ravel())], ["at", "x"])

    out = np.zeros(width * width)
    for r in block.select(*_columns(width)).mapInArrow(run, "at int, x double").groupBy("at").agg(F.sum("x").alias("x")).collect():
        out[r["at"]] = r["x"]
    out = out.reshape(width, width)
    return (out + out.T) / 2


def _turned(block: DataFrame, m: np.ndarray) -> DataFrame:
    """The block times a small matrix."""
    before, names = m.shape[0], _columns(m.shape[1])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            v = _numbers(batch, before) @ m
            yield pa.RecordBatch.from_arrays([batch.column("key"), *[pa.array(v[:, i]) for i in range(len(names))]], ["key", *names])

    kind = block.schema["key"].dataType.simpleString()
    return block.select("key", *_columns(before)).mapInArrow(run, f"key {kind}, " + ", ".join(f"{c} double" for c in names))


def _orthonormal(block: DataFrame, width: int) -> tuple[DataFrame, int]:
    """The same span in orthonormal columns (two passes over the Gram matrix); directions that vanish are left out."""
    turn = np.eye(width)
    for _ in range(2):
        values, vectors = np.linalg.eigh(_gram(_turned(block, turn), turn.shape[1]))
        keep = values > max(values.max(), 0) * 1e-13
        turn = turn @ (vectors[:, keep] / np.sqrt(values[keep]))
        if not keep.any():
            return block, 0
    return staged(_turned(block, turn)), turn.shape[1]


def truncated_svd(entries: DataFrame, row: str, column: str, value: str, k: int = 12, oversample: int = 20, tolerance: float = 1e-9, rounds: int = 100) -> tuple[DataFrame, DataFrame, list[float]]:
    """The ``k`` greatest singular triples of the matrix of ``entries``: (key, vector) of rows U and of columns V, and the values S.

    Block subspace iteration: a block of k + ``oversample`` vectors on the columns, filled by a hash of the column's
    name, goes through A and A' in turn; both products are joins with grouped sums, and the driver holds
    Gram matrices of (k + oversample)**2 numbers alone, whatever the matrix' size. Rounds end when the
    residuals of A'A on all k vectors are below ``tolerance`` times its greatest eigenvalue, or after ``rounds`` with an
    error. Entries that repeat a place add up; null keys and values count nowhere. Vectors are signed so that the
    row side's component of largest size is positive (ties: the smallest key). An empty matrix gives no vectors;
    fewer than ``k`` come back where the rank is smaller.
    """
    spark = entries.sparkSession
    a = staged(entries.select(F.col(row).alias("_r"), F.col(column).alias("_c"), F.col(value).cast("double").alias("value")).dropna())
    width = k + oversample
    start = lambda j: F.xxhash64("_c", F.lit(j)) / F.lit(2.0**63)
    block, width = _orthonormal(staged(a.select("_c").distinct().select(F.col("_c").alias("key"), *[start(j).alias(f"v{j}") for j in range(width)])), width)
    if not width:
        none = spark.createDataFrame([], "key string, vector array<double>")
        return none, none, []
    for done in range(rounds):
        left = staged(_times(a, block, "_r", "_c", width))
        values, turn = np.linalg.eigh(_gram(left, width))
        turn, values = turn[:, ::-1], np.maximum(values[::-1], 0)
        block, left = _turned(block, turn), staged(_turned(left, turn))
        back = staged(_times(a, left, "_c", "_r", width))
        names = _columns(min(k, width))
        both = back.join(block.select("key", *[F.col(c).alias(f"b_{c}") for c in names]), "key")
        rest = both.agg(*[F.sum(F.pow(F.col(c) - float(values[i]) * F.col(f"b_{c}"), 2)) for i, c in enumerate(names)]).first()
        if not values[0] or max(np.sqrt([x or 0.0 for x in rest])) <= tolerance * values[0]:
            break
        block, width = _orthonormal(back, width)
    else:
        raise ArithmeticError(f"no convergence in {rounds} rounds")
    kept = int((values[:k] > 1e-13 * max(values[0], 1e-300)).sum())
    s = np.sqrt(values[:kept])
    names = _columns(kept)
    left = left.select("key", *[(F.col(c) / float(s[i])).alias(c) for i, c in enumerate(names)])
    peaks = left.agg(*[F.min(F.struct((-F.abs(c)).alias("size"), "key", F.signum(c).alias("sign"))).alias(c) for c in names]).first() if kept else {}
    sign = [peaks[c]["sign"] if peaks[c] else 1.0 for c in names] if kept else []
    vector = F.array(*[F.col(c) * float(g) for c, g in zip(names, sign)]).cast("array<double>").alias("vector")
    return left.select("key", vector), block.select("key", vector), [float(x) for x in s]


def scaled(vectors: DataFrame, factors: list[float]) -> DataFrame:
    """(key, vector) with each component times its factor."""
    by = F.array(*[F.lit(float(x)) for x in factors])
    return vectors.select("key", F.zip_with("vector", by, lambda x, f: x * f).alias("vector"))


def weighted_means(rows: DataFrame, vectors: DataFrame, by: list[str], key: str, weight: str) -> DataFrame:
    """The weighted mean of the vectors of each group's keys: by, i (from 0), x.

    Rows whose key has no vector are left out (of the weights as well), so are groups without
    any. Weights are summed before the join, so rows that repeat a key in a group cost nothing more.
    """
    summed = rows.groupBy(*by, F.col(key).alias("key")).agg(F.sum(weight).cast("double").alias("_w"))
    each = summed.join(vectors.select("key", F.posexplode("vector").alias("i", "_x")), "key")
    return each.groupBy(*by, "i").agg((F.sum(F.col("_w") * F.col("_x")) / F.sum("_w")).alias("x"))


def weighted_row_means(rows: DataFrame, entries: DataFrame, by: list[str], key: str, weight: str, row: str, column: str, value: str) -> DataFrame:
    """The same for sparse vectors, the rows of a matrix of entries: by, ``column``, x, where x isn't zero.

    Absent entries count as zero; keys without any entry are left out of the weights.
    """
    summed = rows.groupBy(*by, F.col(key).alias(row)).agg(F.sum(weight).cast("double").alias("_w"))
    known = summed.join(entries.select(row).distinct(), row)
    total = known.groupBy(*by).agg(F.sum("_w").alias("_t"))
    sums = known.join(entries, row).groupBy(*by, column).agg(F.sum(F.col("_w") * F.col(value)).alias("_s"))
    return sums.join(total, by).select(*by, column, (F.col("_s") / F.col("_t")).alias("x"))
