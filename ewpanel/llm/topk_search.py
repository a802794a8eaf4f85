"""Exact top-k inner-product search by branch and bound over dimension blocks."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ewpanel.llm.common import stage_table

BLOCK_DIMS = 16
EXACT = float(1 << 53)


def vertical(vectors: np.ndarray) -> np.ndarray:
    """Rows to columns: one contiguous line for each dimension."""
    return np.ascontiguousarray(vectors.T)


class BlockSearch:
    """Keeps the k best of each query of one slab while candidate blocks pass by.

    A block holds its vectors in vertical layout. For each query the dimension
    blocks are taken in the order of the query's mass in them; after each, a
    candidate's score so far plus the product of what remains of both norms bounds
    its final score, and only candidates whose bound reaches the query's k-th best
    so far are compacted into the next block. All scores are exact integers: in
    doubles where no product sum can pass 2**53, else in Python integers.
    """

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, k: int):
        self.ids, self.q, self.k = ids, vectors.astype(np.float64), k
        dims = self.q.shape[1]
        self.edges = [(a, min(a + BLOCK_DIMS, dims)) for a in range(0, dims, BLOCK_DIMS)]
        mass = np.stack([np.sqrt((self.q[:, a:b] ** 2).sum(1)) for a, b in self.edges], 1) if self.edges else np.zeros((len(ids), 0))
        self.order = np.argsort(-mass, axis=1, kind="stable")
        left = np.take_along_axis(mass, self.order, 1)[:, ::-1] ** 2
        self.left = np.sqrt(np.cumsum(left, axis=1))[:, ::-1]  # norm of the blocks from the j-th on
        self.best = [(np.zeros(0), np.zeros(0, np.int64)) for _ in ids]

    def block(self, ids: np.ndarray, columns: np.ndarray) -> None:
        squares = np.stack([(columns[a:b] ** 2).sum(0) for a, b in self.edges]) if self.edges else np.zeros((0, len(ids)))
        total = squares.sum(0)
        for i, query in enumerate(self.ids):
            scores, names = self.best[i]
            least = scores[-1] if len(scores) == self.k else -np.inf
            alive, partial = np.flatnonzero(ids != query), None
            rest = total[alive]
            for j, d in enumerate(self.order[i].tolist()):
                a, b = self.edges[d]
                if partial is None:
                    partial = (self.q[i, a:b] @ columns[a:b])[alive]
                else:
                    partial = partial + self.q[i, a:b] @ columns[a:b, alive]
                if j + 1 < len(self.edges) and least > -np.inf:
                    rest = rest - squares[d, alive]
                    keep = partial + self.left[i, j + 1] * np.sqrt(np.maximum(rest, 0)) * (1 + 1e-9) + 1e-3 >= least
                    alive, partial, rest = alive[keep], partial[keep], rest[keep]
                if not len(alive):
                    break
            if partial is None:
                partial = np.zeros(len(alive))
            if len(alive):
                if len(alive) > self.k and least == -np.inf:
                    edge = np.partition(partial, len(partial) - self.k)[len(partial) - self.k]
                    alive, partial = alive[partial >= edge], partial[partial >= edge]
                scores, names = np.concatenate([scores, partial]), np.concatenate([names, ids[alive]])
                top = np.lexsort((names, -scores))[: self.k]
                self.best[i] = (scores[top], names[top])


def _saturated(x: int) -> int:
    return max(-(1 << 63), min((1 << 63) - 1, x))


def _wide_best(q: np.ndarray, q_ids: np.ndarray, v: np.ndarray, ids: np.ndarray, k: int) -> list[list[tuple[int, int]]]:
    """The same for vectors whose products pass 2**53: Python integers, no bounds."""
    out = []
    for vec, name in zip(q.tolist(), q_ids.tolist()):
        own = [(-_saturated(sum(int(a) * int(b) for a, b in zip(vec, row))), i) for row, i in zip(v.tolist(), ids.tolist()) if i != name]
        out.append(sorted(own)[:k])
    return out


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 10, scale: int = 1024, id_col: str = "vec_id", vector_col: str = "embedding",
          slab: int = 16384) -> DataFrame:
    """The k highest integer inner products of each query with all vectors: query_id, rank, id_col, score.

    Components become floor(scale * x). Ties go to the smaller id. A query's own id
    is no candidate; with fewer candidates all are returned. Vectors that are null or
    hold null or non-finite components, or have a null id, take no part; a vector of
    fewer dimensions counts as padded with zeros. Rows that repeat an id are each
    candidates; of queries that repeat an id the smallest vector asks. Scores beyond
    a long saturate. Empty tables give an empty result.

    Candidates are packed where they are read into blocks in vertical layout, and
    queries into slabs of about ``slab``. Every slab meets every block: both are
    dealt over a grid of (slab, column) cells, blocks are sorted behind their slab and
    stream through one search at a time, which holds k results for each query of one
    slab. Cells' results are merged by a ranked window over k rows a cell.
    """
    spark = vectors.sparkSession
    double = F.transform(F.col(vector_col), lambda x: F.floor(x.cast("double") * scale).cast("double"))
    fine = lambda df: df.where(F.col(id_col).isNotNull() & F.col(vector_col).isNotNull()).where(
        F.forall(vector_col, lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < float("inf")))).select(F.col(id_col).cast("long").alias("id"), double.alias("v"))
    asked = fine(queries).groupBy("id").agg(F.min("v").alias("v"))
    asked = stage_table(asked, "queries")
    slabs = max(1, -(-asked.count() // slab))
    columns = int(spark.conf.get("spark.sql.shuffle.partitions"))
    asked = asked.select(F.pmod(F.xxhash64("id"), F.lit(slabs)).alias("slab"), "id", "v")
    asked = asked.groupBy("slab").agg(F.collect_list(F.struct("id", "v")).alias("asked"))  # at most about `slab` of them

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, n = TaskContext.get().partitionId(), 0
        for batch in batches:
            for a in range(0, batch.num_rows, 2048):
                piece = batch.slice(a, 2048)
                v = _dense(piece.column("v"))
                yield pa.RecordBatch.from_pydict({"cell": [(part * 7919 + n) % columns], "dims": [v.shape[1]], "ids": [piece.column("id").to_numpy().tobytes()], "columns": [vertical(v).tobytes()]},
                                                 schema=pa.schema([("cell", pa.int64()), ("dims", pa.int64()), ("ids", pa.binary()), ("columns", pa.binary())]))
                n += 1

    blocks = fine(vectors).mapInArrow(pack, "cell long, dims long, ids binary, columns binary")
    grid = lambda df, what, n: df.withColumn(what, F.explode(F.sequence(F.lit(0), F.lit(n - 1)).cast("array<long>")))
    empty = F.lit(None)
    both = (grid(asked, "cell", columns).select("slab", "cell", "asked", empty.cast("long").alias("dims"), empty.cast("binary").alias("ids"), empty.cast("binary").alias("columns"))
            .union(grid(blocks, "slab", slabs).select("slab", "cell", F.lit(None).cast("array<struct<id:bigint,v:array<double>>>").alias("asked"), "dims", "ids", "columns")))

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, wide, who = None, None, None

        def results() -> pa.RecordBatch:
            rows = []
            for i, q in enumerate(held.ids.tolist()):
                found = [(int(-s), int(n)) for s, n in zip(*held.best[i])] + (wide[i] if wide else [])
                rows += [(q, n, _saturated(-s)) for s, n in sorted(found)[:k]]
            return pa.RecordBatch.from_arrays([pa.array([r[c] for r in rows], pa.int64()) for c in range(3)], ["query_id", "id", "score"])

        for batch in batches:
            for r in range(batch.num_rows):
                row = batch.slice(r, 1)
                asked_row = row.column("asked")
                key = (row.column("slab")[0].as_py(), row.column("cell")[0].as_py())
                if asked_row[0].is_valid:
                    if held is not None:
                        yield results()
                    items = asked_row.flatten()
                    q = _dense(items.field("v"))
                    held, wide, who = BlockSearch(items.field("id").to_numpy(), q, k), None, key
                    norm = float(np.sqrt((q ** 2).sum(1)).max()) if q.size else 0.0
                elif held is not None and key == who:
                    dims = row.column("dims")[0].as_py()
                    ids = np.frombuffer(row.column("ids")[0].as_py(), np.int64)
                    cols = np.frombuffer(row.column("columns")[0].as_py(), np.float64).reshape(dims, len(ids))
                    have = held.q.shape[1]
                    if dims < have:
                        cols = np.vstack([cols, np.zeros((have - dims, len(ids)))])
                    cols = cols[:have]
                    if norm * (float(np.sqrt((cols ** 2).sum(0)).max()) if cols.size else 0.0) < EXACT / 2:
                        held.block(ids, cols)
                    else:
                        new = _wide_best(held.q, held.ids, cols.T, ids, k)
                        wide = [sorted(a + b)[:k] for a, b in zip(wide or [[]] * len(new), new)]
        if held is not None:
            yield results()

    from pyspark.sql.window import Window

    found = (both.repartition("slab", "cell").sortWithinPartitions("slab", "cell", F.col("asked").isNull())
             .mapInArrow(search, "query_id long, id long, score long"))
    ranked = found.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "id")))
    return ranked.where(F.col("rank") <= k).select("query_id", "rank", F.col("id").alias(id_col), "score")


def _dense(lists: pa.Array) -> np.ndarray:
    """A matrix of the lists, shorter ones padded with zeros."""
    sizes = np.diff(lists.offsets.to_numpy())
    flat = lists.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    width = int(sizes.max()) if len(sizes) else 0
    if (sizes == width).all():
        return flat.reshape(len(sizes), width)
    out = np.zeros((len(sizes), width))
    out[np.arange(width)[None, :] < sizes[:, None]] = flat
    return out
