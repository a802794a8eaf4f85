"""Hard negatives of anchors from Hilbert-ordered blocks with zone maps."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ewpanel.llm.common import Stages, mix64
from ewpanel.llm.packing import BITS, DIMENSIONS, hilbert_key
from ewpanel.llm.topk_search import EXACT, _dense, _saturated, vertical

CHUNK = 256  # zone maps that are tested at once
_LONG = float(1 << 63)
CELL_BLOCKS = 16  # blocks that one search takes, about

_BLOCK = "block long, n int, dims int, ids binary, labels binary, columns binary, lo binary, hi binary, bits long, single long, asks binary"
_SLAB = "slab long, dims int, ids binary, labels binary, vectors binary, homes binary"


def curve_key(vectors: np.ndarray) -> np.ndarray:
    """Hilbert position of each row: four signed sums of its direction's components."""
    dims = vectors.shape[1]
    words = mix64(np.arange(1, dims + 1, dtype=np.uint64))
    signs = np.stack([((words >> np.uint64(d)) & np.uint64(1)).astype(np.float64) * 2 - 1 for d in range(DIMENSIONS)], 1)
    norm = np.maximum(np.sqrt((vectors ** 2).sum(1)), 1e-300)
    place = (vectors / norm[:, None]) @ signs / 4  # a direction of no preference has deviation 1/4
    return hilbert_key(np.clip((place + 1) * (1 << (BITS - 1)), 0, (1 << BITS) - 1).astype(np.int64))


def label_bit(labels: np.ndarray) -> np.ndarray:
    return np.uint64(1) << (mix64(labels.astype(np.int64).view(np.uint64)) & np.uint64(63))


class Slots:
    """The best k (score, id) of each slot while blocks pass by.

    A slot belongs to one anchor of a slab: it wants rows of the anchor's label
    (``same``) or of others, with least <= score <= most. Scores are exact integers: doubles
    where no product sum can pass 2**53, else Python integers that saturate at a long.
    """

    def __init__(self, ids, labels, vectors, homes, owner, least, most, known, same: bool, k: int):
        self.ids, self.labels, self.a, self.homes, self.same, self.k = ids, labels, vectors, homes, same, k
        self.owner, self.least, self.most = owner, least, most
        self.bar = np.maximum(least.astype(np.float64), known.astype(np.float64))
        self.norm = float(np.sqrt((vectors ** 2).sum(1)).max()) if vectors.size else 0.0
        self.slot, self.score, self.name = np.zeros(0, np.int64), np.zeros(0, object), np.zeros(0, np.int64)

    def bounds(self, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Interval arithmetic: least and greatest product of each anchor with any vector of each zone."""
        lo, hi = _wide(lo, self.a.shape[1]), _wide(hi, self.a.shape[1])
        plus, minus = np.maximum(self.a, 0), np.minimum(self.a, 0)
        slack = 1e-9 * np.abs(self.a) @ np.maximum(np.abs(lo), np.abs(hi)).T + 1e-3
        below, above = plus @ lo.T + minus @ hi.T - slack, plus @ hi.T + minus @ lo.T + slack
        return np.minimum(below, _LONG), np.maximum(above, -_LONG)  # as scores saturate

    def wanted(self, lo: np.ndarray, hi: np.ndarray, bits: np.ndarray, single: np.ndarray, many: np.ndarray) -> np.ndarray:
        """Slots by zones: may the zone hold a row for the slot? ``single`` is a zone's label unless ``many``."""
        below, above = (b[self.owner] for b in self.bounds(lo, hi))
        if self.same:
            holds = (label_bit(self.labels)[self.owner][:, None] & bits[None, :]) != 0
        else:
            holds = many[None, :] | (self.labels[self.owner][:, None] != single[None, :])
        return holds & (above >= self.bar[:, None]) & (below <= self.most.astype(np.float64)[:, None])

    def block(self, ids: np.ndarray, labels: np.ndarray, columns: np.ndarray, slots: np.ndarray) -> None:
        """Take in a block for the slots with these numbers."""
        anchors, place = np.unique(self.owner[slots], return_inverse=True)
        a = self.a[anchors]
        exact = self.norm * (float(np.sqrt((columns ** 2).sum(0)).max()) if columns.size else 0.0) < EXACT / 2
        if exact:
            scores = a @ columns
        else:
            scores = np.array([[_saturated(sum(int(x) * int(y) for x, y in zip(p, q))) for q in columns.T.tolist()] for p in a.tolist()], object)
        allowed = (labels[None, :] == self.labels[anchors][:, None]) == self.same
        allowed &= ids[None, :] != self.ids[anchors][:, None]
        # a bar may be rounded when scores are beyond 2**53: it only screens, and whole integers decide below
        screened = scores.astype(np.float64)[place]
        loose = 1e-9 * np.abs(self.bar[slots])[:, None] if not exact else 0.0
        s, j = np.nonzero(allowed[place] & (screened >= np.nan_to_num(self.bar[slots], neginf=-1e300)[:, None] - np.nan_to_num(loose, posinf=0.0)))
        found = scores[place[s], j]
        keep = (found <= self.most[slots[s]]) & (found >= self.least[slots[s]])
        self._merge(slots[s][keep], found[keep], ids[j][keep])

    def _merge(self, slot, score, name) -> None:
        slot, name = np.concatenate([self.slot, slot]), np.concatenate([self.name, name])
        score = np.concatenate([self.score, np.array([int(x) for x in score], object)])
        small = not len(score) or max(abs(int(score.max())), abs(int(score.min()))) < 1 << 62
        order = np.lexsort((name, -score.astype(np.int64), slot)) if small else np.array(sorted(range(len(slot)), key=lambda i: (slot[i], -score[i], name[i])), np.int64)
        slot, score, name = slot[order], score[order], name[order]
        first = np.searchsorted(slot, slot, "left")
        rank = np.arange(len(slot)) - first
        full = rank == self.k - 1
        self.bar[slot[full]] = np.maximum(self.bar[slot[full]], score[full].astype(np.float64))
        keep = rank < self.k
        self.slot, self.score, self.name = slot[keep], score[keep], name[keep]


def _wide(x: np.ndarray, dims: int) -> np.ndarray:
    """Rows of ``dims`` columns; what is missing is zero, what is over meets only zeros."""
    return x[:, :dims] if x.shape[1] >= dims else np.hstack([x, np.zeros((len(x), dims - x.shape[1]))])


def _pack_blocks(rows: int, most_bytes: int):
    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, number = TaskContext.get().partitionId(), 0
        for batch in batches:
            a = 0
            while a < batch.num_rows:
                width = max(1, int(np.diff(batch.column("v").offsets.to_numpy())[a : a + rows].max()))
                n = max(1, min(rows, most_bytes // (8 * width)))
                piece = batch.slice(a, n)
                v, labels = _dense(piece.column("v")), piece.column("label").to_numpy()
                v = v if v.shape[1] else np.zeros((len(v), 1))
                kinds = np.unique(labels)
                bits = int(np.bitwise_or.reduce(label_bit(kinds)).astype(np.int64))
                asks = np.flatnonzero(piece.column("ask").to_numpy(zero_copy_only=False))
                yield pa.RecordBatch.from_arrays([
                    pa.array([(part << 32) + number], pa.int64()), pa.array([len(v)], pa.int32()), pa.array([v.shape[1]], pa.int32()), pa.array([piece.column("id").to_numpy().tobytes()]),
                    pa.array([labels.astype(np.int64).tobytes()]), pa.array([vertical(v).tobytes()]), pa.array([v.min(0).tobytes()]), pa.array([v.max(0).tobytes()]),
                    pa.array([bits], pa.int64()), pa.array([int(kinds[0]) if len(kinds) == 1 else None], pa.int64()), pa.array([asks.astype(np.int64).tobytes()])],
                    ["block", "n", "dims", "ids", "labels", "columns", "lo", "hi", "bits", "single", "asks"])
                a, number = a + len(v), number + 1

    return pack


def _with_key(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        v = _dense(batch.column("v"))
        key = curve_key(v) if v.shape[1] else np.zeros(len(v), np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(key, pa.int64()), *batch.columns], ["key", *batch.schema.names])


def _askers(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The anchors of each block: block, id, label, v."""
    for batch in batches:
        for r in batch.to_pylist():
            asks = np.frombuffer(r["asks"], np.int64)
            if len(asks):
                v = np.frombuffer(r["columns"], np.float64).reshape(r["dims"], -1)[:, asks].T
                yield pa.RecordBatch.from_arrays([
                    pa.array(np.full(len(asks), r["block"])), pa.array(np.frombuffer(r["ids"], np.int64)[asks]), pa.array(np.frombuffer(r["labels"], np.int64)[asks]),
                    pa.array(v.tolist(), pa.list_(pa.float64()))], ["block", "id", "label", "v"])


def _pack_slab(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    from pyspark import TaskContext

    whole = [b for b in batches if b.num_rows]
    if whole:
        t = pa.Table.from_batches(whole).combine_chunks()
        v = _dense(t.column("v").chunk(0))
        yield pa.RecordBatch.from_arrays([
            pa.array([TaskContext.get().partitionId()], pa.int64()), pa.array([v.shape[1]], pa.int32()), *(pa.array([x.astype(np.int64).tobytes()]) for x in (t.column("id").to_numpy(), t.column("label").to_numpy())),
            pa.array([v.tobytes()]), pa.array([t.column("block").to_numpy().astype(np.int64).tobytes()])], ["slab", "dims", "ids", "labels", "vectors", "homes"])


def _pack_zones(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Chunks of zone maps: a row for each CHUNK blocks."""
    for batch in batches:
        for a in range(0, batch.num_rows, CHUNK):
            rows = batch.slice(a, CHUNK).to_pylist()
            dims = max(r["dims"] for r in rows)
            lo, hi = (np.vstack([_wide(np.frombuffer(r[c], np.float64)[None, :], dims) for r in rows]) for c in ("lo", "hi"))
            yield pa.RecordBatch.from_arrays([
                pa.array([np.array([r["block"] for r in rows], np.int64).tobytes()]), pa.array([dims], pa.int32()), pa.array([lo.tobytes()]), pa.array([hi.tobytes()]),
                pa.array([np.array([r["bits"] for r in rows], np.int64).tobytes()]), pa.array([np.array([0 if r["single"] is None else r["single"] for r in rows], np.int64).tobytes()]),
                pa.array([np.array([r["single"] is None for r in rows], np.uint8).tobytes()])], ["blocks", "dims", "lo", "hi", "bits", "single", "many"])


class _Mine:
    """The searches of one call over staged blocks and slabs."""

    def __init__(self, stages: Stages, blocks: DataFrame, slabs: DataFrame):
        self.stages, self.blocks, self.slabs = stages, blocks, slabs
        n_blocks, self.n_slabs = blocks.count(), (slabs.agg(F.max("slab")).first()[0] or 0) + 1
        self.cells = max(1, -(-n_blocks // CELL_BLOCKS))

    def _stream(self, slots: DataFrame, rows: DataFrame, names: list[str], task, schema: str) -> DataFrame:
        """Every slab with its slots before the rows of its cells, each (slab, cell) one search."""
        held = self.slabs.join(slots.groupBy("slab").agg(F.collect_list(F.struct("owner", "slot", "positive_score", "known")).alias("slots")), "slab")
        held = held.withColumn("cell", F.explode(F.sequence(F.lit(0), F.lit(self.cells - 1)).cast("array<long>")))
        mine = [c for c in held.columns if c not in ("slab", "cell")]
        held, rows = held.select("slab", "cell", F.struct(*mine).alias("held")), rows.select("slab", "cell", F.struct(*names).alias("row"))
        both = held.unionByName(rows, allowMissingColumns=True)
        return both.repartition("slab", "cell").sortWithinPartitions("slab", "cell", F.col("held").isNull()).mapInArrow(task, schema)

    def _held(self, k: int, same: bool, low: int, base: int):
        def make(row: dict) -> tuple[Slots, list]:
            a = np.frombuffer(row["vectors"], np.float64).reshape(-1, row["dims"])
            owner = np.array([s["owner"] for s in row["slots"]], np.int64)
            if same:
                least, most = np.full(len(owner), -np.inf), np.full(len(owner), np.inf)
            else:
                most = np.array([s["positive_score"] for s in row["slots"]], object)
                least = np.array([-((-low * int(x)) // base) for x in most], object)  # the smallest integer with base * least >= low * positive
            known = np.array([-np.inf if s["known"] is None else float(s["known"]) for s in row["slots"]])
            ids, labels, homes = (np.frombuffer(row[c], np.int64) for c in ("ids", "labels", "homes"))
            return Slots(ids, labels, a, homes, owner, least, most, known, same, k), row["slots"]

        return make

    def needed(self, slots: DataFrame, zones: DataFrame, **kind) -> DataFrame:
        """(slab, block) of the blocks that bounds leave open for any slot of the slab."""
        make = self._held(1, **kind)

        def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            held, slab = None, None
            for batch in batches:
                for r in range(batch.num_rows):
                    row = batch.slice(r, 1).to_pylist()[0]
                    if row["held"] is not None:
                        (held, _), slab = make(row["held"]), row["slab"]
                    elif held is not None and row["slab"] == slab:
                        z = row["row"]
                        names = np.frombuffer(z["blocks"], np.int64)
                        lo, hi = (np.frombuffer(z[c], np.float64).reshape(len(names), -1) for c in ("lo", "hi"))
                        open_ = held.wanted(lo, hi, np.frombuffer(z["bits"], np.int64).view(np.uint64), np.frombuffer(z["single"], np.int64), np.frombuffer(z["many"], np.uint8) > 0).any(0)
                        names = names[open_]
                        yield pa.RecordBatch.from_arrays([pa.array(np.full(len(names), slab)), pa.array(names)], ["slab", "block"])

        names = [c for c in zones.columns if c != "cell"]
        rows = zones.withColumn("slab", F.explode(F.sequence(F.lit(0), F.lit(self.n_slabs - 1)).cast("array<long>")))
        return self._stream(slots, rows, names, task, "slab long, block long")

    def homes(self) -> DataFrame:
        """(slab, block) of the blocks that the slab's anchors stand in."""
        def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for r in batch.to_pylist():
                    homes = np.unique(np.frombuffer(r["homes"], np.int64))
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(homes), r["slab"])), pa.array(homes)], ["slab", "block"])

        return self.slabs.select("slab", "homes").mapInArrow(task, "slab long, block long")

    def search(self, slots: DataFrame, pairs: DataFrame, k: int, home: bool, **kind) -> DataFrame:
        """The k best of each slot in the paired blocks: slab, owner, slot, rank, id, score; ``home``: in the anchor's own block."""
        make = self._held(k, **kind)

        def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            held, key, slots = None, None, None

            def results() -> pa.RecordBatch:
                at = [slots[i] for i in held.slot.tolist()]
                return pa.RecordBatch.from_arrays([
                    pa.array([key[0]] * len(at), pa.int64()), pa.array([s["owner"] for s in at], pa.int32()), pa.array([s["slot"] for s in at], pa.int32()),
                    pa.array(held.name, pa.int64()), pa.array([int(x) for x in held.score], pa.int64())], ["slab", "owner", "slot", "id", "score"])

            for batch in batches:
                for r in range(batch.num_rows):
                    row = batch.slice(r, 1).to_pylist()[0]
                    now = (row["slab"], row["cell"])
                    if row["held"] is not None:
                        if held is not None:
                            yield results()
                        (held, slots), key = make(row["held"]), now
                    elif held is not None and now == key:
                        b = row["row"]
                        lo, hi = (np.frombuffer(b[c], np.float64)[None, :] for c in ("lo", "hi"))
                        many = np.array([b["single"] is None])
                        asked = held.wanted(lo, hi, np.array([b["bits"]], np.int64).view(np.uint64), np.array([b["single"] or 0]), many)[:, 0]
                        if home:
                            asked &= held.homes[held.owner] == b["block"]
                        if asked.any():
                            columns = _wide(np.frombuffer(b["columns"], np.float64).reshape(b["dims"], -1).T, held.a.shape[1]).T
                            held.block(np.frombuffer(b["ids"], np.int64), np.frombuffer(b["labels"], np.int64), columns, np.flatnonzero(asked))
            if held is not None:
                yield results()

        rows = pairs.join(self.blocks.drop("asks"), "block").withColumn("cell", F.pmod(F.xxhash64("block"), F.lit(self.cells)))
        found = self._stream(slots, rows, [c for c in rows.columns if c not in ("slab", "cell")], task, "slab long, owner int, slot int, id long, score long")
        best = Window.partitionBy("slab", "owner", "slot").orderBy(F.desc("score"), "id")
        return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)


def mine(vectors: DataFrame, anchor: str | Column = "vec_id % 100 = 0", positives: int = 5, negatives: int = 5, low: int = 80, base: int = 100, scale: int = 256,
         id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", block_rows: int = 512, slab_rows: int = 2048) -> DataFrame:
    """For each anchor and each of its nearest positives the nearest negatives in a window of scores below the positive's.

    Returns anchor_id, positive_id, rank, negative_id, positive_score, negative_score. Components become
    floor(scale * x); the score is the integer inner product with the anchor, higher first, ties to
    the smaller id. Positives are the first ``positives`` other rows of the anchor's label; a positive's
    negatives are the first ``negatives`` rows of other labels with low * positive_score <= base * negative_score
    <= base * positive_score (none where the positive's score is negative).

    Rows with a null id, label or vector, or a null or non-finite component, take no part.
    A vector of fewer dimensions counts as padded with zeros. Rows that repeat an id are each
    candidates, but never of an anchor with that id; of anchors that repeat an id the smallest (vector, label) asks.
    An anchor without positives, or whose windows are empty, gives no row. Scores beyond a long
    saturate and are compared so. Empty tables give an empty result. Only the three columns named are read.

    Rows are sorted by range along a Hilbert curve and staged as Parquet blocks of up to ``block_rows`` rows in
    vertical layout, each with its zone map: least and greatest value of each dimension, a 64-bit set of
    label hashes and its label if it has only one. Anchors lie in slabs along the curve. Each of the two
    searches (positives, then windows) first looks in an anchor's own block, which gives a bar; interval
    arithmetic on the zone maps then says which blocks may hold a better row for any slot of a slab, and
    only these are joined to it. Bounds decide exactly: nothing is lost, and where they are of no use (many
    dimensions, no clusters) all blocks are read. Each search holds k results for each slot of one slab and
    one block at a time; a hot vector or label is spread over blocks by id.
    """
    spark = vectors.sparkSession
    stages = Stages(spark)
    ask = F.expr(anchor) if isinstance(anchor, str) else anchor
    fine = vectors.where(F.col(id_col).isNotNull() & F.col(label_col).isNotNull() & F.col(vector_col).isNotNull()).where(
        F.forall(vector_col, lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < float("inf"))))
    rows = fine.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("long").alias("label"), F.coalesce(ask, F.lit(False)).alias("ask"),
                       F.transform(vector_col, lambda x: F.floor(x.cast("double") * scale).cast("double")).alias("v"))
    keyed = rows.mapInArrow(_with_key, "key long, id long, label long, ask boolean, v array<double>")
    kept = ()
    try:
        ordered = keyed.repartitionByRange("key", "id", F.xxhash64("label", "v")).sortWithinPartitions("key", "id")
        blocks = stages.table(ordered.mapInArrow(_pack_blocks(block_rows, 8 << 20), _BLOCK), "blocks", 64 << 20)
        asking = blocks.where(F.length("asks") > 0).select("block", "dims", "ids", "labels", "columns", "asks").mapInArrow(_askers, "block long, id long, label long, v array<double>")
        one = asking.groupBy("id").agg(F.min(F.struct("v", "label", "block")).alias("best")).select("id", "best.*")
        one = stages.table(one, "anchors", 64 << 20)
        n, width = one.agg(F.count("*"), F.max(F.size("v"))).first()
        per = max(64, min(slab_rows, (16 << 20) // (8 * (width or 1))))
        slabs = stages.table(one.repartitionByRange(max(1, -(-n // per)), "block", "id").mapInArrow(_pack_slab, _SLAB), "slabs", 64 << 20)
        search = _Mine(stages, blocks, slabs)
        zones = blocks.select("block", "dims", "lo", "hi", "bits", "single").coalesce(max(1, search.cells // CHUNK + 1)).mapInArrow(
            _pack_zones, "blocks binary, dims int, lo binary, hi binary, bits binary, single binary, many binary")
        zones = stages.table(zones.withColumn("cell", F.pmod(F.xxhash64("blocks"), F.lit(search.cells))), "zones", 64 << 20)

        def numbered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for r in batch.to_pylist():
                    ids = np.frombuffer(r["ids"], np.int64)
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(ids), r["slab"])), pa.array(np.arange(len(ids)), pa.int32()), pa.array(ids)], ["slab", "owner", "id"])

        owners = slabs.select("slab", "ids").mapInArrow(numbered, "slab long, owner int, id long")
        same, other = dict(same=True, low=low, base=base), dict(same=False, low=low, base=base)
        blank = owners.select("slab", "owner", F.lit(0).alias("slot"), F.lit(None).cast("long").alias("positive_score"), F.lit(None).cast("long").alias("known"))
        bar = lambda found, k: found.where(F.col("rank") == k).select("slab", "owner", "slot", F.col("score").alias("known"))
        near = stages.table(bar(search.search(blank, search.homes(), positives, True, **same), positives), "near-positives")
        barred = blank.drop("known").join(near, ["slab", "owner", "slot"], "left")
        pairs = stages.table(search.needed(barred, zones, **same), "positive-blocks")
        best = stages.table(search.search(barred, pairs, positives, False, **same), "positives")
        windows = best.select("slab", "owner", F.col("rank").alias("slot"), F.col("id").alias("positive_id"), F.col("score").alias("positive_score")).where("positive_score >= 0")
        blank = windows.drop("positive_id").withColumn("known", F.lit(None).cast("long"))
        near = stages.table(bar(search.search(blank, search.homes(), negatives, True, **other), negatives), "near-negatives")
        barred = blank.drop("known").join(near, ["slab", "owner", "slot"], "left")
        pairs = stages.table(search.needed(barred, zones, **other), "negative-blocks")
        found = search.search(barred, pairs, negatives, False, **other).select("slab", "owner", "slot", F.col("rank"), F.col("id").alias("negative_id"), F.col("score").alias("negative_score"))
        out = stages.table(
            found.join(windows, ["slab", "owner", "slot"]).join(owners.withColumnRenamed("id", "anchor_id"), ["slab", "owner"])
            .select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"), "negatives")
        kept = ("negatives",)
        return out
    finally:
        stages.close(*kept)
