"""Exact Jaccard join of word-shingle sets by parity sketches."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ewpanel.llm.common import Stages, mix64, text_slices
from ewpanel.llm.components import components, more_links
from ewpanel.llm.words import shingle_sets

SLICE = 2 << 20  # bytes of text that are hashed at a time
TOKEN_KEYS = 0x9E3779B97F4A7C15  # orders tokens apart from their segments
SLACK = 4  # segments for each one that may be left out
LEAST_BITS = 1024  # of a parity sketch
BLOCK = 256  # sets around a centre that are compared with one another at a time
COPIES = 1 << 16  # sets remembered by a task, so that copies close to each other are hashed once
GROWTH = 1.6  # of a size band's upper end over the last band's


class Bands:
    """Size bands and, for each, how many segments its sketches have.

    Sets A and B with |A & B| * 100 >= percent * |A or B| differ in at most
    (100 - percent) / (100 + percent) * (|A| + |B|) tokens. For a band whose
    largest size is U that is at most D(U). A sketch has one parity bit for each of
    2**64 token hashes, dealt to D + 1 + t segments; a token in one set only
    changes one segment, so the number of segments that differ is a lower bound of
    the symmetric difference, and at least t + 1 segments of a linked pair agree.
    A segment is represented by the exclusive or of its tokens' hashes. Segments with
    few tokens are often equal by chance, so each set leaves out those with fewer than
    w tokens, w as large as leaves out at most t. This loses no pair: of the t + 1
    segments that hold the same tokens in both sets at most t have fewer tokens than the larger w of the two.

    An empty segment is never a key, as unrelated sets share it. A set with more than t empty segments keeps all
    others. It and a linked set then have a key in common unless all segments that agree are empty; but
    then every segment that it fills differs. So where it fills more segments than any link's difference
    allows, nothing is lost. Else (all its tokens in a few segments) it also has token keys: its first
    n - ceil(percent * n / 100) + 1 tokens in a fixed order. Two linked sets that both have token
    keys share one: they have at least percent / 100 of the larger in common, so not all
    common tokens can come after the first ones of either.
    """

    def __init__(self, percent: int):
        self.percent, self.upper = percent, [1]

    def of(self, n: int) -> int:
        while self.upper[-1] < n:
            self.upper.append(max(self.upper[-1] + 1, int(self.upper[-1] * GROWTH)))
        return int(np.searchsorted(self.upper, n))

    def wanted(self, n: int) -> range:
        """The bands in whose sketches a set of n tokens must appear: its own, and larger ones in which a partner can lie."""
        return range(self.of(n), self.of(100 * n // self.percent) + 1)

    def shape(self, band: int) -> tuple[int, int]:
        """Number of segments and the slack t."""
        self.of(self.upper[-1] + 1 if band >= len(self.upper) else 1)
        differ = (100 - self.percent) * 2 * self.upper[band] // (100 + self.percent)
        slack = (differ + 1) // SLACK
        return differ + 1 + slack, slack

    def differ(self, n: int, band: int) -> int:
        """The greatest symmetric difference of a set of n tokens and a linked one of the band's sizes."""
        return (100 - self.percent) * (n + min(self.upper[band], 100 * n // self.percent)) // (100 + self.percent)

    def keys(self, tokens: np.ndarray) -> np.ndarray:
        """The lookup keys of a token set: (band, segment, segment's parity), and tokens of sets that fill few segments."""
        out = []
        for band in self.wanted(len(tokens)):
            segments, slack = self.shape(band)
            place = ((tokens >> np.uint64(32)) * np.uint64(segments)) >> np.uint64(32)
            order = np.argsort(place, kind="stable")
            place, mixed = place[order], mix64(tokens[order] + np.uint64(1))
            first = np.flatnonzero(np.concatenate([[True], place[1:] != place[:-1]]))
            used, parity = place[first], np.bitwise_xor.reduceat(mixed, first)
            size = np.diff(np.append(first, len(place)))
            fewer = segments - len(used) + np.cumsum(np.bincount(size))
            if segments - len(used) > slack:
                if len(used) <= self.differ(len(tokens), band):
                    first_tokens = np.sort(mix64(tokens ^ np.uint64(TOKEN_KEYS)))[: len(tokens) - -(-self.percent * len(tokens) // 100) + 1]
                    out.append(mix64(first_tokens + np.uint64(1)))
            else:
                dense = size >= np.searchsorted(fewer, slack, "right")
                used, parity = used[dense], parity[dense]
            out.append(mix64(parity ^ mix64(used + np.uint64((band + 1) << 40))))
        return np.unique(np.concatenate(out))


def _set_hash(tokens: np.ndarray) -> int:
    return int(mix64(np.array([mix64(tokens).sum(dtype=np.uint64) ^ np.uint64(len(tokens))], np.uint64)).view(np.int64)[0])


def parity_sketch(tokens: np.ndarray) -> bytes:
    """One parity bit for each of 2**k token hashes, two to four for each token and 1,024 at least; the upper half folds onto the lower."""
    bits = max(LEAST_BITS, 1 << int(2 * len(tokens) - 1).bit_length())
    odd = np.bincount((mix64(tokens) & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").tobytes()


def sketch_distance(a: bytes, b: bytes) -> int:
    """A lower bound of the symmetric difference of the sets behind two sketches."""
    x, y = np.frombuffer(a, np.uint64), np.frombuffer(b, np.uint64)
    while len(x) > len(y):
        x = x[: len(x) // 2] ^ x[len(x) // 2 :]
    while len(y) > len(x):
        y = y[: len(y) // 2] ^ y[len(y) // 2 :]
    return int(np.bitwise_count(x ^ y).sum())


def sketched_sets(docs: DataFrame, width: int) -> DataFrame:
    """id, text_hash, n (size of the set), fp (hash of the set, null if empty) and its parity sketch."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_slices(batches, "text", SLICE):
            sets = shingle_sets(batch.column("text"), width)
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), batch.column("text_hash"), pa.array([len(s) for s in sets], pa.int64()), pa.array([_set_hash(s) if len(s) else None for s in sets], pa.int64()),
                 pa.array([parity_sketch(s) if len(s) else None for s in sets], pa.binary())], ["id", "text_hash", "n", "fp", "sketch"])

    return docs.mapInArrow(run, "id long, text_hash long, n long, fp long, sketch binary")


FILTER_BITS = 1 << 25  # of the id filter, 4 MB, whatever the input


def _filter_of(rows: DataFrame, places: list):
    """A broadcast bit table of FILTER_BITS bits in which the places of all rows are set."""
    words = rows.select(F.explode(F.array(*places)).alias("bit")).groupBy(F.shiftright("bit", 6).alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, cast(bit & 63 as int))")).alias("bits"))
    held = np.zeros(FILTER_BITS // 64, np.int64)
    for r in words.toLocalIterator():
        held[r.word] = r.bits
    return rows.sparkSession.sparkContext.broadcast(held)


def tokens_of(docs: DataFrame, wanted: DataFrame, width: int) -> DataFrame:
    """fp and tokens (sorted 64-bit words) of the documents whose id is among ``wanted``, and perhaps of some others.

    The wanted ids go to the tasks as a Bloom filter of fixed size, so no text is
    shuffled. If they are too many for it more documents pass, never fewer.
    """
    shared = _filter_of(wanted, [F.pmod(F.xxhash64("id", F.lit(k)), F.lit(FILTER_BITS)) for k in (1, 2, 3)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = shared.value
        for batch in text_slices(batches, "text", SLICE):
            keep = np.ones(batch.num_rows, bool)
            for k in ("h1", "h2", "h3"):
                h = batch.column(k).to_numpy()
                keep &= (bits[h >> 6] >> (h & 63)) & 1 == 1
            chosen = batch.filter(pa.array(keep))
            sets = [s for s in shingle_sets(chosen.column("text"), width) if len(s)]
            if sets:
                yield pa.RecordBatch.from_arrays([pa.array([_set_hash(s) for s in sets], pa.int64()), pa.array([s.tobytes() for s in sets], pa.binary())], ["fp", "tokens"])

    hashed = docs.select("text", *[F.pmod(F.xxhash64("id", F.lit(k)), F.lit(FILTER_BITS)).alias(f"h{k}") for k in (1, 2, 3)])
    return hashed.mapInArrow(run, "fp long, tokens binary")


def _sketch_keys(docs: DataFrame, width: int, percent: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bands, seen = Bands(percent), np.zeros(COPIES, np.int64)
        for batch in text_slices(batches, "text", SLICE):
            sets = {_set_hash(s): s for s in shingle_sets(batch.column("text"), width) if len(s)}
            sets = {fp: s for fp, s in sets.items() if seen[fp % COPIES] != fp}
            for fp in sets:
                seen[fp % COPIES] = fp
            if sets:
                keys = [bands.keys(s) for s in sets.values()]
                fps = np.repeat(np.array(list(sets), np.int64), [len(k) for k in keys])
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(keys).view(np.int64)), pa.array(fps)], ["key", "fp"])

    return docs.select("text").mapInArrow(run, "key long, fp long")


def _bucket_centres(keys: DataFrame) -> DataFrame:
    """(c, x) for every set x of a bucket and the bucket's centre c; buckets stream by, sorted, none is held.

    The centre is the set that a hash with the bucket's key puts first, so a group of
    similar sets meets many centres in its many buckets.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held_key, held = None, 0
        for batch in batches:
            key, fp = batch.column("key").to_numpy(), batch.column("fp").to_numpy()
            if not len(key):
                continue
            new = np.concatenate([[held_key is None or key[0] != held_key], key[1:] != key[:-1]])
            at = np.maximum.accumulate(np.where(new, np.arange(len(key)), -1))
            centre = np.where(at >= 0, fp[np.maximum(at, 0)], held)
            held_key, held = key[-1], centre[-1]
            other = fp != centre
            if other.any():
                pairs = np.unique(np.stack([centre[other], fp[other]], 1), axis=0)
                yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], ["c", "x"])

    ordered = keys.repartition("key").sortWithinPartitions("key", F.xxhash64("key", "fp"), "fp")
    return ordered.mapInArrow(run, "c long, x long").distinct()


def _screen(pairs: DataFrame, sketches: DataFrame, percent: int) -> DataFrame:
    """Pairs (c, x) with their sizes nc, nx, a lower bound of their difference and whether it leaves a link possible."""
    gap, whole = 100 - percent, 100 + percent

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = batch.column("nc").to_numpy() + batch.column("nx").to_numpy()
            low = [sketch_distance(a, b) for a, b in zip(batch.column("sc").to_pylist(), batch.column("sx").to_pylist())]
            low = np.maximum(np.array(low, np.int64), np.abs(batch.column("nc").to_numpy() - batch.column("nx").to_numpy()))
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in ("c", "x", "nc", "nx")), pa.array(low), pa.array(whole * low <= gap * sizes)], ["c", "x", "nc", "nx", "low", "near"])

    side = lambda k: sketches.select(F.col("fp").alias(k), F.col("n").alias(f"n{k}"), F.col("sketch").alias(f"s{k}"))
    joined = pairs.join(side("c"), "c").join(side("x"), "x").select("c", "x", "nc", "nx", "sc", "sx")
    return joined.mapInArrow(run, "c long, x long, nc long, nx long, low long, near boolean")


def _verify(pairs: DataFrame, tokens: DataFrame, percent: int) -> DataFrame:
    """For each pair (c, x) the symmetric difference of their sets and whether they are linked."""
    gap, whole = 100 - percent, 100 + percent

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            differ, linked = [], []
            for a, b in zip(batch.column("tc"), batch.column("tx")):
                a, b = np.frombuffer(a.as_buffer(), np.uint64), np.frombuffer(b.as_buffer(), np.uint64)
                differ.append(len(a) + len(b) - 2 * len(np.intersect1d(a, b, assume_unique=True)))
                linked.append(whole * differ[-1] <= gap * (len(a) + len(b)))
            yield pa.RecordBatch.from_arrays([batch.column("c"), batch.column("x"), pa.array(differ, pa.int64()), pa.array(linked, pa.bool_())], ["c", "x", "differ", "linked"])

    joined = (pairs.join(tokens.select(F.col("fp").alias("c"), F.col("tokens").alias("tc")), "c")
              .join(tokens.select(F.col("fp").alias("x"), F.col("tokens").alias("tx")), "x").select("c", "x", "tc", "tx"))
    return joined.mapInArrow(run, "c long, x long, differ long, linked boolean")


def _folded(sketches: list[bytes]) -> np.ndarray:
    """The sketches folded to LEAST_BITS, a row of words for each."""
    return np.stack([np.bitwise_xor.reduce(np.frombuffer(s, np.uint64).reshape(-1, LEAST_BITS // 64), axis=0) for s in sketches])


def _possible(p: dict, q: dict, percent: int) -> np.ndarray:
    """For each set of p and of q (around one centre) the least share of their tokens in which they differ, infinite where no link is possible or needed.

    A link is needed between sets of different components, and possible with similar
    sizes and a symmetric difference of at most gap / whole of the sizes' sum. Differences
    are a metric: that of x and y is at least the lower bound of one set's difference
    from the centre less the other's exact one, and at least the number of parity bits
    in which the sketches differ.
    """
    gap, whole = 100 - percent, 100 + percent
    sizes = p["n"][:, None] + q["n"][None, :]
    out = (p["component"][:, None] != q["component"][None, :]) & (whole * np.abs(p["n"][:, None] - q["n"][None, :]) <= gap * sizes)
    out &= whole * (p["low"][:, None] - q["high"][None, :]) <= gap * sizes
    out &= whole * (q["low"][None, :] - p["high"][:, None]) <= gap * sizes
    at = np.nonzero(out)
    apart = np.bitwise_count(p["sketch"][at[0]] ^ q["sketch"][at[1]]).sum(1, dtype=np.int64)
    share = np.full(out.shape, np.inf)
    share[at] = np.where(whole * apart <= gap * sizes[at], apart / sizes[at], np.inf)
    return share


def _around_centres(around: DataFrame, percent: int, nearest: bool) -> DataFrame:
    """Pairs (c, x) of sets around one centre that may be linked although their components differ.

    ``around``: centre, x, n, low, high, component, sketch and blocks. The sets around
    a centre are dealt to blocks of about BLOCK by a hash, and any two blocks, or one
    block with itself, are compared by one task; only possible pairs come out, or, with
    ``nearest``, the nearest possible partner of each set.
    """
    own = F.pmod(F.xxhash64("x"), F.col("blocks"))
    dealt = around.withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    dealt = dealt.select("centre", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own", "x", "n", "low", "high", "component", "sketch")

    def compared(table: pa.Table) -> pa.RecordBatch:
        sets = {k: table.column(k).to_numpy() for k in ("x", "n", "low", "high", "component", "own")} | {"sketch": _folded(table.column("sketch").to_pylist())}
        i, j = table.column("i")[0].as_py(), table.column("j")[0].as_py()
        p, q = ({k: v[sets["own"] == b] for k, v in sets.items()} for b in (i, j))
        a = b = np.zeros(0, np.int64)
        if len(p["x"]) and len(q["x"]):
            share = _possible(p, q, percent)
            if nearest:
                down, right = share.argmin(0), share.argmin(1)
                a, b = np.append(np.arange(len(right)), down), np.append(right, np.arange(len(down)))
                keep = np.isfinite(share[a, b])
                a, b = a[keep], b[keep]
            else:
                a, b = np.nonzero(np.isfinite(share))
        x, y = p["x"][a], q["x"][b]
        pairs = np.unique(np.stack([np.minimum(x, y), np.maximum(x, y)], 1), axis=0)
        return pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], ["c", "x"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None  # the rows of the pair of blocks that the last batch ended in
        for batch in batches:
            table = pa.Table.from_batches([batch])
            table = pa.concat_tables([held, table]) if held is not None else table
            names = [table.column(k).to_numpy() for k in ("centre", "i", "j")]
            edges = [0, *(np.flatnonzero(np.any([k[1:] != k[:-1] for k in names], axis=0)) + 1).tolist()] if len(table) else [0]
            for a, b in zip(edges, edges[1:]):
                yield compared(table.slice(a, b - a))
            held = table.slice(edges[-1]).combine_chunks()
        if held is not None and len(held):
            yield compared(held)

    ordered = dealt.repartition("centre", "i", "j").sortWithinPartitions("centre", "i", "j")
    return ordered.mapInArrow(run, "c long, x long").distinct()


def jaccard_groups(docs: DataFrame, width: int, percent: int, stages: Stages) -> tuple[DataFrame, DataFrame]:
    """The sets of all documents (id, text_hash, n, fp; fp null if empty) and the group of each fp (fp, id, component).

    ``id`` of the second is the smallest of the set's documents, ``component`` the
    smallest fp that links reach. ``docs`` has id and text.
    """
    docs = docs.select("id", "text")
    sets = stages.table(sketched_sets(docs.select("id", "text", F.xxhash64("text").alias("text_hash")), width), "sets")
    first = stages.table(sets.where("fp is not null").groupBy("fp").agg(F.min("id").alias("id")), "set-ids")
    pairs = stages.table(_bucket_centres(_sketch_keys(docs, width, percent)), "bucket-pairs")
    ends = lambda t: t.select(F.explode(F.array("c", "x")).alias("fp")).distinct()
    sketches = stages.table(sets.join(ends(pairs), "fp", "left_semi").dropDuplicates(["fp"]).select("fp", "n", "sketch"), "sketches")
    screened = stages.table(_screen(pairs, sketches, percent), "screened")
    near = screened.where("near")

    def verified(some: DataFrame, name: str) -> DataFrame:
        tokens = stages.table(tokens_of(docs, first.join(ends(some), "fp", "left_semi"), width).join(ends(some), "fp", "left_semi").dropDuplicates(["fp"]), "tokens")
        found = stages.table(_verify(some, tokens, percent), name, 16 << 20)
        stages.drop("tokens")
        return found

    def with_components(some: DataFrame, node: DataFrame, k: str) -> DataFrame:
        name = node.select(F.col("node").alias(k), F.col("component").alias(f"component_{k}"))
        return some.join(name, k, "left").withColumn(f"component_{k}", F.coalesce(f"component_{k}", k))

    # each set with its nearest centre first
    best = near.groupBy("x").agg(F.min(F.struct((F.col("low") / (F.col("nc") + F.col("nx"))).alias("share"), "c")).alias("best"))
    found = verified(stages.table(best.select(F.col("best.c").alias("c"), "x"), "nearest"), "verified-nearest")

    node = components(found.where("linked").select("c", "x"), "c", "x", stages)

    # then the nearest possible partners around each centre (the centre is one of the sets), and at last all that is still possible
    for turn, nearest in ((1, True), (2, False)):
        known = screened.join(found, ["c", "x"], "left").select("c", "x", F.col("nx").alias("n"), F.coalesce("differ", "low").alias("low"), F.coalesce("differ", F.lit(1 << 40)).alias("high"))
        itself = screened.select("c", F.col("c").alias("x"), F.col("nc").alias("n"), F.lit(0).cast("long").alias("low"), F.lit(0).cast("long").alias("high")).distinct()
        around = stages.table(with_components(known.union(itself), node, "x"), f"around-{turn}")
        mixed = around.groupBy("c").agg(F.min("component_x").alias("a"), F.max("component_x").alias("b"), F.ceil(F.count(F.lit(1)) / BLOCK).cast("long").alias("blocks")).where("a < b")
        mixed = around.join(mixed.select("c", "blocks"), "c").join(sketches.select(F.col("fp").alias("x"), "sketch"), "x")
        mixed = mixed.select(F.col("c").alias("centre"), "x", "n", "low", "high", F.col("component_x").alias("component"), "sketch", "blocks")
        told = found.select(F.least("c", "x").alias("c"), F.greatest("c", "x").alias("x"))
        rest = stages.table(_around_centres(mixed, percent, nearest).join(told, ["c", "x"], "left_anti"), "rest-pairs")
        if rest.take(1):
            rest = stages.table(_screen(rest, sketches, percent).where("near").select("c", "x"), "rest-near")
            new = verified(rest, f"verified-rest-{turn}")
            node = more_links(node, new.where("linked").select(F.col("c").alias("a"), F.col("x").alias("b")), stages, f"nodes-{turn}")
            found = found.union(new)
        stages.drop("rest-pairs", "rest-near", f"around-{turn}")

    labelled = stages.table(first.join(node, first.fp == node.node, "left").select("fp", "id", F.coalesce("component", "fp").alias("component")), "labelled")
    stages.close("sets", "labelled")
    return sets, labelled


def jaccard_components(docs: DataFrame, width: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Link documents whose shingle sets have 100 * intersection >= percent * union; a row for each document.

    Returns id_col, n_shingles and component_id: the smallest id reachable by links,
    the document's own included. Texts are compared whole; the sets are distinct
    ``width``-word shingles of the A-Z-lower-cased text. A null, empty or blank text
    has an empty set and is linked with nothing. Equal sets are one node, so copies
    cost nothing. Null ids take part and don't count for the smallest id; repeated
    rows are returned as often as they come. An empty table gives an empty result.
    Other columns are ignored.

    Each set is compared with the centres of its buckets of equal sketch segments, by
    parity sketches first, and with the nearest of them by tokens. Sets around one centre
    that are then of different components are compared by sketches, block against
    block; tokens move only for the nearest that may be linked, and in a last round for
    all that may be and still are of different components. All verified links connect
    exactly what all links connect.
    """
    stages = Stages(docs.sparkSession)
    sets, labelled = jaccard_groups(docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text")), width, percent, stages)
    least = labelled.groupBy("component").agg(F.min("id").alias("component_id"))
    by_set = stages.table(labelled.join(least, "component").select("fp", "component_id"), "set-components")
    stages.close("sets", "set-components")
    return sets.join(by_set, "fp", "left").select(
        F.col("id").alias(id_col), F.col("n").alias("n_shingles"), F.when(F.col("n") == 0, F.col("id")).otherwise(F.col("component_id")).alias("component_id"))
