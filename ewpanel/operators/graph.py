"""Graphs as edge tables: actor pairs, hypergraphs, grid diffusion, theme co-occurrence."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ewpanel.functions.staging import staged
from ewpanel.functions.text import pairs_of


def knowledge_graph(events: DataFrame, event_id: str, place: str, actors: list[str]) -> DataFrame:
    """Typed edges: an event OCCURRED_AT its place, each of its actors (blank ones apart, once) PARTICIPATED_IN it."""
    event = F.concat(F.lit("EVT:"), F.col(event_id).cast("string"))
    at = events.select(event.alias("src"), F.concat(F.lit("LOC:"), F.col(place)).alias("dst"), F.lit("OCCURRED_AT").alias("kind"))
    who = events.select(event.alias("dst"), F.explode(F.array_distinct(F.array(*actors))).alias("a")).where("a is not null and trim(a) != ''")
    return at.unionByName(who.select(F.concat(F.lit("ACT:"), "a").alias("src"), "dst", F.lit("PARTICIPATED_IN").alias("kind")))


def pair_stats(df: DataFrame, keys: list[str], a: str, b: str) -> DataFrame:
    """Distinct undirected edges without self-loops, density and the top node's share of all degrees; zeros where a key has none."""
    edges = df.where(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col(a) != F.col(b)))
    edges = edges.select(*keys, F.least(a, b).alias("u"), F.greatest(a, b).alias("v")).distinct()
    degree = edges.select(*keys, F.explode(F.array("u", "v")).alias("node")).groupBy(*keys, "node").agg(F.count(F.lit(1)).alias("deg"))
    stats = degree.groupBy(*keys).agg((F.sum("deg") / 2).cast("long").alias("n_edges"), F.count(F.lit(1)).alias("n"), F.max("deg").alias("top"))
    stats = stats.select(*keys, "n_edges", (F.col("n_edges") / (F.col("n") * (F.col("n") - 1) / 2)).alias("density"), (F.col("top") / (2 * F.col("n_edges"))).alias("top_degree_share"))
    return df.select(*keys).distinct().join(stats, keys, "left").fillna(0, ["n_edges", "density", "top_degree_share"])


def incidence(nodes: DataFrame, node: str, edges: dict[str, list[str]], lookup: dict[str, DataFrame] | None = None, least: int = 2) -> DataFrame:
    """Hypergraph incidence (node_id, edge_type, edge_id): one hyperedge for each value of each column list.

    ``lookup`` gives membership tables (node, value) for set-valued edge types.
    Hyperedges of fewer than ``least`` members are dropped. A column that is missing is
    an error.
    """
    parts = []
    for kind, columns in edges.items():
        missing = [c for c in columns if c not in nodes.columns]
        if missing:
            raise ValueError(f"edge type {kind} needs the columns {missing}")
        parts.append(nodes.select(F.col(node).alias("node_id"), F.lit(kind).alias("edge_type"), F.concat_ws("|", *columns).alias("edge_id")))
    for kind, members in (lookup or {}).items():
        parts.append(members.select(F.col(node).alias("node_id"), F.lit(kind).alias("edge_type"), F.col("value").cast("string").alias("edge_id")).distinct())
    whole = parts[0]
    for p in parts[1:]:
        whole = whole.unionByName(p)
    sizes = whole.groupBy("edge_type", "edge_id").agg(F.count(F.lit(1)).alias("edge_size")).where(F.col("edge_size") >= least)
    return whole.join(sizes, ["edge_type", "edge_id"])


BLOCK, BUCKET = 256, 32768  # nodes whose unions one pass holds; positions of a bitmap


def structural_features(inc: DataFrame) -> DataFrame:
    """Hyperedge degree, co-membership count (sum of the edges' other members) and mean degree of the distinct co-members of each node.

    No pairs of members are made, however large an edge is: see ``co_member_degrees``.
    """
    own = inc.groupBy("node_id").agg(F.count(F.lit(1)).alias("degree"), (F.sum("edge_size") - F.count(F.lit(1))).alias("co_memberships"))
    numbered = staged(own.withColumn("_no", F.monotonically_increasing_id()))
    sums = co_member_degrees(inc.select("edge_type", "edge_id", "node_id").join(numbered.select("node_id", "_no", "degree"), "node_id"), numbered.select("_no", "degree"))
    others = F.col("_members") - 1  # a node is a member of its own edges
    mean = F.when(others > 0, (F.col("_degrees") - F.col("degree")) / others)
    return numbered.join(sums, "_no").select("node_id", "degree", "co_memberships", mean.alias("mean_co_degree"))


def co_member_degrees(inc: DataFrame, nodes: DataFrame) -> DataFrame:
    """For each node number _no: how many nodes its edges hold in all, each once, and the sum of their degrees.

    An edge is a bitmap for each bucket of 32,768 node numbers it reaches, and meets each block of 256
    nodes once with the list of its members there, so an edge of m members costs at most m / 256 bitmaps of 4 KB for each of its
    buckets and not m * m pairs. Tasks stream these in the order of (block, bucket) and hold
    the unions of one block: 1 MB. Degrees are bit slices, bitmaps of the nodes with a given bit in their degree,
    so their sum over a union is a count of common bits.
    """
    edge = ["edge_type", "edge_id"]
    at, bucket = F.col("_no") % BUCKET, F.shiftright("_no", 15).alias("_bucket")
    bits = inc.groupBy(*edge, bucket).agg(F.bitmap_construct_agg(at).alias("_map"))
    here = inc.groupBy(*edge, F.shiftright("_no", 8).alias("_block")).agg(F.collect_list((F.col("_no") % BLOCK).cast("int")).alias("_at"))  # at most 256
    unions = here.join(bits, edge).select("_block", "_bucket", F.lit(-1).alias("_slice"), "_at", "_map")
    slices = nodes.select("_no", F.explode(F.sequence(F.lit(0), F.floor(F.log2(F.col("degree"))).cast("int"))).alias("_slice"), "degree")
    slices = slices.where(F.expr("shiftright(degree, _slice) % 2 = 1")).groupBy(bucket, "_slice").agg(F.bitmap_construct_agg(at).alias("_map"))
    asked = unions.select("_block", "_bucket").distinct().join(slices, "_bucket").select("_block", "_bucket", "_slice", F.array().cast("array<int>").alias("_at"), "_map")
    ordered = unions.unionByName(asked).repartition("_block", "_bucket").sortWithinPartitions("_block", "_bucket", "_slice")
    parts = ordered.mapInArrow(_unions, "_no long, _members long, _degrees long")
    return parts.groupBy("_no").agg(F.sum("_members").alias("_members"), F.sum("_degrees").alias("_degrees"))


def _unions(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Unions of the bitmaps of each node of a block in one bucket, counted; edges (slice -1) come before the slices."""
    words = BUCKET // 64
    held, key, members, degrees = np.zeros((BLOCK, words), np.uint64), None, None, None

    def counted(key):
        there = np.flatnonzero(members)
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in (key[0] * BLOCK + there, members[there], degrees[there])], ["_no", "_members", "_degrees"])

    for batch in batches:
        columns = [batch.column(n) for n in ("_block", "_bucket", "_slice", "_at", "_map")]
        for i in range(batch.num_rows):
            block, bucket, cut, at, bitmap = (c[i] for c in columns)
            if (block.as_py(), bucket.as_py()) != key:
                if key:
                    yield counted(key)
                key, members, degrees = (block.as_py(), bucket.as_py()), None, np.zeros(BLOCK, np.int64)
                held[:] = 0
            row = np.frombuffer(bitmap.as_buffer(), np.uint64)
            if cut.as_py() < 0:
                held[at.values.to_numpy()] |= row
                continue
            if members is None:
                members = np.bitwise_count(held).sum(1, dtype=np.int64)
            degrees += np.bitwise_count(held & row).sum(1, dtype=np.int64) << cut.as_py()
    if key:
        yield counted(key)


def propagate(inc: DataFrame, signal: DataFrame, values: list[str], symmetric: bool | None = True, by: list[str] | None = None) -> DataFrame:
    """One step of hypergraph smoothing of the ``values`` of each node_id, as edge means and node sums; no node-by-node matrix.

    Symmetric: Dv^-1/2 H De^-1 H' Dv^-1/2; else Dv^-1 H De^-1 H'; with None both, as
    {value}_symmetric and {value}_asymmetric, from one pass. ``by`` holds separate
    hypergraphs apart.
    """
    by = by or []
    degree = inc.groupBy(*by, "node_id").agg(F.count(F.lit(1)).alias("deg"))
    x = inc.select(*by, "node_id", "edge_type", "edge_id", "edge_size").join(degree.join(signal, [c for c in signal.columns if c not in values]), [*by, "node_id"])
    modes = {"_symmetric": (1 / F.sqrt("deg"),) * 2, "_asymmetric": (F.lit(1.0), 1 / F.col("deg"))}
    if symmetric is not None:
        modes = {"": modes["_symmetric" if symmetric else "_asymmetric"]}
    means = [(F.sum(F.col(v) * before) / F.max("edge_size")).alias(v + name) for v in values for name, (before, _) in modes.items()]
    edge = x.groupBy(*by, "edge_type", "edge_id").agg(*means)
    back = inc.select(*by, "node_id", "edge_type", "edge_id").join(edge, [*by, "edge_type", "edge_id"]).join(degree, [*by, "node_id"])
    return back.groupBy(*by, "node_id").agg(*[F.sum(F.col(v + name) * after).alias(v + name) for v in values for name, (_, after) in modes.items()])


def diffuse(values: DataFrame, adjacency: DataFrame, key: str, cell: str, value: str, hops: int = 3) -> DataFrame:
    """x <- x / 2 + mean of the neighbours / 2 on a cell graph, ``hops`` times, for each key; absent values are zero.

    ``adjacency`` (cell, neighbour) must hold each cell's neighbours; its degree is
    taken over it. Columns hop_1 ... are returned for the cells of ``values``.
    """
    degree = adjacency.groupBy(cell).agg(F.count(F.lit(1)).alias("_deg"))
    out, x = values.select(key, cell, F.col(value).cast("double").alias("_x")), values.select(key, cell, F.col(value).cast("double").alias("_x"))
    wanted = values.select(key, cell)
    for hop in range(1, hops + 1):
        spread = x.where("_x != 0").withColumnRenamed(cell, "neighbour").join(adjacency, "neighbour").groupBy(key, cell).agg(F.sum("_x").alias("_s"))
        mean = spread.join(degree, cell).select(key, cell, (F.col("_s") / F.col("_deg") / 2).alias("_h"))
        x = x.select(key, cell, (F.col("_x") / 2).alias("_h")).unionByName(mean).groupBy(key, cell).agg(F.sum("_h").alias("_x"))
        wanted = wanted.join(x.withColumnRenamed("_x", f"hop_{hop}"), [key, cell], "left").fillna(0.0, [f"hop_{hop}"])
    return wanted


def co_occurrence(docs: DataFrame, themes: str, least: int = 2) -> DataFrame:
    """Documents in which two entries of the array occur together: theme_a < theme_b, weight."""
    each = docs.select(F.explode(pairs_of(F.col(themes))).alias("p"))
    pairs = each.groupBy(F.least("p.a", "p.b").alias("theme_a"), F.greatest("p.a", "p.b").alias("theme_b")).agg(F.count(F.lit(1)).alias("weight"))
    return pairs.where(F.col("weight") >= least)


def ppmi(edges: DataFrame) -> DataFrame:
    """Positive pointwise mutual information of the symmetrised weights."""
    both = edges.select("theme_a", "theme_b", "weight").unionByName(edges.select(F.col("theme_b").alias("theme_a"), F.col("theme_a").alias("theme_b"), "weight"))
    rows = both.groupBy("theme_a").agg(F.greatest(F.sum("weight"), F.lit(1)).alias("r"))
    total = both.agg(F.sum("weight").alias("t"))
    joined = both.join(rows, "theme_a").join(rows.select(F.col("theme_a").alias("theme_b"), F.col("r").alias("c")), "theme_b").crossJoin(F.broadcast(total))  # one row
    value = F.ln(F.col("weight") * F.col("t") / (F.col("r") * F.col("c")) + 1e-9)
    return joined.select("theme_a", "theme_b", value.alias("ppmi")).where("ppmi > 0")


def spread_labels(edges: DataFrame, nodes: DataFrame, alpha: float = 0.2, rounds: int = 5) -> DataFrame:
    """Label spreading on an undirected graph (u, w): node, prob of class 1.

    ``nodes`` has node and known (0, 1 or null). Each round F = alpha * S F + (1 - alpha) * Y
    with S the symmetrically normalised adjacency; at the end the two classes' shares,
    the rate of known labels where neither reaches a node. With fewer than ten known
    labels or one class the rate stands for all. The edges are computed once, whatever they come from.
    """
    known, pos = nodes.agg(F.count("known"), F.sum("known")).first()
    rate = float(pos or 0) / known if known else 0.0
    if known < 10 or not 0 < pos < known:
        return nodes.select("node", F.lit(rate).alias("prob"))
    edges = staged(edges.select("u", "w"))
    both = edges.union(edges.select("w", "u")).where("u != w").distinct()
    degree = both.groupBy("u").agg(F.count(F.lit(1)).cast("double").alias("deg"))
    step = both.join(degree, "u").join(degree.select(F.col("u").alias("w"), F.col("deg").alias("deg_w")), "w")
    step = staged(step.select("u", "w", (alpha / F.sqrt(F.col("deg") * F.col("deg_w"))).alias("s")))  # read by every round
    start = nodes.select(F.col("node").alias("u"), *[F.when(F.col("known") == c, 1 - alpha).otherwise(0.0).alias(f"y{c}") for c in (0, 1)])
    state = start.select("u", F.col("y0").alias("f0"), F.col("y1").alias("f1"))
    for _ in range(rounds):
        moved = step.join(state.withColumnRenamed("u", "w"), "w").groupBy("u").agg(*[F.sum(F.col("s") * F.col(f"f{c}")).alias(f"g{c}") for c in (0, 1)])
        state = start.join(moved, "u", "left").select("u", *[(F.col(f"y{c}") + F.coalesce(f"g{c}", F.lit(0.0))).alias(f"f{c}") for c in (0, 1)])
    total = F.col("f0") + F.col("f1")
    return state.select(F.col("u").alias("node"), F.when(total > 0, F.col("f1") / total).otherwise(rate).alias("prob"))
