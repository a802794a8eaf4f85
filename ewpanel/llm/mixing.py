"""Mixing sources to target weights by a multivariate-hypergeometric splitting tree."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ewpanel.llm.common import fresh_names, stage_table

WORD = r"[^\x20\x09-\x0D]+"
BLOCKS = 4096  # of a source at most
GROUPS = 1024  # of sources, dealt by the top of the tree
WEIGHTS = (5, 2, 1)


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = 3) -> DataFrame:
    """source, docs, source_size, target for each source of ``sizes`` (source, size).

    Sources by code point, null last, have the weights in turn and share the sum of
    all sizes. A target stops at ``most`` times its source's size, the excess is
    shared anew by weight until none is above. The source table stays in Spark; each
    round brings three sums to the driver.
    """
    table = sizes.groupBy("source").agg(F.count(F.lit(1)).alias("docs"), F.sum("size").alias("source_size"))
    # the position of a source: ranges in order, then a running number in each range
    table = stage_table(table.repartitionByRange(F.col("source").asc_nulls_last()).sortWithinPartitions(F.col("source").asc_nulls_last())
                        .select("*", F.spark_partition_id().alias("part"), F.monotonically_increasing_id().alias("own")), "sources")
    counts = {r.part: r["count"] for r in table.groupBy("part").count().collect()}
    before, starts = 0, {}
    for part in sorted(counts):
        starts[part], before = before, before + counts[part]
    if not starts:
        return table.select("source", "docs", "source_size", F.lit(0.0).alias("target"))
    start = F.element_at(F.create_map(*[F.lit(x) for kv in starts.items() for x in kv]), F.col("part"))
    place = (start + F.col("own").bitwiseAND(F.lit((1 << 33) - 1))) % len(weights)
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (place + 1).cast("int"))
    table = stage_table(table.select("source", "docs", "source_size", weight.alias("weight")), "weighted-sources")

    total = table.agg(F.sum("source_size")).first()[0] or 0
    per_weight = 0.0
    while True:  # at most as many rounds as there are steps of a source to its limit
        capped = F.col("source_size") * most <= F.lit(per_weight) * F.col("weight")
        fixed, open_weight = table.agg(F.sum(F.when(capped, F.col("source_size") * most).otherwise(0)), F.sum(F.when(capped, 0.0).otherwise(F.col("weight")))).first()
        new = (total - fixed) / open_weight if open_weight else per_weight
        if new <= per_weight:
            break
        per_weight = new
    return table.select("source", "docs", "source_size", F.least(F.lit(per_weight) * F.col("weight"), (F.col("source_size") * most).cast("double")).alias("target"))


def _draw_blocks(seed: int, most: int):
    """For one source (at most BLOCKS rows): how often each block is taken, and the order of its draws."""
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        key, whole, target = int(pdf["key"].iloc[0]), int(pdf["source_size"].iloc[0]), float(pdf["target"].iloc[0])
        pdf = pdf.sort_values("block")
        order = np.random.default_rng([seed, key & 0x7FFFFFFF]).permutation(len(pdf))
        blocks, sizes = pdf["block"].to_numpy()[order], pdf["block_size"].to_numpy()[order].astype(np.int64)
        passes = int(target // whole) if whole else 0
        gap = target - passes * whole
        extra = np.zeros(len(blocks), bool)
        for i, s in enumerate(sizes.tolist()):  # whole blocks in permuted order, each that still fits
            if 0 < s <= gap:
                extra[i] = True
                gap -= s
        times = passes + extra.astype(np.int64)
        for _ in range(64):  # whole blocks exchanged for others while that brings the words nearer
            more, less = np.flatnonzero((times < most) & (sizes > 0)), np.flatnonzero((times > 0) & (sizes > 0))
            more = more[np.argsort(sizes[more], kind="stable")]
            add, drop = np.append(0, sizes[more]), np.append(0, sizes[less])
            at = np.searchsorted(add, gap + drop)
            pairs = np.stack([np.clip(at - 1, 0, len(add) - 1), np.clip(at, 0, len(add) - 1)])
            left = np.abs(gap + drop[None, :] - add[pairs])
            side, d = np.unravel_index(left.argmin(), left.shape)
            if left[side, d] >= abs(gap):
                break
            a = pairs[side, d]
            gap += float(drop[d] - add[a])
            if d:
                times[less[d - 1]] -= 1
            if a:
                times[more[a - 1]] += 1
        units = [(b, p) for p in range(most) for b in blocks[times > p].tolist()]
        out = pd.DataFrame(units, columns=["block", "pass"])
        out["key"], out["unit"] = key, np.arange(len(out))
        return out.astype({"key": "int64", "block": "int64", "pass": "int64", "unit": "int64"})[["key", "block", "pass", "unit"]]

    return run


def multivariate_draw(counts: np.ndarray, need: int, rng: np.random.Generator) -> np.ndarray:
    """How many of ``need`` draws without replacement fall on each source of ``counts``, one source after another."""
    drawn, rest = np.zeros_like(counts), int(counts.sum())
    for k, c in enumerate(counts.tolist()):
        if need:
            drawn[k] = rng.hypergeometric(c, rest - c, need) if rest > c else need
            need -= int(drawn[k])
        rest -= c
    return drawn


def split_quotas(counts: np.ndarray, shards: int, rng: np.random.Generator) -> np.ndarray:
    """Quotas [shard, source] whose column sums are ``counts``.

    A node of the tree gives its left half of the shards a multivariate
    hypergeometric draw of its blocks, the right half the others; shard sizes differ
    by at most one block.
    """
    if shards == 1:
        return counts[None, :]
    left = shards // 2
    drawn = multivariate_draw(counts, int(counts.sum()) * left // shards, rng)
    return np.vstack([split_quotas(drawn, left, rng), split_quotas(counts - drawn, shards - left, rng)])


def mix_plan(docs: DataFrame, seed: int = 17, shards: int = 64, weights: tuple[int, ...] = WEIGHTS, most: int = 3,
             id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> tuple[DataFrame, DataFrame]:
    """The documents' narrow table and the draws of their blocks.

    The first has id, source, size (words), text_hash, source_size, target, key (of the
    source) and block; the second key, block, pass and shard: a row for each time a
    block is taken.

    A source's documents are dealt by a hash of id and text to at most 4,096 blocks;
    block totals are grouped sums. Each source takes all its blocks as often as its
    target holds it whole, and then, in a seeded permutation, the blocks that still
    fit; a few exchanges of single blocks bring its words nearer to the target. The splitting
    tree deals exact quotas of block draws to the shards and each source's permuted
    draws fill its quotas one after another, so shards hold disjoint draws. Tasks that
    see a source whole see at most 4,096 block totals; the top of the tree sees a number
    for each of at most 1,024 groups of sources, and each group a number for each of its
    own. Same input, same seed, same plan.
    """
    spark = docs.sparkSession
    text = F.col(text_col).cast("string")
    sized = stage_table(docs.select(
        F.col(id_col).alias("id"), F.col(source_col).cast("string").alias("source"), F.xxhash64(text).alias("text_hash"),
        F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long").alias("size")), "sizes")
    targets = stage_table(source_targets(sized, weights, most).withColumn("key", F.xxhash64(F.col("source").isNull(), "source")), "targets")
    placed = sized.join(targets, sized.source.eqNullSafe(targets.source)).select("id", sized.source, "size", "text_hash", "source_size", "target", "key", "docs")
    blocks = F.least(F.lit(BLOCKS).cast("long"), F.col("docs") * 4)
    placed = stage_table(placed.withColumn("block", F.pmod(F.xxhash64(F.lit(seed), "id", "text_hash"), blocks)), "placed")
    totals = placed.groupBy("key", "block").agg(F.sum("size").alias("block_size"))
    totals = stage_table(totals.join(targets.select("key", "source_size", "target"), "key"), "blocks")
    units = stage_table(totals.groupBy("key").applyInPandas(_draw_blocks(seed, most), "key long, block long, pass long, unit long"), "draws")

    # the top of the tree deals the quotas of groups of sources, each group then deals its own to its sources
    def over_groups(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("part")
        quotas = split_quotas(pdf["n"].to_numpy(np.int64), shards, np.random.default_rng(seed))
        return pd.DataFrame({"part": pdf["part"].to_numpy(), "quota": list(quotas.T.tolist())})

    def over_sources(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("key")
        rng = np.random.default_rng([seed, int(pdf["part"].iloc[0])])
        left, rows = pdf["n"].to_numpy(np.int64).copy(), []
        for q in pdf["quota"].iloc[0]:
            rows.append(multivariate_draw(left, int(q), rng))
            left -= rows[-1]
        return pd.DataFrame({"key": pdf["key"].to_numpy(), "ends": np.cumsum(np.array(rows), axis=0).T.tolist()})

    counts = stage_table(units.groupBy("key").agg(F.count(F.lit(1)).alias("n")).withColumn("part", F.pmod(F.xxhash64("key"), F.lit(GROUPS))), "draw-counts")
    top = counts.groupBy("part").agg(F.sum("n").alias("n"))  # GROUPS rows at most
    top = stage_table(top.withColumn("all", F.lit(1)).groupBy("all").applyInPandas(lambda pdf: over_groups(pdf), "part long, quota array<long>"), "group-quotas")
    quotas = stage_table(counts.join(top, "part").groupBy("part").applyInPandas(over_sources, "key long, ends array<long>"), "quotas")
    shard = F.size(F.filter("ends", lambda e: e <= F.col("unit"))).alias("shard")
    return placed, stage_table(units.join(quotas, "key").select("key", "block", "pass", shard), "plan")


def taken_words(docs: DataFrame, **options) -> DataFrame:
    """A row for each document: id, size, source_size, target, taken (the words the mix takes of it, repeats counted) and the shards that hold it.

    Null texts have size 0 and are taken 0 words; a null source is a source; sources
    without words have target 0. Repeated rows share a block and are each taken. An
    empty table gives an empty result.
    """
    placed, plan = mix_plan(docs, **options)
    times = plan.groupBy("key", "block").agg(F.sort_array(F.collect_list("shard")).alias("shards"))  # at most ``most`` entries
    shards = F.coalesce("shards", F.array().cast("array<int>"))
    return placed.join(stage_table(times, "times"), ["key", "block"], "left").select(
        "id", "size", "source_size", "target", (F.col("size") * F.size(shards)).alias("taken"), F.when(F.col("size") > 0, shards).otherwise(F.array().cast("array<int>")).alias("shards"))


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", seed: int = 17, **options) -> DataFrame:
    """The mixed corpus: the columns of ``docs`` plus mix_shard and mix_order, a row for each time a document is taken.

    Within a shard mix_order is a seeded hash order: sorting by it shuffles the
    shard locally. Documents without words are not taken. Null ids and sources are values
    like others; repeated rows are each taken as often as their block. mix_shard and mix_order replace columns of
    these names, all others stay, whatever their names. An empty table gives an empty result.
    """
    placed, plan = mix_plan(docs, seed=seed, id_col=id_col, text_col=text_col, source_col=source_col, **options)
    drawn = placed.where("size > 0").select("id", "text_hash", "source", "key", "block").distinct().join(plan, ["key", "block"])
    own_id, own_hash, own_source = fresh_names(docs, "_id", "_hash", "_source")
    drawn = stage_table(drawn.select(F.col("id").alias(own_id), F.col("text_hash").alias(own_hash), F.col("source").alias(own_source), F.col("shard").alias("mix_shard"),
                                     F.xxhash64(F.lit(seed), "id", "text_hash", "pass").alias("mix_order")), "drawn")
    on = docs[id_col].eqNullSafe(F.col(own_id)) & (F.xxhash64(docs[text_col].cast("string")) == F.col(own_hash)) & docs[source_col].cast("string").eqNullSafe(F.col(own_source))
    return docs.drop("mix_shard", "mix_order").join(drawn, on).drop(own_id, own_hash, own_source)
