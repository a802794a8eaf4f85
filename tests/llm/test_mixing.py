from collections import defaultdict

import numpy as np
from pyspark.sql import functions as F

from ewpanel.llm.mixing import mix, mix_plan, split_quotas, taken_words

SF = "/root/testdata/sf0.01"


def wanted_targets(sizes):
    """Water filling by repeated resharing."""
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode("utf-32-be")) + [None] * (None in sizes)
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    total, full = sum(sizes.values()), {s for s in names if not sizes[s]}
    while True:
        open_ = [s for s in names if s not in full]
        if not open_:
            return {s: 3.0 * sizes[s] for s in names}
        per = (total - sum(3 * sizes[s] for s in full)) / sum(weight[s] for s in open_)
        more = {s for s in open_ if 3 * sizes[s] < per * weight[s]}
        if not more:
            return {s: 3.0 * sizes[s] if s in full else per * weight[s] for s in names}
        full |= more


def test_targets_and_taken_words(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    docs = docs.withColumn("source", F.when(F.col("doc_id") % 17 == 0, None).when(F.col("doc_id") % 3 == 0, "hot").otherwise(F.col("source")))
    rows = taken_words(docs).collect()
    assert sorted(map(str, rows)) == sorted(map(str, taken_words(docs.repartition(7)).collect()))
    words = {r.doc_id: len((r.text or "").split()) for r in docs.collect()}
    source = {r.doc_id: r.source for r in docs.collect()}
    sizes, taken, targets = defaultdict(int), defaultdict(int), {}
    for r in rows:
        assert r["size"] == words[r.id] and r.taken % max(1, r["size"]) == 0 and r.taken <= 3 * r["size"]
        sizes[source[r.id]] += r["size"]
        taken[source[r.id]] += r.taken
        targets[source[r.id]] = r.target
    want = wanted_targets(sizes)
    for s in sizes:
        assert abs(targets[s] - want[s]) < 1e-6 * max(1, want[s])
        assert abs(taken[s] - want[s]) <= 0.01 * want[s] + 5
    assert len(rows) == docs.count()


def test_mix_has_the_planned_words_in_even_shards(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    mixed = mix(docs, shards=5).select("doc_id", "text", "mix_shard", "mix_order").collect()
    times = defaultdict(int)
    for r in mixed:
        times[r.doc_id] += 1
    plan = {r.id: r.taken // r["size"] if r["size"] else 0 for r in taken_words(docs, shards=5).collect()}
    assert {k: v for k, v in plan.items() if v} == dict(times)
    _, draws = mix_plan(docs, shards=5)
    n = [r["count"] for r in draws.groupBy("shard").count().collect()]
    assert len(n) == 5 and max(n) - min(n) <= 5


def test_tree_keeps_exact_quotas():
    counts = np.array([1000, 3, 0, 57, 400])
    q = split_quotas(counts, 7, np.random.default_rng(1))
    assert (q.sum(0) == counts).all() and (q >= 0).all()
    assert q.sum(1).max() - q.sum(1).min() <= 3
    mean = np.mean([split_quotas(counts, 4, np.random.default_rng(s))[2] for s in range(300)], axis=0)
    assert np.abs(mean - counts / 4).max() < 3


def test_odd_rows(spark, odd_docs):
    docs = odd_docs.withColumn("source", F.when(F.col("doc_id") > 3, F.col("row")))
    rows = taken_words(docs).collect()
    assert len(rows) == docs.count() and all(r.taken <= 3 * r["size"] for r in rows)
    assert set(mix(docs).columns) == {"doc_id", "text", "row", "source", "mix_shard", "mix_order"}
    assert mix(docs).where("text is null").count() == 0
    assert taken_words(docs.limit(0)).count() == 0 and mix(docs.limit(0)).count() == 0
