"""Components in rounds and link by link against a union of sets."""

import random

import pytest

from ewpanel.llm.common import Stages
from ewpanel.llm.components import components, more_links


def joined(edges):
    least = {}

    def find(x):
        while least.setdefault(x, x) != x:
            x = least[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        least[max(a, b)] = min(a, b)
    return {n: find(n) for n in list(least)}


@pytest.mark.parametrize("kind", ["chain", "random", "star", "cycle"])
def test_components(spark, kind):
    rng = random.Random(kind)
    names = rng.sample(range(-500, 500), 60)
    edges = {"chain": list(zip(names, names[1:])), "random": [tuple(rng.choices(names, k=2)) for _ in range(45)], "star": [(names[0], n) for n in names[1:]], "cycle": list(zip(names, names[1:] + names[:1]))}[kind]
    want = {n: c for n, c in joined(edges).items() if any(n in e and e[0] != e[1] for e in edges)}
    df = spark.createDataFrame(edges, "a long, b long")
    assert {r.node: r.component for r in components(df).collect()} == want
    half = len(edges) // 2
    some = components(df.limit(half)) if half else None
    first = {r.node: r.component for r in components(spark.createDataFrame(edges[:half], "a long, b long")).collect()}
    assert len(first) and some is not None
    stages = Stages(spark)
    rest = spark.createDataFrame(edges[half:], "a long, b long")
    got = more_links(spark.createDataFrame(list(first.items()), "node long, component long"), rest, stages, "nodes")
    assert {r.node: r.component for r in got.collect() if r.node in want} == want


def test_no_edges(spark):
    none = spark.createDataFrame([(1, 1), (None, 2)], "a long, b long")
    assert components(none).count() == 0
