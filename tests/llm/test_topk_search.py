import math
import random

import pytest

from ewpanel.llm.topk_search import top_k


def brute(rows, asks, k):
    good = lambda v: v is not None and all(x is not None and math.isfinite(x) for x in v)
    ints = [(i, [max(-(1 << 63), min((1 << 63) - 1, math.floor(1024 * x))) for x in v]) for i, v in rows if i is not None and good(v)]
    out = []
    queries = {}
    for i, v in ints:
        if asks(i):
            queries[i] = min(v, queries.get(i, v))
    for i, v in queries.items():
        own = sorted((-max(-(1 << 63), min((1 << 63) - 1, sum(a * b for a, b in zip(v, w)))), j) for j, w in ints if j != i)[:k]
        out += [(i, r + 1, j, -s) for r, (s, j) in enumerate(own)]
    return sorted(out)


@pytest.mark.parametrize("n, dims, k", [(700, 64, 10), (5, 3, 10), (300, 40, 7)])
def test_against_all_pairs(spark, n, dims, k):
    rng = random.Random(n)
    rows = [(i, [rng.gauss(0, 1) / dims**0.5 for _ in range(dims)]) for i in range(n)]
    rows += [(i + n, rows[i % len(rows)][1]) for i in range(n // 4)]  # ties
    rows += [(None, rows[0][1]), (10_000, None), (10_100, [None] * dims), (10_200, [float("nan")] * dims), (10_300, [float("inf")] * dims),
             (10_400, []), (10_500, [0.5]), (0, rows[0][1]), (200, [0.25] * dims)]
    df = spark.createDataFrame([(i, v, 1) for i, v in rows], "vec_id long, embedding array<double>, id int")
    got = top_k(df, df.where("vec_id % 100 = 0"), k=k, slab=4)
    assert got.columns == ["query_id", "rank", "vec_id", "score"] and dict(got.dtypes)["rank"] == "int"
    assert sorted(map(tuple, got.collect())) == brute(rows, lambda i: i % 100 == 0, k)


def test_huge_components_and_empty(spark):
    rows = [(i, [1e12 * (i + 1), -3e9 * i, 1.0]) for i in range(0, 20)] + [(100, [1e30, 1.0, 1.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    assert sorted(map(tuple, top_k(df, df.where("vec_id % 100 = 0"), k=5).collect())) == brute(rows, lambda i: i % 100 == 0, 5)
    assert top_k(df.limit(0), df.limit(0)).count() == 0
    assert top_k(df, df.limit(0)).count() == 0
