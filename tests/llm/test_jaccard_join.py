import random
import re

import numpy as np
import pytest

from ewpanel.llm.components import components
from ewpanel.llm.jaccard_join import jaccard_components


def sets_of(text, width):
    words = [w for w in re.split(r"[\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")) if w]
    return {tuple(words[i : i + width]) for i in range(max(1, len(words) - width + 1))} if words else set()


def brute(rows, width, percent):
    sets = [sets_of(t, width) for _, t in rows]
    top = list(range(len(rows)))

    def find(i):
        while top[i] != i:
            i = top[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 100 * both >= percent * len(sets[i] | sets[j]):
                top[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[find(i)] = min(d, least.get(find(i), d))
    return sorted((str(d), len(sets[i]), str(least.get(find(i)) if sets[i] else d)) for i, (d, _) in enumerate(rows))


def check(spark, rows, width, percent):
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted((str(r.doc_id), r.n_shingles, str(r.component_id)) for r in jaccard_components(df, width, percent).collect())
    assert got == brute(rows, width, percent)


@pytest.mark.parametrize("seed", [1, 2])
def test_against_all_pairs(spark, seed):
    """Chains of near copies around a few texts of several lengths, many of them close to the threshold."""
    rng, rows = random.Random(seed), []
    vocabulary = [f"w{i}" for i in range(60)]
    for n in (3, 5, 9, 40, 120, 400):
        base = rng.choices(vocabulary, k=n)
        for _ in range(60):
            words = base[:] if rng.random() < 0.7 else rng.choice([r for _, r in rows[-20:]] or [base]).split() if rows else base[:]
            for _ in range(rng.choice([0, 0, 1, 2, 3, 4, n // 20, n // 15])):
                at = rng.randrange(len(words))
                words[at : at + rng.choice([0, 1])] = [rng.choice(vocabulary)]
            rows.append((len(rows) * 7 % 1000, " ".join(words)))
    check(spark, rows, 4, 85)


def test_hot_group_is_compared_around_its_centre(spark):
    """One text with hundreds of edited copies that are not all linked with the smallest."""
    rng = random.Random(5)
    base = [f"t{i}" for i in range(150)]
    rows = []
    for i in range(400):
        words = base[:]
        for _ in range(rng.choice([1, 2, 3, 4, 5])):
            words[rng.randrange(len(words))] = f"n{rng.randrange(40)}"
        rows.append((i, " ".join(words)))
    check(spark, rows, 4, 85)


def test_odd_rows(spark, odd_docs):
    rows = [(r.doc_id, r.text) for r in odd_docs.collect()]
    check(spark, rows, 4, 85)
    check(spark, rows, 5, 80)
    assert jaccard_components(odd_docs.limit(0)).count() == 0


def test_components(spark):
    rng = random.Random(3)
    edges = [(i, i + 1) for i in range(100, 160)] + [(200, 200), (7, 5), (5, 7), (5, 6)] + [(rng.randrange(1000, 1400), rng.randrange(1000, 1400)) for _ in range(250)]
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    top = {n: n for e in edges for n in e}

    def find(i):
        while top[i] != i:
            i = top[i]
        return i

    for a, b in edges:
        x, y = find(a), find(b)
        top[max(x, y)] = min(x, y)
    assert got == {n: find(n) for a, b in edges if a != b for n in (a, b)}


@pytest.mark.parametrize("n, percent", [(4, 80), (5, 80), (10, 85), (20, 80), (300, 80)])
def test_unrelated_sets_share_no_bucket(n, percent):
    from collections import Counter

    from ewpanel.llm.jaccard_join import Bands

    rng, bands, times = np.random.default_rng(n), Bands(percent), Counter()
    for _ in range(20_000 // n):
        times.update(bands.keys(np.unique(rng.integers(0, 1 << 63, n).astype(np.uint64) * np.uint64(2))).tolist())
    assert max(times.values()) <= 2


@pytest.mark.parametrize("percent", [50, 80, 85])
def test_linked_sets_share_a_key(percent):
    from ewpanel.llm.jaccard_join import Bands

    rng, bands, linked = np.random.default_rng(percent), Bands(percent), 0
    for _ in range(4000):
        n, m = int(rng.integers(1, 40)), int(rng.integers(0, 8))
        a = np.unique(rng.integers(0, 1 << 63, n).astype(np.uint64) * np.uint64(2))
        b = np.unique(np.append(a[rng.random(len(a)) < 0.95], rng.integers(0, 1 << 63, m // 3).astype(np.uint64)))
        both = len(np.intersect1d(a, b))
        if len(b) and 100 * both >= percent * (len(a) + len(b) - both):
            linked += 1
            assert np.intersect1d(bands.keys(a), bands.keys(b)).size
    assert linked > 500
