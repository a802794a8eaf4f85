from ewpanel.llm import jaccard_join as jj
from ewpanel.llm.common import Stages

from test_jaccard_join import check


def test_repeated_rows_do_not_multiply_tokens_or_pairs(spark, monkeypatch):
    """Chains c - x - y where y is not near c, every document in many rows: each set has its tokens once, each pair its row once."""
    rows_of, table = {}, Stages.table

    def counted(self, df, name, *rest):
        out = table(self, df, name, *rest)
        key = {"tokens": ["fp"], "screened": ["c", "x"], "around-1": ["c", "x"], "verified-nearest": ["c", "x"], "verified-rest-1": ["c", "x"], "verified-rest-2": ["c", "x"]}.get(name)
        if key:
            rows_of.setdefault(name, []).append((out.count(), out.select(*key).distinct().count()))
        return out

    monkeypatch.setattr(Stages, "table", counted)
    rows = []
    for k in range(8):
        words = [f"{k}t{i}" for i in range(120)]
        for step in range(4):
            words = words[:]
            for i in range(2):
                words[10 + 20 * step + 9 * i] = f"{k}n{step}{i}"
            rows += [(10 * k + step, " ".join(words))] * 6
    check(spark, rows, 5, 80)
    assert len(rows_of["tokens"]) >= 1 and rows_of["around-1"][0][0] > rows_of["screened"][0][0] > 0
    assert all(n == different for found in rows_of.values() for n, different in found)
    assert jj.BLOCK > 1


def test_lower_similarity_looks_into_every_band(spark):
    """Below 63 percent a partner can lie two size bands further."""
    rows = [(i, " ".join(f"w{k}" for k in range(n))) for i, n in enumerate((2, 4, 5, 7, 9, 14, 20, 33, 60))]
    check(spark, rows, 1, 50)
    check(spark, rows, 1, 60)


def test_many_blocks_around_a_centre(spark, monkeypatch):
    """Sets around one centre that are dealt to several blocks are all compared."""
    import random

    monkeypatch.setattr(jj, "BLOCK", 8)
    rng, rows = random.Random(11), []
    base = [f"t{i}" for i in range(100)]
    for i in range(150):
        words = base[:]
        for _ in range(rng.choice([1, 4, 5, 6])):
            words[rng.randrange(len(words))] = f"n{rng.randrange(30)}"
        rows.append((i, " ".join(words)))
    check(spark, rows, 4, 85)
