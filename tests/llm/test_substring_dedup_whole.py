import random

from pyspark.sql import functions as F

from ewpanel.llm.substring_dedup import runs, substring_dedup

WORDS = [f"w{i}x" for i in range(2000)]
VERSE = [" ".join(f"v{i}{k}" for k in range(4)) for i in range(16)]
PASSAGES = {
    "short lines": "".join(x + "\n" for x in VERSE),
    "indented": "".join(x + "\n    " for x in VERSE),
    "two spaces": "".join(" ".join(VERSE[i : i + 3]) + ".  " for i in range(0, 15, 3)),
    "closing quotes": "".join("“" + " ".join(VERSE[i : i + 3]) + ".” " for i in range(0, 15, 3)),
    "brackets": "".join("(" + " ".join(VERSE[i : i + 3]) + "!) " for i in range(0, 15, 3)),
    "devanagari": "".join("यह एक " + x + "। " for x in VERSE),
    "arabic": "".join("هذا " + x + "؟ " for x in VERSE),
    "ideographic": "".join(chr(0x4E00 + 31 * i) + "語日本文章試験中" + chr(0x5E00 + 17 * i) + "。" for i in range(16)),
    "one long sentence": " ".join(VERSE) + ". ",
    "short end": " ".join(VERSE) + ". Yes. No. ",
}
PASSAGES = {k: v.replace("v", f"k{n}v") for n, (k, v) in enumerate(PASSAGES.items())}  # no kind repeats another's words


def test_repeated_passages_go(spark):
    kinds, rng, rows = list(PASSAGES), random.Random(6), []
    for k in kinds:
        for _ in range(2):
            text = lambda: " ".join(rng.choices(WORDS, k=30)) + ". "
            rows.append((len(rows), text() + PASSAGES[k] + text()))
    got = {r.doc_id: r for r in substring_dedup(spark.createDataFrame(rows, "doc_id long, text string"), whole=True).collect()}
    for n, k in enumerate(kinds):
        one, two = got[2 * n], got[2 * n + 1]
        assert one.text == rows[2 * n][1] and one.n_removed == 0, k
        before, after = rows[2 * n + 1][1].split(PASSAGES[k])
        assert two.text == before + after, k


def test_runs_cover_every_passage():
    rng = random.Random(7)
    for _ in range(300):
        inside = [rng.choice([0, 1, 2, 3, 5, 11, 12, 30]) for _ in range(rng.randrange(2, 30))]
        if sum(inside) < 50:
            continue
        left, right = ([rng.randrange(20) for _ in range(rng.randrange(5))] for _ in "ab")
        a, b = len(left), len(left) + len(inside)
        covered = {p for i, j in runs(left + inside + right, 2, 12) if a <= i and j < b for p in range(i, j + 1)}
        assert covered == set(range(a, b))


def test_odd_rows_whole(spark, odd_docs):
    rows = substring_dedup(odd_docs, whole=True).collect()
    assert len(rows) == odd_docs.count() and not any(r.n_removed for r in rows)
    assert {(r.text, r.n_sentences) for r in rows if r.doc_id in (3, 4)} == {(None, 0), ("", 1)}
    assert substring_dedup(odd_docs.limit(0), whole=True).count() == 0


def test_sentences_are_those_of_the_plain_pattern(spark):
    """The pattern that passes over what can't end a sentence cuts as the one that tries every end at every character."""
    from ewpanel.llm import substring_dedup as module

    plain = rf"(?s).*?(?:[.!?]{module.CLOSING}{module.BLANK}+|{module.STOPS}+{module.CLOSING}{module.BLANK}*|\n{module.BLANK}*)|.+"
    rng = random.Random(5)
    signs = ["a", "é", "ж", "語", "ك", " ", "\u00a0", "\u3000", "\x85", "\t", "\n", "\r", ".", "!", "?", "…", "。", "！", "؟", "।", "։", "｡", ")", "”", "»", "'", '"', "*", "_", "3", "-", "\U0001f600"]
    texts = ["", ".", "\n", "...", "a" * 100_000, "." * 100_000, "。" * 100_000, "3.14 " * 30_000] + ["".join(rng.choices(signs, k=rng.randrange(1, 60))) for _ in range(4000)]
    df = spark.createDataFrame([(t,) for t in texts], "text string").repartition(4)
    want = F.when(F.col("text") == "", F.array(F.lit(""))).otherwise(F.regexp_extract_all("text", F.lit(plain), F.lit(0)))
    got = df.select((module.sentences(F.col("text"), True) == want).alias("same"), (F.array_join(module.sentences(F.col("text"), True), "") == F.col("text")).alias("whole"))
    assert got.where("not same or not whole").count() == 0
