import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from ewpanel.llm.language_id import SEGMENT, CrossParser, fit_samples, held_out, identify

SF = "/root/testdata/sf0.01"


def reduce_text(text):
    out = ""
    for c in text:
        c = c.lower() if c.isalpha() else " "
        if c != " " or (out and out[-1] != " "):
            out += c
    return out


def phrases(text, sample):
    """Longest matches by substring search."""
    count, i = 0, 0
    while i < len(text):
        n = 1
        while i + n < len(text) and text[i : i + n] in sample and text[i : i + n + 1] in sample:
            n += 1
        count, i = count + 1, i + n
    return count


def test_costs_against_substring_search():
    samples = {"a": "the quick brown fox jumps over the lazy dog and runs away from the bear " * 2, "b": "le renard brun saute par dessus le chien paresseux et s'enfuit de l'ours"}
    parser = CrossParser(samples)
    texts = ["The quick dog", "renard!! brun", "", None, "123 --", "zzz", "été ß 日本", "the lazy dog and the brown bear jumps " * 40]
    costs, has = parser.costs(pa.array(texts, pa.string()))
    assert has.tolist() == [True, True, False, False, False, True, True, True]
    for t, row in zip(texts, costs):
        r = reduce_text(t or "")
        for k, name in enumerate(parser.names):
            sample = reduce_text(samples[name])
            want = sum(phrases(r[a : a + SEGMENT], sample) for a in range(0, len(r), SEGMENT)) * np.log2(len(sample)) / max(1, len(r))
            assert abs(row[k] - want) < 1e-9


def test_held_out_accuracy(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").withColumn("held_out", held_out(F.col("doc_id")))
    got = identify(docs, fit_samples(docs.where("not held_out")))
    right, n = got.where("held_out").select(F.avg((F.col("lang") == F.col("lang_pred")).cast("double")), F.count("*")).first()
    assert n > 100 and right >= 0.97


def test_odd_rows(spark, odd_docs):
    got = {(r.doc_id, r.text): (r.lang_pred, r.score) for r in identify(odd_docs, {"en": "a word is a word"}).collect()}
    assert got[(3, None)] == ("und", 0.0) and got[(8, "***")] == ("und", 0.0) and got[(4, "")] == ("und", 0.0)
    assert got[(1, "a b c")] == ("en", 1.0)
    assert {r.lang_pred for r in identify(odd_docs, {}).collect()} == {"und"}
    assert identify(odd_docs.limit(0), {"en": "x"}).count() == 0
    assert fit_samples(odd_docs.withColumn("lang", F.lit(None).cast("string"))) == {}
    assert set(fit_samples(odd_docs.withColumn("lang", F.lit("q")))) == {"q"}
