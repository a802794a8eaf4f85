"""The registered queries: those with SQL against DuckDB, the others by what their contracts say of the rows."""

import zlib

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from ewpanel.llm.queries import ORACLE_SQL, QUERIES

SF = "/root/testdata/sf0.001"
WHITE = " \t\n\v\f\r"


@pytest.fixture(scope="module")
def documents(spark):
    return {r.doc_id: r for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query_equals_its_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "embeddings", "pages"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    want = con.execute(ORACLE_SQL[name])
    columns = sorted(c[0] for c in want.description)
    place = [[c[0] for c in want.description].index(c) for c in columns]
    got = QUERIES[name](spark, SF).select(*columns).collect()
    assert sorted(map(str, map(tuple, got))) == sorted(str(tuple(r[i] for i in place)) for r in want.fetchall())


def words(text):
    for c in WHITE:
        text = (text or "").replace(c, " ")
    return [w for w in text.split(" ") if w]


def test_packing_covers_every_document(spark, documents):
    rows = QUERIES["op4_packing"](spark, SF).collect()
    by, sequences = {}, {}
    for r in rows:
        by.setdefault(r.doc_id, []).append(r)
        sequences.setdefault(r.sequence_id, []).append(r)
    assert by.keys() == documents.keys()
    for pieces in by.values():
        pieces.sort(key=lambda r: r.start)
        assert [r.start for r in pieces] == np.cumsum([0, *(r.length for r in pieces[:-1])]).tolist()
        assert sum(r.length for r in pieces) == pieces[0].doc_tokens
    for pieces in sequences.values():
        pieces.sort(key=lambda r: r.offset)
        assert [r.offset for r in pieces] == np.cumsum([0, *(r.length for r in pieces[:-1])]).tolist()
        assert sum(r.length for r in pieces) <= 4096


def test_mixing_counts_words_and_shards(spark, documents):
    for r in QUERIES["op5_mixing"](spark, SF).collect():
        assert r["size"] == len(words(documents[r.doc_id].text)) and r.taken <= 3 * r["size"]
        assert r.taken == r["size"] * len(r.shards)


def test_language_and_held_out(spark, documents):
    rows = QUERIES["op8_language_id"](spark, SF).collect()
    assert {r.doc_id for r in rows} == documents.keys() and all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and 0 <= r.score <= 1 for r in rows)
    known = [r for r in rows if r.held_out and documents[r.doc_id].lang]
    assert sum(r.lang_pred == documents[r.doc_id].lang for r in known) >= 0.95 * len(known)


def test_token_files_come_back_in_order(spark, documents):
    rows = sorted(QUERIES["op10_token_files"](spark, SF).collect(), key=lambda r: r.doc_id)
    assert [r.doc_id for r in rows] == sorted(documents) and [r.start for r in rows] == np.cumsum([0, *(r.n_tokens for r in rows[:-1])]).tolist()


@pytest.mark.parametrize("name", ["op3_substring_dedup", "op7_line_dedup"])
def test_dedup_returns_every_document_with_lines_of_its_own(spark, documents, name):
    rows = QUERIES[name](spark, SF).collect()
    assert {r.doc_id for r in rows} == documents.keys()
    for r in rows:
        text = documents[r.doc_id].text
        assert (r.text is None) == (text is None) and len(r.text or "") <= len(text or "") and (r.n_removed > 0 or r.text == text)


def test_no_digest_table_stays(spark):
    there = lambda: {t.name for t in spark.catalog.listTables() if t.name.startswith("ewpanel_digests")}
    before = there()
    QUERIES["op2_exact_dedup"](spark, SF).collect()
    assert there() == before


def test_second_batch_meets_the_index_without_a_shuffle_of_it(spark):
    from ewpanel.llm.exact_dedup import DigestIndex, dedup

    index = DigestIndex(spark, buckets=4)
    df = spark.createDataFrame([(i, f"text {i % 6}") for i in range(20)], "doc_id long, text string")
    got = {r.doc_id: (r.keep_id, r.group_size, r.kept) for r in dedup(df, index, cuts=(4, 9)).collect()}
    assert got == {i: (i % 6, 4 if i % 6 < 2 else 3, i < 6) for i in range(20)}
    assert index.rows().count() == 6 and index.rows().select("digest").distinct().count() == 6
    new = df.select(F.unhex(F.sha2("text", 256)).alias("digest"))
    plan = new.hint("merge").join(index.rows().select("digest"), "digest", "left_anti")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and "SortMergeJoin" in plan  # of the new batch alone
    index.drop()
