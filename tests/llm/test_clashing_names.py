"""Columns of the input by the names that operators use inside."""

import pytest

from ewpanel.llm.common import fresh_names
from ewpanel.llm.line_dedup import line_dedup
from ewpanel.llm.mixing import mix
from ewpanel.llm.substring_dedup import substring_dedup

INNER = ["gone", "_gone", "_id", "_hash", "_removed", "_source", "__id", "_ID", "id", "text_hash", "place", "first", "component", "line", "key", "block", "shard", "size"]


@pytest.fixture(scope="module")
def docs(spark):
    text = "One sentence of a few words stands here. And a second sentence follows it, long enough to count. A third one ends it all.\nAnother line."
    rows = [(i, text if i < 4 else f"Text number {i} is short.", "s") for i in range(6)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    return df.selectExpr("*", *[f"'{n}' AS {n}" for n in INNER if n.lower() != "_id" or n == "_id"])


def test_all_columns_come_back(docs):
    for out in (line_dedup(docs), substring_dedup(docs), mix(docs)):
        assert set(docs.columns) <= set(out.columns)
        rows = out.collect()
        assert rows and all(r[n] == n for r in rows for n in INNER if n in docs.columns)
    kept = {r.doc_id: r.text for r in line_dedup(docs).collect()}
    assert kept[1] == "" and kept[0] and kept[4]
    assert [r.n_removed for r in substring_dedup(docs).orderBy("doc_id").collect()][:2] == [0, 4]


def test_fresh_names(spark):
    df = spark.range(1).selectExpr("id AS _ID", "id AS __id")
    assert fresh_names(df, "_id", "_hash", "___id") == ["___id", "_hash", "____id"]
