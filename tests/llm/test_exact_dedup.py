import hashlib
import re
from collections import defaultdict

from ewpanel.llm.exact_dedup import DigestIndex, dedup


def test_odd_rows(spark, odd_docs):
    groups = defaultdict(list)
    for r in odd_docs.collect():
        groups[re.sub(r"[\x20\x09-\x0D]+", " ", r.text or "")].append(r.doc_id)
    by_hash = {hashlib.sha256(t.encode()).hexdigest(): ids for t, ids in groups.items()}
    got = dedup(odd_docs, DigestIndex(spark)).collect()
    assert len(got) == odd_docs.count()
    for h, ids in by_hash.items():
        rows = [r for r in got if r.text_sha256 == h]
        assert len(rows) == len(ids) and sum(r.kept for r in rows) == 1
        least = min((i for i in ids if i is not None), default=None)
        assert all(r.keep_id == least and r.group_size == len(ids) for r in rows)
        assert all(r.doc_id == least for r in rows if r.kept)


def test_batches_are_appended_and_the_anti_join_keeps_the_index_in_place(spark):
    index = DigestIndex(spark, buckets=4)
    first = spark.createDataFrame([(5, "x y"), (6, "z")], "doc_id long, text string")
    second = spark.createDataFrame([(1, "x\ny"), (2, "new"), (3, "new")], "doc_id long, text string")
    assert all(r.kept for r in dedup(first, index).collect())
    got = {r.doc_id: (r.keep_id, r.kept) for r in dedup(second, index).collect()}
    assert got == {1: (5, False), 2: (2, True), 3: (2, False)}
    assert index.rows().count() == 3
    assert dedup(first.limit(0), index).count() == 0 and index.rows().count() == 3
