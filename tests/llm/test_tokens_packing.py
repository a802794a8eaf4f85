import zlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from ewpanel.llm.common import new_path
from ewpanel.llm.packing import hilbert_key, pack
from ewpanel.llm.token_files import SequenceFile, read_token_files, write_token_files
from ewpanel.llm.tokens import encoder

SF = "/root/testdata/sf0.001"


def whole(name, text):
    return encoder(name).tokenizer.encode(text or "", add_special_tokens=False).ids


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
@settings(max_examples=150, deadline=None)
@given(texts=st.lists(st.one_of(st.text(alphabet=" ab.'s\n\té́ 　日*1", max_size=30), st.text(max_size=20), st.none()), max_size=6))
def test_chunks_give_the_ids_of_the_whole_text(name, texts):
    texts = [t if t is None else t.encode("utf-8", "ignore").decode() for t in texts]
    ids, sizes = encoder(name).encode(pa.array(texts, pa.string()))
    want = [whole(name, t) for t in texts]
    assert sizes.tolist() == [len(w) for w in want]
    assert ids.tolist() == [i for w in want for i in w]


def test_hilbert_neighbours_touch():
    grid = np.array([(a, b, c) for a in range(8) for b in range(8) for c in range(8)])
    keys = hilbert_key(grid, bits=3)
    path = grid[np.argsort(keys)]
    assert sorted(keys.tolist()) == list(range(512))
    assert (np.abs(np.diff(path, axis=0)).sum(axis=1) == 1).all()


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


@pytest.mark.parametrize("table", ["odd", "documents"])
def test_pack(spark, odd_docs, table):
    docs = odd_docs if table == "odd" else spark.read.parquet(f"{SF}/documents.parquet")
    want = defaultdict(list)
    for r in docs.collect():
        want[r.doc_id].append(whole("word_bpe_49k.json", r.text) + [2])
    pieces, sequences = defaultdict(list), defaultdict(list)
    for r in pack(docs).collect():
        pieces[r.doc_id].append(r)
        sequences[r.sequence_id].append(r)
        assert r.ids_crc32 == crc(r.ids) and r.length == len(r.ids)
    for doc, texts in want.items():
        got = sorted((r.start, r.length, tuple(r.ids)) for r in pieces[doc])
        assert sum(x[1] for x in got) == sum(map(len, texts))
        assert {p for p in got} <= {(s, n, tuple(t[s : s + n])) for t in texts for s, n, _ in got}
    for rows in sequences.values():
        rows.sort(key=lambda r: r.offset)
        end = 0
        for r in rows:
            assert r.offset == end
            end += r.length
        assert end == 4096 or end & (end - 1) == 0
    assert set(pieces) == set(want)


@pytest.mark.parametrize("table", ["odd", "documents"])
def test_token_files(spark, odd_docs, table):
    docs = odd_docs if table == "odd" else spark.read.parquet(f"{SF}/documents.parquet")
    manifest = write_token_files(docs, new_path(spark, "t"), length=16).collect()
    got = sorted((r.start, r.n_tokens, r.ids_crc32, r.doc_id) for r in read_token_files(spark, manifest).collect())
    rows = sorted(docs.collect(), key=lambda r: (r.doc_id is not None, r.doc_id or 0))
    assert [g[3] for g in got] == [r.doc_id for r in rows]
    at = 0
    for g in got:
        assert g[0] == at
        at += g[1]
    want = sorted((str(r.doc_id), len(i := whole("byte_bpe_50k.json", r.text) + [0]), crc(i)) for r in rows)
    assert sorted((str(g[3]), g[1], g[2]) for g in got) == want


def test_random_access_and_empty(spark, odd_docs):
    path = new_path(spark, "t")
    m = write_token_files(odd_docs.where("doc_id = 6"), path, length=16).collect()
    file = SequenceFile(pa.memory_map(m[0].path.removeprefix("file://") + ".arrow"))
    want = whole("byte_bpe_50k.json", "word " * 30_000) + [0]
    ids, mask = file.sequence(1500)
    assert ids.tolist() == want[24_000:24_016] and mask.all()
    last = len(want) // 16
    ids, mask = file.sequence(last)
    assert mask.sum() == len(want) % 16 and ids[mask].tolist() == want[last * 16 :]
    assert read_token_files(spark, write_token_files(odd_docs.limit(0), new_path(spark, "t")).collect()).count() == 0
    assert pack(odd_docs.limit(0)).count() == 0
