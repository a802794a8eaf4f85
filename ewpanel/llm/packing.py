"""Packing documents into sequences along a Hilbert curve of their content."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ewpanel.llm.common import mix64, text_slices, utf8_parts
from ewpanel.llm.tokens import encoder

DIMENSIONS, BITS = 4, 15
_signs: list[np.ndarray] = []


def _projection() -> list[np.ndarray]:
    """For each dimension a sign for each of 65,536 feature hashes."""
    if not _signs:
        words = mix64(np.arange(1, (1 << 16) + 1, dtype=np.uint64))
        _signs.extend((((words >> np.uint64(d)) & np.uint64(1)).astype(np.int8) * 2 - 1) for d in range(DIMENSIONS))
    return _signs


def hilbert_key(cells: np.ndarray, bits: int = BITS) -> np.ndarray:
    """Positions on the Hilbert curve of integer points (rows of ``cells``, each below 2**bits).

    Follows the curve's definition from the highest bit down: each level's orthant
    number (Gray-decoded) is appended to the key and the axes of all lower levels
    are reflected and exchanged as in that orthant.
    """
    x = cells.astype(np.int64).T.copy()
    dims = len(x)
    level = 1 << (bits - 1)
    while level > 1:
        low = level - 1
        for d in range(dims):
            inside = (x[d] & level) != 0
            swap = np.where(inside, 0, (x[0] ^ x[d]) & low)
            x[0] ^= np.where(inside, low, swap)
            x[d] ^= swap
        level >>= 1
    for d in range(1, dims):
        x[d] ^= x[d - 1]
    flip, level = np.zeros_like(x[0]), 1 << (bits - 1)
    while level > 1:
        flip ^= np.where((x[-1] & level) != 0, level - 1, 0)
        level >>= 1
    x ^= flip
    key = np.zeros_like(x[0])
    for bit in range(bits - 1, -1, -1):
        for d in range(dims):
            key = (key << 1) | ((x[d] >> bit) & 1)
    return key


def content_key(texts: pa.Array) -> np.ndarray:
    """Hilbert key of each whole text's hashed vector.

    The vector counts the hashes of all runs of four bytes; random signs project
    it to four dimensions, divided by the number of runs. Texts of fewer than four
    bytes lie at the centre.
    """
    data, offsets = utf8_parts(texts)
    n = len(offsets) - 1
    runs = np.maximum(np.diff(offsets) - 3, 0)
    if len(data) < 4:
        return hilbert_key(np.full((n, DIMENSIONS), 1 << (BITS - 1)))
    b = data.astype(np.uint32)
    grams = b[:-3] | (b[1:-2] << np.uint32(8)) | (b[2:-1] << np.uint32(16)) | (b[3:] << np.uint32(24))
    bucket = ((grams * np.uint32(2654435761)) >> np.uint32(16)).astype(np.uint16)
    cells = np.empty((n, DIMENSIONS), np.int64)
    first = np.minimum(offsets[:-1], len(bucket))
    for d, sign in enumerate(_projection()):
        total = np.concatenate([[0], np.cumsum(sign[bucket], dtype=np.int64)])
        mean = (total[first + np.where(first + runs > len(bucket), 0, runs)] - total[first]) / np.maximum(runs, 1)
        cells[:, d] = np.clip((mean + 1) * (1 << (BITS - 1)), 0, (1 << BITS) - 1)
    return hilbert_key(cells)


def pack(docs: DataFrame, tokenizer: str = "word_bpe_49k.json", end_id: int = 2, length: int = 4096,
         id_col: str = "doc_id", text_col: str = "text", with_ids: bool = True) -> DataFrame:
    """Pack all documents into sequences of at most ``length`` ids, neighbours on the curve together.

    Documents are range-partitioned and sorted by their Hilbert key (ties by id, so
    that many copies of a text still spread over partitions), encoded there, and
    laid end to end: every sequence of a partition is full, and what is left at a
    partition's end is cut into sequences of descending powers of two, which need no
    padding. Only the key, never the ids, is computed twice (Spark samples keys for
    the ranges); texts are shuffled once.

    A row for each piece: id_col, start (ids of the document before it), length,
    ids_crc32, doc_tokens, sequence_id, offset, and the ids if ``with_ids``. Null
    text counts as empty: the end id alone. Repeated rows are packed as often as
    they come; null ids keep their null. An empty table gives no piece. Other
    columns are ignored.
    """
    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_slices(batches, "text"):
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(content_key(batch.column("text")))], ["id", "text", "key"])

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        enc, base = encoder(tokenizer), TaskContext.get().partitionId() << 40
        sequence = filled = 0
        pending: list[tuple] = []  # pieces of the sequence that is not full yet

        def emit(pieces: list[tuple]) -> pa.RecordBatch:
            columns = list(zip(*pieces))
            arrays = [pa.array(c, pa.int64()) for c in columns[:-1]]
            arrays.insert(3, pa.array([zlib.crc32(x.astype("<u4").tobytes()) for x in columns[-1]], pa.int64()))
            names = ["id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
            if with_ids:
                arrays.append(pa.array([x.astype(np.int32) for x in columns[-1]], pa.list_(pa.int32())))
                names.append("ids")
            return pa.RecordBatch.from_arrays(arrays, names)

        for batch in text_slices(batches, "text"):
            done: list[tuple] = []
            ids, sizes = enc.encode(batch.column("text"))
            ids = np.insert(ids, np.cumsum(sizes), end_id)
            ends = np.cumsum(sizes + 1)
            for doc, end, n in zip(batch.column("id").to_pylist(), ends.tolist(), (sizes + 1).tolist()):
                start = 0
                while start < n:
                    k = min(n - start, length - filled)
                    at = end - n + start
                    pending.append((doc, start, k, n, base + sequence, filled, ids[at : at + k]))
                    start, filled = start + k, filled + k
                    if filled == length:
                        done += pending
                        pending, sequence, filled = [], sequence + 1, 0
            pending = [(*p[:-1], p[-1].copy()) for p in pending]
            if done:
                yield emit(done)
        done, room = [], 0
        for doc, start, k, n, _, _, ids in pending:
            while k:
                if not room:
                    room = size = 1 << (filled.bit_length() - 1)
                    filled -= size
                    sequence += 1
                m = min(k, room)
                done.append((doc, start, m, n, base + sequence - 1, size - room, ids[:m]))
                start, k, room, ids = start + m, k - m, room - m, ids[m:]
        if done:
            yield emit(done)

    schema = "id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long" + ", ids array<int>" * with_ids
    return (docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
            .mapInArrow(keyed, "id long, text string, key long")
            .repartitionByRange("key", "id").sortWithinPartitions("key", "id").drop("key")
            .mapInArrow(packed, schema).withColumnRenamed("id", id_col))
