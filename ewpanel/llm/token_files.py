"""Token ids in Arrow files of equal-length sequences with masks."""

from __future__ import annotations

import itertools
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ewpanel.llm.common import filesystem, published, text_slices
from ewpanel.llm.tokens import encoder

ROWS = 1024  # sequences in a record batch


def _schema(length: int) -> pa.Schema:
    return pa.schema([pa.field("ids", pa.list_(pa.uint16(), length), False), pa.field("mask", pa.list_(pa.bool_(), length), False)])


INDEX = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64())])


class SequenceWriter:
    """Cuts a stream of ids into sequences of one length; the last is padded and masked."""

    def __init__(self, sink, length: int):
        self.length, self.writer, self.rest = length, pa.ipc.new_file(sink, _schema(length)), []
        self.held = self.total = 0

    def add(self, ids: np.ndarray) -> None:
        self.rest.append(ids.astype(np.uint16))
        self.held += len(ids)
        self.total += len(ids)
        whole = self.length * ROWS
        if self.held >= whole:
            data = np.concatenate(self.rest)
            end = len(data) // whole * whole
            for a in range(0, end, whole):
                self._write(data[a : a + whole], whole)
            self.rest, self.held = [data[end:]], len(data) - end

    def _write(self, data: np.ndarray, used: int) -> None:
        mask = pa.array(np.arange(len(data)) < used)
        self.writer.write_batch(pa.record_batch(
            [pa.FixedSizeListArray.from_arrays(pa.array(data), self.length), pa.FixedSizeListArray.from_arrays(mask, self.length)], schema=_schema(self.length)))

    def close(self) -> None:
        if self.held:
            data = np.concatenate(self.rest)
            padded = np.zeros(-(-len(data) // self.length) * self.length, np.uint16)
            padded[: len(data)] = data
            self._write(padded, len(data))
        self.writer.close()


class SequenceFile:
    """Random access to the sequences of a file; local files are mapped, not read."""

    def __init__(self, source):
        self.file = pa.ipc.open_file(source)
        self.length = self.file.schema.field("ids").type.list_size
        self.held: tuple[int, np.ndarray] = (-1, np.zeros(0, np.uint16))

    def _batch(self, k: int) -> np.ndarray:
        if self.held[0] != k:
            column = self.file.get_batch(k).column("ids")
            self.held = (k, np.frombuffer(column.values.buffers()[1], np.uint16)[: len(column) * self.length])
        return self.held[1]

    def sequence(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids and mask of sequence ``k``; the ids are a view of the file's memory."""
        row = self.file.get_batch(k // ROWS).slice(k % ROWS, 1)
        return self._batch(k // ROWS)[k % ROWS * self.length :][: self.length], row.column("mask").flatten().to_numpy(zero_copy_only=False)

    def ids(self, start: int, n: int) -> np.ndarray:
        """The ids from ``start`` on, over as many sequences as they fill."""
        whole, parts = self.length * ROWS, []
        while n > 0:
            piece = self._batch(start // whole)[start % whole :][:n]
            parts.append(piece)
            start, n = start + len(piece), n - len(piece)
        return np.concatenate(parts) if parts else np.zeros(0, np.uint16)


def write_token_files(docs: DataFrame, folder: str, tokenizer: str = "byte_bpe_50k.json", end_id: int = 0, length: int = 2048,
                      id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encode every text, add ``end_id`` and write the ids in ascending id order.

    One Arrow file ``part-N.arrow`` and one document index ``part-N.index.arrow``
    for each range of ids, N ascending with the ids, null ids first. Columns of the
    data file: ids and mask, fixed-size lists of ``length``; a file's last sequence
    is padded with masked zeros. Ids are 16-bit, so the vocabulary must have at
    most 65,536 entries (checked). Null text counts as empty and gives the end id
    alone; repeated ids are all written. An empty table writes no file. A task
    writes under a name of its own and renames at its end, so a second attempt
    replaces the first. Returns a row for each file: part, path, docs, tokens.
    """
    if encoder(tokenizer).tokenizer.get_vocab_size() > 1 << 16:
        raise ValueError("the vocabulary does not fit 16-bit ids")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        fs, base = filesystem(folder)
        slices = text_slices(batches, "text")
        first = next(slices, None)
        if first is None:
            return
        fs.create_dir(base, recursive=True)
        enc, count = encoder(tokenizer), 0
        with published(fs, [f"{base}/part-{part:06d}.arrow", f"{base}/part-{part:06d}.index.arrow"]) as sinks:
            writer, index = SequenceWriter(sinks[0], length), pa.ipc.new_file(sinks[1], INDEX)
            for batch in itertools.chain([first], slices):
                ids, sizes = enc.encode(batch.column("text"))
                begin = writer.total
                writer.add(np.insert(ids, np.cumsum(sizes), end_id))
                sizes = sizes + 1
                index.write_batch(pa.record_batch([batch.column("id"), pa.array(begin + np.cumsum(sizes) - sizes), pa.array(sizes)], schema=INDEX))
                count += batch.num_rows
            writer.close()
            index.close()
        yield pa.RecordBatch.from_pydict({"part": [part], "path": [f"{folder}/part-{part:06d}"], "docs": [count], "tokens": [writer.total]})

    ordered = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    ordered = ordered.repartitionByRange(F.col("id").asc_nulls_first()).sortWithinPartitions(F.col("id").asc_nulls_first())
    return ordered.mapInArrow(write, "part long, path string, docs long, tokens long")


def read_token_files(spark: SparkSession, manifest: list, id_col: str = "doc_id") -> DataFrame:
    """A row for each document, from the files: start (ids of all documents before it), n_tokens, ids_crc32.

    ``manifest`` has a row for each file, as ``write_token_files`` returns; it grows
    with the number of tasks, not of documents.
    """
    schema = "id long, start long, n_tokens long, ids_crc32 long"
    rows, before = [], 0
    for m in sorted(manifest, key=lambda m: m["part"]):
        rows.append((m["part"], m["path"], before))
        before += m["tokens"]
    if not rows:
        return spark.createDataFrame([], schema).withColumnRenamed("id", id_col)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in (r for b in batches for r in b.to_pylist()):
            fs, path = filesystem(row["path"])
            local = fs.type_name == "local"
            opened = (lambda p: pa.memory_map(p)) if local else fs.open_input_file
            with opened(f"{path}.arrow") as data, opened(f"{path}.index.arrow") as names:
                file, index = SequenceFile(data), pa.ipc.open_file(names)
                for k in range(index.num_record_batches):
                    b = index.get_batch(k)
                    start, size = b.column("start").to_numpy(), b.column("n_tokens").to_numpy()
                    crc = [zlib.crc32(file.ids(s, n).astype("<u4").tobytes()) for s, n in zip(start.tolist(), size.tolist())]
                    ids = pa.array(b.column("doc_id").to_pylist(), pa.int64())
                    yield pa.RecordBatch.from_arrays([ids, pa.array(start + row["before"]), pa.array(size.copy()), pa.array(crc, pa.int64())], ["id", "start", "n_tokens", "ids_crc32"])

    files = spark.createDataFrame(rows, "part long, path string, before long").repartitionByRange(len(rows), "part")
    return files.mapInArrow(read, schema).withColumnRenamed("id", id_col)
