"""What the operators of this subpackage share: the cluster's folder and Arrow helpers."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share.

    It is the session's ``spark.checkpoint.dir`` or an already set checkpoint
    directory; only where neither is set (tests, notebooks) a temporary one is
    made and set.
    """
    sc = spark.sparkContext
    found = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not found:
        found = "file://" + tempfile.mkdtemp(prefix="ewpanel-")
        sc.setCheckpointDir(found)
    return found.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


CLEAN = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"  # shuffle files of a write go when it has ended


def stage_table(df: DataFrame, name: str, batch_bytes: int | None = None, path: str | None = None) -> DataFrame:
    """Write ``df`` once to the shared folder and return the written table.

    Cuts the lineage: what is built on the result neither recomputes ``df`` nor
    depends on the shuffle files of an executor that may be lost; those of the write
    itself are removed as it ends. ``batch_bytes`` bounds the Arrow batches of this
    write, for rows that may be long.
    """
    spark = df.sparkSession
    path = path or new_path(spark, name)
    wanted = {CLEAN: "true"} | ({"spark.sql.execution.arrow.maxBytesPerBatch": str(batch_bytes)} if batch_bytes else {})
    before = {key: spark.conf.get(key, None) for key in wanted}
    try:
        for key, value in wanted.items():
            spark.conf.set(key, value)
        df.write.parquet(path)
    finally:
        for key, value in before.items():
            spark.conf.unset(key) if value is None else spark.conf.set(key, value)
    return spark.read.schema(df.schema).parquet(path)


class Stages:
    """The staged tables of one call: each is dropped by name once it is used up, or all but some at the end."""

    def __init__(self, spark: SparkSession):
        self.spark, self.paths = spark, {}

    def table(self, df: DataFrame, name: str, batch_bytes: int | None = None) -> DataFrame:
        self.paths.setdefault(name, []).append(path := new_path(self.spark, name))
        return stage_table(df, name, batch_bytes, path)

    def drop(self, *names: str) -> None:
        for name in names:
            for path in self.paths.pop(name, []):
                remove(self.spark, path)

    def close(self, *keep: str) -> None:
        self.drop(*(name for name in list(self.paths) if name not in keep))


def fresh_names(df: DataFrame, *names: str) -> list[str]:
    """These names, each with as many underscores in front as ``df`` needs to have no column of that name."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name = "_" + name
        taken.add(name.lower())
        out.append(name)
    return out


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder of the shared file system."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


def filesystem(uri: str):
    """pyarrow's file system and the path in it for a folder of the cluster."""
    from pyarrow import fs

    if uri.startswith("file:/") and not uri.startswith("file://"):
        uri = "file://" + uri[len("file:"):]
    if "://" not in uri:
        return fs.LocalFileSystem(), uri
    return fs.FileSystem.from_uri(uri)


@contextmanager
def published(fs, names: list[str]):
    """Streams under names of this attempt's own; they get ``names`` at the end, in place of those an earlier attempt left.

    Nothing of an attempt that fails stays. Readers come after all tasks have ended.
    """
    own = [f"{n}.{uuid.uuid4().hex}" for n in names]
    sinks = [fs.open_output_stream(n) for n in own]
    try:
        yield sinks
        for sink, mine, name in zip(sinks, own, names):
            sink.close()
            if fs.get_file_info(name).type.name != "NotFound":
                fs.delete_file(name)
            fs.move(mine, name)
    except BaseException:
        for sink, mine in zip(sinks, own):
            sink.close()
            if fs.get_file_info(mine).type.name != "NotFound":
                fs.delete_file(mine)
        raise


def text_slices(batches: Iterator[pa.RecordBatch], column: str, most_bytes: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    """The same rows in slices of about ``most_bytes`` of text (a longer text stands alone).

    Only bounds the memory of what is computed on a slice; no row is cut.
    """
    for batch in batches:
        lengths = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
        block = np.cumsum(lengths.astype(np.int64)) // most_bytes
        edges = [0, *(np.flatnonzero(np.diff(block)) + 1).tolist(), batch.num_rows]
        for a, b in zip(edges, edges[1:]):
            if b > a:
                yield batch.slice(a, b - a)


def utf8_parts(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all texts one after another and the n + 1 offsets; null counts as empty."""
    column = pc.fill_null(column.cast(pa.string()), "")
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    n = len(column)
    if n == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + n + 1].astype(np.int64)
    raw = column.buffers()[2]
    data = np.frombuffer(raw, np.uint8)[offsets[0] : offsets[-1]] if raw is not None else np.zeros(0, np.uint8)
    return data, offsets - offsets[0]


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit mix (xor-shift-multiply), element by element."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(32)
    x *= np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    x *= np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    return x
