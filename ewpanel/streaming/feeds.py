"""Streaming forms of the weekly counts, sliding counts and decaying intensity."""

from __future__ import annotations

import math
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import StructType

from ewpanel.functions.staging import shared_folder


def _timed(stream: DataFrame, ts: str) -> DataFrame:
    """Event times as timestamps (session zone UTC), which watermarks need."""
    return stream.withColumn(ts, F.col(ts).cast("timestamp"))


def weekly_counts(stream: DataFrame, entity: str, ts: str, late: str = "14 days") -> DataFrame:
    """Monday weeks of each entity; rows later than the watermark are dropped."""
    w = F.window(ts, "7 days", "7 days", "4 days")  # the epoch is a Thursday
    return _timed(stream, ts).withWatermark(ts, late).groupBy(w, entity).agg(F.count(F.lit(1)).alias("n_events")).select(entity, F.col("window.start").alias("week"), "n_events")


def sliding_counts(stream: DataFrame, entity: str, ts: str, length: int = 30, every: int = 7, late: str = "14 days") -> DataFrame:
    """Counts of the ``length`` days before each issue Monday."""
    w = F.window(ts, f"{length} days", f"{every} days", f"{(4 - length) % 7} days")
    return _timed(stream, ts).withWatermark(ts, late).groupBy(w, entity).agg(F.count(F.lit(1)).alias("n_events")).select(entity, F.col("window.end").alias("issue"), "n_events")


class Decay(StatefulProcessor):
    """A key's intensity: level * exp(-rate * gap) + 1 at each event, in time order within a batch; late events add what is left of them.

    State is the level, the time of the last event and the number of events. A timer drops it once nothing but
    ``silence`` seconds have passed, when less than 1e-9 of the level is left, so that state follows the active keys.
    """

    def __init__(self, key: str, rate: float, silence: float):
        self.key, self.rate, self.silence = key, rate, silence

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("intensity", "level double, last double, n long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        level, last, n = self.state.get() if self.state.exists() else (0.0, None, 0)
        for t in sorted(t for b in rows for t in b["seconds"].tolist()):
            n += 1
            if last is None or t >= last:
                level, last = (level * math.exp(-self.rate * (t - last)) if last is not None else 0.0) + 1, t
            else:
                level += math.exp(-self.rate * (last - t))
        self.state.update((level, last, n))
        for old in self.handle.listTimers():
            self.handle.deleteTimer(old)
        self.handle.registerTimer(int((last + self.silence) * 1000))
        yield pd.DataFrame({self.key: [key[0]], "at": [last], "intensity": [level], "n": [n]})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.state.clear()
        return iter(())

    def close(self) -> None:
        pass


def decaying_intensity(stream: DataFrame, key: str, ts: str, half_life_s: float, late: str = "14 days") -> DataFrame:
    """For each key its intensity at its last event and the number of its events, an update a batch. State is kept in RocksDB (``run_available`` sets it)."""
    kind = dict(stream.dtypes)[key]
    ready = _timed(stream, ts).withWatermark(ts, late).select(key, ts, F.col(ts).cast("double").alias("seconds")).where(F.col(key).isNotNull() & F.col(ts).isNotNull())
    return ready.groupBy(key).transformWithStateInPandas(
        Decay(key, math.log(2) / half_life_s, 30 * half_life_s), f"{key} {kind}, at double, intensity double, n long", "update", "eventtime")


ROCKS = {"spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"}


def run_available(result: DataFrame, keys: list[str], folder: str | None = None) -> DataFrame:
    """Runs a stream over all that has arrived, then stops; the last update of each key so far.

    ``folder`` holds the checkpoint and the updates of each batch; by default a new one in the folder that the
    cluster shares. A later call with the same folder goes on where the last one ended, also after a failure:
    a batch that is run again replaces its own updates.
    """
    spark = result.sparkSession
    folder = folder or shared_folder(spark, "stream")
    updates = f"{folder}/updates"
    before = {k: spark.conf.get(k, None) for k in ROCKS}
    try:
        for k, v in ROCKS.items():
            spark.conf.set(k, v)
        run = (result.writeStream.outputMode("update").option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True)
               .foreachBatch(lambda batch, number: batch.write.mode("overwrite").parquet(f"{updates}/batch={number}")).start())
        run.awaitTermination()
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    values = [c for c in result.columns if c not in keys]
    kept = spark.read.schema(StructType(result.schema.fields).add("batch", "long")).parquet(updates)
    return kept.groupBy(*keys).agg(F.max_by(F.struct(*values), "batch").alias("_last")).select(*keys, "_last.*")


def read_stream(spark: SparkSession, path: str) -> DataFrame:
    """The table at ``path``, a folder or one file, as a stream of its files."""
    place = f"{path[:-1]}[{path[-1]}]"  # a pattern that it alone fits: a stream's source can't be one file by its plain name
    return spark.readStream.schema(spark.read.parquet(path).schema).parquet(place)
