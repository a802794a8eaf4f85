"""Sweeps of configurations over one training table: side by side, logged one by one, resumed from the log."""

from __future__ import annotations

import json
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor, as_completed

from pyspark import inheritable_thread_target
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

LOG = "name string, position long, run long, value double, metrics map<string,double>, error string"


def read_log(spark: SparkSession, path: str) -> DataFrame:
    """What is logged at ``path``; no rows where nothing is yet."""
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    if not folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(folder):
        return spark.createDataFrame([], LOG)
    return spark.read.schema(LOG).json(path)


def pending(spark: SparkSession, configs: list[dict], path: str, again: bool = False) -> list[dict]:
    """Configurations, in order, that the log doesn't name; with ``again`` also those that it names with errors alone."""
    log = read_log(spark, path)
    done = log.where("error is null") if again else log
    names = spark.createDataFrame([(c["name"],) for c in configs], "name string").distinct() if configs else spark.createDataFrame([], "name string")
    left = {r.name for r in names.join(done.select("name"), "name", "left_anti").collect()}  # at most a row for each configuration
    return [c for c in configs if c["name"] in left]


def sweep(spark: SparkSession, configs: list[dict], fit: Callable[[dict], dict[str, float]], path: str, metric: str, side_by_side: int = 4, again: bool = False) -> DataFrame:
    """Run ``fit`` for each configuration that isn't logged at ``path`` and return the log of all of ``configs``.

    ``fit`` gets a configuration (a dict with a name of its own) and returns its metrics; it reads a table that the caller has
    staged or cached, once for all. ``side_by_side`` fits run at once, each in a scheduler pool of its own, so that with
    ``spark.scheduler.mode`` FAIR a long fit doesn't hold up short ones. Each result is appended as it comes, by one
    thread, so a run that is lost has all that ended before; the next call goes on with the rest. A fit that raises
    is a row with its error, and the others go on. Two configurations of one name are an error.

    Columns: name, position (from 0, in ``configs``), run (from 1, the call that fitted it), value (``metric``), metrics, error,
    best_so_far (greatest value up to that position; null before the first).
    """
    names = [c["name"] for c in configs]
    if len(set(names)) < len(names):
        raise ValueError("two configurations of one name")
    todo = pending(spark, configs, path, again)
    run = (read_log(spark, path).agg(F.max("run")).first()[0] or 0) + 1
    place = {n: i for i, n in enumerate(names)}

    def one(config: dict) -> dict:
        spark.sparkContext.setLocalProperty("spark.scheduler.pool", f"sweep-{place[config['name']] % side_by_side}")
        row = {"name": config["name"], "position": place[config["name"]], "run": run}
        try:
            metrics = {k: None if v is None else float(v) for k, v in fit(config).items()}
            return {**row, "value": metrics.get(metric), "metrics": metrics}
        except Exception as e:  # noqa: BLE001 - of any kind: it is logged
            return {**row, "error": f"{type(e).__name__}: {e}"[:500]}

    with ThreadPoolExecutor(max(1, side_by_side)) as pool:
        running = [pool.submit(inheritable_thread_target(spark)(one), c) for c in todo]
        lost = None
        try:
            for f in as_completed(running):
                if f.cancelled():
                    continue
                if f.exception() is not None:  # an interruption: nothing more begins, what has ended is logged
                    lost = lost or f.exception()
                    for other in running:
                        other.cancel()
                    continue
                spark.createDataFrame([(json.dumps(f.result()),)], "value string").coalesce(1).write.mode("append").text(path)
        finally:
            for f in running:
                f.cancel()
    if lost is not None:
        raise lost
    return best_so_far(configs, read_log(spark, path))


def best_so_far(configs: list[dict], log: DataFrame) -> DataFrame:
    """The last logged row of each of ``configs``, by position, with the running best; a row for each configuration, so one window."""
    spark = log.sparkSession
    places = spark.createDataFrame([(c["name"], i) for i, c in enumerate(configs)], "name string, position long")
    last = log.groupBy("name").agg(F.max_by(F.struct("run", "value", "metrics", "error"), "run").alias("_l")).select("name", "_l.*")
    return places.join(last, "name").withColumn("best_so_far", F.max("value").over(Window.orderBy("position").rowsBetween(Window.unboundedPreceding, 0)))
