"""Intermediate results that several plans read."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def _checkpoint_dir(spark: SparkSession) -> str:
    sc = spark.sparkContext
    found = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir() or "file://" + tempfile.mkdtemp(prefix="ewpanel-")
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(found)
    return found.rstrip("/")


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder below the one that driver and executors share."""
    return f"{_checkpoint_dir(spark)}/{name}-{uuid.uuid4().hex}"


def remove_folder(spark: SparkSession, folder: str) -> None:
    """Delete ``folder`` with all in it, on whichever file system it is; nothing happens where there is none."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def staged(df: DataFrame) -> DataFrame:
    """``df`` computed once and written to the checkpoint folder of the cluster (spark.checkpoint.dir), its lineage cut.

    Only where no folder is set, as in tests and notebooks, a temporary one is.
    """
    _checkpoint_dir(df.sparkSession)
    return df.checkpoint()
