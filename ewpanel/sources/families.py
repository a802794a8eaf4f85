"""Feature families kept as bucketed tables on one key, merged into a wide table without a shuffle."""

from __future__ import annotations

import uuid
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ewpanel.functions.staging import remove_folder, shared_folder


class FamilyStore:
    """Tables of feature families, all bucketed by the same keys into the same number of buckets and partitioned by ``period``.

    A family is shuffled once, when it is put; every merge after that reads bucket by bucket. Rows lie in the
    shared folder, so executors on any machine read them. ``period`` is a column of the partition (a year);
    a later ``put`` of a family replaces the partitions that it has rows of and leaves the others.

    Rows with a null key or period match nothing and are not stored. Two rows of a family with equal keys are an error, since a
    merge would copy rows of the base; the family is then dropped.
    """

    def __init__(self, spark: SparkSession, keys: list[str], period: str, buckets: int | None = None):
        """``buckets``: as many as shuffle partitions, by default; one value for the life of the tables."""
        self.spark, self.keys, self.period = spark, keys, period
        self.buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
        self.folder = shared_folder(spark, "families")
        self.prefix = f"ewpanel_family_{uuid.uuid4().hex}"
        self.families: list[str] = []

    def _name(self, family: str) -> str:
        return f"{self.prefix}_{family}"

    def put(self, family: str, df: DataFrame) -> None:
        """Store ``df`` (keys, period and features), one file a bucket and partition; raises ValueError where keys repeat.

        The number of a bucket is the one of a task of ``repartition`` by the same keys, so a task writes one bucket.
        """
        whole = df.dropna(subset=[*self.keys, self.period])
        dealt = whole.repartition(self.buckets, *self.keys)
        rest = [c for c in df.columns if c != self.period]
        if family in self.families:
            if set(df.columns) != set(self.spark.table(self._name(family)).columns):
                raise ValueError(f"family {family} has other columns than before")
            # insertInto goes by position, the partition column last; only partitions with rows are replaced
            target = [c for c in self.spark.table(self._name(family)).columns if c != self.period]
            with _dynamic(self.spark):
                dealt.select(*target, self.period).write.insertInto(self._name(family), overwrite=True)
        else:
            writer = dealt.select(*rest, self.period).write.format("parquet").option("path", f"{self.folder}/{family}")
            writer.partitionBy(self.period).bucketBy(self.buckets, self.keys[0], *self.keys[1:]).sortBy(self.keys[0], *self.keys[1:]).saveAsTable(self._name(family))
            self.families.append(family)
        twice = self.repeated(family).limit(3).collect()
        if twice:
            self._drop_table(family)
            raise ValueError(f"family {family} has several rows of {', '.join(str(tuple(r)) for r in twice)}")

    def family(self, family: str) -> DataFrame:
        return self.spark.table(self._name(family))

    def repeated(self, family: str) -> DataFrame:
        """Keys with several rows in any partition; counted inside the buckets, without a shuffle."""
        return self.family(family).groupBy(*self.keys).agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(*self.keys)

    def merged(self, base: str, families: list[str] | None = None) -> DataFrame:
        """Every row of family ``base`` with the features of the others (all, by default), null where one has no such key.

        Left joins by sort-merge over equal buckets: no exchange and nothing broadcast, however large a family is. Equal
        names of features in two families are an error.
        """
        others = [f for f in families or self.families if f != base]
        out = self.family(base)
        for f in others:
            features = self.family(f).drop(self.period)
            clash = sorted(set(out.columns) & set(features.columns) - set(self.keys))
            if clash:
                raise ValueError(f"family {f} repeats {', '.join(clash)}")
            out = out.join(features.hint("merge"), self.keys, "left")
        return out

    def _drop_table(self, family: str) -> None:
        self.spark.sql(f"DROP TABLE IF EXISTS {self._name(family)}")
        self.families.remove(family)
        remove_folder(self.spark, f"{self.folder}/{family}")

    def drop(self) -> None:
        """Drop the tables and their files."""
        for f in list(self.families):
            self._drop_table(f)
        remove_folder(self.spark, self.folder)

    def __enter__(self) -> FamilyStore:
        return self

    def __exit__(self, *_) -> None:
        self.drop()


@contextmanager
def _dynamic(spark: SparkSession):
    name = "spark.sql.sources.partitionOverwriteMode"
    before = spark.conf.get(name)
    spark.conf.set(name, "dynamic")
    try:
        yield
    finally:
        spark.conf.set(name, before)


def replace_partitions(df: DataFrame, path: str, by: list[str]) -> None:
    """Write ``df`` to the partitioned table at ``path``: partitions that it has rows of are replaced, others stay as they are.

    A bucket's rows of one partition leave their task as one file; nothing is shuffled.
    """
    df.sortWithinPartitions(*by).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*by).parquet(path)
