"""Exact deduplication against a persistent digest index (DataFrame functions only)."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ewpanel.llm.common import Stages, remove, shared_dir

WHITE = r"[\x20\x09-\x0D]+"


def normalised(text: Column) -> Column:
    """Null counts as empty; every run of ASCII white space becomes one space."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), WHITE, " ")


class DigestIndex:
    """A table of SHA-256 digests, bucketed and sorted by digest, that grows by appending.

    Each digest stands there once with the id of the row that stays. New batches
    meet it by a sort-merge anti-join for which the index is not shuffled; where
    several appends have given a bucket several files, each bucket is sorted as it is read.
    """

    def __init__(self, spark: SparkSession, table: str | None = None, buckets: int | None = None):
        self.spark = spark
        self.table = table or f"ewpanel_digests_{uuid.uuid4().hex}"
        self.buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))

    def exists(self) -> bool:
        return self.spark.catalog.tableExists(self.table)

    def rows(self) -> DataFrame:
        return self.spark.table(self.table)

    def drop(self) -> None:
        if self.exists():
            place = self.spark.sql(f"DESCRIBE FORMATTED {self.table}").where("col_name = 'Location'").first()["data_type"]
            self.spark.sql(f"DROP TABLE IF EXISTS {self.table}")
            remove(self.spark, place)

    def append_new(self, groups: DataFrame) -> None:
        """Add the rows of ``groups`` (unique digests) whose digest isn't there yet."""
        new, place = groups, {"path": f"{shared_dir(self.spark)}/digest-index-{self.table}"}
        if self.exists():
            new, place = groups.hint("merge").join(self.rows().select("digest"), "digest", "left_anti"), {}
        (new.select("digest", "keep_id", "keep_row", "batch")
            .write.mode("append").format("parquet").options(**place)
            .bucketBy(self.buckets, "digest").sortBy("digest").saveAsTable(self.table))


def dedup(docs: DataFrame, index: DigestIndex, id_col: str = "doc_id", text_col: str = "text", cuts: tuple[int, ...] = ()) -> DataFrame:
    """Decide for every row of ``docs`` whether it stays; new digests are appended to ``index``.

    The rows come to the index in batches: ids below the first of the ascending
    ``cuts``, below the second and so on, then the rest with the null ids. Of a batch
    only digests that the anti-join doesn't find in the index are appended.

    Returns id_col, keep_id, group_size (rows of ``docs`` with that text), kept
    and text_sha256. Of equal texts the row with the smallest id stays, null ids
    last; of repeated rows with one id exactly one is kept. If the index had the text
    before, its row stays and none of these. Null texts equal empty ones. An empty
    table gives an empty result and leaves the index empty. Other columns are ignored,
    whatever their names.

    Texts are read and hashed once into a narrow table of digests; all that
    follows moves 32-byte digests. Groups are pre-aggregated before the shuffle
    and the join back is between two plain shuffles, which Spark splits where one
    digest holds many rows.
    """
    stages, call = Stages(docs.sparkSession), uuid.uuid4().hex
    number = F.lit(len(cuts))
    for k in reversed(range(len(cuts))):
        number = F.when(F.col(id_col) < cuts[k], k).otherwise(number)
    digests = stages.table(
        docs.select(
            F.col(id_col).alias("id"),
            F.monotonically_increasing_id().alias("row"),
            F.unhex(F.sha2(normalised(F.col(text_col)).cast("binary"), 256)).alias("digest"),
            number.alias("number"),
        ),
        "digests",
    )
    groups = digests.groupBy("digest", "number").agg(
        F.min(F.struct(F.col("id").isNull().alias("none"), "id", "row")).alias("first"), F.count(F.lit(1)).alias("n")
    )
    groups = stages.table(
        groups.select("digest", "number", F.col("first.id").alias("keep_id"), F.col("first.row").alias("keep_row"), "n", F.lit(call).alias("batch")),
        "digest-groups",
    )
    for k in range(len(cuts) + 1):
        index.append_new(groups.where(F.col("number") == k))
    sizes = groups.groupBy("digest").agg(F.sum("n").alias("group_size"))
    decided = stages.table(
        index.rows().join(sizes.hint("merge"), "digest")
        .select("digest", "keep_id", F.when(F.col("batch") == call, F.col("keep_row")).alias("keep_row"), "group_size"),
        "digest-decisions",
    )
    stages.close("digests", "digest-decisions")
    return digests.join(decided, "digest").select(
        F.col("id").alias(id_col),
        "keep_id",
        "group_size",
        F.coalesce(F.col("row") == F.col("keep_row"), F.lit(False)).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"),
    )
