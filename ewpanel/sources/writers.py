"""Writers of panels, candidate tables and result documents."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def write_panel(df: DataFrame, path: str, by: list[str], mode: str = "overwrite") -> None:
    """Parquet in a folder for each value of ``by``; rows of one value and range of the others go out together, so folders get few files.

    A value that holds most rows is dealt to several tasks (the rebalancing hint splits it).
    """
    df.hint("rebalance", *by).write.mode(mode).partitionBy(*by).parquet(path)


def result_documents(parts: dict[str, DataFrame]) -> DataFrame:
    """One JSON document a row: the part's name and the row as a nested object, nulls left out."""
    whole = None
    for name, df in sorted(parts.items()):
        rows = df.select(F.to_json(F.struct(F.lit(name).alias("part"), F.struct(*df.columns).alias("result"))).alias("document"))
        whole = rows if whole is None else whole.union(rows)
    return whole


def with_split(train: DataFrame, test: DataFrame) -> DataFrame:
    """Training and test rows as one table with a flag: nodes of one graph, labels of the test rows masked by whoever fits."""
    return train.withColumn("is_train", F.lit(True)).unionByName(test.withColumn("is_train", F.lit(False)), allowMissingColumns=True)
