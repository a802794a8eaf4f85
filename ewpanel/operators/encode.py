"""Feature columns: blocks by name, categories as flags, explicit renaming."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def feature_columns(blocks: Iterable[str], registry: dict[str, list[str]], existing: Iterable[str]) -> list[str]:
    """The columns of the named blocks in order, each once, of those that exist. An unknown block is an error."""
    there, out = set(existing), {}
    for name in blocks:
        if name not in registry:
            raise KeyError(f"no feature block {name}; there are {sorted(registry)}")
        out |= dict.fromkeys(c for c in registry[name] if c in there)
    return list(out)


def one_hot(train: DataFrame, df: DataFrame, column: str, alias: str = "flags", most: int = 1000) -> DataFrame:
    """``df`` with an array of 0/1 flags, one for each category of ``train`` in sorted order; unseen and null categories are all zero.

    The categories become literals of the plan, so more than ``most`` are an error.
    """
    found = [r[0] for r in train.where(F.col(column).isNotNull()).select(column).distinct().limit(most + 1).collect()]
    if len(found) > most:
        raise ValueError(f"{column} has more than {most} categories")
    flag = lambda c: F.coalesce((F.col(column) == F.lit(c)).cast("int"), F.lit(0))
    return df.withColumn(alias, F.array(*[flag(c) for c in sorted(found)]) if found else F.array().cast("array<int>"))


def adapted(df: DataFrame, wanted: list[str], renamed: dict[str, str]) -> DataFrame:
    """``df`` with every wanted feature: its own column, or the one that ``renamed`` names for it. A feature without either is an error."""
    missing = [c for c in wanted if c not in df.columns and renamed.get(c) not in df.columns]
    if missing:
        raise ValueError(f"no column for {missing}")
    return df.withColumns({c: F.col(renamed[c]) for c in wanted if c not in df.columns})


def projected(lon: Column, lat: Column, west: Column, east: Column, south: Column, north: Column, width: float = 760.0, height: float = 520.0, pad: float = 20.0) -> tuple[Column, Column]:
    """Map coordinates of an equirectangular projection of the box into a picture with a margin."""
    x = pad + (lon - west) / (east - west) * (width - 2 * pad)
    return x, height - pad - (lat - south) / (north - south) * (height - 2 * pad)
