"""As-of, nearest and shifted-key joins of slow covariates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def prior_week(df: DataFrame, weekly: DataFrame, keys: list[str], issue: str, week: str = "week") -> DataFrame:
    """Values of the last completed week: the one that starts seven days before a Monday issue date."""
    return df.join(weekly.withColumn(week, F.date_add(week, 7)).withColumnRenamed(week, issue), [*keys, issue], "left")


def month_key(issue: Column, strict: bool = True) -> Column:
    """First day of the last completed month; not strict: of the month of the day before the issue."""
    return F.to_date(F.trunc(F.date_sub(F.trunc(issue, "month"), 1), "month")) if strict else F.to_date(F.trunc(F.date_sub(issue, 1), "month"))


def prior_month(df: DataFrame, monthly: DataFrame, keys: list[str], issue: str, month: str, zero: list[str], strict: bool = True) -> DataFrame:
    joined = df.withColumn(month, month_key(F.col(issue), strict)).join(monthly, [*keys, month], "left")
    return joined.fillna(0, zero)


def prior_year(df: DataFrame, yearly: DataFrame, keys: list[str], issue: str, year: str) -> DataFrame:
    return df.withColumn(year, F.year(issue) - 1).join(yearly, [*keys, year], "left")


def nearest_event(df: DataFrame, calendar: DataFrame, key: str, day: str, event_day: str, ordinal: str, far: int = 9999, within: int = 28) -> DataFrame:
    """Signed days to the nearest event of the key in either direction (first by ordinal on a tie), and whether it is near.

    Looks one event back and one ahead: events and days are one sorted stream for each
    key, so no day meets all events of its key.
    """
    w = Window.partitionBy(key).orderBy("_d", "_o")
    events = calendar.groupBy(key, F.col(event_day).alias("_d")).agg(F.min(ordinal).alias("_o"))
    both = df.select(key, F.col(day).alias("_d"), F.lit(None).cast("long").alias("_o")).distinct().unionByName(events.select(key, "_d", F.col("_o").cast("long")))
    event = F.when(F.col("_o").isNotNull(), F.struct("_d", "_o"))
    back = F.last(event, True).over(Window.partitionBy(key).orderBy("_d").rangeBetween(Window.unboundedPreceding, 0))
    ahead = F.first(event, True).over(Window.partitionBy(key).orderBy("_d").rangeBetween(0, Window.unboundedFollowing))
    both = both.select(key, "_d", "_o", back.alias("_b"), ahead.alias("_a")).where("_o is null")
    gap = lambda s: F.datediff(F.col(f"{s}._d"), F.col("_d"))
    first = F.when(F.col("_b").isNull(), gap("_a")).when(F.col("_a").isNull(), gap("_b")).when(
        (F.abs(gap("_b")) < F.abs(gap("_a"))) | ((F.abs(gap("_b")) == F.abs(gap("_a"))) & (F.col("_b._o") < F.col("_a._o"))), gap("_b")).otherwise(gap("_a"))
    near = both.select(key, F.col("_d").alias(day), F.coalesce(first, F.lit(far)).alias("days_to_nearest"))
    return df.join(near, [key, day]).withColumn("near", (F.abs("days_to_nearest") <= within).cast("int"))


def forward_filled(spine: DataFrame, df: DataFrame, keys: list[str], entity: str, period: str, columns: list[str]) -> DataFrame:
    """Left join onto a spine and carry the last value forward."""
    w = Window.partitionBy(entity).orderBy(period).rowsBetween(Window.unboundedPreceding, 0)
    return spine.join(df, keys, "left").withColumns({c: F.last(c, True).over(w) for c in columns})


def zonal(pixels: DataFrame, cells: DataFrame, gid: str = "priogrid_gid", half: float = 0.25) -> DataFrame:
    """Mean of values above -1 and sum (negatives as zero) of the pixels in each cell's box; pixels and cells have lat, lon."""
    tile = lambda c: F.floor(c / (2 * half))
    boxes = cells.select(gid, F.col("lat").alias("_y"), F.col("lon").alias("_x"), F.explode(F.array(*[
        F.struct((tile(F.col("lat")) + a).alias("ty"), (tile(F.col("lon")) + b).alias("tx")) for a in (-1, 0, 1) for b in (-1, 0, 1)])).alias("t")).select(gid, "_y", "_x", "t.*")
    points = pixels.withColumns({"ty": tile(F.col("lat")), "tx": tile(F.col("lon"))})
    inside = (F.abs(F.col("lat") - F.col("_y")) <= half) & (F.abs(F.col("lon") - F.col("_x")) <= half)
    return points.join(boxes, ["ty", "tx"]).where(inside).groupBy(gid).agg(
        F.avg(F.when(F.col("value") > -1, F.col("value"))).alias("mean_value"), F.sum(F.greatest(F.col("value"), F.lit(0.0))).alias("sum_value"), F.count(F.lit(1)).alias("n_pixels"))
