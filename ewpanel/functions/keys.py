"""Week, period and grid keys."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

GRID_COLUMNS = 720
EPOCH_MONDAY = "1970-01-05"


def week_monday(day: Column) -> Column:
    """The Monday that starts the day's week."""
    return F.date_sub(day, F.weekday(day))


def week_sunday(day: Column) -> Column:
    """The Sunday that ends the day's week."""
    return F.date_add(week_monday(day), 6)


def period_key(day: Column, weeks: int, anchor: str = EPOCH_MONDAY) -> Column:
    """Start of the n-week period of the day, counted from a Monday."""
    days = F.datediff(week_monday(day), F.to_date(F.lit(anchor)))
    return F.date_sub(week_monday(day), F.pmod(days, F.lit(7 * weeks)))


def day_number(day: Column) -> Column:
    return F.unix_date(F.to_date(day)).cast("long")


def grid_id(lat: Column, lon: Column) -> Column:
    """Half-degree cell: row * 720 + column + 1, from -90 and -180."""
    row, column = F.floor((lat + 90) * 2), F.floor((lon + 180) * 2)
    return (row * GRID_COLUMNS + column + 1).cast("long")


def grid_centre(gid: Column) -> tuple[Column, Column]:
    """Latitude and longitude of the cell's centre."""
    return F.floor((gid - 1) / GRID_COLUMNS) / 2 - 89.75, ((gid - 1) % GRID_COLUMNS) / 2 - 179.75


def ring(gid: Column, distance: int) -> Column:
    """Cells at Chebyshev distance ``distance``; none beyond the grid's left and right edge."""
    steps = [(r, c) for r in range(-distance, distance + 1) for c in range(-distance, distance + 1) if max(abs(r), abs(c)) == distance]
    column = (gid - 1) % GRID_COLUMNS
    inside = [F.when((column + c >= 0) & (column + c < GRID_COLUMNS), gid + r * GRID_COLUMNS + c) for r, c in steps]
    return F.filter(F.array(*inside), lambda x: x.isNotNull())


def calendar_spine(df: DataFrame, entity: str, period: str, step_days: int = 7) -> DataFrame:
    """Every period between each entity's first and last; the join key of a dense panel."""
    ends = df.groupBy(entity).agg(F.min(period).alias("lo"), F.max(period).alias("hi"))
    return ends.select(entity, F.explode(F.expr(f"sequence(lo, hi, interval {step_days} days)")).alias(period))
