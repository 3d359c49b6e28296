"""Moving windows over a count of rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _w(partition: list[str], order: list[str]):
    return Window.partitionBy(*partition).orderBy(*order)


def evicted(value: Column, size: int, partition: list[str], order: list[str]) -> Column:
    """The value that leaves a window of size rows; 0 while it fills, the value itself for size 0."""
    return F.lag(value, size, 0.0).over(_w(partition, order)) if size else value


def moving_mean(value: Column, size: int, partition: list[str], order: list[str]) -> Column:
    """Sum of the last size values over size, also while the window fills. Decimals keep sums exact."""
    return F.sum(value).over(_w(partition, order).rowsBetween(-(size - 1), 0)).cast("double") / size


def element_at(value: Column, i: int, partition: list[str], order: list[str]) -> Column:
    """The i-th most recent value, 0 the current; 0.0 where there is none."""
    return F.lag(value, i, 0.0).over(_w(partition, order))


def filled(size: int, partition: list[str], order: list[str]) -> Column:
    return F.least(F.row_number().over(_w(partition, order)), F.lit(size)).cast("long")


def bucket_sum(df: DataFrame, value: str, granularity: int, span: int, partition: list[str], order: list[str], alignment: int = 0) -> DataFrame:
    """Add fresh and result: the sum of the last span values, renewed at row span, then (after alignment rows, if any)
    every granularity rows, and held between; 0 before."""
    if not 0 < granularity < span:
        raise ValueError("granularity must lie between 0 and span")
    w = _w(partition, order)
    rows = df.withColumn("rn__", F.row_number().over(w).cast("long")).withColumn("sum__", F.sum(value).over(w.rowsBetween(-(span - 1), 0)))
    first = F.col("rn__") == span
    later = (F.col("rn__") > span) & (F.col("rn__") >= span + alignment) & (F.pmod(F.col("rn__") - span - alignment, F.lit(granularity)) == 0)
    rows = rows.withColumn("fresh", first | later)
    held = F.last(F.when(F.col("fresh"), F.col("sum__")), ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0))
    return rows.withColumn("result", F.coalesce(held, F.lit(0))).drop("rn__", "sum__")


def new_mean(fresh: Column, result: Column, span: int) -> Column:
    """The mean where it was just renewed, NaN between."""
    return F.when(fresh, result / span).otherwise(F.lit(float("nan")))
