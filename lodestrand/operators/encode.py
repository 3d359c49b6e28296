"""Field operators: copy, increment, delta, default and constant, each with its inverse.

An encoded field is a value and a presence flag, so that a value left out differs from a null. State is kept within a
dictionary (partition) in the given order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _window(partition: list[str], order: list[str]):
    return Window.partitionBy(*partition).orderBy(*order)


def encode_copy(df: DataFrame, value: str, partition: list[str], order: list[str]) -> DataFrame:
    """Leave out a value equal to the one before (nulls too)."""
    w = _window(partition, order)
    same = (F.row_number().over(w) > 1) & F.col(value).eqNullSafe(F.lag(value).over(w))
    return df.withColumn("present", ~same).withColumn("encoded", F.when(F.col("present"), F.col(value)))


def decode_copy(df: DataFrame, partition: list[str], order: list[str]) -> DataFrame:
    w = _window(partition, order).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn("decoded", F.last(F.when(F.col("present"), F.struct("encoded")), ignorenulls=True).over(w)["encoded"])


def encode_increment(df: DataFrame, value: str, partition: list[str], order: list[str]) -> DataFrame:
    """Leave out a value one more than the one before."""
    w = _window(partition, order)
    return df.withColumn("present", ~F.coalesce(F.col(value) == F.lag(value).over(w) + 1, F.lit(False))).withColumn("encoded", F.when(F.col("present"), F.col(value)))


def decode_increment(df: DataFrame, partition: list[str], order: list[str]) -> DataFrame:
    """The run's first value plus the rows since."""
    w = _window(partition, order)
    rows = df.withColumn("rn__", F.row_number().over(w))
    start = F.last(F.when(F.col("present"), F.struct((F.col("encoded") - F.col("rn__")).alias("base"))), ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0))
    return rows.withColumn("decoded", F.when(F.col("present"), F.col("encoded")).otherwise(start["base"] + F.col("rn__"))).drop("rn__")


def encode_delta(df: DataFrame, value: str, partition: list[str], order: list[str]) -> DataFrame:
    """The difference to the last value before that is not null (0 at first); a null stays null."""
    w = _window(partition, order).rowsBetween(Window.unboundedPreceding, -1)
    return df.withColumn("encoded", F.col(value) - F.coalesce(F.last(value, ignorenulls=True).over(w), F.lit(0)))


def decode_delta(df: DataFrame, partition: list[str], order: list[str]) -> DataFrame:
    w = _window(partition, order).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn("decoded", F.when(F.col("encoded").isNotNull(), F.sum("encoded").over(w)))


def encode_default(value: Column, default) -> Column:
    """Leave out the default; a real null must be flagged by the caller."""
    return F.when(~value.eqNullSafe(F.lit(default)), value)


def decode_default(encoded: Column, default) -> Column:
    return F.coalesce(encoded, F.lit(default))


def encode_constant(value: Column) -> Column:
    """A constant is never stored."""
    return F.lit(None).cast("string")


def decode_constant(constant) -> Column:
    return F.lit(constant)
