"""Field statistics and the choice of an encoding from them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.hashing import murmur2
from ..functions.types import stop_bit_width


def width_histogram(df: DataFrame, value: str, *keys: str) -> DataFrame:
    """Rows by stop-bit width of a value; a text counts with its number of bytes."""
    kind = df.schema[value].dataType.typeName()
    v = F.octet_length(value) if kind == "string" else F.col(value)
    return df.groupBy(*keys, stop_bit_width(v).alias("width")).agg(F.count("*").alias("n"))


def with_previous(df: DataFrame, value: str, partition: list[str], order: list[str]) -> DataFrame:
    """Add prev: the value of the row before in its dictionary, null for the first."""
    return df.withColumn("prev", F.lag(value).over(Window.partitionBy(*partition).orderBy(*order)))


def delta_histogram(df: DataFrame, value: str, partition: list[str], order: list[str]) -> DataFrame:
    """Rows by width of the difference to the row before; the first of a partition differs from 0."""
    rows = with_previous(df, value, partition, order)
    return rows.groupBy(stop_bit_width(F.col(value) - F.coalesce("prev", F.lit(0))).alias("width")).agg(F.count("*").alias("n"))


def copy_histogram(df: DataFrame, value: str, partition: list[str], order: list[str]) -> DataFrame:
    """Rows equal to the one before, by width."""
    rows = with_previous(df, value, partition, order).where(F.col(value) == F.col("prev"))
    return width_histogram(rows, value)


def increment_histogram(df: DataFrame, value: str, partition: list[str], order: list[str]) -> DataFrame:
    """Rows that are one more than the one before, by width."""
    rows = with_previous(df, value, partition, order).where(F.col(value) == F.col("prev") + 1)
    return width_histogram(rows, value)


def encoding_costs(df: DataFrame, value: str, partition: list[str], order: list[str]) -> DataFrame:
    """One row: bytes under none, copy, increment and delta, and the operator chosen.

    A later operator of the list is chosen only if it is strictly cheaper. A text column is `copy` if at least half of
    its rows are copies, else `delta`.
    """
    rows = with_previous(df, value, partition, order)
    if df.schema[value].dataType.typeName() == "string":
        got = rows.agg(F.count("*").alias("total"), F.count_if(F.col(value) == F.col("prev")).alias("copies"))
        return got.select("total", "copies", F.when(F.col("copies") >= F.floor(F.col("total") / 2), "copy").otherwise("delta").alias("operator"))
    w, v = stop_bit_width(F.col(value)), F.col(value)
    got = rows.agg(F.sum(w).alias("none"), F.sum(F.when(v == F.col("prev"), 0).otherwise(w)).alias("copy"), F.sum(F.when(v == F.col("prev") + 1, 0).otherwise(w)).alias("increment"), F.sum(stop_bit_width(v - F.coalesce("prev", F.lit(0)))).alias("delta"))
    best = F.when((F.col("copy") >= F.col("none")) & (F.col("increment") >= F.col("none")) & (F.col("delta") >= F.col("none")), "none")
    best = best.when((F.col("copy") <= F.col("increment")) & (F.col("copy") <= F.col("delta")), "copy").when(F.col("increment") <= F.col("delta"), "increment").otherwise("delta")
    return got.withColumn("operator", best)


def operators(df: DataFrame, fields: list[str], partition: list[str], order: list[str]) -> DataFrame:
    """(field, operator) as encoding_costs() chooses it, for several fields over one window and in one aggregate."""
    w = Window.partitionBy(*partition).orderBy(*order)
    rows = df.select(*fields, *[F.lag(c).over(w).alias(f"prev_{c}") for c in fields])
    sums, chosen = [F.count("*").alias("total")], []
    for c in fields:
        v, p = F.col(c), F.col(f"prev_{c}")
        if df.schema[c].dataType.typeName() == "string":
            sums.append(F.count_if(v == p).alias(f"copies_{c}"))
            best = F.when(F.col(f"copies_{c}") >= F.floor(F.col("total") / 2), "copy").otherwise("delta")
        else:
            width = stop_bit_width(v)
            sums += [F.sum(width).alias(f"none_{c}"), F.sum(F.when(v == p, 0).otherwise(width)).alias(f"copy_{c}"), F.sum(F.when(v == p + 1, 0).otherwise(width)).alias(f"increment_{c}"), F.sum(stop_bit_width(v - F.coalesce(p, F.lit(0)))).alias(f"delta_{c}")]
            none, copy, increment, delta = (F.col(f"{k}_{c}") for k in ("none", "copy", "increment", "delta"))
            best = F.when((copy >= none) & (increment >= none) & (delta >= none), "none").when((copy <= increment) & (copy <= delta), "copy").when(increment <= delta, "increment").otherwise("delta")
        chosen.append(F.struct(F.lit(c).alias("field"), best.alias("operator")))
    return rows.agg(*sums).select(F.inline(F.array(*chosen)))


def message_counts(df: DataFrame, kind: str) -> DataFrame:
    """Rows by kind, and the total in a row whose kind is null."""
    return df.rollup(kind).agg(F.count("*").alias("n"))


def bucket_counts(df: DataFrame, value: str, bits: int) -> DataFrame:
    """Hashed frequency: rows by the low bits of the value's hash; values that meet in a bucket add up."""
    return df.where(F.col(value).isNotNull()).groupBy(murmur2(F.col(value).cast("string")).bitwiseAND(F.lit((1 << bits) - 1).cast("long")).alias("bucket")).agg(F.count("*").alias("n"))


def bucket_summary(buckets: DataFrame) -> DataFrame:
    """Distinct values (non-empty buckets), the largest bucket and the total."""
    return buckets.agg(F.count("*").alias("distinct_estimate"), F.coalesce(F.max("n"), F.lit(0)).alias("largest"), F.coalesce(F.sum("n"), F.lit(0)).alias("total"))


def heavy_buckets(buckets: DataFrame, bits: int, percentile: float = 0.86) -> DataFrame:
    """Buckets strictly above the discrete percentile of all 2^bits counts, empty buckets among them.

    Counts are summed up by value first, so the running total orders the distinct counts and not the buckets.
    """
    by = buckets.groupBy("n").agg(F.count("*").alias("m"))
    used = by.agg(F.coalesce(F.sum("m"), F.lit(0)).alias("used"))
    run = by.crossJoin(F.broadcast(used)).withColumn("upto", F.sum("m").over(Window.orderBy("n")) + F.lit(1 << bits) - F.col("used"))
    cut = run.where(F.col("upto") >= F.ceil(F.lit(percentile) * F.lit(1 << bits))).agg(F.min("n").alias("cut"))
    empty = used.select(((F.lit(1 << bits) - F.col("used")) >= F.ceil(F.lit(percentile) * F.lit(1 << bits))).alias("low"))
    limit = cut.crossJoin(F.broadcast(empty)).select(F.when(F.col("low"), 0).otherwise(F.col("cut")).alias("cut"))
    return buckets.crossJoin(F.broadcast(limit)).where(F.col("n") > F.col("cut")).select("bucket", "n")


def could_be_key(buckets: DataFrame, most: int = 80_000, repeats: int = 10) -> DataFrame:
    """Whether a field looks like a repeating key: some but fewer than `most` values, each over `repeats` times on average."""
    s = bucket_summary(buckets)
    return s.select("distinct_estimate", "total", ((F.col("distinct_estimate") > 0) & (F.col("distinct_estimate") < most) & (F.floor(F.col("total") / F.greatest("distinct_estimate", F.lit(1))) > repeats)).alias("repeating_key"))


def heavy_key(value: Column, heavy: list) -> Column:
    """A dictionary key for a record: its own value if that is frequent, else null for the common dictionary."""
    return F.when(value.isin(heavy), value) if heavy else F.lit(None)


def compression(raw_bytes: Column, out_bytes: Column) -> Column:
    """Saved percent."""
    return F.round(F.lit(100.0) * (1 - out_bytes / raw_bytes), 4)


def deviation(df: DataFrame, value: str, *keys: str) -> DataFrame:
    """count, mean, least, greatest, sample variance (0 for one row) and deviation; NaN is skipped."""
    v = F.when(~F.isnan(F.col(value).cast("double")), F.col(value).cast("double"))
    got = df.groupBy(*keys).agg(F.count(v).alias("n"), F.avg(v).alias("mean"), F.min(v).alias("least"), F.max(v).alias("greatest"), F.coalesce(F.var_samp(v), F.lit(0.0)).alias("variance"))
    return got.withColumn("deviation", F.sqrt("variance"))


def normal_density(x: Column, mean: Column, variance: Column) -> Column:
    """The normal density at x; null without variance."""
    return F.when(variance > 0, F.exp(-(x - mean) * (x - mean) / (2 * variance)) / F.sqrt(2 * F.pi() * variance))
