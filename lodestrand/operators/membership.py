"""Membership: bitmaps with several hashes, and exact set operations as joins."""

from __future__ import annotations

import gzip

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.hashing import murmur2

BITS, PROBES = 1 << 25, 8


def positions(value: Column, probes: int = PROBES, bits: int = BITS) -> Column:
    """The bit positions of a value, from 1."""
    return F.array(*[F.pmod(F.xxhash64(value, F.lit(k)), F.lit(bits)) + 1 for k in range(probes)])


def bitmap(members: DataFrame, value: str, probes: int = PROBES, bits: int = BITS) -> DataFrame:
    """bucket, bits: the members' bitmap in pieces of 4 KiB, built in each task before it is merged."""
    pos = members.select(F.explode(positions(F.col(value), probes, bits)).alias("p"))
    return pos.groupBy(F.bitmap_bucket_number("p").alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("p")).alias("bits"))


def found(rows: DataFrame, value: str, built: DataFrame, probes: int = PROBES, bits: int = BITS) -> DataFrame:
    """Distinct values of rows whose bits are all set: every member, and few others."""
    asked = rows.select(value).where(F.col(value).isNotNull()).distinct().select(value, F.explode(F.array_distinct(positions(F.col(value), probes, bits))).alias("p"))
    hit = asked.withColumn("bucket", F.bitmap_bucket_number("p")).join(built, "bucket", "left")
    at = F.bitmap_bit_position("p")
    byte = F.conv(F.hex(F.substring(F.col("bits"), (F.floor(at / 8) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
    one = F.expr("shiftright(b__, int(a__ % 8))").bitwiseAND(F.lit(1))
    hit = hit.withColumn("a__", at).withColumn("b__", F.coalesce(byte, F.lit(0))).withColumn("one__", one)
    return hit.groupBy(value).agg(F.min("one__").alias("m")).where("m = 1").select(value)


def new_members(rows: DataFrame, known: DataFrame, key: str) -> DataFrame:
    """Rows whose key is not known; exact."""
    return rows.join(known.select(key), key, "left_anti")


def overlap(rows: DataFrame, known: DataFrame, key: str) -> DataFrame:
    """Rows whose key is known."""
    return rows.join(known.select(key), key, "left_semi")


def bit_difference(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """Members of b that are not in a."""
    return b.select(key).distinct().join(a.select(key), key, "left_anti")


def mixed(a: DataFrame, b: DataFrame, key: str, seed: int) -> DataFrame:
    """Both tables' rows in the order of a hash of their key, side and the seed (`at`): the same however they are partitioned."""
    rows = a.withColumn("side", F.lit("a")).unionByName(b.withColumn("side", F.lit("b")))
    return rows.withColumn("at", murmur2(F.concat_ws("|", F.col(key).cast("string"), "side", F.lit(str(seed))))).orderBy("at", key, "side")


def gaps(rows: DataFrame, position: str, bucket: int = 1 << 15) -> DataFrame:
    """Differences of set positions in order, counted anew in each stretch of `bucket` positions."""
    piece = F.floor(F.col(position) / bucket)
    w = Window.partitionBy("piece").orderBy(position)
    rows = rows.select(position).distinct().withColumn("piece", piece)
    return rows.withColumn("gap", F.col(position) - F.coalesce(F.lag(position).over(w), F.col("piece") * bucket))


def gzip_size(raw: Column) -> Column:
    """Bytes of a binary after gzip, a batch at a time."""
    def size(x):
        return x.map(lambda b: None if b is None else len(gzip.compress(b, mtime=0)))

    return F.pandas_udf(size, "long", F.PandasUDFType.SCALAR)(raw)


def raw_size(df: DataFrame, value: str) -> DataFrame:
    """Bytes of a column as text lines."""
    return df.agg(F.coalesce(F.sum(F.octet_length(F.col(value).cast("string")) + 1), F.lit(0)).alias("bytes"))
