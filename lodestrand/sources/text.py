"""Text and byte sources, line and field splitting, and the plain sinks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

LINES = r"\r\n|\n|\r"


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """(file, block, line) of a text path; line order within a file is that of (block, position in the scan)."""
    return spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.col("value").alias("line"))


def lines_in_memory(spark: SparkSession, text: str) -> DataFrame:
    """The lines of a string that is at hand, numbered."""
    return split_lines(spark.createDataFrame([(text,)], "text string"), "text").select("ordinal", "line")


def split_lines(df: DataFrame, text: str) -> DataFrame:
    """Rows of df by line of a text column, with `ordinal` from 0; a line end at the very end begins no line."""
    parts = F.split(F.regexp_replace(F.col(text), r"(?:\r\n|\n|\r)\z", ""), LINES)
    return df.select("*", F.posexplode(parts).alias("ordinal", "line"))


def split_fields(line: Column) -> Column:
    """The comma-separated fields of a line; a comma after a backslash is content and the backslash stays."""
    return F.split(line, r"(?<!\\),", -1)


def split_quoted(line: Column) -> Column:
    """The comma-separated fields of a line in which a field in double quotes may hold commas and doubled quotes."""
    raw = F.regexp_extract_all(F.concat(F.lit(","), line), F.lit(r',("(?:[^"]|"")*"(?=,|$)|[^,]*)'), F.lit(1))
    bare = lambda x: F.when(x.rlike(r'^"(?s:.*)"$') & (F.length(x) > 1), F.replace(F.substring(x, F.lit(2), F.length(x) - 2), F.lit('""'), F.lit('"'))).otherwise(x)
    return F.transform(raw, bare)


def explode_fields(df: DataFrame, line: str = "line") -> DataFrame:
    """Rows of df by field: pos from 0, and raw."""
    return df.select("*", F.posexplode(split_fields(F.col(line))).alias("pos", "raw"))


def assemble(df: DataFrame, *keys: str) -> DataFrame:
    """The inverse: fields of a record in order, joined by commas."""
    return df.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("pos", "raw"))).alias("f")).select(*keys, F.array_join(F.transform("f", lambda x: x["raw"]), ",").alias("line"))


def byte_chunks(df: DataFrame, raw: str, size: int) -> DataFrame:
    """Rows of df by chunk of at most size bytes of a binary column; an empty value has none."""
    n = F.octet_length(raw)
    starts = F.when(n > 0, F.sequence(F.lit(0), n - 1, F.lit(size))).otherwise(F.array().cast("array<int>"))
    df = df.select("*", F.posexplode(starts).alias("chunk", "at"))
    return df.withColumn("bytes", F.substring(F.col(raw), F.col("at") + 1, F.lit(size))).drop("at")


def read_chunks(spark: SparkSession, path: str, size: int) -> DataFrame:
    """Whole files as chunks of bytes."""
    return byte_chunks(spark.read.format("binaryFile").load(path).select("path", "content"), "content", size).drop("content")


def token_starts(text: Column) -> Column:
    """Bytes after which a token begins: those below 48 and those of characters beyond ASCII."""
    return (F.octet_length(text) - F.regexp_count(text, F.lit(r"[\x30-\x7F]"))).cast("long")


def tokens(text: Column) -> Column:
    """The stretches between such bytes."""
    return F.split(text, r"[^\x30-\x7F]")


def write_lines(df: DataFrame, column: str, path: str) -> None:
    """One column as text files, in place of what is there."""
    df.select(F.col(column).cast("string").alias("value")).write.mode("overwrite").text(path)


def made_rows(spark: SparkSession, n: int) -> DataFrame:
    """Synthetic delimited lines: a number, a word, and the number in hexadecimal."""
    return spark.range(n).select(F.concat_ws(",", F.col("id").cast("string"), F.lit("sometext"), F.lower(F.hex("id"))).alias("line"))


def record_text(fields: list[str]) -> Column:
    """Fields as a delimited line, nulls as empty fields."""
    return F.concat_ws(",", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in fields])
