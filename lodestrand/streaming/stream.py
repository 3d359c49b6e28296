"""Streaming forms: message counts, and conforming text as it arrives."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.conform import conform
from ..operators.schema import Template


def place(spark: SparkSession, what: str) -> str:
    """A new path in the session's shared folder, or a temporary one where none is set."""
    top = spark.conf.get("spark.checkpoint.dir", None) or os.environ.setdefault("LODESTRAND_SCRATCH", tempfile.mkdtemp(prefix="lodestrand-"))
    return f"{top.rstrip('/')}/stream-{what}-{uuid.uuid4().hex}"


def running_counts(stream: DataFrame, kind: str) -> DataFrame:
    """Rows by kind so far."""
    return stream.groupBy(kind).agg(F.count("*").alias("n"))


def drain_counts(stream: DataFrame, kind: str, path: str, log: str) -> None:
    """Process all that is there now and leave the final counts at path; a batch that runs again writes the same."""

    def put(batch: DataFrame, _: int) -> None:
        batch.write.mode("overwrite").parquet(path)

    q = running_counts(stream, kind).writeStream.outputMode("complete").option("checkpointLocation", log).foreachBatch(put).trigger(availableNow=True).start()
    q.awaitTermination()


def conform_stream(lines: DataFrame, templates: list[Template], path: str, log: str):
    """Route arriving lines to their templates and append the long form to path; ends when all that is there is done."""
    return conform(lines, templates, "value").writeStream.format("parquet").outputMode("append").option("path", path).option("checkpointLocation", log).trigger(availableNow=True).start()
