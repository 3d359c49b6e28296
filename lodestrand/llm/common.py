"""Shared helpers of the training-data operators: scratch tables, worker paths, batches cut by size."""

from __future__ import annotations

import gc
import os
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

ARROW_BYTES = 4 << 20
_own: list[str] = []


def ready(spark: SparkSession) -> SparkSession:
    """Let Python workers find this package, hold Arrow batches to a size that several workers can hold at once, and give checkpoints a folder where the session has none."""
    if int(spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch").rstrip("b")) > ARROW_BYTES:
        spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(ARROW_BYTES))
    env = spark.sparkContext.environment
    if ROOT not in env.get("PYTHONPATH", "").split(os.pathsep):
        env["PYTHONPATH"] = os.pathsep.join(x for x in (ROOT, env.get("PYTHONPATH", "")) if x)
    if not spark.sparkContext._jsc.sc().getCheckpointDir().isDefined():
        spark.sparkContext.setCheckpointDir(shared_dir(spark))
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The folder named in spark.checkpoint.dir; a temporary one where it is unset, on one machine alone."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not named:
        if spark.sparkContext.master.split("[")[0] != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        if not _own:
            _own.append(tempfile.mkdtemp(prefix="lodestrand-"))
        named = _own[0]
    return named


def scratch(spark: SparkSession, what: str) -> str:
    """A new path in the shared folder."""
    return f"{shared_dir(spark).rstrip('/')}/lodestrand-{what}-{uuid.uuid4().hex}"


def stored(df: DataFrame, what: str) -> DataFrame:
    """Write df to the shared folder and read it back: lineage ends there and lost executors lose nothing."""
    path = scratch(df.sparkSession, what)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def drop_path(spark: SparkSession, path: str) -> None:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def drop_stored(*tables: DataFrame) -> None:
    """Delete the files under tables made by stored(), once nothing reads them any more, and let Spark delete shuffle files that nothing reads."""
    for df in tables:
        for top in {m[0] for f in df.inputFiles() if (m := re.match(r".*/lodestrand-[^/]*(?=/)", f))}:
            drop_path(df.sparkSession, top)
    if tables:
        gc.collect()
        tables[0].sparkSession.sparkContext._jvm.System.gc()


#: Ids that are broadcast at most; each takes some 30 bytes there.
FEW_IDS = 2_000_000


def among(df: DataFrame, ids: DataFrame, how: str = "left_semi") -> DataFrame:
    """Rows of df whose key is among ids, or is not with how="left_anti".

    ids: a stored table of one column, distinct, named as the key is in df. Up to FEW_IDS of them are broadcast, so
    that df, with its texts, stays where it is; more are joined by a shuffle.
    """
    (key,) = ids.columns
    return df.join(F.broadcast(ids) if ids.limit(FEW_IDS + 1).count() <= FEW_IDS else ids, key, how)


def rows_by_chars(batches, text_at: int, most_chars: int = 1 << 20, most_rows: int = 512):
    """Cut Arrow batches into slices of a bounded number of characters (one long text may exceed it alone)."""
    import numpy as np
    import pyarrow.compute as pc

    for b in batches:
        if not b.num_rows:
            continue
        size = np.cumsum(pc.fill_null(pc.binary_length(b.column(text_at)), 0).to_numpy(zero_copy_only=False))
        at = 0
        while at < b.num_rows:
            base = size[at - 1] if at else 0
            to = min(max(at + 1, int(np.searchsorted(size, base + most_chars, "right"))), at + most_rows)
            yield b.slice(at, to - at)
            at = to


def trimmed(run):
    """A function of batches that gives freed memory back to the system at its end, as the worker lives on."""

    def whole(batches):
        import ctypes

        yield from run(batches)
        try:
            ctypes.CDLL(None).malloc_trim(0)
        except (AttributeError, OSError):  # another C library
            pass

    return whole


def by_row(batches):
    """Rows of Arrow batches one by one as dicts: of a batch of large rows one at a time becomes Python objects."""
    for b in batches:
        for i in range(b.num_rows):
            yield b.slice(i, 1).to_pylist()[0]


def vocabulary(name: str) -> str:
    """Where a public vocabulary file lies on this machine."""
    import public_tokenizers

    return public_tokenizers.path(name)


def only(df: DataFrame, *names: str) -> DataFrame:
    """The named columns; a clash that differs in case alone goes to the exact spelling."""
    at = {c: i for i, c in reversed(list(enumerate(df.columns)))}
    if len({c.lower() for c in df.columns}) < len(df.columns):
        df = df.toDF(*[f"_{i}_" for i in range(len(df.columns))])
        return df.select(*[F.col(f"_{at[n]}_").alias(n) for n in names])
    return df.select(*names)
