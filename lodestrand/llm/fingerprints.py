"""Document fingerprints: bottom-k sketches of shingle hashes, in DataFrame expressions alone.

A sketch is the sorted array of the k least 48-bit hashes of a text's five-word shingles. The sketch of a union is the k
least of the parts' hashes; two sketches give resemblance and containment, one gives the number of distinct shingles.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import only, ready, stored

K, SHINGLE = 128, 5
LAST = -(1 << 63)
SPACE = r"[\x20\x09-\x0D]+"


def with_sketch(df: DataFrame, text: str, out: str, k: int = K, size: int = SHINGLE) -> DataFrame:
    """Add the sketch of a text column (null: empty). Fewer words than size are one shingle, no words none.

    Words are an own projection, so that they are split once and not for every shingle.
    """
    words = F.array_remove(F.split(F.lower(F.coalesce(F.col(text), F.lit(""))), SPACE), "")
    df = df.withColumn("words__", words)
    h = F.transform("words__", lambda w, i: F.shiftrightunsigned(F.xxhash64(w, *[F.get("words__", i + j) for j in range(1, size)]), 16))
    return df.withColumn(out, F.slice(F.array_sort(F.array_distinct(F.slice(h, F.lit(1), F.greatest(F.size("words__") - (size - 1), F.lit(1))))), 1, k)).drop("words__")


def resemblance(a: Column, b: Column, k: int = K) -> Column:
    """Share of the union's k least hashes that lie in both: the sets' resemblance. Two empty sets are equal."""
    both = F.slice(F.array_sort(F.array_union(a, b)), 1, k)
    shared = F.size(F.array_intersect(both, F.array_intersect(a, b)))
    return F.when(F.size(both) == 0, F.lit(1.0)).otherwise(shared / F.size(both))


def distinct_count(a: Column, k: int = K) -> Column:
    """Distinct shingles: exact below k, else (k - 1) over the k-th hash as a share of the hash range."""
    return F.when(F.size(a) < k, F.size(a).cast("double")).otherwise(F.lit(float(k - 1)) * F.lit(2.0**48) / (F.element_at(a, -1) + 1))


def containment(a: Column, b: Column, k: int = K) -> Column:
    """Share of the first set that lies in the second, from resemblance and the two counts (0 to 1; an empty first set: 1)."""
    j, n, m = resemblance(a, b, k), distinct_count(a, k), distinct_count(b, k)
    return F.when(F.size(a) == 0, F.lit(1.0)).otherwise(F.least(F.lit(1.0), j * (n + m) / ((1 + j) * n)))


def merged(df: DataFrame, sketch: str, *keys: str, k: int = K) -> DataFrame:
    """One sketch of the union for each key. Ranks are cut to k in each task before the shuffle, so no key is gathered."""
    rows = df.select(*keys, F.explode(sketch).alias("h__")).withColumn("r__", F.dense_rank().over(Window.partitionBy(*keys).orderBy("h__"))).where(F.col("r__") <= k)
    return rows.groupBy(*keys, "h__").agg(F.lit(1)).groupBy(*keys).agg(F.array_sort(F.collect_list("h__")).alias(sketch))


def as_string(sketch: Column) -> Column:
    """The hashes in hexadecimal, 12 digits each."""
    return F.array_join(F.transform(sketch, lambda x: F.lpad(F.lower(F.hex(x)), 12, "0")), "")


def neighbours(docs: DataFrame) -> DataFrame:
    """(key, to, need): each distinct key, the next larger one (the least after the greatest) and a third of that one's length.

    Keys and lengths alone are dealt by range; a row per partition carries the borders.
    """
    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ids = docs.groupBy("key").agg(F.max(F.length("text")).cast("long").alias("n"))
    ids = stored(ids.repartitionByRange(n, "key").select("key", "n", F.spark_partition_id().alias("p")), "ids")
    head = ids.groupBy("p").agg(F.min(F.struct("key", "n")).alias("first"))
    every = Window.orderBy("p")
    edge = head.select("p", F.coalesce(F.lead("first").over(every), F.first("first").over(every.rowsBetween(Window.unboundedPreceding, 0))).alias("edge"))
    w = Window.partitionBy("p").orderBy("key")
    rows = ids.select("key", "p", F.lead(F.struct("key", "n")).over(w).alias("next")).join(edge, "p")
    found = F.coalesce("next", "edge")
    return rows.select("key", found["key"].alias("to"), F.floor(found["n"] / 3).alias("need"))


def edited_pairs(docs: DataFrame) -> DataFrame:
    """Every document with the text and sketch that its successor in descending doc_id (the first after the last) lends it.

    A null doc_id comes last (and so does the least long, which stands for it). Where rows repeat a doc_id each takes the same successor, and the least of their texts is
    what they lend. Whole texts are dealt once, by key; what is lent (a third of a text at most needed) once more.
    """
    rows = only(docs, "doc_id", "text").select(F.coalesce("doc_id", F.lit(LAST)).alias("key"), F.coalesce("text", F.lit("")).alias("text"))
    lend = rows.withColumn("r__", F.lag(F.lit(1)).over(Window.partitionBy("key").orderBy("text"))).where("r__ is null").join(neighbours(rows), "key")
    lend = with_sketch(lend, "text", "next_sketch").select(F.col("to").alias("key"), F.expr("substring(text, 1, int(need))").alias("lent"), "next_sketch")
    return rows.join(lend, "key").withColumn("doc_id", F.when(F.col("key") != LAST, F.col("key")))


def op5_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of every text and its edited text, and how alike they are."""
    ready(spark)
    rows = edited_pairs(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    third = F.floor(F.length("text") / 3).cast("int")
    rows = rows.withColumn("edited", F.concat(F.substring("text", F.lit(1), F.length("text") - third), F.substring("lent", F.lit(1), third)))
    rows = with_sketch(with_sketch(rows, "text", "a"), "edited", "b")
    return rows.select("doc_id", F.length("text").cast("long").alias("n_chars"), F.sha2("edited", 256).alias("edited_sha256"), as_string(F.col("a")).alias("fingerprint"), as_string(F.col("b")).alias("edited_fingerprint"), resemblance(F.col("a"), F.col("b")).alias("near_edited"), resemblance(F.col("a"), F.col("next_sketch")).alias("near_next"))
