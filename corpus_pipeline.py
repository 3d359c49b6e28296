"""From raw documents to packed sequences: STAGES in order, each over all that the one before it kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestrand.llm.common import among, drop_path, drop_stored, only, ready, scratch, stored, vocabulary
from lodestrand.llm.decontam import find_phrases
from lodestrand.llm.lang_id import identify, train
from lodestrand.llm.near_dedup import near_duplicates
from lodestrand.llm.packing import pack
from lodestrand.llm.secret_scan import scan, trained

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
MIN_SCORE = 0.4


def _key() -> F.Column:
    """A row's own text and id as one number, where an id is null or lies on several rows."""
    return F.xxhash64(F.lit("row"), "doc_id", "text")


def _without(docs: DataFrame, gone: DataFrame, key: F.Column) -> DataFrame:
    """Documents whose key is not among those gone (a stored table of the column key__)."""
    return among(docs.withColumn("key__", key), gone, "left_anti").select(*COLUMNS)


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep documents of a recognised language: those without a letter (null and empty texts too) or without a likely language go.

    Learns from all labelled rows of docs (see train for its bound). Repeated rows get the same answer each.
    """
    docs = only(docs, *COLUMNS)
    return identify(docs, train(docs), *COLUMNS).where((F.col("lang_pred") != "und") & (F.col("score") >= MIN_SCORE)).select(*COLUMNS)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep of each group of near copies (five-word shingles, 0.8) the document with the least id.

    Rows with a null id, or with an id that other rows have too, stand for themselves under a hash of id and text: they
    go only where their own text is a copy, and of rows equal in id and text one stays. Texts without a word stay.
    """
    docs = only(docs, *COLUMNS)
    shared = stored(docs.groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1 or doc_id is null").select("doc_id"), "shared_ids")
    plain = not shared.limit(1).count()
    keyed = docs.withColumn("key__", F.col("doc_id"))
    if not plain:
        mark = shared.where("doc_id is not null")
        alone = among(docs.where("doc_id is not null"), mark, "left_anti").withColumn("key__", F.col("doc_id"))
        keyed = alone.unionByName(among(docs.where("doc_id is not null"), mark).unionByName(docs.where("doc_id is null")).withColumn("key__", _key()))
    groups = near_duplicates(keyed.select(F.col("key__").alias("doc_id"), "text"), 5, 80)
    gone = stored(groups.where("not kept").select(F.col("doc_id").alias("key__")).distinct(), "gone")
    if plain:
        drop_stored(groups, shared)
        return _without(docs, gone, F.col("doc_id"))
    left = among(keyed, gone, "left_anti")
    twice = stored(groups.where("kept and n_shingles > 0").groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1").select(F.col("doc_id").alias("key__")), "twice")
    drop_stored(groups)
    return among(left, twice, "left_anti").unionByName(among(left, twice).dropDuplicates(["key__"]).select(left.columns)).select(*COLUMNS)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents that hold a whole benchmark window of 13 words, or of whose words a twentieth lie in shorter items.

    Null and empty texts hold none and stay; rows that repeat id and text share one answer.
    """
    docs = only(docs, *COLUMNS)
    found = find_phrases(docs.select(_key().alias("doc_id"), "text"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    gone = stored(found.where("whole or n_hit > 0 and 20 * n_hit >= n_words").select(F.col("doc_id").alias("key__")).distinct(), "gone")
    return _without(docs, gone, _key())


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Redact secrets; every row stays, repeated, null and empty ones too. n_chars is the new length where something was redacted."""
    docs = only(docs, *COLUMNS)
    found = scan(docs, *COLUMNS, model=trained(docs))
    return found.select("doc_id", F.col("redacted").alias("text"), "lang", "source", F.when(F.col("spans") == "", F.col("n_chars")).otherwise(F.length("redacted").cast("long")).alias("n_chars"))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pack the rest into sequences of 2048 ids: one row per piece. Null and empty texts have their end id alone; every row is a document."""
    return pack(docs, vocabulary("word_bpe_49k.json"), 1, False)


STAGES = [("language_id", language_id), ("near_dedup", near_dedup), ("decontamination", decontamination), ("secret_scan", secrets), ("packing", packing)]

#: Models and tokenizers are beyond SQL: tests/llm/test_pipeline.py compares the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents table, each written to the shared folder and read again; what a stage has read is deleted then."""
    ready(spark)
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, stage in STAGES[:-1]:
        path = scratch(spark, name)
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
        if before:
            drop_path(spark, before)
        before = path
    return STAGES[-1][1](spark, docs, sf_dir)
