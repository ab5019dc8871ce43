"""Corpus pipeline: quality, near duplicates, benchmark leaks, secrets, packing, each stage on what the one before kept.

Every stage takes ``(spark, docs, sf_dir)`` and returns a DataFrame; ``run`` writes each result as Parquet to the
shared folder and reads it again as the next stage's input. All but the last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from constella.llm import common, decontaminate, ngram_join, packing, quality, secrets


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the additive model doesn't reject (score of 0.3 or more)."""
    model = quality.train_quality(common.table(spark, sf_dir, "documents"), common.table(spark, sf_dir, "labels"))
    return quality.keep_good(docs, model)


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document (the smallest id) of each group linked by five-word shingle sets with a similarity of 0.8 or more.

    Of rows that repeat an id and its text one is kept; rows with a null id are never dropped.
    """
    found = ngram_join.ngram_join(docs, "doc_id", "text", width=5, percent=80)
    gone = common.cut(found.where("doc_id <> component_id").select("doc_id").distinct(), "copies")
    again = common.cut(found.where("doc_id is not null").groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1").select("doc_id"), "repeated")
    common.drop(found)
    kept = common.by_ids(docs, gone, "doc_id", "left_anti")
    if again.isEmpty():
        return kept
    once = common.by_ids(kept, again, "doc_id", "left_semi").dropDuplicates(["doc_id", "text"])
    return common.by_ids(kept, again, "doc_id", "left_anti").unionByName(once)


def leak_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no benchmark item was confirmed."""
    found = decontaminate.decontaminate(docs, common.table(spark, sf_dir, "benchmark"))
    gone = common.cut(found.select("doc_id").distinct(), "leaks")
    common.drop(found)
    return common.by_ids(docs, gone, "doc_id", "left_anti")


def secret_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The same documents with every secret replaced by a mark; ``n_chars`` follows the new text."""
    clean = secrets.redact_secrets(docs, "text")
    return clean.withColumn("n_chars", F.char_length("text").cast("bigint")).select(docs.columns)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Bucket, batch and slot of each remaining document."""
    return packing.pack(docs, "doc_id", "text")


STAGES = [
    ("quality_classifier", quality_stage),
    ("ngram_jaccard_join", near_duplicate_stage),
    ("benchmark_decontamination", leak_stage),
    ("secret_scan", secret_stage),
    ("packing", packing_stage),
]

#: Stages train models and iterate: SQL can't express them. tests/llm hold each stage's operator against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        kept = common.cut(stage(spark, docs, sf_dir), name)
        common.drop(docs)
        common.release(spark)
        docs = kept
    return docs
