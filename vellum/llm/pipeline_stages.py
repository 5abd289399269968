"""The stages of the corpus pipeline: each takes (session, documents, folder of the tables) and returns documents.

Nulls, empty texts, ties, repeated rows and empty tables mean in each stage what its operator says. Further columns are kept.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vellum.llm import decontam, mixing, quality, secret_scan, simhash
from vellum.llm.shared import columns_for_python, free_column, settle, small


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the documents that weak supervision rejects."""
    columns_for_python(spark)
    return quality.keep_good(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates: the one with the smallest id, the first by text's hash of equal ids, one of
    repeated rows; rows without an id come last. Rows are told apart by id and text, not by numbers, which depend on how files
    are dealt out."""
    columns_for_python(spark)
    key = free_column(docs, "key")
    of = F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("doc_id"), F.xxhash64("text").alias("hash"))
    keyed = docs.withColumn(key, of)
    groups = simhash.near_duplicates(keyed.select(key, "text"), id=key)
    others = settle(groups.filter(F.col(key) != F.col("component_id")).select(key).distinct())
    again = settle(groups.groupBy(key).count().filter("count > 1").select(key))  # rows that are there more than once
    kept = keyed.join(small(others, 32), key, "left_anti")
    if not again.isEmpty():
        once = kept.join(small(again, 32), key, "left_semi").dropDuplicates([key])  # combined before the shuffle
        kept = kept.join(small(again, 32), key, "left_anti").unionByName(once)
    return kept.select(docs.columns)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the documents that hold a benchmark item."""
    columns_for_python(spark)
    return decontam.drop_leaks(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def secret_scans(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """With secrets taken out of the texts, whose lengths are told anew."""
    return secret_scan.redact(docs).withColumn("n_chars", F.length("text").cast("long"))


def mixing_weights(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that are taken once or more, with how often (copies), and the rate, topic and tokens behind it."""
    return mixing.mix(docs).filter("copies > 0")
