"""The corpus pipeline: stages over the table of documents, each of which works on all rows that the one before it kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from vellum.llm import pipeline_stages as stages
from vellum.llm.shared import settle

STAGES = [
    ("quality rules", stages.quality_rules),
    ("simhash near-dedup", stages.near_dedup),
    ("benchmark decontamination", stages.decontamination),
    ("secret scans", stages.secret_scans),
    ("mixing sources to target weights", stages.mixing_weights),
]

#: Weak supervision, SimHash, latent semantic retrieval and Markov models have no SQL form; tests hold them to brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows that come out of the last stage, for the documents in sf_dir."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = settle(docs)
    return docs
