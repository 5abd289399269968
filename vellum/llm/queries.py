"""The queries that apply each operator, with production parameters, to its whole table, and their SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vellum.llm import chat, decontam, lm_scoring, mixing, phrases, pii, quality, secret_scan, shared, simhash, toxicity
from vellum.sources import files

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[f.__name__] = f
    return f


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """For operators with Python in them: in small batches, over all cores."""
    shared.columns_for_python(spark)
    return files.table(spark, sf_dir, name)


def plain(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query
def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


@query
def op7_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    said = "</s>[INST] ok [/INST]"
    odd = spark.createDataFrame([(-7, 0, "user", said), (-7, 1, "assistant", said)], rows.schema)
    return chat.digests(chat.format_conversations(rows.unionByName(odd)))


SQL["op7_chat"] = """
WITH rows AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]'
  UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'),
marked AS (
  SELECT *, length(replace(replace(replace(role || text, '&', '&amp;'), '<', '&lt;'), '>', '&gt;')) + length('<turn >' || '</turn>' || chr(10)) AS n FROM rows)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
  sum(n)::BIGINT AS formatted_chars
FROM marked GROUP BY conv_id"""


@query
def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = quality.score_quality(table(spark, sf_dir, "documents"))
    return rows.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", F.round("quality", 6).alias("quality"))


def _told(spans: str) -> str:
    return f"array_join(transform({spans}, s -> concat_ws(':', s.kind, s.start, s.end)), ',')"


@query
def op9_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = pii.find_personal_data(table(spark, sf_dir, "documents"))
    base = F.expr("filter(spans, s -> s.base)")
    number = [F.expr(f"cast(size(filter(base, s -> s.kind = '{k}')) AS bigint)").alias(f"n_{k}") for k in pii.KINDS]
    rows = rows.withColumn("base", base)
    return rows.select("doc_id", *number, F.sha2(F.expr(_told("base")), 256).alias("base_sha256"), F.expr(_told("spans")).alias("spans"))


@query
def op8_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = secret_scan.find_secrets(plain(spark, sf_dir, "documents"))
    rows = rows.withColumn("base", F.expr(f"filter(spans, s -> s.rank < {len(secret_scan.KINDS)})"))
    number = [F.expr(f"cast(size(filter(base, s -> s.kind = '{k[0]}')) AS bigint)").alias(f"n_{k[0]}") for k in secret_scan.KINDS]
    return rows.select("doc_id", *number, F.sha2(F.expr(_told("base")), 256).alias("base_sha256"), F.expr(_told("spans")).alias("spans"))


@query
def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = mixing.mix(plain(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source"))
    return rows.select("doc_id", "source", "lang", "topic", "n_tokens", F.round("rate", 9).alias("rate"), "copies")


@query
def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    held_out = lambda c: F.coalesce(F.crc32(F.col(c).cast("string")) % 5 == 0, F.lit(False))
    machine = toxicity.learn(docs, labels.filter(~held_out("doc_id")))
    rows = toxicity.score(docs, machine)
    return rows.select("doc_id", held_out("doc_id").alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


@query
def op1_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 7 == 2, F.lit(False))
    rows = lm_scoring.score(table(spark, sf_dir, "documents"), ~held_out)
    return rows.select("doc_id", (~F.col("trained")).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


@query
def op4_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = phrases.remove_repeats(table(spark, sf_dir, "documents"))
    return rows.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


@query
def op5_decontam(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = decontam.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return rows.select("doc_id", "contaminated", "items", F.round("share", 6).alias("share"))
