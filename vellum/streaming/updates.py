"""Page states from a stream of updates: the same result as ``decisions.latest`` over the whole log."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from vellum.operators.decisions import latest


def read_updates(spark: SparkSession, folder: str, schema: str, files: int = 100) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(folder)


def current_pages(updates: DataFrame, keys: list[str], seq: str = "seq") -> DataFrame:
    """A streaming aggregate (complete or update mode): each key's last update; state is one row a key."""
    return latest(updates, keys, seq)


def counts_over_time(updates: DataFrame, at: str, late: str, window: str) -> DataFrame:
    """Updates by state and window of time, given out once no update as late as that can come."""
    return updates.withWatermark(at, late).groupBy(F.window(at, window), "state").count()


def upsert_into(updates: DataFrame, checkpoint: str, write: Callable[[DataFrame, int], None], keys: list[str], seq: str = "seq") -> StreamingQuery:
    """Hands each micro-batch's last updates to write with the batch's number, so that a repeated batch can be told."""
    return updates.writeStream.foreachBatch(lambda rows, n: write(latest(rows, keys, seq), n)).option("checkpointLocation", checkpoint).start()
