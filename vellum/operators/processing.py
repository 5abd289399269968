"""What becomes of pages and documents: states, failures, restarts, kept results, cancelled runs, and timings."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

PAGE = ["doc_id", "page_index"]


def page_state(extract_error: Column, detect_error: Column, scanned: Column, ocr_enabled: Column, ocr_error: Column) -> Column:
    """struct(state, ocr, ocr_error, error) of a page that has been through all stages. What fails in extraction or detection fails
    the page; what fails in recognition only leaves the page without recognised lines."""
    error = F.coalesce(extract_error, detect_error)
    tried = error.isNull() & F.coalesce(scanned & ocr_enabled, F.lit(False))
    return F.struct(
        F.when(error.isNull(), "ready").otherwise("error").alias("state"),
        (tried & ocr_error.isNull()).alias("ocr"),
        F.when(tried, ocr_error).alias("ocr_error"),
        error.alias("error"),
    )


def page_steps(scanned: Column, ocr_enabled: Column, failed: Column) -> Column:
    """The states that a page goes through, in order; failed is the state in which it fails, null if it doesn't."""
    steps = F.when(scanned & ocr_enabled, F.array(*map(F.lit, ("pending", "extracting", "ocr", "detecting", "ready")))).otherwise(F.array(*map(F.lit, ("pending", "extracting", "detecting", "ready"))))
    stop = F.when(failed != "ocr", F.array_position(steps, failed))
    return F.when(F.coalesce(stop, F.lit(0)) > 0, F.concat(F.slice(steps, F.lit(1), stop.cast("int")), F.array(F.lit("error")))).otherwise(steps)


def document_status(events: DataFrame, doc: str = "doc_id", seq: str = "seq") -> DataFrame:
    """(doc, status, wrong_password) after the last event of each document: open, loaded, password-required, password-incorrect,
    submit, cancel; any other event is an error. A password asked for again after one was submitted was wrong."""
    last = events.groupBy(doc).agg(F.max_by("event", seq).alias("event"), F.count_if(F.col("event") == "submit").alias("tries"))
    e = F.col("event")
    asked = e.isin("password-required", "password-incorrect")
    status = F.when(e.isin("open", "submit"), "loading").when(e == "loaded", "ready").when(asked, "password").when(e == "cancel", "idle").otherwise("error")
    return last.select(doc, status.alias("status"), ((e == "password-incorrect") & (F.col("tries") > 0)).alias("wrong_password"))


def all_ready(pages: DataFrame, doc: str = "doc_id") -> DataFrame:
    """(doc, ready): whether every page is; only then is an analysis kept."""
    return pages.groupBy(doc).agg(F.bool_and(F.col("state") == "ready").alias("ready"))


def to_analyse(wanted: DataFrame, kept: DataFrame) -> DataFrame:
    """The documents (hash, ocr_enabled) whose analysis isn't kept: turning recognition on or off is another analysis."""
    return wanted.join(kept, ["hash", "ocr_enabled"], "left_anti")


def to_recognise(pages: DataFrame, kept_lines: DataFrame) -> DataFrame:
    """The pages (hash, page_index) without recognised lines kept for their document."""
    return pages.join(kept_lines.select("hash", "page_index").distinct(), ["hash", "page_index"], "left_anti")


def restored(decisions: DataFrame, hash: str) -> DataFrame:
    """A document's kept decisions as a fresh start: nothing can be undone or redone."""
    return decisions.filter(F.col("hash") == hash).withColumns({"can_undo": F.lit(False), "can_redo": F.lit(False)})


def sidebar_totals(pages: DataFrame, doc: str = "doc_id") -> DataFrame:
    """(doc, processed, no_text_pages, ocr_failed_pages) of pages (state, no_text, ocr, ocr_error)."""
    ready = F.col("state") == "ready"
    return pages.groupBy(doc).agg(
        F.count_if(F.col("state").isin("ready", "error")).alias("processed"),
        F.count_if(ready & F.col("no_text") & ~F.col("ocr") & F.col("ocr_error").isNull()).alias("no_text_pages"),
        F.count_if(ready & F.col("ocr_error").isNotNull()).alias("ocr_failed_pages"),
    )


def stage_timings(log: DataFrame, by: list[str]) -> DataFrame:
    """(by, stage, pages, total_ms, longest_ms) of a log (page, stage, started, ended in milliseconds)."""
    ms = F.col("ended") - F.col("started")
    return log.groupBy(*by, "stage").agg(F.count("*").alias("pages"), F.sum(ms).alias("total_ms"), F.max(ms).alias("longest_ms"))


def observed(df: DataFrame, name: str, **counts: Column) -> tuple[DataFrame, Callable[[], dict]]:
    """df, and a function that gives its counts once df has been worked. Only numbers are let through, never text."""
    seen = Observation(name)
    return df.observe(seen, *[c.cast("double").alias(k) for k, c in counts.items()]), lambda: seen.get


@contextmanager
def cancellable(spark: SparkSession) -> Iterator[Callable[[], None]]:
    """Jobs started inside can be stopped, from any thread, by calling what this gives."""
    tag = f"vellum-{uuid.uuid4().hex}"
    spark.sparkContext.addJobTag(tag)
    try:
        yield lambda: spark.sparkContext.cancelJobsWithTag(tag)
    finally:
        spark.sparkContext.removeJobTag(tag)
