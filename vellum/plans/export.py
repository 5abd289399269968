"""Redaction plans and whether an export may go ahead."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vellum.operators.detect import Thresholds

# Parts of a file that an export takes out, and what they are called.
CATALOG_KEYS = ["Metadata", "Outlines", "AcroForm", "Names", "OpenAction", "AA", "StructTreeRoot", "MarkInfo", "PieceInfo", "Threads", "Dests"]
PAGE_KEYS = ["Annots", "Thumb", "PieceInfo", "Metadata", "AA", "B"]
INFO_LABEL = "Document information (title, author, subject, keywords)"
CATALOG_LABELS = {
    "Metadata": "XMP metadata",
    "Outlines": "Bookmarks",
    "AcroForm": "Form fields",
    "Names": "Attachments, named destinations and scripts",
    "Dests": "Attachments, named destinations and scripts",
    "StructTreeRoot": "Tagged structure (alternate / actual text)",
    "MarkInfo": "Tagged structure (alternate / actual text)",
}
CATALOG_DEFAULT = "Document actions and private data"
PAGE_LABELS = {"Annots": "Annotations, comments and links", "Thumb": "Page thumbnails"}
PAGE_DEFAULT = "Page private data and actions"


def regions(masks: DataFrame) -> DataFrame:
    """What will be taken out: the masks that are shown as solid."""
    return masks.filter("tier = 'auto'").select("doc_id", "page_index", F.col("mask").alias("region"), "text", "ordinal")


def excluded_uncertain(t: Thresholds) -> Column:
    """Masks that stay although they are flagged; this takes the uncertain bound as it is set."""
    return (F.col("tier") != "auto") & (F.col("status") == "auto") & (F.col("confidence") >= t.uncertain)


def by_page(found: DataFrame) -> DataFrame:
    """(doc_id, page_index, n, texts): a page's regions in order."""
    rows = F.array_sort(F.collect_list(F.struct("ordinal", "text")))
    return found.groupBy("doc_id", "page_index").agg(F.count("*").alias("n"), F.transform(rows, lambda r: r["text"]).alias("texts"))


def report(found: DataFrame) -> DataFrame:
    return found.groupBy("doc_id").agg(F.count("*").alias("regions"), F.count_distinct("page_index").alias("pages"))


def readiness(pages: DataFrame, n_pages: Column | None = None) -> DataFrame:
    """(doc_id, processed, page_count, failed, unanalysed, complete) from pages (doc_id, page_index, state, no_text, ocr)."""
    listed = lambda test: F.array_sort(F.collect_list(F.when(test, F.col("page_index"))))
    state = F.col("state")
    out = pages.groupBy("doc_id").agg(
        F.count_if(state.isin("ready", "error")).alias("processed"),
        F.count("*").alias("page_count"),
        listed(state == "error").alias("failed"),
        listed((state == "ready") & F.col("no_text") & ~F.col("ocr")).alias("unanalysed"),
    )
    return out.withColumn("complete", F.col("processed") == F.col("page_count"))


def blocked(started: Column, acknowledged: Column) -> Column:
    return ~started | ~F.col("complete") | (F.size("failed") > 0) | ((F.size("unanalysed") > 0) & ~acknowledged)


def removed_label(scope: Column, key: Column) -> Column:
    """What a key of the document's catalog or of a page is called; null for keys that stay."""
    named = lambda table, rest: F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in table.items() for x in kv]), key), F.lit(rest))
    return (
        F.when((scope == "trailer") & (key == "Info"), INFO_LABEL)
        .when((scope == "catalog") & key.isin(CATALOG_KEYS), named(CATALOG_LABELS, CATALOG_DEFAULT))
        .when((scope == "page") & key.isin(PAGE_KEYS), named(PAGE_LABELS, PAGE_DEFAULT))
    )
