"""What a reviewer sees: counts, result lists, page states."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vellum.functions import text as tx
from vellum.operators.detect import Thresholds

#: Fixed value: characters of a line that a result shows.
SNIPPET = 48


def summary(masks: DataFrame, by: list[str], t: Thresholds) -> DataFrame:
    """Counts of masks by what was decided; masks has status, confidence and tier."""
    status, tier = F.col("status"), F.col("tier")
    open_ = ~status.isin("manual", "ignored")
    return masks.groupBy(*by).agg(
        F.count_if(status == "manual").alias("manual"),
        F.count_if((status == "ignored") & (F.col("confidence") >= t.uncertain)).alias("ignored"),
        F.count_if(open_ & (tier == "auto")).alias("auto"),
        F.count_if(open_ & (tier == "uncertain")).alias("uncertain"),
    )


def is_result(t: Thresholds) -> Column:
    return (F.col("tier") != "none") | ((F.col("status") == "ignored") & (F.col("confidence") >= t.uncertain))


def label(status: Column, text: Column) -> Column:
    return tx.snippet(F.when(status == "manual", "Manual mask").otherwise(text), SNIPPET)


def percent(status: Column, score: Column) -> Column:
    return F.when(status == "manual", "—").otherwise(F.concat(tx.round_half_up(score * 100).cast("string"), F.lit("%")))


def spoken(status: Column, tier: Column, score: Column) -> Column:
    """A mask's accessible label."""
    sure = F.concat(tx.round_half_up(score * 100).cast("string"), F.lit("%"))
    return F.when(tier == "uncertain", F.concat(F.lit("Uncertain region, "), sure)).when(status == "manual", "Manual mask").otherwise(F.concat(F.lit("Detected region, "), sure))


def page_status(state: Column, ocr_error: Column, no_text: Column, ocr: Column, auto: Column, uncertain: Column) -> Column:
    count = F.concat(F.when(ocr, "OCR ").otherwise(""), auto.cast("string"), F.when(uncertain > 0, F.concat(F.lit(" +"), uncertain.cast("string"), F.lit("?"))).otherwise(""))
    working = F.when(state == "ocr", "Running OCR").otherwise("Analyzing")
    return (
        F.when(state.isNull() | (state == "pending"), "·")
        .when(state.isin("extracting", "detecting", "ocr"), working)
        .when(state == "error", "Error")
        .when(ocr_error, "OCR failed")
        .when(no_text & ~ocr, "No text")
        .otherwise(count)
    )


def debug_label(language: Column, score: Column, text: Column, x: Column, y: Column, tier: Column) -> Column:
    head = F.concat_ws(" ", F.upper(language), F.format_number(score, 2))
    place = F.concat_ws(",", tx.round_half_up(x).cast("string"), tx.round_half_up(y).cast("string"))
    return F.concat_ws(" | ", F.coalesce(F.when(score.isNotNull(), head), F.lit("pending")), text, place, tier)
