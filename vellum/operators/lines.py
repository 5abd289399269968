"""Lines of documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vellum.functions import text as tx

LINES_A_PAGE = 8


def split_lines(docs: DataFrame, id: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, line_no, text) of the lines that aren't blank; numbers count all lines, from 0. A null text has none."""
    rows = docs.select(F.col(id), F.posexplode(F.split(F.col(text), "\n")).alias("line_no", "text"))
    return rows.filter(~tx.is_blank(F.col("text")))


def joined_text(lines: DataFrame, keys: list[str], order: list[str], text: str = "text") -> DataFrame:
    """(keys, text): texts in order with a space between."""
    parts = F.array_sort(F.collect_list(F.struct(*order, F.col(text).alias("t"))))
    return lines.groupBy(*keys).agg(F.array_join(F.transform(parts, lambda p: p["t"]), " ").alias("text"))


def little_text(items: DataFrame, keys: list[str], text: str = "text", least: int = 20) -> DataFrame:
    """(keys, n_chars, little): pages with fewer than so many characters that aren't white space."""
    n = F.coalesce(F.sum(F.length(F.regexp_replace(F.col(text), tx.SPACE, ""))), F.lit(0)).cast("long")
    return items.groupBy(*keys).agg(n.alias("n_chars")).withColumn("little", F.col("n_chars") < least)


def page_of(line_no: Column) -> Column:
    return F.floor(line_no / LINES_A_PAGE).cast("int")
