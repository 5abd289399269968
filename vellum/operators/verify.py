"""Leak checks on exported pages: joins of what can still be extracted with the regions that should be gone."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as Win
from pyspark.sql import functions as F

from vellum.functions import geometry as g
from vellum.functions import text as tx

PAGE = ["doc_id", "page_index"]
#: Share of an item that may not lie in a region; inset of the region for characters; least share of dark pixels.
ITEM_SHARE, CHAR_INSET, DARK_SHARE, DARK_SUM = 0.5, 0.5, 0.97, 60


def _first(rows: DataFrame, per: list[str]) -> DataFrame:
    """Of each item's matches the region that comes first."""
    rank = F.row_number().over(Win.partitionBy(*per).orderBy("region_no"))
    return rows.withColumn("rank", rank).filter("rank = 1").drop("rank")


def item_leaks(items: DataFrame, regions: DataFrame) -> DataFrame:
    """items (page, item_index, text, box) that lie by half or more in a region (page, region_no, region) of their page."""
    shown = items.filter(~tx.is_blank(F.col("text")) & (g.area(F.col("box")) > 0))
    pairs = shown.join(regions, PAGE).filter(g.meets(F.col("box"), F.col("region")))
    share = g.area(g.intersect(F.col("box"), F.col("region"))) / g.area(F.col("box"))
    return _first(pairs.filter(share >= ITEM_SHARE), [*PAGE, "item_index"]).select(*PAGE, "item_index", "region_no", F.col("region"), F.lit("items").alias("engine"), F.substring("text", 1, 40).alias("detail"))


def char_leaks(chars: DataFrame, regions: DataFrame) -> DataFrame:
    """chars (page, char_index, char, cx, cy) whose centre lies in a region, less its rim."""
    inner = g.pad(F.col("region"), -CHAR_INSET, -CHAR_INSET)
    pairs = chars.filter(~tx.is_blank(F.col("char"))).join(regions.withColumn("inner", inner), PAGE)
    inside = F.col("cx").between(F.col("inner.x"), g.right(F.col("inner"))) & F.col("cy").between(F.col("inner.y"), g.top(F.col("inner")))
    return _first(pairs.filter(inside), [*PAGE, "char_index"]).select(*PAGE, "char_index", "region_no", F.col("region"), F.lit("chars").alias("engine"), F.col("char").alias("detail"))


def pixel_leaks(pixels: DataFrame) -> DataFrame:
    """(page, region_no, dark) of regions whose pixels (page, region_no, r, g, b) aren't dark enough; none says nothing."""
    dark = F.avg(F.when(F.col("r") + F.col("g") + F.col("b") < DARK_SUM, 1.0).otherwise(0.0))
    return pixels.groupBy(*PAGE, "region_no").agg(dark.alias("dark")).filter(F.col("dark") < DARK_SHARE)


def tenth(c: Column) -> Column:
    return F.floor(c * 10 + 0.5).cast("long")


def dedupe(leaks: DataFrame, order: list[str]) -> DataFrame:
    """The first leak of each page, engine and region corner (in tenths of a point)."""
    same = Win.partitionBy(*PAGE, "engine", tenth(F.col("region.x")), tenth(F.col("region.y"))).orderBy(*order)
    return leaks.withColumn("rank", F.row_number().over(same)).filter("rank = 1").drop("rank")


def merge_reports(reports: list[DataFrame]) -> DataFrame:
    """(doc_id, ok, checked, engines, n_leaks) from reports (doc_id, engine, checked, n_leaks)."""
    rows = reduce(DataFrame.unionByName, reports)
    return rows.groupBy("doc_id").agg(
        (F.sum("n_leaks") == 0).alias("ok"), F.max("checked").alias("checked"), F.array_sort(F.collect_set("engine")).alias("engines"), F.sum("n_leaks").alias("n_leaks")
    )


def stray_regions(regions: DataFrame, pages: DataFrame) -> DataFrame:
    """Regions on pages that there aren't."""
    return regions.join(pages.select(*PAGE), PAGE, "left_anti")


def require_clean(leaks: DataFrame) -> None:
    """Raises unless there are no leaks: nothing may be written otherwise."""
    if not leaks.isEmpty():
        raise ValueError("validation failed: redacted content can still be extracted")
