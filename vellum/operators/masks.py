"""Masks over detected lines, the user's decisions on them, and what is shown.

lines: doc_id, page_index, line_id, text, bbox, font_size, baseline, rotation, ocr_confidence, ordinal (reading order).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vellum.functions import geometry as g
from vellum.functions import keys
from vellum.operators.detect import Thresholds, effective_tier

PAGE = ["doc_id", "page_index"]
# Padding in points; heights of capitals and depth of descenders, and what is one row, in ems.
PAD_X, PAD_Y = 2.0, 1.0
CAP_EM, DESCENDER_EM, ROW_EM = 0.75, 0.22, 0.3


def candidates(lines: DataFrame, detections: DataFrame, pad: tuple[float, float] = (PAD_X, PAD_Y)) -> DataFrame:
    """A padded mask for each detected line that there is: detections without a line go."""
    found = detections.select(*PAGE, "line_id", "detector", "language", "confidence")
    masks = lines.join(found, [*PAGE, "line_id"])
    key = keys.region_key(F.col("page_index"), F.col("bbox"), F.col("text"))
    return masks.withColumns({"key": key, "mask": g.pad(F.col("bbox"), *pad), "status": F.lit("auto")})


#: What a neighbour o allows the mask of a line: no further than these, infinite where it sets no bound. Across rows it is the
#: letters' height that counts, within a row the side it stands on.
_FAR = "double('infinity')"
_CAP, _DOWN, _OWN_CAP = f"o.baseline + {CAP_EM} * o.font_size", f"baseline - {DESCENDER_EM} * font_size", f"baseline + {CAP_EM} * font_size"
_OTHER_ROW = f"abs(rotation) < 1 AND abs(o.rotation) < 1 AND abs(baseline - o.baseline) > {ROW_EM} * greatest(font_size, o.font_size)"
_BOUNDS = f"""
transform(near, o -> transform(array(({_OTHER_ROW})), apart -> named_struct(
  'box', o.bbox,
  'low', IF(apart AND o.baseline < baseline, least(baseline, IF({_CAP} <= {_DOWN}, {_CAP}, ({_CAP} + {_DOWN}) / 2)), -{_FAR}),
  'high', IF(apart AND o.baseline >= baseline, greatest(baseline + 0.5 * font_size, IF(o.baseline >= {_OWN_CAP}, o.baseline, (o.baseline + {_OWN_CAP}) / 2)), {_FAR}),
  'left', IF(NOT apart AND o.bbox.x < bbox.x + bbox.width / 2 AND o.bbox.x + o.bbox.width <= bbox.x + bbox.width / 2, least(bbox.x, (o.bbox.x + o.bbox.width + bbox.x) / 2), -{_FAR}),
  'right', IF(NOT apart AND o.bbox.x >= bbox.x + bbox.width / 2, greatest(bbox.x + bbox.width, (bbox.x + bbox.width + o.bbox.x) / 2), {_FAR})))[0])"""
_CUT = """
aggregate(bounds, named_struct('l', mask.x, 'r', mask.x + mask.width, 'b', mask.y, 't', mask.y + mask.height), (m, o) ->
  IF(least(m.r, o.box.x + o.box.width) > greatest(m.l, o.box.x) AND least(m.t, o.box.y + o.box.height) > greatest(m.b, o.box.y),
     named_struct('l', greatest(m.l, o.left), 'r', least(m.r, o.right), 'b', greatest(m.b, o.low), 't', least(m.t, o.high)), m))"""


def clip(masks: DataFrame, visible: DataFrame, pages: DataFrame | None = None) -> DataFrame:
    """masks with mask cut back from the letters of the visible lines of their page, in reading order, and to the page.

    A page's lines are collected once, and each mask takes those it meets before any cut; cuts only make it smaller, so no
    neighbour is missed. One shuffle by page. Masks that nothing is left of go. pages: doc_id, page_index, page (a box)."""
    line = F.struct("ordinal", "line_id", "bbox", "font_size", "baseline", "rotation")
    around = visible.groupBy(*PAGE).agg(F.array_sort(F.collect_list(line)).alias("around"))
    met = lambda o: (o["line_id"] != F.col("line_id")) & g.meets(F.col("mask"), o["bbox"])
    out = masks.join(around, PAGE, "left").withColumn("near", F.coalesce(F.filter("around", met), F.expr("filter(array(struct(ordinal, line_id, bbox, font_size, baseline, rotation)), o -> false)")))
    out = out.withColumn("bounds", F.expr(_BOUNDS)).withColumn("cut", F.expr(_CUT))
    zero = F.lit(0.0)
    box = g.box(F.col("cut.l"), F.col("cut.b"), F.greatest(zero, F.col("cut.r") - F.col("cut.l")), F.greatest(zero, F.col("cut.t") - F.col("cut.b")))
    return on_page(out.withColumn("mask", box).drop("around", "near", "bounds", "cut"), pages)


def on_page(masks: DataFrame, pages: DataFrame | None) -> DataFrame:
    """masks cut to their page; without those that it has nothing of."""
    if pages is None:
        return masks
    return masks.join(pages, PAGE).withColumn("mask", g.intersect(F.col("mask"), F.col("page"))).drop("page").filter(F.col("mask").isNotNull())


def decide(masks: DataFrame, overrides: DataFrame, revealed: DataFrame | None = None) -> DataFrame:
    """masks with status and visible after the user's overrides (doc_id, key, override) and reveals (doc_id, key)."""
    out = masks.join(overrides.select("doc_id", "key", "override"), ["doc_id", "key"], "left")
    out = out.withColumn("status", F.when(F.col("status") == "manual", "manual").otherwise(F.coalesce("override", "status"))).drop("override")
    if revealed is None:
        return out.withColumn("visible", F.lit(True))
    shown = revealed.select("doc_id", "key").distinct().withColumn("shown", F.lit(True))
    return out.join(shown, ["doc_id", "key"], "left").withColumn("visible", F.col("shown").isNull()).drop("shown")


def resolve(lines: DataFrame, detections: DataFrame, overrides: DataFrame, t: Thresholds, pages: DataFrame | None = None, manual: DataFrame | None = None, revealed: DataFrame | None = None) -> DataFrame:
    """Masks as they are shown: first it is found which lines will be masked, which no cut changes; then masks are cut back from all
    others."""
    first = on_page(candidates(lines, detections), pages)
    masked = decide(first, overrides).filter(tier_of(t) == "auto").select(*PAGE, "line_id").distinct()
    seen = lines.join(masked, [*PAGE, "line_id"], "left_anti")
    out = decide(clip(first, seen), overrides, revealed)
    if manual is not None:
        out = out.unionByName(decide(manual, overrides, revealed), allowMissingColumns=True)
    return out


def tier_of(t: Thresholds) -> Column:
    return effective_tier(F.col("status"), F.col("confidence"), F.col("ocr_confidence"), t)


def display(tier: Column, visible: Column, show_uncertain: Column) -> Column:
    return F.when(tier == "none", "hidden").when(tier == "uncertain", F.when(show_uncertain, "uncertain").otherwise("hidden")).when(visible, "solid").otherwise("revealed")


def manual_masks(drags: DataFrame, least: float = 4.0) -> DataFrame:
    """drags (event_id, page_index, x0, y0, x1, y1 in pixels, to_px matrix, page box) as masks; small drags and such as miss
    the page go. The event's id makes the key."""
    drag = g.from_edges(F.col("x0"), F.col("y0"), F.col("x1"), F.col("y1"))
    rows = drags.withColumn("drag", drag).filter((F.col("drag.width") >= least) & (F.col("drag.height") >= least))
    rows = rows.withColumn("mask", g.intersect(g.map_box(g.invert(F.col("to_px")), F.col("drag")), F.col("page"))).filter(F.col("mask").isNotNull())
    key = F.concat_ws(":", F.lit("manual"), "page_index", keys.base36(F.col("event_id")))
    return rows.select("event_id", "page_index", key.alias("key"), "mask", F.lit("manual").alias("status"), F.lit(1.0).alias("confidence"))
