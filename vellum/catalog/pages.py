"""Queries about layout, masks, exports and decisions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as Win
from pyspark.sql import functions as F

from vellum.catalog.base import ITEMS, LAID, LINES, OVERRIDDEN, decided, items, laid, lines, query, values
from vellum.functions import geometry as g
from vellum.functions import keys
from vellum.functions import text as tx
from vellum.operators import decisions as dc
from vellum.operators import detect as dt
from vellum.operators import layout as ly
from vellum.operators import masks as mk
from vellum.operators import verify as vf
from vellum.operators.lines import little_text
from vellum.plans import export, review, settings
from vellum.sources.files import load_error, table

T = dt.Thresholds()
PAGE = mk.PAGE


def flat(c: str, name: str = "") -> list:
    """A box's fields as columns, in thousandths, so that both engines' last bits agree."""
    return [tx.round_half_up(F.col(f"{c}.{f}"), 3).alias(name + f) for f in ("x", "y", "width", "height")]


def r3(sql: str, name: str) -> str:
    return f"floor(({sql}) * 1000.0::DOUBLE + 0.5) / 1000.0::DOUBLE AS {name}"


# layout

_RUN_RULE = "CAST(doc_id * 31 + item_index * 17 AS BIGINT)"
_GEOMETRY = f"""WITH {ITEMS}, k AS (SELECT doc_id, page_index, line_id, item_index, text, font_size AS s, u_start, baseline, width, {_RUN_RULE} % 4 AS q, {_RUN_RULE} % 7 = 0 AS tall FROM items)
SELECT doc_id, page_index, line_id, item_index, s AS font_size, s * 0.75 AS ascent, s * 0.25 AS descent, CASE WHEN tall THEN -90.0 ELSE CASE q WHEN 0 THEN 0.0 WHEN 1 THEN 90.0 WHEN 2 THEN 180.0 ELSE -90.0 END END AS rotation,
  {r3("CASE WHEN tall THEN u_start - s / 2 ELSE CASE q WHEN 0 THEN u_start WHEN 1 THEN u_start - 0.75 * s WHEN 2 THEN u_start - width ELSE u_start - 0.25 * s END END", "x")},
  {r3("CASE WHEN tall THEN baseline - 9 ELSE CASE q WHEN 0 THEN baseline - 0.25 * s WHEN 1 THEN baseline WHEN 2 THEN baseline - 0.75 * s ELSE baseline - width END END", "y")},
  {r3("CASE WHEN tall THEN s ELSE CASE WHEN q IN (0, 2) THEN width ELSE s END END", "width")}, {r3("CASE WHEN tall THEN 9 ELSE CASE WHEN q IN (0, 2) THEN s ELSE width END END", "height")} FROM k"""


def runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items as a parser would give them: turned by quarters, some written downwards."""
    rule = F.col("doc_id") * 31 + F.col("item_index") * 17
    s, pick = F.col("font_size"), lambda *v: F.element_at(F.array(*[F.lit(float(x)) for x in v]), (rule % 4 + 1).cast("int"))
    cos, sin = pick(1, 0, -1, 0), pick(0, 1, 0, -1)
    m = g.matrix(cos * s, sin * s, -sin * s, cos * s, F.col("u_start"), F.col("baseline"))
    rows = items(spark, sf_dir).select("doc_id", "page_index", "line_id", "item_index", "text", m.alias("m"), "width", F.lit(-9.0).alias("height"), F.lit("ltr").alias("dir"), (rule % 7 == 0).alias("vertical"))
    return rows.withColumns({"ascent": F.lit(0.75), "descent": F.lit(-0.25)})


@query(_GEOMETRY)
def item_geometry(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ly.items_from_runs(runs(spark, sf_dir)).select("doc_id", "page_index", "line_id", "item_index", "font_size", "ascent", "descent", tx.round_half_up(F.col("rotation"), 6).alias("rotation"), *flat("bbox"))


@query(
    f"""WITH {ITEMS}, e AS (SELECT *, max(u_end) OVER w AS reach, lag(font_size) OVER (PARTITION BY doc_id, line_id ORDER BY u_start, item_index) AS before FROM items
  WINDOW w AS (PARTITION BY doc_id, line_id ORDER BY u_start, item_index ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))
SELECT doc_id, line_id, item_index, CAST(sum(CASE WHEN u_start - reach > 1.5 * greatest(before, font_size) THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id, line_id ORDER BY u_start, item_index) AS INTEGER) AS segment FROM e"""
)
def gap_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ly.gap_segments(items(spark, sf_dir), ["doc_id", "line_id"]).select("doc_id", "line_id", "item_index", "segment")


@query(
    f"""WITH {ITEMS}, e AS (SELECT *, CASE WHEN u_start - max(u_end) OVER w > 0.18 * font_size THEN ' ' || text ELSE text END AS piece FROM items
  WINDOW w AS (PARTITION BY doc_id, line_id ORDER BY u_start, item_index ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))
SELECT doc_id, line_id, trim(string_agg(piece, '' ORDER BY u_start, item_index), ' ') AS text, min(x) AS x, min(y) AS y, max(x + width) - min(x) AS width, max(y + height) - min(y) AS height,
  list_sort(list(font_size))[CAST(floor(count(*) / 2) AS INTEGER) + 1] AS font_size, count(*) AS n_items FROM e GROUP BY doc_id, line_id"""
)
def line_assembly(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ly.assemble_lines(items(spark, sf_dir), ["doc_id", "line_id"])


_TWICE = "SELECT doc_id, line_id, item_index * 4 + c AS item_index, text, u_start + c * 4.0 AS u_start, u_end + c * 4.0 AS u_end FROM items, (VALUES (0), (1), (2)) t(c) WHERE c = 0 OR (doc_id + item_index) % 3 = 0"


@query(
    f"""WITH RECURSIVE {ITEMS}, twice AS ({_TWICE}), o AS (SELECT *, row_number() OVER (PARTITION BY doc_id, line_id ORDER BY u_start, item_index) AS n FROM twice),
kept AS (
  SELECT doc_id, line_id, n, item_index, true AS k, text, u_start, u_end FROM o WHERE n = 1
  UNION ALL
  SELECT o.doc_id, o.line_id, o.n, o.item_index, NOT d, CASE WHEN d THEN kept.text ELSE o.text END, CASE WHEN d THEN kept.u_start ELSE o.u_start END, CASE WHEN d THEN kept.u_end ELSE o.u_end END
  FROM kept JOIN o ON o.doc_id = kept.doc_id AND o.line_id = kept.line_id AND o.n = kept.n + 1,
    LATERAL (SELECT kept.text = o.text AND (least(kept.u_end, o.u_end) - greatest(kept.u_start, o.u_start)) / greatest(kept.u_end - kept.u_start, 1e-6) > 0.7 AS d) x)
SELECT doc_id, line_id, CAST(item_index AS INTEGER) AS item_index FROM kept WHERE k"""
)
def overprint_drop(spark: SparkSession, sf_dir: str) -> DataFrame:
    again = items(spark, sf_dir).withColumn("c", F.explode(F.array(F.lit(0), F.lit(1), F.lit(2)))).filter((F.col("c") == 0) | ((F.col("doc_id") + F.col("item_index")) % 3 == 0))
    twice = again.select("doc_id", "line_id", (F.col("item_index") * 4 + F.col("c")).alias("item_index"), "text", (F.col("u_start") + F.col("c") * 4.0).alias("u_start"), (F.col("u_end") + F.col("c") * 4.0).alias("u_end"))
    return ly.drop_overprint(twice, ["doc_id", "line_id"])


@query()
def group_lines_full(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = items(spark, sf_dir).withColumns(
        {"id": F.concat_ws("-", "line_id", "item_index"), "rotation": F.lit(0.0), "baseline_x": F.col("u_start"), "baseline_y": F.col("baseline"), "advance": F.col("width"), "dir": F.lit("ltr")}
    ).withColumns({"ascent": 0.75 * F.col("font_size"), "descent": 0.25 * F.col("font_size"), "item_index": F.expr("cast(substring_index(line_id, 'l', -1) as int) * 100000 + item_index")})
    return ly.group_lines(rows, PAGE)


@query(
    f"""WITH {LAID} SELECT doc_id, page_index, CAST(sum(length(regexp_replace(text, '\\s', '', 'g'))) AS BIGINT) AS n_chars, sum(length(regexp_replace(text, '\\s', '', 'g'))) < 20 AS little FROM laid GROUP BY doc_id, page_index"""
)
def little_text_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return little_text(laid(spark, sf_dir), PAGE)


_TURNS = [(w, h, r, u) for w, h in ((612.0, 792.0), (595.0, 842.0)) for r in (0, 90, 180, 270, 450, -90) for u in (1.0, 2.0, None)]


@query(
    f"""WITH {values("t", "w, h, r, u", _TURNS)}, s AS (SELECT *, CAST(((r % 360) + 360) % 360 AS INTEGER) AS turn, 2.0 * (96.0::DOUBLE / 72) * coalesce(u, 1.0) AS k FROM t)
SELECT CAST(w AS DOUBLE) AS w, CAST(h AS DOUBLE) AS h, CAST(r AS INTEGER) AS rotate, CAST(u AS DOUBLE) AS unit, {r3("CASE WHEN turn IN (90, 270) THEN h * k ELSE w * k END", "page_width")}, {r3("CASE WHEN turn IN (90, 270) THEN w * k ELSE h * k END", "page_height")},
  {r3("CASE turn WHEN 0 THEN 100 * k WHEN 90 THEN 200 * k WHEN 180 THEN (w - 130) * k ELSE (h - 240) * k END", "x")}, {r3("CASE turn WHEN 0 THEN (h - 240) * k WHEN 90 THEN 100 * k WHEN 180 THEN 200 * k ELSE (w - 130) * k END", "y")},
  {r3("CASE WHEN turn IN (90, 270) THEN 40 * k ELSE 30 * k END", "width")}, {r3("CASE WHEN turn IN (90, 270) THEN 30 * k ELSE 40 * k END", "height")} FROM s"""
)
def page_viewport_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = spark.createDataFrame(_TURNS, "w double, h double, rotate int, unit double")
    view = F.struct(F.lit(0.0).alias("x0"), F.lit(0.0).alias("y0"), F.col("w").alias("x1"), F.col("h").alias("y1"))
    rows = pages.withColumn("v", g.viewport(view, F.col("rotate"), F.col("unit"), F.lit(2.0)))
    rows = rows.withColumn("b", g.map_box(F.col("v.matrix"), g.box(F.lit(100), F.lit(200), F.lit(30), F.lit(40))))
    return rows.select("w", "h", "rotate", "unit", tx.round_half_up(F.col("v.width"), 3).alias("page_width"), tx.round_half_up(F.col("v.height"), 3).alias("page_height"), *flat("b"))


@query(f"WITH {LAID} SELECT doc_id, line_id, {r3('x', 'x')}, {r3('y', 'y')}, {r3('width', 'width')}, {r3('height', 'height')} FROM laid")
def affine_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    view = F.struct(F.lit(0.0).alias("x0"), F.lit(0.0).alias("y0"), F.lit(612.0).alias("x1"), F.lit(792.0).alias("y1"))
    rows = laid(spark, sf_dir).withColumn("m", g.viewport(view, F.col("line_no") * 90, F.lit(1.0), F.lit(1.5))["matrix"])
    there = rows.withColumn("px", g.map_box(F.col("m"), F.col("bbox")))
    return there.withColumn("b", g.map_box(g.invert(F.col("m")), F.col("px"))).select("doc_id", "line_id", *flat("b"))


@query(
    f"""WITH {LAID}, p AS (SELECT a.doc_id, a.line_id, b.line_id AS other_id, greatest(a.x, b.x) AS x0, greatest(a.y, b.y) AS y0, least(a.x + a.width, b.x + b.width) AS x1, least(a.y + a.height, b.y + b.height) AS y1,
    least(a.width * a.height, b.width * b.height) AS low FROM laid a JOIN laid b ON a.doc_id = b.doc_id AND a.page_index = b.page_index AND a.ordinal < b.ordinal)
SELECT doc_id, line_id, other_id, {r3("x0", "x")}, {r3("y0", "y")}, {r3("x1 - x0", "width")}, {r3("y1 - y0", "height")}, {r3("(x1 - x0) * (y1 - y0) / low", "ratio")} FROM p WHERE x1 > x0 AND y1 > y0"""
)
def box_algebra(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = laid(spark, sf_dir).select(*PAGE, "line_id", "ordinal", "bbox")
    b = a.select(*PAGE, F.col("line_id").alias("other_id"), F.col("ordinal").alias("later"), F.col("bbox").alias("other"))
    pairs = a.join(b, PAGE).filter((F.col("ordinal") < F.col("later")) & g.meets(F.col("bbox"), F.col("other")))
    both = pairs.withColumn("i", g.intersect(F.col("bbox"), F.col("other")))
    return both.select("doc_id", "line_id", "other_id", *flat("i"), tx.round_half_up(g.overlap_ratio(F.col("bbox"), F.col("other")), 3).alias("ratio"))


@query(f"WITH {LAID}, p AS (SELECT doc_id, page_index, 400.0 + 16.0 * count(*) AS height FROM laid GROUP BY ALL) SELECT doc_id, page_index, height, 24 + coalesce(sum(height + 16) OVER (PARTITION BY doc_id ORDER BY page_index ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0) AS top FROM p")
def page_tops(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = laid(spark, sf_dir).groupBy(*PAGE).agg((400.0 + 16.0 * F.count("*")).alias("height"))
    return ly.page_tops(pages, ["doc_id"])


_SIZES = [(612.0, 792.0), (2000.0, 3000.0), (100.0, 50.0), (842.0, 1191.0)]


@query(f"WITH {values('t', 'w, h', _SIZES)} SELECT CAST(w AS DOUBLE) AS w, CAST(h AS DOUBLE) AS h, {r3('least(300.0::DOUBLE / 72, sqrt(24000000.0::DOUBLE / (w * h)))', 'scale')} FROM t")
def ocr_render_scale(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.createDataFrame(_SIZES, "w double, h double").withColumn("scale", tx.round_half_up(ly.scanned_scale(F.col("w"), F.col("h")), 3))


_PAGES_SQL = "p AS (SELECT doc_id, page_index, 300.0 + max(width) AS width, 400.0 + 16.0 * count(*) AS height FROM laid GROUP BY ALL)"


def sized_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return laid(spark, sf_dir).groupBy(*PAGE).agg((300.0 + F.max("bbox.width")).alias("width"), (400.0 + 16.0 * F.count("*")).alias("height"))


@query(
    f"""WITH {LAID}, {_PAGES_SQL}, w AS (SELECT doc_id, least(6, greatest(0.1, (1000 - 48) / max(width))) AS fit_width FROM p GROUP BY doc_id),
h AS (SELECT doc_id, least(6, greatest(0.1, least((1000 - 48) / width, (700 - 48) / height))) AS fit_page FROM p WHERE page_index = 1 OR (page_index = 0 AND doc_id NOT IN (SELECT doc_id FROM p WHERE page_index = 1)))
SELECT doc_id, {r3("fit_width", "fit_width")}, {r3("fit_page", "fit_page")} FROM w JOIN h USING (doc_id)"""
)
def fit_zoom(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = sized_pages(spark, sf_dir)
    wide = ly.fit_zoom(pages, ["doc_id"], "width", F.lit(1), 1000, 700).select("doc_id", tx.round_half_up(F.col("zoom"), 3).alias("fit_width"))
    whole = ly.fit_zoom(pages, ["doc_id"], "page", F.lit(1), 1000, 700).select("doc_id", tx.round_half_up(F.col("zoom"), 3).alias("fit_page"))
    return wide.join(whole, "doc_id")


@query(f"WITH {LAID}, {_PAGES_SQL} SELECT doc_id, max(width) AS max_width, sum(height + 16) - 16 + 48 AS total_height FROM p GROUP BY doc_id")
def layout_extent(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ly.extent(sized_pages(spark, sf_dir), ["doc_id"])


@query(
    f"""WITH {LAID} SELECT doc_id, line_id, trim(regexp_replace(text, '\\s+', ' ', 'g'), ' ') AS text, {r3("x", "x")}, {r3("792 - (792 - y - height) - height", "y")}, {r3("width", "width")}, {r3("height", "height")}, {r3("y + 0.2 * height", "baseline_y")}, {r3("0.8 * height / 0.75", "font_size")}
FROM laid WHERE confidence >= 0.3 AND regexp_matches(text, '\\p{{L}}|\\p{{N}}')"""
)
def ocr_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = 3.0  # pixels a point, y down
    b = F.col("bbox")
    rows = laid(spark, sf_dir).withColumns(
        {
            "box": F.struct((b["x"] * k).alias("x0"), ((792 - g.top(b)) * k).alias("y0"), (g.right(b) * k).alias("x1"), ((792 - b["y"]) * k).alias("y1")),
            "base": F.lit(None).cast("double"),
            "to_image": g.matrix(F.lit(k), F.lit(0), F.lit(0), F.lit(-k), F.lit(0), F.lit(792 * k)),
        }
    )
    rows = ly.ocr_lines(rows.select("doc_id", "line_id", "text", "confidence", "box", "base", "to_image"))
    return rows.select("doc_id", "line_id", "text", *flat("bbox"), tx.round_half_up(F.col("baseline_y"), 3).alias("baseline_y"), tx.round_half_up(F.col("font_size"), 3).alias("font_size"))


@query(f"WITH {ITEMS} SELECT doc_id, line_id, item_index, CASE item_index % 3 WHEN 0 THEN 0.75 WHEN 1 THEN 0.9 END AS ascent FROM items")
def item_style_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    styles = F.create_map(F.lit("f0"), F.lit(0.75), F.lit("f1"), F.lit(0.9))
    font = F.concat(F.lit("f"), F.col("item_index") % 3)
    return items(spark, sf_dir).select("doc_id", "line_id", "item_index", F.try_element_at(styles, font).alias("ascent"))


# keys and masks

_HASH = "list_reduce(list_prepend(2166136261::BIGINT, list_transform(range(1, length(text) + 1), lambda i: unicode(text[i])::BIGINT)), lambda h, u: (xor(h, u) * 16777619) & 4294967295)"
_BASE36 = """list_reduce(list_prepend('', list_transform(range(0, 7), lambda i: '0123456789abcdefghijklmnopqrstuvwxyz'[CAST((h // CAST(pow(36, i) AS BIGINT)) % 36 AS INTEGER) + 1])), lambda a, d: d || a)"""


@query(
    f"""WITH {LAID}, t AS (SELECT *, {_HASH} AS h FROM laid)
SELECT doc_id, line_id, page_index || ':' || concat_ws(',', CAST(floor(x + 0.5) AS BIGINT), CAST(floor(y + 0.5) AS BIGINT), CAST(floor(width + 0.5) AS BIGINT), CAST(floor(height + 0.5) AS BIGINT)) || ':' || CASE WHEN h = 0 THEN '0' ELSE ltrim({_BASE36}, '0') END AS key FROM t"""
)
def region_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    return laid(spark, sf_dir).select("doc_id", "line_id", keys.region_key(F.col("page_index"), F.col("bbox"), F.col("text")).alias("key"))


@query(f"WITH {LAID} SELECT doc_id, page_index, line_id, {r3('x - 2', 'x')}, {r3('y - 1', 'y')}, {r3('width + 4', 'width')}, {r3('height + 2', 'height')}, confidence FROM laid WHERE confidence >= 0.25")
def candidate_masks(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = laid(spark, sf_dir)
    found = rows.filter("confidence >= 0.25").select(*PAGE, "line_id", F.lit("rule").alias("detector"), F.lit("vi").alias("language"), "confidence")
    stray = found.limit(0).unionByName(spark.createDataFrame([(-1, 0, "p0-l0", "rule", "vi", 1.0)], found.schema))
    return mk.candidates(rows.drop("confidence"), found.unionByName(stray)).select(*PAGE, "line_id", *flat("mask"), "confidence")


def detections(rows: DataFrame) -> DataFrame:
    return rows.select(*PAGE, "line_id", F.lit("rule").alias("detector"), F.lit("vi").alias("language"), "confidence")


_EDGE = f"""CASE WHEN NOT (least(m.r, o.x + o.w) > greatest(m.l, o.x) AND least(m.t, o.y + o.h) > greatest(m.b, o.y)) THEN m
  WHEN abs(baseline - o.base) > {mk.ROW_EM} * greatest(font_size, o.s) THEN CASE WHEN o.base < baseline
    THEN {{'l': m.l, 'r': m.r, 'b': greatest(m.b, least(baseline, CASE WHEN o.base + {mk.CAP_EM} * o.s <= baseline - {mk.DESCENDER_EM} * font_size THEN o.base + {mk.CAP_EM} * o.s ELSE (o.base + {mk.CAP_EM} * o.s + baseline - {mk.DESCENDER_EM} * font_size) / 2 END)), 't': m.t, 'x': 0.0, 'y': 0.0, 'w': 0.0, 'h': 0.0, 's': 0.0, 'base': 0.0}}
    ELSE {{'l': m.l, 'r': m.r, 'b': m.b, 't': least(m.t, greatest(baseline + 0.5 * font_size, CASE WHEN o.base >= baseline + {mk.CAP_EM} * font_size THEN o.base ELSE (o.base + baseline + {mk.CAP_EM} * font_size) / 2 END)), 'x': 0.0, 'y': 0.0, 'w': 0.0, 'h': 0.0, 's': 0.0, 'base': 0.0}} END
  WHEN o.x >= x + width / 2 THEN {{'l': m.l, 'r': least(m.r, greatest(x + width, (x + width + o.x) / 2)), 'b': m.b, 't': m.t, 'x': 0.0, 'y': 0.0, 'w': 0.0, 'h': 0.0, 's': 0.0, 'base': 0.0}}
  WHEN o.x + o.w <= x + width / 2 THEN {{'l': greatest(m.l, least(x, (o.x + o.w + x) / 2)), 'r': m.r, 'b': m.b, 't': m.t, 'x': 0.0, 'y': 0.0, 'w': 0.0, 'h': 0.0, 's': 0.0, 'base': 0.0}}
  ELSE m END"""


def clip_sql(visible: str) -> str:
    """Common table expressions: cut, the lines of told with their mask (l, r, b, t) cut back from those of visible."""
    whole = "{'l': x - 2.0, 'r': x + width + 2.0, 'b': y - 1.0, 't': y + height + 1.0, 'x': 0.0, 'y': 0.0, 'w': 0.0, 'h': 0.0, 's': 0.0, 'base': 0.0}"
    return f"""near AS (
  SELECT a.doc_id, a.page_index, a.line_id, list({{'l': 0.0, 'r': 0.0, 'b': 0.0, 't': 0.0, 'x': o.x, 'y': o.y, 'w': o.width, 'h': o.height, 's': o.font_size, 'base': o.baseline}} ORDER BY o.ordinal) AS near
  FROM told a JOIN {visible} o ON o.doc_id = a.doc_id AND o.page_index = a.page_index AND o.line_id <> a.line_id
  WHERE least(a.x + a.width + 2, o.x + o.width) > greatest(a.x - 2, o.x) AND least(a.y + a.height + 1, o.y + o.height) > greatest(a.y - 1, o.y) GROUP BY ALL),
cut AS (SELECT a.*, list_reduce(list_prepend({whole}, coalesce(near, [])), lambda m, o: {_EDGE}) AS c FROM told a LEFT JOIN near n ON n.doc_id = a.doc_id AND n.page_index = a.page_index AND n.line_id = a.line_id)"""


_CUT_BOX = f"{r3('c.l', 'x')}, {r3('c.b', 'y')}, {r3('greatest(0, c.r - c.l)', 'width')}, {r3('greatest(0, c.t - c.b)', 'height')}"


@query(f"WITH {LAID}, told AS (SELECT * FROM laid), {clip_sql('laid')} SELECT doc_id, page_index, line_id, {_CUT_BOX} FROM cut")
def neighbour_clip(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = laid(spark, sf_dir)
    return mk.clip(mk.candidates(rows.drop("confidence"), detections(rows)), rows).select(*PAGE, "line_id", *flat("mask"))


@query(
    f"""WITH {LAID}, {OVERRIDDEN}, told AS (SELECT * FROM tiered), seen AS (SELECT * FROM tiered WHERE tier <> 'auto'), {clip_sql("seen")}
SELECT doc_id, page_index, line_id, status, length(text) % 17 <> 0 AS visible, tier, {_CUT_BOX} FROM cut"""
)
def resolve_masks(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = laid(spark, sf_dir)
    n = F.length("text")
    told = rows.withColumn("key", keys.region_key(F.col("page_index"), F.col("bbox"), F.col("text"))).withColumn("override", F.when(n % 11 == 0, "ignored").when(n % 13 == 0, "confirmed"))
    overrides = told.filter("override IS NOT NULL").select("doc_id", "key", "override").distinct()
    revealed = told.filter(n % 17 == 0).select("doc_id", "key")
    out = mk.resolve(rows.drop("confidence"), detections(rows), overrides, T, revealed=revealed)
    return out.select(*PAGE, "line_id", "status", "visible", mk.tier_of(T).alias("tier"), *flat("mask"))


@query(
    f"""WITH {LAID}, {OVERRIDDEN} SELECT doc_id, line_id, status, tier, CASE WHEN tier = 'none' THEN 'hidden' WHEN tier = 'uncertain' THEN 'uncertain' WHEN length(text) % 17 = 0 THEN 'revealed' ELSE 'solid' END AS display FROM tiered"""
)
def effective_tiers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decided(spark, sf_dir).select("doc_id", "line_id", "status", "tier", mk.display(F.col("tier"), F.length("text") % 17 != 0, F.lit(True)).alias("display"))


@query(
    f"""WITH {LAID}, {OVERRIDDEN} SELECT doc_id, count_if(status = 'manual')::BIGINT AS manual, count_if(status = 'ignored' AND confidence >= 0.6)::BIGINT AS ignored, count_if(status NOT IN ('manual', 'ignored') AND tier = 'auto')::BIGINT AS auto,
  count_if(status NOT IN ('manual', 'ignored') AND tier = 'uncertain')::BIGINT AS uncertain FROM tiered GROUP BY doc_id"""
)
def mask_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return review.summary(decided(spark, sf_dir), ["doc_id"], T)


@query(
    f"""WITH {LAID}, {OVERRIDDEN} SELECT doc_id, page_index, CAST(row_number() OVER (PARTITION BY doc_id, page_index ORDER BY y + height DESC, ordinal) AS INTEGER) AS place, CAST(floor(confidence * 100 + 0.5) AS BIGINT) || '%' AS percent,
  CASE WHEN length(text) > 48 THEN text[1:48] || '…' ELSE text END AS label FROM tiered WHERE tier <> 'none' OR (status = 'ignored' AND confidence >= 0.6)"""
)
def results_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    order = Win.partitionBy(*PAGE).orderBy(g.top(F.col("mask")).desc(), "ordinal")
    rows = decided(spark, sf_dir).filter(review.is_result(T))
    return rows.select(*PAGE, F.row_number().over(order).alias("place"), review.percent(F.col("status"), F.col("confidence")).alias("percent"), review.label(F.col("status"), F.col("text")).alias("label"))


@query(
    f"""WITH {LAID}, {OVERRIDDEN}, p AS (SELECT doc_id, page_index, count_if(tier = 'auto') AS a, count_if(tier = 'uncertain') AS u, (doc_id + page_index) % 9 AS k FROM tiered GROUP BY ALL)
SELECT doc_id, page_index, CASE k WHEN 0 THEN '·' WHEN 1 THEN 'Analyzing' WHEN 2 THEN 'Running OCR' WHEN 3 THEN 'Error' WHEN 4 THEN 'OCR failed' WHEN 5 THEN 'No text' ELSE CASE WHEN k = 6 THEN 'OCR ' ELSE '' END || a || CASE WHEN u > 0 THEN ' +' || u || '?' ELSE '' END END AS label FROM p"""
)
def page_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = (F.col("doc_id") + F.col("page_index")) % 9
    rows = decided(spark, sf_dir).groupBy(*PAGE).agg(F.count_if(F.col("tier") == "auto").alias("a"), F.count_if(F.col("tier") == "uncertain").alias("u"))
    state = F.when(k == 0, "pending").when(k == 1, "detecting").when(k == 2, "ocr").when(k == 3, "error").otherwise("ready")
    return rows.select(*PAGE, review.page_status(state, k == 4, k == 5, k == 6, F.col("a"), F.col("u")).alias("label"))


@query(
    f"""WITH {LAID}, {OVERRIDDEN} SELECT doc_id, page_index, count(*) AS n, list(text ORDER BY ordinal) AS texts FROM tiered WHERE tier = 'auto' GROUP BY doc_id, page_index"""
)
def redaction_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return export.by_page(export.regions(decided(spark, sf_dir)))


@query(f"WITH {LAID}, {OVERRIDDEN} SELECT doc_id, count(*) AS regions, count(DISTINCT page_index) AS pages FROM tiered WHERE tier = 'auto' GROUP BY doc_id")
def redaction_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return export.report(export.regions(decided(spark, sf_dir)))


@query(f"WITH {LAID}, {OVERRIDDEN} SELECT count_if(tier <> 'auto' AND status = 'auto' AND confidence >= 0.6)::BIGINT AS excluded FROM tiered")
def excluded_uncertain(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decided(spark, sf_dir).agg(F.count_if(export.excluded_uncertain(T)).alias("excluded"))


_STATES = ["pending", "extracting", "ocr", "detecting", "ready", "error"]
_UPDATES = """updates AS (SELECT user_id % 200 AS doc_id, CAST(event_id % 6 AS INTEGER) AS page_index, event_id AS seq, CASE WHEN event_type = 'error' THEN 'error' WHEN event_id % 5 = 0 THEN 'error' ELSE 'ready' END AS state,
  event_id % 7 = 0 AS no_text, event_id % 2 = 0 AS ocr, CASE WHEN event_id % 3 = 0 THEN value END AS value FROM events),
current AS (SELECT * FROM updates QUALIFY row_number() OVER (PARTITION BY doc_id, page_index ORDER BY seq DESC) = 1)"""


def updates(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = F.col("event_id")
    return table(spark, sf_dir, "events").select(
        (F.col("user_id") % 200).alias("doc_id"),
        (e % 6).cast("int").alias("page_index"),
        e.alias("seq"),
        F.when(F.col("event_type") == "error", "error").when(e % 5 == 0, "error").otherwise("ready").alias("state"),
        (e % 7 == 0).alias("no_text"),
        (e % 2 == 0).alias("ocr"),
        F.when(e % 3 == 0, F.col("value")).alias("value"),
    )


@query(f"WITH {_UPDATES} SELECT doc_id, page_index, seq, state, value FROM current")
def page_state_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dc.latest(updates(spark, sf_dir), PAGE).select(*PAGE, "seq", "state", "value")


@query(
    f"""WITH {_UPDATES}, r AS (SELECT doc_id, count_if(state IN ('ready', 'error'))::BIGINT AS processed, count(*) AS page_count, coalesce(list(page_index ORDER BY page_index) FILTER (WHERE state = 'error'), []) AS failed,
  coalesce(list(page_index ORDER BY page_index) FILTER (WHERE state = 'ready' AND no_text AND NOT ocr), []) AS unanalysed FROM current GROUP BY doc_id)
SELECT *, processed = page_count AS complete, processed <> page_count OR len(failed) > 0 OR len(unanalysed) > 0 AS blocked FROM r"""
)
def export_readiness(spark: SparkSession, sf_dir: str) -> DataFrame:
    return export.readiness(dc.latest(updates(spark, sf_dir), PAGE)).withColumn("blocked", export.blocked(F.lit(True), F.lit(False)))


@query(f"WITH {_UPDATES}, n AS (SELECT doc_id, max(seq // 1000) AS run FROM updates GROUP BY doc_id) SELECT u.doc_id, count(*) AS n FROM updates u JOIN n ON n.doc_id = u.doc_id AND u.seq // 1000 = n.run GROUP BY u.doc_id")
def current_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = updates(spark, sf_dir).withColumn("run", F.expr("seq div 1000"))
    return dc.current_run(rows).groupBy("doc_id").agg(F.count("*").alias("n"))


# leaks

_REGIONS = "regions AS (SELECT doc_id, page_index, ordinal AS region_no, x, y, width, height FROM tiered WHERE tier = 'auto')"


def regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return export.regions(decided(spark, sf_dir)).select(*PAGE, F.col("ordinal").alias("region_no"), "region")


@query(
    f"""WITH {ITEMS}, {OVERRIDDEN}, {_REGIONS}, hits AS (
  SELECT i.doc_id, i.page_index, i.r * 100000 + i.item_index AS item_index, region_no, i.text FROM items i JOIN regions g ON g.doc_id = i.doc_id AND g.page_index = i.page_index
  WHERE least(i.x + i.width, g.x + g.width) > greatest(i.x, g.x) AND least(i.y + i.height, g.y + g.height) > greatest(i.y, g.y)
    AND (least(i.x + i.width, g.x + g.width) - greatest(i.x, g.x)) * (least(i.y + i.height, g.y + g.height) - greatest(i.y, g.y)) / (i.width * i.height) >= 0.5
  QUALIFY row_number() OVER (PARTITION BY i.doc_id, i.page_index, i.r, i.item_index ORDER BY region_no) = 1)
SELECT doc_id, page_index, CAST(region_no AS INTEGER) AS region_no, CAST(min(item_index) AS INTEGER) AS item_index, arg_min(text[1:40], item_index) AS detail FROM hits GROUP BY doc_id, page_index, region_no"""
)
def item_leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = items(spark, sf_dir).withColumns({"box": g.box(F.col("x"), F.col("y"), F.col("width"), F.col("height")), "item_index": F.expr("cast(substring_index(line_id, 'l', -1) as int) * 100000 + item_index")})
    leaks = vf.item_leaks(rows, regions(spark, sf_dir))
    return vf.dedupe(leaks, ["item_index"]).select(*PAGE, "region_no", "item_index", "detail")


@query(
    f"""WITH {LAID}, {OVERRIDDEN}, {_REGIONS}, chars AS (SELECT doc_id, page_index, ordinal * 10000000 + i AS char_index, c, x + (i + 0.5) * font_size * 0.5 AS cx, baseline AS cy FROM (SELECT *, unnest(string_split(text, '')) AS c, generate_subscripts(string_split(text, ''), 1) - 1 AS i FROM laid)),
hits AS (SELECT c.*, region_no FROM chars c JOIN regions g USING (doc_id, page_index) WHERE NOT regexp_full_match(c.c, '\\s*') AND cx BETWEEN x + 0.5 AND x + 0.5 + greatest(0, width - 1) AND cy BETWEEN y + 0.5 AND y + 0.5 + greatest(0, height - 1)
  QUALIFY row_number() OVER (PARTITION BY doc_id, page_index, char_index ORDER BY region_no) = 1)
SELECT doc_id, page_index, CAST(region_no AS INTEGER) AS region_no, count(*) AS n FROM hits GROUP BY ALL"""
)
def char_leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = laid(spark, sf_dir).select(*PAGE, "ordinal", "bbox", "font_size", "baseline", F.posexplode(F.split("text", "")).alias("i", "char")).filter("char <> ''")
    chars = rows.select(*PAGE, (F.col("ordinal") * 10000000 + F.col("i")).alias("char_index"), "char", (F.col("bbox.x") + (F.col("i") + 0.5) * F.col("font_size") * 0.5).alias("cx"), F.col("baseline").alias("cy"))
    return vf.char_leaks(chars, regions(spark, sf_dir)).groupBy(*PAGE, "region_no").agg(F.count("*").alias("n"))


_DARK = "CASE WHEN (doc_id + i) % (20 + page_index) = 0 THEN 200 ELSE 10 END"


@query(
    f"""WITH {LAID}, {OVERRIDDEN}, {_REGIONS}, px AS (SELECT doc_id, page_index, region_no, {_DARK} AS v FROM regions, range(60) t(i))
SELECT doc_id, page_index, CAST(region_no AS INTEGER) AS region_no, {r3("avg(CASE WHEN v * 3 < 60 THEN 1.0 ELSE 0.0 END)", "dark")} FROM px GROUP BY ALL HAVING avg(CASE WHEN v * 3 < 60 THEN 1.0 ELSE 0.0 END) < 0.97"""
)
def pixel_darkness(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = regions(spark, sf_dir).select(*PAGE, "region_no", F.explode(F.sequence(F.lit(0), F.lit(59))).alias("i")).withColumn("r", F.expr(_DARK))
    return vf.pixel_leaks(rows.withColumns({"g": F.col("r"), "b": F.col("r")})).withColumn("dark", tx.round_half_up(F.col("dark"), 3))


@query("SELECT doc_id, sum(n) = 0 AS ok, max(checked) AS checked, list_sort(list(DISTINCT engine)) AS engines, sum(n)::BIGINT AS n_leaks FROM (SELECT doc_id, 'chars' AS engine, n_chars % 9 AS checked, CASE WHEN doc_id % 4 = 0 THEN 1 ELSE 0 END AS n FROM documents UNION ALL SELECT doc_id, 'items', n_chars % 7, CASE WHEN doc_id % 6 = 0 THEN 2 ELSE 0 END FROM documents) GROUP BY doc_id")
def report_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")

    def report(engine: str, mod: int, every: int, n: int) -> DataFrame:
        return docs.select("doc_id", F.lit(engine).alias("engine"), (F.col("n_chars") % mod).alias("checked"), F.when(F.col("doc_id") % every == 0, n).otherwise(0).cast("long").alias("n_leaks"))

    return vf.merge_reports([report("chars", 9, 4, 1), report("items", 7, 6, 2)])


@query(f"WITH {LAID}, {OVERRIDDEN}, {_REGIONS} SELECT doc_id, page_index, count(*) AS n FROM regions WHERE page_index >= 2 GROUP BY ALL")
def region_page_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = laid(spark, sf_dir).filter("page_index < 2").select(*PAGE).distinct()
    return vf.stray_regions(regions(spark, sf_dir), pages).groupBy(*PAGE).agg(F.count("*").alias("n"))


@query(f"WITH {LAID} SELECT doc_id, page_index, line_id, page_index % 2 = 0 AS has_geometry FROM laid")
def geometry_zip(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = laid(spark, sf_dir).select(*PAGE, "line_id")
    known = rows.filter("page_index % 2 = 0").select(*PAGE).distinct().withColumn("known", F.lit(True))
    return rows.join(known, PAGE, "left").select(*PAGE, "line_id", F.coalesce("known", F.lit(False)).alias("has_geometry"))


# decisions and settings

_PAGES = [(i, c, n) for n, c in ((6, 0), (6, 3), (5, 4), (1, 0)) for i in range(n)]


@query(
    f"""WITH {values("t", "page, cur, n", _PAGES)} SELECT CAST(page AS INTEGER) AS page, CAST(cur AS INTEGER) AS cur, CAST(n AS INTEGER) AS n,
  CAST(row_number() OVER (PARTITION BY cur, n ORDER BY CASE WHEN page = cur THEN 0 WHEN page = cur + 1 THEN 1 WHEN page = cur - 1 THEN 2 WHEN page > cur THEN 3 ELSE 4 END, page) AS INTEGER) AS turn FROM t"""
)
def page_schedule(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.createDataFrame(_PAGES, "page int, cur int, n int")
    order = Win.partitionBy("cur", "n").orderBy(dc.page_schedule(F.col("page"), F.col("cur"), F.col("n")))
    return rows.withColumn("turn", F.row_number().over(order))


_OPS = ("set", "set", "clear", "add", "remove", "undo", "redo", "set")


def log(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = F.col("event_id")
    op = F.element_at(F.array(*map(F.lit, _OPS)), (F.floor(e / 3) % 8 + 1).cast("int"))
    value = F.when(op == "set", F.when(e % 2 == 0, "ignored").otherwise("confirmed"))
    return table(spark, sf_dir, "events").select((F.col("user_id") % 50).alias("doc_id"), e.alias("seq"), op.alias("op"), F.concat(F.lit("k"), e % 5).alias("key"), value.alias("value"))


@query(
    f"""WITH RECURSIVE log AS (
  SELECT user_id % 50 AS doc_id, row_number() OVER (PARTITION BY user_id % 50 ORDER BY event_id) AS n, {list(_OPS)}[CAST(event_id // 3 % 8 AS INTEGER) + 1] AS op, 'k' || event_id % 5 AS key,
    CASE WHEN event_id % 2 = 0 THEN 'ignored' ELSE 'confirmed' END AS value FROM events),
s AS (
  SELECT doc_id, 0::BIGINT AS n, []::VARCHAR[] AS o, []::VARCHAR[] AS m, []::STRUCT(o VARCHAR[], m VARCHAR[])[] AS past, []::STRUCT(o VARCHAR[], m VARCHAR[])[] AS future FROM log GROUP BY doc_id
  UNION ALL
  SELECT doc_id, n,
    CASE WHEN back THEN past[-1].o WHEN forth THEN future[-1].o WHEN new AND op = 'set' THEN list_append(list_filter(o, lambda e: split_part(e, '|', 1) <> key), key || '|' || value)
      WHEN new AND op = 'clear' THEN list_filter(o, lambda e: split_part(e, '|', 1) <> key) ELSE o END,
    CASE WHEN back THEN past[-1].m WHEN forth THEN future[-1].m WHEN new AND op = 'add' THEN list_append(m, key) WHEN new AND op = 'remove' THEN list_filter(m, lambda e: e <> key) ELSE m END,
    CASE WHEN back THEN past[1:len(past) - 1] WHEN forth THEN list_append(past, {{'o': o, 'm': m}}) WHEN new THEN list_append(past, {{'o': o, 'm': m}})[greatest(1, len(past) + 2 - {dc.HISTORY}):] ELSE past END,
    CASE WHEN back THEN list_append(future, {{'o': o, 'm': m}}) WHEN forth THEN future[1:len(future) - 1] WHEN new THEN [] ELSE future END
  FROM (SELECT l.doc_id, l.n, l.op, l.key, l.value, s.o, s.m, s.past, s.future, l.op = 'undo' AND len(s.past) > 0 AS back, l.op = 'redo' AND len(s.future) > 0 AS forth,
      CASE l.op WHEN 'set' THEN NOT list_contains(s.o, l.key || '|' || l.value) WHEN 'clear' THEN len(list_filter(s.o, lambda e: split_part(e, '|', 1) = l.key)) > 0 WHEN 'add' THEN true WHEN 'remove' THEN list_contains(s.m, l.key) ELSE false END AS new
    FROM s JOIN log l ON l.doc_id = s.doc_id AND l.n = s.n + 1)),
last AS (SELECT s.* FROM s JOIN (SELECT doc_id, max(n) AS n FROM log GROUP BY doc_id) e ON e.doc_id = s.doc_id AND e.n = s.n)
SELECT doc_id, split_part(e, '|', 1) AS key, split_part(e, '|', 2) AS override, false AS manual, can_undo, can_redo FROM (SELECT doc_id, unnest(o) AS e, len(past) > 0 AS can_undo, len(future) > 0 AS can_redo FROM last)
UNION ALL SELECT doc_id, unnest(m), NULL, true, len(past) > 0, len(future) > 0 FROM last"""
)
def decision_replay(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dc.replay(log(spark, sf_dir))


@query("SELECT user_id % 50 AS doc_id, event_id AS seq FROM events QUALIFY row_number() OVER (PARTITION BY user_id % 50 ORDER BY event_id DESC) <= 200")
def undo_tail(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dc.undo_tail(log(spark, sf_dir)).select("doc_id", "seq")


@query("WITH o AS (SELECT user_id, event_id % 9 AS doc, max(event_id) AS last FROM events GROUP BY ALL) SELECT user_id, doc, CAST(row_number() OVER (PARTITION BY user_id ORDER BY last DESC) AS INTEGER) AS rank FROM o QUALIFY rank <= 3")
def lru_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    opens = table(spark, sf_dir, "events").select("user_id", (F.col("event_id") % 9).alias("doc"), F.col("event_id").alias("seq"))
    return dc.recent_sessions(opens, "user_id", "doc", "seq")


@query(
    """WITH n AS (SELECT user_id % 50 AS doc_id, 'k' || event_id % 5 AS key, arg_max(CASE WHEN event_id % 3 > 0 THEN 'v' || event_id % 2 ELSE '' END, event_id) AS value FROM events GROUP BY ALL)
SELECT doc_id, count(*) AS n, string_agg(key || '=' || value, ',' ORDER BY key) AS overrides FROM n WHERE value <> '' GROUP BY doc_id"""
)
def override_map_ops(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = F.col("event_id")
    steps = table(spark, sf_dir, "events").select((F.col("user_id") % 50).alias("doc_id"), F.concat(F.lit("k"), e % 5).alias("key"), e.alias("seq"), F.when(e % 3 > 0, F.concat(F.lit("v"), e % 2)).alias("value"))
    maps = dc.override_map(steps)
    told = F.array_join(F.transform(F.map_entries("overrides"), lambda x: F.concat_ws("=", x["key"], x["value"])), ",")
    return maps.select("doc_id", F.size("overrides").cast("long").alias("n"), told.alias("overrides"))


@query(
    """WITH d AS (SELECT event_id, CAST(event_id % 6 AS INTEGER) AS page_index, least(a, a + b) AS x, least(c, c + e) AS y, abs(b) AS w, abs(e) AS h FROM (
  SELECT event_id, CAST(event_id % 700 AS DOUBLE) AS a, CAST(event_id % 90 - 40 AS DOUBLE) AS b, CAST(event_id % 1100 AS DOUBLE) AS c, CAST(event_id % 70 - 30 AS DOUBLE) AS e FROM events)),
p AS (SELECT event_id, page_index, x * 0.5 AS x0, 792 - (y + h) * 0.5 AS y0, (x + w) * 0.5 AS x1, 792 - y * 0.5 AS y1 FROM d WHERE w >= 4 AND h >= 4)
SELECT event_id, page_index, greatest(x0, 0.0) AS x, greatest(y0, 300.0) AS y, least(x1, 300.0) - greatest(x0, 0.0) AS width, least(y1, 792.0) - greatest(y0, 300.0) AS height FROM p WHERE least(x1, 300) > greatest(x0, 0) AND least(y1, 792) > greatest(y0, 300)"""
)
def manual_masks(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = F.col("event_id").cast("double")
    x, y = e % 700, e % 1100
    drags = table(spark, sf_dir, "events").select(
        "event_id", (F.col("event_id") % 6).cast("int").alias("page_index"), x.alias("x0"), y.alias("y0"), (x + e % 90 - 40).alias("x1"), (y + e % 70 - 30).alias("y1"),
        g.matrix(F.lit(2), F.lit(0), F.lit(0), F.lit(-2), F.lit(0), F.lit(1584)).alias("to_px"), g.box(F.lit(0), F.lit(300), F.lit(300), F.lit(492)).alias("page"),
    )
    return mk.manual_masks(drags).select("event_id", "page_index", *[F.col(f"mask.{f}").alias(f) for f in ("x", "y", "width", "height")])


_SETTINGS = [
    (-1, '{"version":1,"settings":{"thresholds":{"auto":0.7,"uncertain":0.65},"showUncertain":false,"maskPadding":{"x":30,"y":-2},"maskOpacity":0.1}}'),
    (-2, '{"version":1,"settings":{"thresholds":{"auto":"high","uncertain":0.9}}}'),
    (-3, '{"version":2,"settings":{"thresholds":{"auto":0.7}}}'),
    (-4, "not json"),
    (-5, None),
    (-6, '{"version":1,"settings":{"thresholds":{"auto":0.5},"showUncertain":"no"}}'),
    (-7, '{"version":1}'),
]
_WRAP = "CASE WHEN event_id % 2 = 0 THEN props ELSE '{\"version\":1,\"settings\":{\"thresholds\":{\"auto\":' || CAST(event_id % 120 AS VARCHAR) || 'e-2,\"uncertain\":' || CAST(event_id % 70 AS VARCHAR) || 'e-2}}}' END"


def _told_sql(path: str, least: float, most: str, fallback: float) -> str:
    full = f"'$.settings.{path}'"
    return f"CASE WHEN ours AND json_type(doc, {full}) IN ('UBIGINT', 'BIGINT', 'DOUBLE') THEN least({most}, greatest({least}::DOUBLE, CAST(json_extract(doc, {full}) AS DOUBLE))) ELSE least({fallback}::DOUBLE, {most}) END"


@query(
    f"""WITH {values("t", "id, raw", _SETTINGS)}, every AS (SELECT id, raw FROM t UNION ALL SELECT event_id, {_WRAP} FROM events),
parsed AS (SELECT id, CASE WHEN json_valid(raw) THEN raw ELSE '{{}}' END::JSON AS doc FROM every),
known AS (SELECT *, coalesce(CAST(json_extract(doc, '$.version') AS VARCHAR) = '1', false) AS ours FROM parsed),
a AS (SELECT *, {_told_sql("thresholds.auto", 0.5, "0.99::DOUBLE", 0.85)} AS auto FROM known)
SELECT CAST(id AS BIGINT) AS id, auto, {_told_sql("thresholds.uncertain", 0.3, "auto", 0.6)} AS uncertain, {_told_sql("maskPadding.x", 0.0, "12.0::DOUBLE", 2.0)} AS pad_x, {_told_sql("maskPadding.y", 0.0, "12.0::DOUBLE", 1.0)} AS pad_y,
  {_told_sql("maskOpacity", 0.5, "1.0::DOUBLE", 1.0)} AS opacity, CASE WHEN ours AND json_type(doc, '$.settings.showUncertain') = 'BOOLEAN' THEN CAST(json_extract(doc, '$.settings.showUncertain') AS BOOLEAN) ELSE true END AS shown FROM a"""
)
def settings_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.createDataFrame(_SETTINGS, "id long, raw string").unionByName(table(spark, sf_dir, "events").select(F.col("event_id").alias("id"), F.expr(_WRAP.replace("VARCHAR", "STRING")).alias("raw")))
    again = rows.withColumn("s", settings.parse(F.col("raw"))).withColumn("json", settings.dump(F.col("s"))).withColumn("s", settings.parse(F.col("json")))
    return again.select("id", "s.auto", "s.uncertain", "s.pad_x", "s.pad_y", "s.opacity", F.col("s.showUncertain").alias("shown"))


_KEYS = [("trailer", "Info"), *(("catalog", k) for k in export.CATALOG_KEYS), *(("page", k) for k in export.PAGE_KEYS), ("catalog", "Pages"), ("page", "Contents")]
_LABEL_SQL = " ".join(f"WHEN scope = 'catalog' AND key = '{k}' THEN '{v}'" for k, v in export.CATALOG_LABELS.items()) + " " + " ".join(f"WHEN scope = 'page' AND key = '{k}' THEN '{v}'" for k, v in export.PAGE_LABELS.items())


@query(
    f"""WITH {values("t", "scope, key", _KEYS)}, l AS (SELECT CASE WHEN scope = 'trailer' THEN '{export.INFO_LABEL}' {_LABEL_SQL} WHEN key IN ('Pages', 'Contents') THEN NULL WHEN scope = 'catalog' THEN '{export.CATALOG_DEFAULT}' ELSE '{export.PAGE_DEFAULT}' END AS label FROM t)
SELECT label, count(*) AS n FROM l WHERE label IS NOT NULL GROUP BY label"""
)
def removed_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.createDataFrame(_KEYS, "scope string, key string").withColumn("label", export.removed_label(F.col("scope"), F.col("key")))
    return rows.filter("label IS NOT NULL").groupBy("label").agg(F.count("*").alias("n"))


_ERRORS = [("password", "", False, False), ("password", "", True, False), ("password", "", False, True), ("invalid", "bad", False, False), ("other", "Unknown ENCRYPTion", False, False), ("other", "boom", False, False), ("other", None, False, False)]
_EVENT_ERRORS = "SELECT CASE event_id % 3 WHEN 0 THEN 'password' WHEN 1 THEN 'invalid' ELSE 'other' END AS kind, event_type || CASE WHEN event_id % 5 = 0 THEN ' Encrypted' ELSE '' END AS message, event_id % 2 = 0 AS wrong, event_id % 7 = 0 AS password FROM events"


@query(
    f"""WITH {values("t", "kind, message, wrong, password", _ERRORS)}, every AS (SELECT kind, message, wrong, password FROM t UNION ALL {_EVENT_ERRORS})
SELECT kind, message, wrong, password, CASE WHEN kind = 'password' AND (wrong OR password) THEN 'password-incorrect' WHEN kind = 'password' THEN 'password-required' WHEN kind = 'invalid' THEN 'corrupt'
  WHEN contains(lower(coalesce(message, '')), 'encrypt') THEN 'unsupported' ELSE 'unknown' END AS error, count(*) AS n FROM every GROUP BY ALL"""
)
def load_error_kind(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.createDataFrame(_ERRORS, "kind string, message string, wrong boolean, password boolean")
    e = F.col("event_id")
    told = table(spark, sf_dir, "events").select(
        F.when(e % 3 == 0, "password").when(e % 3 == 1, "invalid").otherwise("other").alias("kind"),
        F.concat("event_type", F.when(e % 5 == 0, " Encrypted").otherwise("")).alias("message"), (e % 2 == 0).alias("wrong"), (e % 7 == 0).alias("password"),
    )
    rows = rows.unionByName(told).withColumn("error", load_error(F.col("kind"), F.coalesce("message", F.lit("")), F.col("wrong"), F.col("password")))
    return rows.groupBy("kind", "message", "wrong", "password", "error").agg(F.count("*").alias("n"))


_PATHS = ["/a/b/Report.PDF", "C:\\docs\\x.pdf", "/a%20b/c%2Bd+e.txt", "plain", "/x/100%", "/d/%C3%A9t%C3%A9.pdf", ""]


@query(
    f"""WITH {values("t", "path", [(p,) for p in _PATHS])}, every AS (SELECT path FROM t UNION ALL SELECT url FROM pages UNION ALL SELECT replace(url, '?', '%3F') || '.pdf' FROM pages),
n AS (SELECT path, regexp_extract(url_decode(path), '([^/\\\\]*)$', 1) AS name FROM every)
SELECT path, name, lower(name) LIKE '%.pdf' AS is_pdf, regexp_replace(name, '[.]pdf$', '', 'i') || '-redacted.pdf' AS redacted FROM n"""
)
def path_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    urls = table(spark, sf_dir, "pages").select(F.col("url").alias("path"))
    rows = spark.createDataFrame([(p,) for p in _PATHS], "path string").unionByName(urls).unionByName(urls.select(F.concat(F.replace("path", F.lit("?"), F.lit("%3F")), F.lit(".pdf")).alias("path")))
    rows = rows.withColumn("name", tx.basename(tx.percent_decode(F.col("path"))))
    return rows.select("path", "name", tx.is_pdf_name(F.col("name")).alias("is_pdf"), tx.redacted_name(F.col("name")).alias("redacted"))


@query(f"WITH {LAID}, {OVERRIDDEN} SELECT doc_id, line_id, CASE WHEN line_no % 4 = 3 THEN 'pending' ELSE 'VI ' || printf('%.2f', confidence) END || ' | ' || text || ' | ' || CAST(floor(x + 0.5) AS BIGINT) || ',' || CAST(floor(y + 0.5) AS BIGINT) || ' | ' || tier AS label FROM tiered")
def debug_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = decided(spark, sf_dir)
    found = rows.filter("line_no % 4 <> 3").select("doc_id", "line_id", F.col("confidence").alias("score"), F.lit("vi").alias("language"))
    both = rows.join(found, ["doc_id", "line_id"], "left")
    return both.select("doc_id", "line_id", review.debug_label(F.col("language"), F.col("score"), F.col("text"), F.col("bbox.x"), F.col("bbox.y"), F.col("tier")).alias("label"))


@query(f"WITH {LAID}, {OVERRIDDEN} SELECT doc_id, line_id, CASE WHEN tier = 'uncertain' THEN 'Uncertain region, ' ELSE 'Detected region, ' END || CAST(floor(confidence * 100 + 0.5) AS BIGINT) || '%' AS label FROM tiered")
def mask_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decided(spark, sf_dir).select("doc_id", "line_id", review.spoken(F.col("status"), F.col("tier"), F.col("confidence")).alias("label"))
