"""What the queries share: registration, inline rows, and frames made from the driver's tables by fixed rules.

The tables hold no positioned text. Lines are laid out by rule instead, in numbers that binary fractions hold exactly: eight
lines a page, 13 points apart, sizes 10, 12 and 14, half an em a character."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vellum.functions import geometry as g
from vellum.operators.lines import split_lines
from vellum.sources.files import table

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def register(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return register


def literal(v: object) -> str:
    if v is None:
        return "NULL"
    if isinstance(v, bool):
        return str(v).upper()
    return "'" + v.replace("'", "''") + "'" if isinstance(v, str) else repr(v)


def values(name: str, columns: str, rows: list[tuple]) -> str:
    """A common table expression for DuckDB."""
    body = ", ".join("(" + ", ".join(literal(v) for v in row) + ")" for row in rows)
    return f"{name}({columns}) AS (VALUES {body})"


#: White space for DuckDB's patterns.
SP = r"[\t\n\x0B\f\r \x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}]"
LINES = rf"""
lines AS (
  SELECT doc_id, lang, CAST(n - 1 AS INTEGER) AS line_no, text FROM (
    SELECT doc_id, lang, unnest(string_split(text, chr(10))) AS text, generate_subscripts(string_split(text, chr(10)), 1) AS n FROM documents)
  WHERE NOT regexp_full_match(text, '{SP}*'))"""
LAID = (
    LINES
    + """,
laid AS (
  SELECT *, 'p' || page_index || '-l' || r AS line_id, r AS ordinal, 72.0 + 24.0 * (r % 2) AS x, 720.0 - 13.0 * r - 0.25 * font_size AS y, length(text) * font_size * 0.5 AS width,
    font_size AS height, 720.0 - 13.0 * r AS baseline, CASE WHEN line_no % 5 = 0 THEN 0.25 + 0.5 * (line_no % 2) END AS ocr_confidence, ((length(text) * 7) % 101) / 100.0 AS confidence FROM (
    SELECT doc_id, line_no, text, CAST(line_no // 8 AS INTEGER) AS page_index, line_no % 8 AS r, CAST(10.0 + 2.0 * (line_no % 8 % 3) AS DOUBLE) AS font_size FROM lines))"""
)
OVERRIDDEN = """
decided AS (
  SELECT *, CASE WHEN length(text) % 11 = 0 THEN 'ignored' WHEN length(text) % 13 = 0 THEN 'confirmed' ELSE 'auto' END AS status FROM laid),
tiered AS (
  SELECT *, CASE WHEN status = 'confirmed' THEN 'auto' WHEN status = 'ignored' THEN 'none' WHEN confidence >= 0.85 AND ocr_confidence < 0.6 THEN 'uncertain'
    WHEN confidence >= 0.85 THEN 'auto' WHEN confidence >= 0.6 THEN 'uncertain' ELSE 'none' END AS tier FROM decided)"""
ITEMS = (
    LAID
    + """,
words AS (
  SELECT doc_id, page_index, line_id, r, font_size, baseline, unnest(w) AS text, CAST(generate_subscripts(w, 1) - 1 AS INTEGER) AS item_index FROM (SELECT *, ordinal AS r, regexp_extract_all(text, '[^ ]+') AS w FROM laid)),
items AS (
  SELECT *, 72.0 + 40.0 * item_index AS u_start, 72.0 + 40.0 * item_index + 4.0 * length(text) AS u_end, 72.0 + 40.0 * item_index AS x, baseline - 0.25 * font_size AS y, 4.0 * length(text) AS width, font_size AS height FROM words)"""
)


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return split_lines(table(spark, sf_dir, "documents"))


def laid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines with a place on a page, a size and a confidence."""
    r, n = F.expr("line_no % 8"), F.length("text")
    out = lines(spark, sf_dir).withColumns({"page_index": F.expr("line_no div 8").cast("int"), "r": r, "font_size": (10 + 2 * (r % 3)).cast("double")})
    size, base = F.col("font_size"), 720.0 - 13.0 * F.col("r")
    return out.withColumns(
        {
            "line_id": F.concat(F.lit("p"), "page_index", F.lit("-l"), "r"),
            "ordinal": F.col("r"),
            "baseline": base,
            "rotation": F.lit(0.0),
            "bbox": g.box(72 + 24 * (F.col("r") % 2), base - 0.25 * size, n * size * 0.5, size),
            "ocr_confidence": F.when(F.col("line_no") % 5 == 0, 0.25 + 0.5 * (F.col("line_no") % 2)),
            "confidence": ((n * 7) % 101) / 100.0,
        }
    ).drop("r")


def items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The words of laid lines as items 40 points apart, 4 points a character."""
    rows = laid(spark, sf_dir).select("doc_id", "page_index", "line_id", "font_size", "baseline", F.posexplode(F.regexp_extract_all("text", F.lit("[^ ]+"), F.lit(0))).alias("item_index", "text"))
    u, w = 72.0 + 40.0 * F.col("item_index"), 4.0 * F.length("text")
    return rows.withColumns({"u_start": u, "u_end": u + w, "x": u, "y": F.col("baseline") - 0.25 * F.col("font_size"), "width": w, "height": F.col("font_size")})


def decided(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Laid lines as masks with a status by rule, and their tier."""
    from vellum.operators.detect import Thresholds
    from vellum.operators.masks import tier_of

    n = F.length("text")
    rows = laid(spark, sf_dir).withColumn("status", F.when(n % 11 == 0, "ignored").when(n % 13 == 0, "confirmed").otherwise("auto"))
    return rows.withColumns({"tier": tier_of(Thresholds()), "mask": F.col("bbox")})
