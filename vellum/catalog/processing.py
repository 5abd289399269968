"""Queries about recognised text and about what becomes of pages and documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vellum.catalog.base import LAID, laid, query
from vellum.catalog.pages import PAGE, r3
from vellum.functions import geometry as g
from vellum.functions import text as tx
from vellum.operators import detect as dt
from vellum.operators import masks as mk
from vellum.operators import ocr
from vellum.operators import processing as pr
from vellum.operators.lines import little_text
from vellum.sources.files import table

# recognised text: laid lines as an engine would give them, two blocks a page, every third line without words


def scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    edges = lambda b: F.struct(b["x"].alias("x0"), b["y"].alias("y0"), g.right(b).alias("x1"), g.top(b).alias("y1"))
    rows = laid(spark, sf_dir).withColumn("box", edges(F.col("bbox")))
    words = F.transform(F.split("text", " "), lambda w: F.struct(w.alias("text"), F.col("box").alias("bbox"), F.length(w).cast("double").alias("confidence")))
    words = F.when(F.col("line_no") % 3 == 0, F.array().cast(f"array<{ocr.WORD}>")).otherwise(words)
    line = F.struct("text", F.col("box").alias("bbox"), F.lit(None).cast(ocr.BOX).alias("baseline"), (F.col("confidence") * 100).alias("confidence"), words.alias("words"))
    parts = rows.groupBy(*PAGE, (F.col("ordinal") >= 4).alias("second")).agg(F.array_sort(F.collect_list(F.struct("ordinal", line.alias("line")))).alias("lines"))
    block = F.struct(F.array(F.struct(F.transform("lines", lambda x: x["line"]).alias("lines"))).alias("paragraphs"))
    return parts.groupBy(*PAGE).agg(F.transform(F.array_sort(F.collect_list(F.struct("second", block.alias("block")))), lambda x: x["block"]).alias("blocks"))


_FLAT = "flat AS (SELECT *, CAST(row_number() OVER (PARTITION BY doc_id, page_index ORDER BY ordinal) - 1 AS INTEGER) AS n FROM laid)"


@query(
    f"""WITH {LAID}, {_FLAT} SELECT doc_id, page_index, n AS line_no, text, {r3("x", "x0")}, {r3("y + height", "y1")}, {r3("confidence", "confidence")}, CAST(CASE WHEN line_no % 3 = 0 THEN 0 ELSE len(string_split(text, ' ')) END AS INTEGER) AS n_words FROM flat"""
)
def ocr_flatten(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = ocr.flatten(scans(spark, sf_dir), PAGE)
    r = lambda c, n: tx.round_half_up(F.col(c), 3).alias(n)
    return rows.select(*PAGE, "line_no", "text", r("bbox.x0", "x0"), r("bbox.y1", "y1"), r("confidence", "confidence"), F.size("words").alias("n_words"))


@query(
    f"""WITH {LAID}, {_FLAT}, w AS (
  SELECT doc_id, page_index, n, unnest(CASE WHEN line_no % 3 = 0 THEN [text] ELSE string_split(text, ' ') END) AS raw, generate_subscripts(CASE WHEN line_no % 3 = 0 THEN [text] ELSE string_split(text, ' ') END, 1) AS i, line_no, confidence FROM flat),
c AS (SELECT *, trim(regexp_replace(regexp_replace(raw, '[\\x00-\\x08\\x0B\\x0C\\x0E-\\x1F\\x7F-\\x{{9F}}]', '', 'g'), '[\\s\\x{{A0}}]+', ' ', 'g'), ' ') AS text FROM w)
SELECT doc_id, page_index, n AS line_no, CAST(row_number() OVER (PARTITION BY doc_id, page_index, n ORDER BY i) - 1 AS INTEGER) AS item_index, text, {r3("CASE WHEN line_no % 3 = 0 THEN confidence ELSE length(raw) / 100.0 END", "confidence")} FROM c WHERE text <> ''"""
)
def ocr_word_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = ocr.word_items(ocr.flatten(scans(spark, sf_dir), PAGE), PAGE)
    return rows.select(*PAGE, "line_no", "item_index", "text", tx.round_half_up(F.col("confidence"), 3).alias("confidence"))


_OPS = "CASE doc_id % 4 WHEN 0 THEN 'paintImageXObject' WHEN 1 THEN 'paintInlineImageXObject' WHEN 2 THEN 'paintImageXObjectRepeat' ELSE 'showText' END"


@query(
    f"""WITH {LAID} SELECT doc_id, page_index, sum(length(regexp_replace(text, '\\s', '', 'g'))) < 20 AND doc_id % 4 < 3 AS scanned FROM laid GROUP BY doc_id, page_index"""
)
def scanned_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = little_text(laid(spark, sf_dir), PAGE).withColumn("ops", F.array(F.lit("save"), F.expr(_OPS)))
    return pages.select(*PAGE, ocr.needs_ocr(F.col("little"), F.col("ops")).alias("scanned"))


@query(
    f"""WITH {LAID} SELECT doc_id, page_index, 'text' AS source, count(*) AS n, count(ocr_confidence) AS n_sure FROM laid GROUP BY ALL UNION ALL SELECT doc_id, page_index, 'ocr', count(*), count(ocr_confidence) FROM laid WHERE doc_id % 4 = 0 GROUP BY ALL"""
)
def lines_of_both_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = laid(spark, sf_dir)
    found = ocr.with_recognised(rows, rows.filter("doc_id % 4 = 0").select(*PAGE, "line_id", "text", "bbox", "ocr_confidence"))
    return found.groupBy(*PAGE, "source").agg(F.count("*").alias("n"), F.count("ocr_confidence").alias("n_sure"))


# pages and documents: events stand for what happened

_EVENT = """e AS (SELECT event_id, user_id % 200 AS doc_id, CAST(event_id % 6 AS INTEGER) AS page_index, CASE WHEN event_id % 11 = 0 THEN 'torn' END AS extract_error, CASE WHEN event_id % 13 = 0 THEN 'lost' END AS detect_error,
  event_id % 3 = 0 AS scanned, event_id % 5 < 3 AS enabled, CASE WHEN event_id % 7 = 0 THEN 'blurred' END AS ocr_failed FROM events),
s AS (SELECT *, extract_error IS NULL AND detect_error IS NULL AND scanned AND enabled AS tried FROM e),
p AS (SELECT event_id, doc_id, page_index, scanned, enabled, CASE WHEN extract_error IS NULL AND detect_error IS NULL THEN 'ready' ELSE 'error' END AS state, tried AND ocr_failed IS NULL AS ocr,
  CASE WHEN tried THEN ocr_failed END AS ocr_error, coalesce(extract_error, detect_error) AS error FROM s)"""


def pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = F.col("event_id")
    rows = table(spark, sf_dir, "events").select("event_id", (F.col("user_id") % 200).alias("doc_id"), (e % 6).cast("int").alias("page_index"), (e % 3 == 0).alias("scanned"), (e % 5 < 3).alias("enabled"))
    failed = lambda n, what: F.when(e % n == 0, what)
    state = pr.page_state(failed(11, "torn"), failed(13, "lost"), F.col("scanned"), F.col("enabled"), failed(7, "blurred"))
    return rows.withColumn("s", state).select("event_id", *PAGE, "scanned", "enabled", "s.*")


@query(f"WITH {_EVENT} SELECT event_id, doc_id, page_index, state, ocr, ocr_error, error FROM p")
def page_machine(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pages(spark, sf_dir).select("event_id", *PAGE, "state", "ocr", "ocr_error", "error")


_FAILED = "CASE event_id % 5 WHEN 0 THEN 'extracting' WHEN 1 THEN 'detecting' WHEN 2 THEN 'ocr' END"


@query(
    f"""WITH {_EVENT}, f AS (SELECT event_id, scanned AND enabled AS recognised, {_FAILED} AS failed FROM e)
SELECT event_id, CASE WHEN failed = 'extracting' THEN 'pending,extracting,error' WHEN failed = 'detecting' THEN CASE WHEN recognised THEN 'pending,extracting,ocr,detecting,error' ELSE 'pending,extracting,detecting,error' END
  WHEN recognised THEN 'pending,extracting,ocr,detecting,ready' ELSE 'pending,extracting,detecting,ready' END AS steps FROM f"""
)
def page_steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    steps = pr.page_steps(F.col("scanned"), F.col("enabled"), F.expr(_FAILED))
    return pages(spark, sf_dir).select("event_id", F.array_join(steps, ",").alias("steps"))


@query(
    f"""WITH {_EVENT} SELECT doc_id, count(*)::BIGINT AS processed, count_if(state = 'ready' AND scanned AND NOT ocr AND ocr_error IS NULL)::BIGINT AS no_text_pages, count_if(state = 'ready' AND ocr_error IS NOT NULL)::BIGINT AS ocr_failed_pages FROM p GROUP BY doc_id"""
)
def sidebar_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pr.sidebar_totals(pages(spark, sf_dir).withColumnRenamed("scanned", "no_text"))


@query(f"WITH {_EVENT} SELECT doc_id, bool_and(state = 'ready') AS ready FROM p GROUP BY doc_id")
def pages_all_ready(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pr.all_ready(pages(spark, sf_dir))


_STATUS = "['open', 'loaded', 'password-required', 'submit', 'password-incorrect', 'cancel', 'corrupt']"


@query(
    f"""WITH e AS (SELECT user_id AS doc_id, event_id AS seq, {_STATUS}[CAST(event_id * 31 % 7 AS INTEGER) + 1] AS event FROM events), l AS (SELECT doc_id, arg_max(event, seq) AS event, count_if(event = 'submit') AS tries FROM e GROUP BY doc_id)
SELECT doc_id, CASE WHEN event IN ('open', 'submit') THEN 'loading' WHEN event = 'loaded' THEN 'ready' WHEN event LIKE 'password-%' THEN 'password' WHEN event = 'cancel' THEN 'idle' ELSE 'error' END AS status, event = 'password-incorrect' AND tries > 0 AS wrong_password FROM l"""
)
def document_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    event = F.element_at(F.expr(f"array({_STATUS[1:-1]})"), (F.col("event_id") * 31 % 7 + 1).cast("int"))
    return pr.document_status(table(spark, sf_dir, "events").select(F.col("user_id").alias("doc_id"), F.col("event_id").alias("seq"), event.alias("event")))


_WANTED = "SELECT DISTINCT sha256(text) AS hash, doc_id % 2 = 0 AS ocr_enabled FROM documents"
_KEPT = "SELECT DISTINCT sha256(text) AS hash, doc_id % 3 = 0 AS ocr_enabled FROM documents WHERE length(text) % 2 = 0"


@query(f"WITH w AS ({_WANTED}), k AS ({_KEPT}) SELECT w.hash, w.ocr_enabled FROM w ANTI JOIN k ON k.hash = w.hash AND k.ocr_enabled = w.ocr_enabled")
def restart_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").withColumn("hash", F.sha2("text", 256))
    wanted = docs.select("hash", (F.col("doc_id") % 2 == 0).alias("ocr_enabled")).distinct()
    kept = docs.filter(F.length("text") % 2 == 0).select("hash", (F.col("doc_id") % 3 == 0).alias("ocr_enabled")).distinct()
    return pr.to_analyse(wanted, kept)


@query(
    f"""WITH {LAID}, h AS (SELECT DISTINCT l.page_index, sha256(d.text) AS hash FROM laid l JOIN documents d USING (doc_id)), k AS (SELECT DISTINCT l.page_index, sha256(d.text) AS hash FROM laid l JOIN documents d USING (doc_id) WHERE l.ocr_confidence > 0.5)
SELECT h.hash, h.page_index FROM h ANTI JOIN k ON k.hash = h.hash AND k.page_index = h.page_index"""
)
def ocr_cache_misses(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = laid(spark, sf_dir).join(table(spark, sf_dir, "documents").select("doc_id", F.sha2("text", 256).alias("hash")), "doc_id")
    return pr.to_recognise(rows.select("hash", "page_index").distinct(), rows.filter("ocr_confidence > 0.5"))


@query(
    """WITH k AS (SELECT 'h' || user_id % 9 AS hash, 'k' || event_id % 5 AS key, arg_max(event_type, event_id) AS override FROM events GROUP BY ALL) SELECT hash, key, override, false AS can_undo, false AS can_redo FROM k WHERE hash = 'h4'"""
)
def restored_decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    steps = table(spark, sf_dir, "events").select(F.concat(F.lit("h"), F.col("user_id") % 9).alias("hash"), F.concat(F.lit("k"), F.col("event_id") % 5).alias("key"), "event_id", "event_type")
    kept = steps.groupBy("hash", "key").agg(F.max_by("event_type", "event_id").alias("override"))
    return pr.restored(kept, "h4")


@query("SELECT user_id AS doc_id, event_type AS stage, count(*) AS pages, sum(event_id % 97)::BIGINT AS total_ms, max(event_id % 97) AS longest_ms FROM events GROUP BY ALL")
def stage_timings(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = F.col("event_id")
    log = table(spark, sf_dir, "events").select(F.col("user_id").alias("doc_id"), F.col("event_type").alias("stage"), (e * 100).alias("started"), (e * 100 + e % 97).alias("ended"))
    return pr.stage_timings(log, ["doc_id"])


# boxes and masks


@query(f"WITH {LAID} SELECT doc_id, line_id, {r3('2 * x', 'x0')}, {r3('1584 - 2 * (y + height)', 'y0')}, {r3('2 * (x + width)', 'x1')}, {r3('1584 - 2 * y', 'y1')}, {r3('x / 612', 'left_share')}, {r3('height / 792', 'height_share')} FROM laid")
def redact_rects(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = g.matrix(F.lit(2), F.lit(0), F.lit(0), F.lit(-2), F.lit(0), F.lit(1584))
    rows = laid(spark, sf_dir).withColumns({"r": g.rectangle(m, F.col("bbox")), "s": g.share_of(F.col("bbox"), F.lit(612), F.lit(792))})
    return rows.select("doc_id", "line_id", *[tx.round_half_up(F.col("r")[i], 3).alias(n) for i, n in enumerate(("x0", "y0", "x1", "y1"))], tx.round_half_up(F.col("s.x"), 3).alias("left_share"), tx.round_half_up(F.col("s.height"), 3).alias("height_share"))


@query(
    f"""WITH {LAID} SELECT doc_id, page_index, status, count(*) AS n, {r3("sum(width)", "width")} FROM (
  SELECT doc_id, page_index, 'auto' AS status, width + 4 AS width FROM laid UNION ALL SELECT doc_id, page_index, 'manual', 10.0 FROM laid WHERE line_id = 'p0-l0') GROUP BY ALL"""
)
def masks_with_manual(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = laid(spark, sf_dir)
    found = rows.select(*PAGE, "line_id", F.lit("rule").alias("detector"), F.lit("vi").alias("language"), "confidence")
    own = rows.filter("line_id = 'p0-l0'").select(*PAGE, F.concat(F.lit("manual:"), "doc_id").alias("key"), g.box(F.lit(300), F.lit(20), F.lit(10), F.lit(10)).alias("mask"), F.lit("manual").alias("status"), F.lit(1.0).alias("confidence"))
    none = spark.createDataFrame([], "doc_id long, key string, override string")
    out = mk.resolve(rows.drop("confidence"), found, none, dt.Thresholds(1.0, 1.0), manual=own)
    wide = out.join(rows.select(*PAGE, "line_id", (F.col("bbox.width") + 4).alias("whole")), [*PAGE, "line_id"], "left").withColumn("width", F.coalesce("whole", "mask.width"))
    return wide.groupBy(*PAGE, "status").agg(F.count("*").alias("n"), tx.round_half_up(F.sum("width"), 3).alias("width"))


_AUTO = "CASE event_id % 5 WHEN 0 THEN 0.65 WHEN 1 THEN 0.85 WHEN 2 THEN 0.95 WHEN 3 THEN 0.7 ELSE 0.8500004 END"


@query(f"SELECT CASE event_id % 5 WHEN 0 THEN 'high' WHEN 1 THEN 'normal' WHEN 2 THEN 'strict' WHEN 3 THEN 'custom' ELSE 'normal' END AS name, count(*) AS n FROM events GROUP BY ALL")
def sensitivity_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").withColumn("auto", F.expr(_AUTO).cast("double"))
    return rows.groupBy(dt.sensitivity(F.col("auto")).alias("name")).agg(F.count("*").alias("n"))

