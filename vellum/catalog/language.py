"""Queries about text and its language."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vellum.catalog.base import LINES, SP, lines, query, values
from vellum.functions import lexicon as lx
from vellum.functions import text as tx
from vellum.operators import detect as dt
from vellum.operators import trigrams as tg
from vellum.operators.lines import joined_text
from vellum.sources.files import table

#: Lines of our own, as the tables hold no Vietnamese.
INLINE = [
    "Mục tiêu của tuần này là hoàn thành bản vẽ",
    "Kiểm tra máy bơm trước khi mở van",
    "Người phụ trách: Trần Văn B",
    "Nguyễn Thị Hoa",
    "Đà Nẵng",
    "Hà Nội, Việt Nam",
    "Khong duoc mo cua khi may dang chay",
    "Le Van Minh",
    "Ho Chi Minh",
    "Vietnam office",
    "Crème brûlée à la maison",
    "El niño pequeño",
    "The pump is to be checked before use",
    "Đã sửa lỗi ở module login",
    "Tốt",
    "được",
    "gì",
    "a b c",
    "A B",
    "12345",
    "Ñandú",
    "QUY TRÌNH THAY THẾ",
    "ngã ngẫ họp họcc hỏc hớp",
]
_INLINE_SQL = values("inline", "n, text", list(enumerate(INLINE)))


def all_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = spark.createDataFrame([(-1, i, t) for i, t in enumerate(INLINE)], "doc_id long, line_no int, text string")
    return lines(spark, sf_dir).unionByName(own)


def _list(words: list[str] | tuple[str, ...]) -> str:
    return ", ".join(f"'{w}'" for w in words)


_TONED, _UNTONED = lx.tone_table()
_MARKED, _BARE = lx.bare_table()
ALL_LINES = f"{LINES}, {_INLINE_SQL}, every AS (SELECT doc_id, line_no, text, lang FROM lines UNION ALL SELECT -1, CAST(n AS INTEGER), text, 'inline' FROM inline)"
TOKENS = rf"""{ALL_LINES},
marked(s) AS (VALUES {", ".join(f"('{s}')" for s in lx.marked_syllables())}),
plain(s) AS (SELECT DISTINCT translate(s, '{_MARKED}', '{_BARE}') FROM marked),
split AS (
  SELECT doc_id, line_no, CAST(unnest(range(len(w))) AS INTEGER) AS i, unnest(w) AS text FROM (SELECT *, regexp_extract_all(text, '\p{{L}}+') AS w FROM every)),
keyed AS (
  SELECT *, lower(text) AS low, translate(lower(text), '{_MARKED}', '{_BARE}') AS key, translate(lower(text), '{_TONED}', '{_UNTONED}') AS toneless,
    length(text) - length(translate(lower(text), '{_TONED}', '')) AS tones FROM split),
tokens AS MATERIALIZED (
  SELECT k.*, regexp_matches(text, '[{lx.STRONG}]') AS strong, regexp_matches(text, '[{lx.WEAK}]') AS weak,
    m.s IS NOT NULL AND tones <= 1 AND NOT (regexp_matches(toneless, '(p|t|c|ch)$') AND regexp_matches(low, '[{lx.not_before_stop()}]')) AS valid,
    p.s IS NOT NULL AS plain, regexp_full_match(text, '\p{{Lu}}\p{{Ll}}*') AS title, regexp_full_match(text, '\p{{Lu}}') AS initial
  FROM keyed k LEFT JOIN marked m ON m.s = k.toneless LEFT JOIN plain p ON p.s = k.key),
islands AS MATERIALIZED (
  SELECT *, i - row_number() OVER (PARTITION BY doc_id, line_no ORDER BY i) AS island FROM tokens WHERE (title AND plain) OR initial OR low = 'vietnam'),
runs AS (
  SELECT doc_id, line_no, island, count(*) AS n, list(key ORDER BY i) AS ks, arg_max(initial, i) AS last_initial, bool_and(key IN ({_list(lx.VI_PLACE_WORDS)})) AS places FROM islands GROUP BY ALL),
names AS MATERIALIZED (
  SELECT doc_id, line_no, island FROM runs
  WHERE (n BETWEEN 2 AND 4 AND ks[1] IN ({_list(lx.VI_SURNAMES)}) AND (n = 2 OR ks[2] IN ({_list(lx.VI_MIDDLE_NAMES)}) OR last_initial)) OR (places AND (n >= 2 OR ks[1] = 'vietnam'))),
named AS (
  SELECT t.*, n.island IS NOT NULL AS in_name FROM tokens t LEFT JOIN islands s USING (doc_id, line_no, i) LEFT JOIN names n ON n.doc_id = s.doc_id AND n.line_no = s.line_no AND n.island = s.island)"""
SIGNALS = rf"""{TOKENS},
counted AS (
  SELECT doc_id, line_no, count(*) AS words, sum(CASE WHEN (strong OR weak) AND valid AND NOT in_name THEN CASE WHEN strong OR length(text) >= 3 THEN 1.0 ELSE 0.6 END ELSE 0 END ORDER BY i)::DOUBLE AS evidence,
    count_if((strong OR weak) AND valid AND NOT in_name)::BIGINT AS marked, count_if((strong OR weak) AND NOT valid)::BIGINT AS invalid, count_if(low IN ({_list(lx.VI_FUNCTION_WORDS)}))::BIGINT AS vi,
    count_if(low NOT IN ({_list(lx.VI_FUNCTION_WORDS)}) AND NOT (strong OR weak) AND low IN ({_list(lx.VI_PLAIN_FUNCTION_WORDS)}))::BIGINT AS vi_plain, count_if(low IN ({_list(lx.EN_FUNCTION_WORDS)}))::BIGINT AS en,
    count_if(plain)::BIGINT AS plains, count_if(in_name)::BIGINT AS names, count_if(in_name) > 0 AND bool_and(in_name OR initial) AS name_only FROM named GROUP BY ALL),
signals AS (
  SELECT e.doc_id, e.line_no, e.text, e.lang, length(regexp_replace(e.text, '\P{{L}}', '', 'g')) AS letters, length(regexp_replace(e.text, '[^{lx.STRONG}]', '', 'g')) AS strong, coalesce(words, 0) AS words, coalesce(evidence, 0.0) AS evidence,
    coalesce(marked / words, 0.0) AS marked_share, coalesce(invalid / words, 0.0) AS invalid_share, coalesce(invalid, 0) AS invalid_words, coalesce(vi, 0) AS vi_words, coalesce(vi_plain, 0) AS vi_plain_words,
    coalesce(en / words, 0.0) AS en_share, coalesce(plains / words, 0.0) AS plain_share, coalesce(names, 0) AS names, coalesce(name_only, false) AS name_only
  FROM every e LEFT JOIN counted c USING (doc_id, line_no)),
logits AS (
  SELECT *, {dt.BIAS} + {dt.FIRST_EVIDENCE} * least(evidence, 1) + {dt.MORE_EVIDENCE} * least(greatest(evidence - 1, 0), 3) + {dt.MARKED_SHARE} * marked_share + {dt.VI_WORD} * least(vi_words, 2)
    + {dt.VI_PLAIN_WORD} * least(vi_plain_words, 3) + {dt.INVALID_SHARE} * invalid_share + {dt.INVALID_WORD} * least(invalid_words, 2) + {dt.EN_SHARE} * en_share
    + CASE WHEN evidence = 0 AND NOT name_only AND words >= 3 AND plain_share >= 0.999 THEN {dt.PLAIN_SHARE} ELSE 0 END AS z FROM signals),
capped AS (SELECT *, CASE WHEN evidence = 0 THEN least(1 / (1 + exp(-z)), {dt.PLAIN_CAP}) ELSE 1 / (1 + exp(-z)) END AS p FROM logits),
scored AS (
  SELECT *, CASE WHEN letters = 0 THEN 0.0 ELSE floor(CASE WHEN NOT name_only THEN p WHEN strong > 0 THEN {dt.NAME_CAP} ELSE least(p, {dt.NAME_CAP}) END * 1000.0::DOUBLE + 0.5) / 1000.0::DOUBLE END AS confidence FROM capped)"""


@query(f"WITH {LINES} SELECT doc_id, line_no, text FROM lines")
def line_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines(spark, sf_dir)


@query(
    rf"""WITH told AS (SELECT 'd' || doc_id AS id, text FROM documents UNION ALL SELECT 'c' || conv_id || '-' || turn, text FROM conversations)
SELECT id, trim(regexp_replace(nfc_normalize(regexp_replace(text, '[\x00-\x08\x0B\x0C\x0E-\x1F\x7F-\x{{9F}}]', '', 'g')), '{SP}+', ' ', 'g'), ' ') AS text FROM told"""
)
def clean_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(F.concat(F.lit("d"), "doc_id").alias("id"), "text")
    said = table(spark, sf_dir, "conversations").select(F.concat(F.lit("c"), "conv_id", F.lit("-"), "turn").alias("id"), "text")
    return docs.unionByName(said).select("id", tx.squash(tx.clean(F.col("text"))).alias("text"))


@query(
    rf"""SELECT page_id, CAST(i AS INTEGER) AS line_no, text FROM (
  SELECT page_id, unnest(range(len(l))) AS i, trim(regexp_replace(unnest(l), '{SP}+', ' ', 'g'), ' ') AS text FROM (
    SELECT page_id, string_split(regexp_replace(regexp_replace(html, '(?is)<(script|style)\b.*?</(script|style)>', '', 'g'), '(?s)<[^>]*>', chr(10), 'g'), chr(10)) AS l FROM pages))
WHERE text <> ''"""
)
def html_visible_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    bare = F.regexp_replace(F.regexp_replace("html", r"(?is)<(script|style)\b.*?</(script|style)>", ""), r"(?s)<[^>]*>", "\n")
    rows = table(spark, sf_dir, "pages").select("page_id", F.posexplode(F.split(bare, "\n")).alias("line_no", "text"))
    return rows.withColumn("text", tx.squash(F.col("text"))).filter("text <> ''")


@query(f"WITH {TOKENS} SELECT doc_id, line_no, i, text, low AS lower, initial, title FROM tokens")
def tokenize_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = dt.tokens(all_lines(spark, sf_dir)).select("doc_id", "line_no", F.posexplode("tokens").alias("i", "t"))
    return rows.select("doc_id", "line_no", "i", "t.text", "t.lower", "t.initial", "t.title")


def _rule_sql() -> str:
    bans = " OR ".join(f"(o.s = '{o}' AND r.s[1] NOT IN ({_list(tuple(a))}))" for o, a in lx.ONLY_BEFORE.items())
    bans += " OR " + " OR ".join(f"(o.s = '{o}' AND r.s[1] IN ({_list(tuple(a))}))" for o, a in lx.NEVER_BEFORE.items())
    one = lambda words: ", ".join(f"('{w}')" for w in words)
    return f"""WITH o(s) AS (VALUES {one(lx.ONSETS)}), r(s) AS (VALUES {one(lx.RHYMES)})
SELECT DISTINCT s AS syllable, translate(s, '{_MARKED}', '{_BARE}') AS plain FROM (SELECT o.s || r.s AS s FROM o, r WHERE NOT ({bans}) UNION ALL SELECT '{lx.EXTRA_SYLLABLE}')"""


@query(_rule_sql())
def syllable_dimension(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.createDataFrame([(s, lx.strip_marks(s)) for s in lx.marked_syllables()], "syllable string, plain string")


@query(f"WITH {TOKENS} SELECT text, valid, plain, count(*) AS n FROM tokens GROUP BY ALL")
def token_syllable_validity(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = dt.tokens(all_lines(spark, sf_dir)).select(F.explode("tokens").alias("t"))
    return rows.groupBy("t.text", "t.valid", "t.plain").agg(F.count("*").alias("n"))


@query(f"WITH {TOKENS} SELECT s.doc_id, s.line_no, s.i, s.text FROM names n JOIN islands s ON s.doc_id = n.doc_id AND s.line_no = n.line_no AND s.island = n.island")
def name_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = dt.tokens(all_lines(spark, sf_dir)).select("doc_id", "line_no", F.posexplode("tokens").alias("i", "t"))
    return rows.filter("t.in_name").select("doc_id", "line_no", "i", "t.text")


_ROUND = "floor({0} * 1000000.0::DOUBLE + 0.5) / 1000000.0::DOUBLE AS {0}"


@query(
    f"""WITH {SIGNALS} SELECT doc_id, line_no, letters, words, {", ".join(_ROUND.format(c) for c in ("evidence", "marked_share", "invalid_share", "en_share", "plain_share"))},
  invalid_words, vi_words, vi_plain_words, names, name_only FROM signals"""
)
def line_signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = dt.signals(all_lines(spark, sf_dir)).select("doc_id", "line_no", "signals.*")
    exact = {c: tx.round_half_up(F.col(c), 6) for c in ("evidence", "marked_share", "invalid_share", "en_share", "plain_share")}
    longs = {c: F.col(c).cast("long") for c in ("letters", "words", "invalid_words", "vi_words", "vi_plain_words", "names")}
    return rows.withColumns(exact | longs).drop("strong_share")


def scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dt.signals(all_lines(spark, sf_dir)).withColumn("confidence", dt.confidence(F.col("signals")))


@query(f"WITH {SIGNALS} SELECT doc_id, line_no, confidence, CASE WHEN confidence >= 0.5 THEN 'vi' ELSE 'und' END AS language FROM scored")
def line_confidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = dt.VietnameseDetector().detect(all_lines(spark, sf_dir), ["doc_id", "line_no"])
    return found.select("doc_id", "line_no", "confidence", "language")


_TIER = "CASE WHEN confidence >= 0.85 THEN 'auto' WHEN confidence >= 0.6 THEN 'uncertain' ELSE 'none' END"


@query(f"WITH {SIGNALS} SELECT lang, {_TIER} AS tier, count(*) AS n FROM scored GROUP BY ALL")
def tier_counts_by_lang(spark: SparkSession, sf_dir: str) -> DataFrame:
    langs = F.broadcast(spark.createDataFrame([(-1, "inline")], "doc_id long, lang string"))
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang").unionByName(langs)
    rows = scored(spark, sf_dir).groupBy("doc_id", dt.tier(F.col("confidence"), dt.Thresholds()).alias("tier")).agg(F.count("*").alias("n"))
    return rows.join(docs, "doc_id").groupBy("lang", "tier").agg(F.sum("n").alias("n"))


@query(
    f"""WITH {SIGNALS}, presets(preset, a) AS (VALUES ('high', 0.65::DOUBLE), ('normal', 0.85::DOUBLE), ('strict', 0.95::DOUBLE))
SELECT preset, CASE WHEN confidence >= a THEN 'auto' WHEN confidence >= least(0.6, a) THEN 'uncertain' ELSE 'none' END AS tier, count(*) AS n FROM scored, presets GROUP BY ALL"""
)
def sensitivity_sweep(spark: SparkSession, sf_dir: str) -> DataFrame:
    tiers = [F.struct(F.lit(p).alias("preset"), dt.tier(F.col("confidence"), dt.Thresholds.preset(p)).alias("tier")) for p in dt.PRESETS]
    rows = scored(spark, sf_dir).select(F.explode(F.array(*tiers)).alias("x"))
    return rows.groupBy("x.preset", "x.tier").agg(F.count("*").alias("n"))


@query(f"WITH {TOKENS} SELECT text, strong, weak, low IN ({_list(lx.EN_FUNCTION_WORDS)}) AS english, count(*) AS n FROM tokens GROUP BY ALL")
def char_class_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = dt.tokens(all_lines(spark, sf_dir)).select(F.explode("tokens").alias("t"))
    return rows.groupBy("t.text", "t.strong", "t.weak", F.col("t.lower").isin(lx.EN_FUNCTION_WORDS).alias("english")).agg(F.count("*").alias("n"))


@query(f"WITH {ALL_LINES}, w AS (SELECT DISTINCT unnest(regexp_extract_all(text, '\\p{{L}}+')) AS word FROM every) SELECT word, replace(strip_accents(lower(word)), 'đ', 'd') AS bare FROM w")
def stripped_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = all_lines(spark, sf_dir).select(F.explode(dt.words(F.col("text"))).alias("word")).distinct()
    return rows.select("word", dt.bare(F.col("word")).alias("bare"))


@query(f"WITH {LINES} SELECT doc_id, string_agg(text, ' ' ORDER BY line_no) AS text FROM lines GROUP BY doc_id")
def text_dump(spark: SparkSession, sf_dir: str) -> DataFrame:
    return joined_text(lines(spark, sf_dir), ["doc_id"], ["line_no"])


@query("SELECT doc_id, sha256(text) AS hash FROM documents")
def document_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from vellum.functions.keys import sha256

    return table(spark, sf_dir, "documents").select("doc_id", sha256("text").alias("hash"))


@query(f"WITH {SIGNALS} SELECT detector, language, count(*) AS n FROM (SELECT 'language:vi' AS detector, CASE WHEN confidence >= 0.5 THEN 'vi' ELSE 'und' END AS language FROM scored UNION ALL SELECT 'digits', 'und' FROM every WHERE regexp_matches(text, '[0-9]')) GROUP BY ALL")
def detector_registry(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = dt.run_detectors([dt.VietnameseDetector(), dt.PatternDetector("digits", "[0-9]")], all_lines(spark, sf_dir), ["doc_id", "line_no"])
    return found.groupBy("detector", "language").agg(F.count("*").alias("n"))


def guessed(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return tg.guess(docs.select("doc_id", "text"), tg.profiles(docs), ["doc_id"])


@query()
def trigram_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return guessed(spark, sf_dir).select("doc_id", "language", tx.round_half_up(F.col("score"), 6).alias("score"), tx.round_half_up(F.col("runner_up"), 6).alias("runner_up"))


_CODES = ["eng", "vie", "deu", "kor", "xyz", "und"]


@query(f"""WITH {values("t", "code", [(c,) for c in _CODES])}, every AS (SELECT code FROM t UNION ALL SELECT lang FROM documents)
SELECT code, CASE {" ".join(f"WHEN code = '{k}' THEN '{v}'" for k, v in tg.CODES.items())} ELSE code END AS label, count(*) AS n FROM every GROUP BY ALL""")
def language_label(spark: SparkSession, sf_dir: str) -> DataFrame:
    told = spark.createDataFrame([(c,) for c in _CODES], "code string").unionByName(table(spark, sf_dir, "documents").select(F.col("lang").alias("code")))
    return told.withColumn("label", tg.short_code(F.col("code"))).groupBy("code", "label").agg(F.count("*").alias("n"))


#: Which of the lines of our own are Vietnamese; of names alone nothing is said.
TRUTH = [(INLINE[i], vi) for i, vi in ((0, True), (1, True), (2, True), (6, True), (10, False), (11, False), (12, False), (13, True), (14, True), (17, False), (19, False), (20, False), (21, True))]


@query(f"""WITH {SIGNALS}, {values("truth", "text, vi", TRUTH)} SELECT s.doc_id, s.line_no, t.vi, {_TIER} AS tier FROM scored s JOIN truth t ON t.text = s.text""")
def fixture_ground_truth(spark: SparkSession, sf_dir: str) -> DataFrame:
    truth = spark.createDataFrame(TRUTH, "text string, vi boolean")
    rows = scored(spark, sf_dir).join(F.broadcast(truth), "text")
    return rows.select("doc_id", "line_no", "vi", dt.tier(F.col("confidence"), dt.Thresholds()).alias("tier"))
