"""Language scores of lines: tokens, names, signals, a logistic score and tiers.

Everything is an expression over the line's row: no shuffle, no Python. A null line scores like an empty one.
"""

from __future__ import annotations

from abc import ABC, abstractmethod
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vellum.functions import lexicon as lx
from vellum.functions import text as tx

# The weights of the logistic score and its caps.
BIAS = -3.2
FIRST_EVIDENCE = 4.6
MORE_EVIDENCE = 0.9
MARKED_SHARE = 2.0
VI_WORD = 1.2
VI_PLAIN_WORD = 0.9
PLAIN_SHARE = 2.0
TRIGRAM_MARGIN = 1.6
INVALID_SHARE = -5.0
INVALID_WORD = -2.0
EN_SHARE = -4.0
PLAIN_CAP = 0.78
NAME_CAP = 0.7
OCR_LEAST = 0.6
PRESETS = {"high": 0.65, "normal": 0.85, "strict": 0.95}


@dataclass(frozen=True)
class Thresholds:
    """Tiers are derived from scores when they are asked for; the uncertain bound is never above the automatic one."""

    auto: float = 0.85
    uncertain: float = 0.6

    def with_auto(self, auto: float) -> Thresholds:
        return Thresholds(auto, min(self.uncertain, auto))

    def with_uncertain(self, uncertain: float) -> Thresholds:
        return Thresholds(self.auto, min(uncertain, self.auto))

    @staticmethod
    def preset(name: str) -> Thresholds:
        return Thresholds().with_auto(PRESETS[name])


def sensitivity(auto: Column) -> Column:
    named = reduce(lambda c, kv: c.when(F.abs(auto - kv[1]) < 1e-6, kv[0]), PRESETS.items(), F.when(F.lit(False), ""))
    return named.otherwise("custom")


def quoted(values: list[str] | tuple[str, ...]) -> str:
    return ", ".join(f"'{v}'" for v in values)


def words(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(r"\p{L}+"), F.lit(0))


def bare(c: Column) -> Column:
    """Lower case without any marks."""
    return F.translate(F.lower(c), *lx.bare_table())


_KEY = "translate(lower(w), '{}', '{}')".format(*lx.bare_table())
_TONELESS = "translate(lower(w), '{}', '{}')".format(*lx.tone_table())
_TOKEN = f"""
transform(words, w -> named_struct(
  'text', w, 'lower', lower(w), 'key', {_KEY},
  'strong', w rlike '[{lx.STRONG}]', 'weak', w rlike '[{lx.WEAK}]',
  'valid', {_TONELESS} IN ({quoted(lx.marked_syllables())}) AND length(w) - length(translate(lower(w), '{lx.tone_table()[0]}', '')) <= 1
    AND NOT ((right(w, 1) IN ('p', 't', 'c', 'P', 'T', 'C') OR lower(right(w, 2)) = 'ch') AND translate(lower(w), '{lx.not_before_stop()}', '') <> lower(w)),
  'plain', {_KEY} IN ({quoted(lx.plain_syllables())}),
  'title', w rlike '^\\\\p{{Lu}}\\\\p{{Ll}}*$', 'initial', w rlike '^\\\\p{{Lu}}$'))"""
_CANDIDATE = "((t.title AND t.plain) OR t.initial OR t.lower = 'vietnam')"
#: Places (from, to) of the longest runs of candidates: one opens where the token before is none, and closes likewise.
_RUNS = """
transform(
  arrays_zip(
    filter(sequence(0, size(flags) - 1), i -> flags[i] AND (i = 0 OR NOT flags[greatest(i - 1, 0)])),
    filter(sequence(0, size(flags) - 1), i -> flags[i] AND (i = size(flags) - 1 OR NOT flags[least(i + 1, size(flags) - 1)]))),
  r -> named_struct('a', r['0'], 'z', r['1']))"""
_IS_NAME = f"""
(r.z - r.a BETWEEN 1 AND 3 AND bare[r.a].key IN ({quoted(lx.VI_SURNAMES)})
   AND (r.z - r.a = 1 OR bare[r.a + 1].key IN ({quoted(lx.VI_MIDDLE_NAMES)}) OR bare[r.z].initial))
 OR (forall(slice(bare, r.a + 1, r.z - r.a + 1), t -> t.key IN ({quoted(lx.VI_PLACE_WORDS)})) AND (r.z > r.a OR bare[r.a].key = 'vietnam'))"""
_FIELDS = ", ".join(f"'{f}', t.{f}" for f in ("text", "lower", "key", "strong", "weak", "valid", "plain", "title", "initial"))


def _let(name: str, value: str, then: str) -> str:
    """SQL that evaluates value once for all its uses in then."""
    return f"transform(array({value}), {name} -> {then})[0]"


_NAMES = _let("flags", f"transform(bare, t -> {_CANDIDATE})", f"IF(array_contains(flags, true), filter({_RUNS}, r -> {_IS_NAME}), cast(array() AS array<struct<a:int,z:int>>))")
_NAMED = _let("names", _NAMES, f"transform(bare, (t, i) -> named_struct({_FIELDS}, 'in_name', size(names) > 0 AND exists(names, r -> i BETWEEN r.a AND r.z)))")


def tokens(lines: DataFrame, text: str = "text") -> DataFrame:
    """lines with tokens: an array of (text, lower, key, strong, weak, valid, plain, title, initial, in_name)."""
    words_ = f"regexp_extract_all(coalesce({text}, ''), '\\\\p{{L}}+', 0)"
    return lines.withColumn("tokens", F.expr(_let("bare", _TOKEN.replace("transform(words,", f"transform({words_},"), _NAMED)))


def signals(lines: DataFrame, text: str = "text") -> DataFrame:
    """lines with signals, a struct of counts and shares over the line's tokens; shares of nothing are 0."""
    out = tokens(lines, text)
    line = F.coalesce(F.col(text), F.lit(""))
    count = lambda test: F.expr(f"size(filter(tokens, t -> {test}))")
    marked = "(t.strong OR t.weak)"
    n = F.size("tokens")
    share = lambda c: F.when(n > 0, c / n).otherwise(F.lit(0.0))
    letters, strong = F.regexp_count(line, F.lit(r"\p{L}")), F.regexp_count(line, F.lit(f"[{lx.STRONG}]"))
    evidence = F.expr(f"aggregate(filter(tokens, t -> {marked} AND t.valid AND NOT t.in_name), 0D, (s, t) -> s + IF(t.strong OR length(t.text) >= 3, 1D, 0.6D))")
    invalid, names = count(f"{marked} AND NOT t.valid"), count("t.in_name")
    vi = f"t.lower IN ({quoted(lx.VI_FUNCTION_WORDS)})"
    return out.withColumn(
        "signals",
        F.struct(
            letters.alias("letters"),
            n.alias("words"),
            F.when(letters > 0, strong / letters).otherwise(F.lit(0.0)).alias("strong_share"),
            evidence.alias("evidence"),
            share(count(f"{marked} AND t.valid AND NOT t.in_name")).alias("marked_share"),
            share(invalid).alias("invalid_share"),
            invalid.alias("invalid_words"),
            count(vi).alias("vi_words"),
            count(f"NOT {vi} AND NOT {marked} AND t.lower IN ({quoted(lx.VI_PLAIN_FUNCTION_WORDS)})").alias("vi_plain_words"),
            share(count(f"t.lower IN ({quoted(lx.EN_FUNCTION_WORDS)})")).alias("en_share"),
            share(count("t.plain")).alias("plain_share"),
            ((names > 0) & F.expr("forall(tokens, t -> t.in_name OR t.initial)")).alias("name_only"),
            names.alias("names"),
        ),
    ).drop("tokens")


def confidence(s: Column, margin: Column | None = None) -> Column:
    """The score of a signals struct, rounded to three places; margin is the trigram margin times its reliability."""
    at_most = lambda c, n: F.least(c.cast("double"), F.lit(float(n)))
    logit = (
        F.lit(BIAS)
        + FIRST_EVIDENCE * at_most(s["evidence"], 1)
        + MORE_EVIDENCE * at_most(F.greatest(s["evidence"] - 1, F.lit(0.0)), 3)
        + MARKED_SHARE * s["marked_share"]
        + VI_WORD * at_most(s["vi_words"], 2)
        + VI_PLAIN_WORD * at_most(s["vi_plain_words"], 3)
        + INVALID_SHARE * s["invalid_share"]
        + INVALID_WORD * at_most(s["invalid_words"], 2)
        + EN_SHARE * s["en_share"]
        + (TRIGRAM_MARGIN * margin if margin is not None else F.lit(0.0))
    )
    no_evidence = s["evidence"] == 0
    logit = logit + F.when(no_evidence & ~s["name_only"] & (s["words"] >= 3) & (s["plain_share"] >= 0.999), PLAIN_SHARE).otherwise(0.0)
    p = 1 / (1 + F.exp(-logit))
    p = F.when(no_evidence, F.least(p, F.lit(PLAIN_CAP))).otherwise(p)
    p = F.when(s["name_only"], F.when(s["strong_share"] > 0, F.lit(NAME_CAP)).otherwise(F.least(p, F.lit(NAME_CAP)))).otherwise(p)
    return F.when(s["letters"] == 0, F.lit(0.0)).otherwise(tx.round_half_up(p, 3))


def tier(score: Column, t: Thresholds) -> Column:
    return F.when(score >= t.auto, "auto").when(score >= min(t.uncertain, t.auto), "uncertain").otherwise("none")


def effective_tier(status: Column, score: Column, ocr: Column, t: Thresholds) -> Column:
    """With the user's decision, and never automatic on poorly recognised text."""
    doubtful = (tier(score, t) == "auto") & F.coalesce(ocr < OCR_LEAST, F.lit(False))
    return F.when(status.isin("confirmed", "manual"), "auto").when(status == "ignored", "none").when(doubtful, "uncertain").otherwise(tier(score, t))


class LineDetector(ABC):
    """A producer of detections (line keys, detector, language, confidence) from lines."""

    id: str

    @abstractmethod
    def detect(self, lines: DataFrame, keys: list[str]) -> DataFrame: ...


class VietnameseDetector(LineDetector):
    id = "language:vi"

    def __init__(self, other: Column | None = None):
        self.other = other if other is not None else F.lit("und")

    def detect(self, lines: DataFrame, keys: list[str]) -> DataFrame:
        rows = signals(lines).withColumn("confidence", confidence(F.col("signals")))
        language = F.when(F.col("confidence") >= 0.5, "vi").otherwise(self.other)
        return rows.select(*keys, F.lit(self.id).alias("detector"), language.alias("language"), "confidence", "signals")


class PatternDetector(LineDetector):
    """Lines that a pattern is found in, with one confidence for all."""

    def __init__(self, id: str, pattern: str, language: str = "und", score: float = 1.0):
        self.id, self.pattern, self.language, self.score = id, pattern, language, score

    def detect(self, lines: DataFrame, keys: list[str]) -> DataFrame:
        found = lines.filter(F.regexp_like("text", F.lit(self.pattern)))
        return found.select(*keys, F.lit(self.id).alias("detector"), F.lit(self.language).alias("language"), F.lit(self.score).alias("confidence"))


def run_detectors(detectors: list[LineDetector], lines: DataFrame, keys: list[str]) -> DataFrame:
    """All detectors' finds; ordinal is the detector's place."""
    columns = [*keys, "detector", "language", "confidence"]
    found = [d.detect(lines, keys).select(*columns, F.lit(i).alias("ordinal")) for i, d in enumerate(detectors)]
    return reduce(DataFrame.unionByName, found)
