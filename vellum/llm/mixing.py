"""Mixing sources to target weights: token weights are raked to source, language and topic marginals by iterative proportional
fitting, and documents are sampled by the probabilities that come out.

DataFrame functions only. Tokens are words ``[^\\x20\\x09-\\x0D]+``. Where no topic is given, topics are clusters of all documents
by their content words: words of ``LONG`` letters or more are counted in BINS hashed bins, and spherical k-means groups the
counts; texts without such words have the empty topic. A null source or language counts as the empty one, a null text as
empty. Texts are read whole; a document is one row throughout, however long. Documents are chosen by a hash of their id (of
their text where the id is null), so repeated rows and tied ids are chosen alike, and a second run chooses the same. An empty
table gives an empty result. Further columns are kept; columns that are added take underscores where a name is taken.

Targets that are given must name values that have tokens, and must be met to within ``CLOSE_ENOUGH``; a ValueError says which
aren't. Targets that follow from the data may contradict each other (a source that has one language only); the nearest fit is
taken then, and a warning tells how far it is off.
"""

from __future__ import annotations

import json
import logging
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vellum.functions.text import once
from vellum.llm.shared import free_column, settle, small

SEPARATORS = r"[\x20\x09-\x0D]+"
#: Up to so many different (source, language, topic), their sums are fitted on the driver; beyond that by grouped sums and joins.
FEW_CELLS = 50_000
#: A target share is the observed share to this power, made to add up to one: 1 leaves a marginal as it is, 0 makes it even.
SOURCE_POWER, LANG_POWER, TOPIC_POWER = 0.7, 0.5, 0.8
CLOSE_ENOUGH = 1e-3
LONG, BINS, TOPICS, STEPS = 8, 16, 6, 5


def n_tokens(text: Column) -> Column:
    """A text's words: its parts between separators, less the empty ones at its ends."""
    parts = F.split(F.coalesce(text.cast("string"), F.lit("")), SEPARATORS, -1)
    empty = lambda p, i: F.when(F.get(p, i) == "", 1).otherwise(0)
    return once(parts, lambda p: F.greatest(F.lit(0), F.size(p) - empty(p, F.lit(0)) - empty(p, F.size(p) - 1))).cast("long")


# topics


def content_bins(text: Column) -> Column:
    """How many of a text's long words fall in each bin. The bins' marks are joined to one string, in which each is counted."""
    words = F.regexp_extract_all(F.lower(F.coalesce(text.cast("string"), F.lit(""))), F.lit(rf"\p{{L}}{{{LONG},}}"), F.lit(0))
    marks = F.array_join(F.transform(words, lambda w: F.char(F.pmod(F.xxhash64(w), F.lit(BINS)) + 48)), "")
    return once(marks, lambda m: F.array(*[(F.length(m) - F.length(F.replace(m, F.lit(chr(48 + b)), F.lit("")))).cast("float") for b in range(BINS)]))


def _dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: (x * y).cast("double")), F.lit(0.0), lambda s, x: s + x)


def topic_of(bins: Column, centres: list[list[float]]) -> Column:
    """The centre with the largest product, the first of equals, as a name; empty without any content word."""
    if not centres:
        return F.lit("")
    best = F.array_max(F.array(*[F.struct(_dot(bins, F.array(*map(F.lit, c))).alias("v"), F.lit(-k).alias("k")) for k, c in enumerate(centres)]))["k"]
    return F.when(_dot(bins, bins) > 0, F.concat(F.lit("t"), (-best).cast("string"))).otherwise("")


def learn_topics(bins: DataFrame, topics: int = TOPICS, steps: int = STEPS) -> list[list[float]]:
    """Unit centres of spherical k-means over the bins of all documents, a column of settled rows. Documents begin in the cluster of their fullest bin; each step sums
    the unit vectors of a cluster, bin by bin, combined before the shuffle. What comes to the driver is topics times BINS sums."""
    vectors = bins.toDF("bins").withColumn("norm", F.sqrt(_dot(F.col("bins"), F.col("bins")))).filter("norm > 0")
    fullest = F.array_position("bins", F.array_max("bins")) - 1
    centres: list[list[float]] = []
    for step in range(steps):
        name = F.concat(F.lit("t"), (fullest % topics).cast("string")) if not step else topic_of(F.col("bins"), centres)
        sums = vectors.groupBy(name.alias("topic")).agg(*[F.sum(F.get("bins", F.lit(b)) / F.col("norm")).alias(f"b{b}") for b in range(BINS)]).orderBy("topic").collect()
        before, centres = centres, []
        for r in sums:
            size = sum(x * x for x in r[1:]) ** 0.5
            centres.append([round(x / size, 6) for x in r[1:]])
        if centres == before:
            break
    return centres


# raking


def _targets(totals: DataFrame, told: dict[str, float] | None, power: float, what: str) -> DataFrame:
    """(value, own, want) for the values of a marginal: what they have, and the share they are to have."""
    spark = totals.sparkSession
    if told is None:
        raw = F.when(F.col("own") > 0, F.pow("own", F.lit(power))).otherwise(0.0)
        out = totals.withColumn("raw", raw)
    else:
        given = _table(spark, told).withColumnRenamed("factor", "raw")
        lost = [r[0] for r in given.filter("raw > 0").join(totals.filter("own > 0"), "value", "left_anti").orderBy("value").limit(20).collect()]
        if lost:
            raise ValueError(f"no tokens for the {what}s {lost}")
        out = totals.join(given, "value", "left").withColumn("raw", F.when(F.col("own") > 0, F.coalesce("raw", F.lit(0.0))).otherwise(0.0))
    out = settle(out)
    whole = out.agg(F.sum("raw")).first()[0] or 1.0
    return out.select("value", "own", (F.col("raw") / whole).alias("want"))


def rake(
    cells: DataFrame,
    sources: dict[str, float] | None = None,
    langs: dict[str, float] | None = None,
    topics: dict[str, float] | None = None,
    rounds: int = 60,
    close: float = 1e-7,
) -> tuple[DataFrame, DataFrame, DataFrame, float]:
    """Factors (value, factor) by source, language and topic for cells (source, lang, topic, tokens): tokens times the three
    factors add up to the target share of every source, language and topic. Then how far a share is off at most.

    FEW_CELLS cells or fewer come to the driver, which fits the factors to them; else each round takes a grouped sum and a join
    for each of the three.
    """
    told = {"source": (sources, SOURCE_POWER), "lang": (langs, LANG_POWER), "topic": (topics, TOPIC_POWER)}
    want = {k: _targets(cells.groupBy(F.col(k).alias("value")).agg(F.sum("tokens").alias("own")), t, power, k) for k, (t, power) in told.items()}
    few = cells.limit(FEW_CELLS + 1).count() <= FEW_CELLS
    factors, off = (_fit_few if few else _fit_many)(cells, want, rounds, close)
    if off > CLOSE_ENOUGH:
        if any(t is not None for t, _ in told.values()):
            raise ValueError(f"the targets contradict each other: a share is off by {off:.4f}")
        logging.getLogger(__name__).warning("the targets contradict each other: a share is off by %.4f", off)
    return *(factors[k] for k in told), off


def _table(spark: SparkSession, of: dict[str, float]) -> DataFrame:
    """(value, factor)"""
    said = json.dumps({str(k): float(v) for k, v in of.items()})
    return spark.range(1).select(F.explode(F.from_json(F.lit(said), "map<string,double>")).alias("value", "factor"))


def _fit_few(cells: DataFrame, want: dict[str, DataFrame], rounds: int, close: float) -> tuple[dict[str, DataFrame], float]:
    share = {k: {r["value"]: r["want"] for r in v.orderBy("value").collect()} for k, v in want.items()}
    table = [(tuple(r[:3]), r[3]) for r in cells.groupBy(*want).agg(F.sum("tokens")).orderBy(*want).collect()]  # FEW_CELLS at most
    now = {k: dict.fromkeys(v, 1.0) for k, v in share.items()}
    off = 0.0
    for _ in range(20 * rounds):
        worst = []
        for side, k in enumerate(want):
            sums = dict.fromkeys(share[k], 0.0)
            for (a, b, c), v in table:
                sums[(a, b, c)[side]] += v * now["source"][a] * now["lang"][b] * now["topic"][c]
            worst.append(max((abs(sums[x] - v) for x, v in share[k].items()), default=0.0))
            for x, v in share[k].items():
                now[k][x] = now[k][x] * v / sums[x] if sums[x] > 0 else 0.0
        off = max(worst[1:])
        if off < close:
            break
    return {k: _table(cells.sparkSession, v) for k, v in now.items()}, off


def _fit_many(cells: DataFrame, want: dict[str, DataFrame], rounds: int, close: float) -> tuple[dict[str, DataFrame], float]:
    factors = {k: v.select("value", F.lit(1.0).alias("factor")) for k, v in want.items()}
    off = 0.0
    for _ in range(rounds):
        worst = []
        for k in ("source", "lang", "topic"):
            rows = reduce(lambda d, j: d.join(small(factors[j].select(F.col("value").alias(j), F.col("factor").alias(f"f_{j}"))), j), factors, cells)
            sums = rows.groupBy(F.col(k).alias("value")).agg(F.sum(F.col("tokens") * F.col("f_source") * F.col("f_lang") * F.col("f_topic")).alias("s"))
            new = settle(sums.join(want[k], "value").join(factors[k], "value"))
            worst.append(new.agg(F.max(F.abs(F.col("s") - F.col("want")))).first()[0] or 0.0)
            factors[k] = new.select("value", F.when(F.col("s") > 0, F.col("factor") * F.col("want") / F.col("s")).otherwise(0.0).alias("factor"))
        off = max(worst[1:])
        if off < close:
            break
    return factors, off


def mix(
    docs: DataFrame,
    id: str = "doc_id",
    text: str = "text",
    source: str = "source",
    lang: str = "lang",
    topic: Column | None = None,
    budget: float = 0.5,
    seed: int = 17,
    **targets: dict[str, float] | None,
) -> DataFrame:
    """docs with n_tokens, topic, rate and copies. rate is the expected number of times that a document is taken, so that the
    tokens taken come to budget times all tokens, shared out by the raked weights; copies is rate rounded up or down by chance,
    the part after the point being the probability of one more."""
    names = [free_column(docs, n) for n in ("n_tokens", "topic", "rate", "copies")]
    tokens, theme, rate, copies = names
    label = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    held = free_column(docs, "bins")
    bins = content_bins(F.col(text)) if topic is None else F.coalesce(topic.cast("string"), F.lit(""))
    rows = settle(docs.withColumns({tokens: n_tokens(F.col(text)), held: bins}))  # texts are looked through once
    rows = rows.withColumn(theme, topic_of(F.col(held), learn_topics(rows.select(held))) if topic is None else F.col(held)).drop(held)
    cells = rows.groupBy(label(source).alias("source"), label(lang).alias("lang"), F.col(theme).alias("topic")).agg(F.sum(tokens).cast("double").alias("tokens"))
    cells = settle(cells)
    total = cells.agg(F.sum("tokens")).first()[0] or 0.0
    *factors, _ = rake(cells, **targets)
    out, weight = rows, F.lit(budget * total)
    for column, of in zip((label(source), label(lang), F.col(theme)), factors, strict=True):
        key, factor = free_column(out, "key"), free_column(out, "factor")
        of = settle(of.select(F.col("value").alias(key), F.col("factor").alias(factor)))
        out = out.withColumn(key, column).join(small(of), key).drop(key)
        weight = weight * F.col(factor)
    out = out.withColumn(rate, weight)
    spin = F.xxhash64(F.lit(seed), F.coalesce(F.col(id).cast("string"), F.col(text).cast("string")))
    chance = F.shiftrightunsigned(spin, 11).cast("double") / F.lit(float(1 << 53))
    out = out.withColumn(copies, F.floor(rate) + F.when(chance < F.col(rate) - F.floor(rate), 1).otherwise(0))
    return out.select(*docs.columns, *names)
