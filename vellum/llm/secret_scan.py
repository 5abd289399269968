"""Secret scans: fixed patterns, and character Markov models of random strings against ordinary identifiers.

There is one model of ordinary identifiers and one for each shape of random strings, all trained from labelled samples. A
string is reported if for some shape the log-likelihood ratio is ``sure`` or more a transition. A find of the models that
reaches beyond the patterns' finds stays beside them; one that a pattern's find covers goes.

DataFrame functions only. A null text counts as empty and has no spans. Repeated rows and tied ids are each judged alone; an
empty table gives an empty result; other columns are ignored by ``find_secrets`` and kept by ``redact``, where a null text
stays null. Texts are read whole, however long: places come from running totals worked out in two levels, so that the cost of a
text with n finds grows with n ** 1.5 at most. Places are code points, ends exclusive.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vellum.functions.text import once
from vellum.llm.shared import free_column, settle

#: kind, pattern (matched leftmost, not overlapping), group whose length counts, its least length
ASSIGN = r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
KINDS = (("assign", ASSIGN, 1, 12), ("access", r"AKIA[A-Z0-9]{14,}", 0, 18), ("hex", r"[0-9a-f]{16,}", 0, 16))
RANDOM = "random"
CANDIDATE = r"[A-Za-z0-9+/_-]{16,}={0,2}"
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-"
SIZE = len(ALPHABET) + 1  # state 0: the string's start
#: So many random strings of each shape are made up, and numbers; names are put together within groups of about so many words.
MADE, TOGETHER = 3000, 1000
#: What the kinds of ordinary strings weigh, whatever number of each there is: their transitions are scaled down to this many, about
#: as many as a shape of random strings has.
ORDINARY = {"word": 40_000, "name": 140_000, "number": 20_000}
SURE = 0.6
_SPAN = "array<struct<start:int,end:int,rank:int,kind:string,m:string>>"


def _none(kind: str) -> Column:
    return F.array().cast(kind)


def _parts(values: Column, k: Column) -> Column:
    """values in parts of k."""
    n = F.ceil(F.size(values) / k).cast("int")
    return F.when(n > 0, F.transform(F.sequence(F.lit(0), F.greatest(n - 1, F.lit(0))), lambda i: F.slice(values, i * k + 1, k))).otherwise(_none("array<array<int>>"))


def running(values: Column, step: Callable[[Column, Column], Column]) -> Column:
    """Of an array of numbers: step of each and all before it. In parts of the root of the length, as an accumulator is copied
    whenever it grows."""

    def scan(part: Column) -> Column:
        grow = lambda acc, x: F.concat(acc, F.array(F.coalesce(step(F.get(acc, F.size(acc) - 1), x), x)))
        return F.aggregate(part, _none("array<int>"), grow)

    def joined(parts: Column) -> Column:
        before = scan(F.transform(parts, lambda p: F.get(p, F.size(p) - 1)))
        return once(before, lambda b: F.flatten(F.transform(parts, lambda p, i: F.transform(p, lambda x: F.coalesce(step(F.get(b, i - 1), x), x)))))

    def scanned(v: Column) -> Column:
        root = F.greatest(F.lit(1), F.ceil(F.sqrt(F.size(v))).cast("int"))
        return once(F.transform(_parts(v, root), scan), joined)

    return once(values, scanned)


def _sum(a: Column, b: Column) -> Column:
    return a + b


def _most(a: Column, b: Column) -> Column:
    return F.when(a > b, a).otherwise(b)


def _spans(kind: str, text: Column, pattern: str, group: int, least: int) -> Column:
    """The matches whose group has the least length; each is found in one pass."""
    rank = [k[0] for k in KINDS].index(kind) if kind != RANDOM else len(KINDS)
    matches, gaps = F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), F.split(text, pattern, -1)

    def placed(m: Column) -> Column:
        ends = running(F.zip_with(F.transform(F.slice(gaps, 1, F.size(m)), F.length), m, lambda gap, x: gap + F.length(x)), _sum)
        struct = lambda x, z: F.struct((z - F.length(x)).alias("start"), z.alias("end"), F.lit(rank).alias("rank"), F.lit(kind).alias("kind"), x.alias("m"))
        return F.zip_with(m, ends, struct)

    long = lambda x: F.length(F.regexp_extract(x["m"], pattern, group) if group else x["m"]) >= least
    return F.when(F.regexp_like(text, F.lit(pattern)), F.filter(once(matches, placed), long)).otherwise(_none(_SPAN))


def _codes(token: Column) -> Column:
    return F.transform(F.filter(F.split(token, ""), lambda c: c != ""), lambda c: F.instr(F.lit(ALPHABET), c))


def _before(codes: Column) -> Column:
    return F.concat(F.array(F.lit(0)), F.slice(codes, 1, F.greatest(F.lit(0), F.size(codes) - 1)))


def labelled_samples(docs: DataFrame, id: str = "doc_id", text: str = "text") -> DataFrame:
    """(token, shape, kind): random strings of six shapes, which are made up, as no table has labelled ones; ordinary identifiers,
    whose shape is null: the different words of all documents without what the patterns find in them; all of these that are made
    of letters put together as names are (snake_case, camelCase, paths and such); numbers, dates and rules, made up too."""
    spark = docs.sparkSession
    digest = F.sha2(F.concat(F.lit("sample "), F.col("id").cast("string")), 256)
    size = (16 + F.col("id") % 25).cast("int")
    base64 = F.regexp_replace(F.base64(F.unhex(digest)), "=", "")
    plain = F.regexp_replace(base64, "[+/]", "")
    dashed = F.concat_ws("-", *[F.substring(digest, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))])
    shapes = {"hex": digest, "HEX": F.upper(digest), "base64": base64, "url": F.translate(base64, "+/", "-_"), "capitals": F.upper(plain), "small": F.lower(plain)}
    random = F.array(*[F.struct(F.substring(c, F.lit(1), size).alias("token"), F.lit(k).alias("shape")) for k, c in shapes.items()], F.struct(dashed.alias("token"), F.lit("hex").alias("shape")))
    random = spark.range(MADE).select(F.explode(random).alias("x")).select("x.token", "x.shape")
    bare = F.col(text).cast("string")
    for _, pattern, _, _ in KINDS:
        bare = F.regexp_replace(bare, pattern, " ")
    tokens = settle(docs.select(F.explode(F.regexp_extract_all(bare, F.lit(r"[A-Za-z0-9+/_-]{2,}"), F.lit(0))).alias("token")).distinct())
    words = tokens.filter(F.length("token") >= 4)
    groups = max(1, tokens.count() // TOGETHER)
    named = tokens.filter(F.col("token").rlike("^[A-Za-z]+$")).groupBy(F.pmod(F.xxhash64("token"), F.lit(groups)).alias("group")).agg(F.sort_array(F.collect_list("token")).alias("w"))
    three = F.expr("transform(sequence(0, (size(w) - 1) div 3), i -> slice(w, i * 3 + 1, 3))")
    named = named.select(F.posexplode(three).alias("i", "w"))
    low, high = F.transform("w", lambda x: F.lower(x)), F.transform("w", lambda x: F.initcap(x))
    camel = F.concat(F.get(low, F.lit(0)), F.array_join(F.slice(high, 2, 2), ""))
    forms = F.array(F.array_join(low, "_"), F.array_join(low, "-"), camel, F.array_join(high, ""), F.array_join(low, "/"), F.upper(F.array_join("w", "_")))
    named = named.select(F.get(forms, F.col("i") % 6).alias("token"))
    day = F.date_format(F.date_add(F.lit("1990-01-01").cast("date"), (F.col("id") * 7).cast("int")), "yyyy-MM-dd")
    rule = F.array(*[F.repeat(F.lit(c), F.lit(24)) for c in "-_=/+0xX"])
    numbers = F.array(F.lpad(F.col("id").cast("string"), 16, "0"), F.concat(day, F.lit("T12-00-00")), F.concat(F.translate(day, "-", ""), (F.col("id") * 7919).cast("string")), F.get(rule, (F.col("id") % 8).cast("int")))
    numbers = spark.range(MADE).select(F.explode(numbers).alias("token"))
    ordinary = [x.select("token", F.lit(None).cast("string").alias("shape"), F.lit(k).alias("kind")) for k, x in (("word", words), ("name", named), ("number", numbers))]
    return reduce(DataFrame.unionByName, ordinary, random.withColumn("kind", F.lit(None).cast("string")))


def train(samples: DataFrame) -> dict[str, list[float]]:
    """For each shape the log-likelihood ratio of each transition, that shape against ordinary, from the samples' counts with one
    added to each. samples: token, shape (null for ordinary strings) and perhaps kind, by which ordinary ones are scaled. What is
    counted is bounded by shapes and kinds times SIZE ** 2."""
    steps = F.zip_with(_before(F.col("codes")), F.col("codes"), lambda a, b: a * SIZE + b)
    kind = F.col("kind") if "kind" in samples.columns else F.lit(None).cast("string").alias("kind")
    coded = samples.select("shape", kind, _codes(F.col("token")).alias("codes")).select("shape", "kind", F.explode(steps).alias("step"))
    counts = coded.groupBy("shape", "kind", "step").count().collect()
    seen: dict[str | None, int] = {}
    for _, k, _, n in counts:
        seen[k] = seen.get(k, 0) + n
    table: dict[str | None, list[float]] = {None: [1.0] * SIZE**2}
    for shape, k, step, n in counts:
        table.setdefault(shape, [1.0] * SIZE**2)[step] += n * min(1.0, ORDINARY[k] / seen[k] if k in ORDINARY else 1.0)
    for row in table.values():
        for a in range(0, SIZE**2, SIZE):
            total = sum(row[a : a + SIZE])
            row[a : a + SIZE] = [math.log(x / total) for x in row[a : a + SIZE]]
    usual = table.pop(None)
    return {shape: [x - y for x, y in zip(row, usual, strict=True)] for shape, row in sorted(table.items())}


#: Ratios are kept as one printable character each, in steps of STEP around the middle one: small literals in every plan.
STEP, MIDDLE, REACH = 0.125, 80, 46


def _packed(ratios: list[float]) -> Column:
    """A string for each state, a character for each state that may follow."""
    marks = [chr(MIDDLE + max(-REACH, min(REACH, round(x / STEP)))) for x in ratios]
    return F.array(*[F.lit("".join(marks[a : a + SIZE])) for a in range(0, SIZE * SIZE, SIZE)])


def llr(token: Column, ratios: dict[str, list[float]]) -> Column:
    """Mean log-likelihood ratio a transition, of the shape for which it is largest."""

    def of(codes: Column) -> Column:
        def mean(table: Column) -> Column:
            marks = F.zip_with(_before(codes), codes, lambda a, b: F.ascii(F.substring(F.get(table, a), b + 1, F.lit(1))) - MIDDLE)
            return F.aggregate(marks, F.lit(0), lambda s, x: s + x) * STEP / F.greatest(F.lit(1), F.size(codes))

        means = [mean(_packed(r)) for r in ratios.values()]
        return F.array_max(F.array(*means)) if means else F.lit(0.0)

    return once(_codes(token), of)


def spans(text: Column, ratios: dict[str, list[float]], sure: float = SURE) -> Column:
    """All spans by start and then kind: the patterns' finds, and random-looking strings that none of those covers."""
    text = F.coalesce(text.cast("string"), F.lit(""))
    base = [_spans(kind, text, pattern, group, least) for kind, pattern, group, least in KINDS]
    more = F.filter(_spans(RANDOM, text, CANDIDATE, 0, 16), lambda x: llr(x["m"], ratios) >= sure)
    told = F.array_sort(F.transform(F.concat(*base, more), lambda x: F.struct(x["start"], x["rank"], x["end"], x["kind"])))
    random = len(KINDS)

    def uncovered(told: Column) -> Column:
        # a pattern's find that covers a string begins no later, and so comes before it; the furthest end says whether there is one
        reach = running(F.transform(told, lambda x: F.when(x["rank"] < random, x["end"]).otherwise(0)), _most)
        both = F.zip_with(told, reach, lambda x, r: F.struct(x.alias("x"), ((x["rank"] < random) | (x["end"] > r)).alias("stays")))
        return F.transform(F.filter(both, lambda b: b["stays"]), lambda b: b["x"])

    return once(told, lambda t: F.when(F.size(t) > 0, uncovered(t)).otherwise(t))


def find_secrets(docs: DataFrame, id: str = "doc_id", text: str = "text", samples: DataFrame | None = None, sure: float = SURE) -> DataFrame:
    """One row per row of docs: id and spans, an array of (start, rank, end, kind); rank is the kind's place among the kinds."""
    ratios = train(samples if samples is not None else labelled_samples(docs, id, text))
    return docs.select(F.col(id), spans(F.col(text), ratios, sure).alias("spans"))


def _without(whole: Column, found: Column, mark: str) -> Column:
    """whole with what the spans cover replaced by mark, spans that overlap as one. A substring is sought from its string's start,
    so the text is cut into parts of about the root of the number of spans first."""

    def cut(joined: Column) -> Column:
        root = F.ceil(F.sqrt(F.size(joined))).cast("int")
        numbers = F.sequence(F.lit(0), F.ceil(F.size(joined) / root).cast("int") - 1)

        def part(i: Column) -> Column:
            here = F.slice(joined, i * root + 1, root)
            low, high = F.get(here, F.lit(0))["before"], F.get(here, F.size(here) - 1)["end"]
            struct = F.struct(F.substring(whole, low + 1, high - low).alias("text"), low.alias("low"), here.alias("spans"))
            return once(struct, lambda p: F.array_join(F.transform(p["spans"], lambda s: F.concat(F.substring(p["text"], s["before"] - p["low"] + 1, s["start"] - s["before"]), F.lit(mark))), ""))

        last = F.get(joined, F.size(joined) - 1)["end"]
        return F.concat(F.array_join(F.transform(numbers, part), ""), F.substring(whole, last + 1, F.length(whole)))

    def joined(found: Column) -> Column:
        def groups(reach: Column) -> Column:
            first = F.filter(F.sequence(F.lit(0), F.size(found) - 1), lambda i: (i == 0) | (F.get(found, i)["start"] >= F.get(reach, i - 1)))
            return once(
                first,
                lambda f: F.transform(
                    f,
                    lambda i, j: F.struct(
                        F.coalesce(F.get(reach, i - 1), F.lit(0)).alias("before"), F.get(found, i)["start"].alias("start"), F.get(reach, F.coalesce(F.get(f, j + 1), F.size(found)) - 1).alias("end")
                    ),
                ),
            )

        return once(once(running(F.transform(found, lambda x: x["end"]), _most), groups), cut)

    return joined(found)


def redact(docs: DataFrame, id: str = "doc_id", text: str = "text", mark: str = "[SECRET]", sure: float = SURE) -> DataFrame:
    """docs with every span of a secret in the text replaced by mark; spans that overlap are replaced as one."""
    ratios = train(labelled_samples(docs, id, text))
    name = free_column(docs, "spans")
    marked = docs.withColumn(name, spans(F.col(text), ratios, sure))
    return marked.withColumn(text, F.when(F.size(name) > 0, _without(F.col(text), F.col(name), mark)).otherwise(F.col(text))).drop(name)
