"""Language-model scores from a log-frequency Bloom filter of quantised word and word-pair counts.

Counts are gathered exactly, over all training texts, and dealt out by hash into buckets. Each bucket becomes a segment of the
filter: a key with count c is put in once for each level 1 .. 1 + floor(log2 c), so that probing level after level until one
misses gives back the quantised count. The filter is sent to the workers; it holds every key at every size of the input, and
grows with the different words and pairs there.

A text's tokens are its lower-cased words and one end. P(w | v) = (c(v, w) + MU * P(w)) / (c(v) + MU), with P(w) add-one
smoothed. Words over a count threshold, HOT of them at most, have exact counts sent along; the exact counts of all other words
reach the texts' sums by a join.

A null text counts as empty: its only token is the end. Repeated rows train and score as rows of their own, rows without an id
train. An empty table gives an empty result; other columns are ignored. Texts are read whole.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vellum.llm import words as W
from vellum.llm.shared import columns_for_python, settle

BITS_A_KEY = 8
PROBES = 4
HOT = 1 << 19
BUCKET_BYTES = 2 << 20
FLUSH_TOKENS = 3_000_000
MU = 100.0
END, START = np.uint64(0x0E4D0E4D0E4D0E4D), np.uint64(0x57A27F00D57A27F1)
_PAIR, _WORD, _LEVEL = np.uint64(0x9FB21C651E98DF25), np.uint64(0xA0761D6478BD642F), np.uint64(0x8EBC6AF09C88C6E3)


class Tokens:
    """The tokens of some texts, each text's words and then its end, as word hashes; and the token before each."""

    def __init__(self, w: W.Words):
        n = w.counts
        self.sizes = n + 1
        self.doc = np.repeat(np.arange(w.n_docs), self.sizes)
        last = np.cumsum(self.sizes) - 1
        self.key = np.full(len(self.doc), END)
        inner = np.ones(len(self.doc), bool)
        inner[last] = False
        self.key[inner] = w.hash
        self.before = np.empty_like(self.key)
        self.before[1:] = self.key[:-1]
        self.before[last - n] = START


def pair_keys(before: np.ndarray, key: np.ndarray) -> np.ndarray:
    return W.mix(before * _PAIR + key)


def word_keys(key: np.ndarray) -> np.ndarray:
    return W.mix(key ^ _WORD)


def bucket_of(key: np.ndarray, n: int) -> np.ndarray:
    return (((key >> W.U(32)) * W.U(n)) >> W.U(32)).astype(np.int64)


def level_of(count: np.ndarray) -> np.ndarray:
    return np.frexp(count.astype(float))[1]  # 1 + floor(log2)


def spots(key: np.ndarray, level: np.ndarray | int, size: np.ndarray | int) -> tuple[np.ndarray, np.ndarray]:
    """The word of a segment that a key's level is kept in, and the bits of it."""
    x = W.mix(key + np.asarray(level, np.uint64) * _LEVEL)
    at = ((x >> W.U(32)) * np.asarray(size, np.uint64)) >> W.U(32)
    bits = np.zeros(len(x), np.uint64)
    for i in range(PROBES):
        bits |= W.U(1) << ((x >> W.U(6 * i)) & W.U(63))
    return at.astype(np.int64), bits


def segment(key: np.ndarray, count: np.ndarray, most_words: float = float("inf")) -> tuple[np.ndarray, int]:
    """The filter's segment for a bucket, and the first level that is kept: 1, unless a bound is given that it doesn't fit."""
    level = level_of(count)
    for least in range(1, 65):
        n = int(np.maximum(0, level - least + 1).sum())
        size = max(1, -(-n * BITS_A_KEY // 64))
        if size <= most_words or n == 0:
            break
    size = min(size, max(1, most_words))
    out = np.zeros(size, np.uint64)
    for j in range(least, int(level.max(initial=0)) + 1):
        at, bits = spots(key[level >= j], j, size)
        np.bitwise_or.at(out, at, bits)
    return out, least


@dataclass
class Filter:
    words: np.ndarray
    first: np.ndarray  # where each bucket's segment begins; one more at the end
    least: np.ndarray

    def counts(self, key: np.ndarray) -> np.ndarray:
        """The quantised count of each key: probes level after level until one misses."""
        b = bucket_of(key, len(self.least))
        base, size, least = self.first[b], self.first[b + 1] - self.first[b], self.least[b]
        out, live = np.zeros(len(key)), np.arange(len(key))
        step = 0
        while len(live):
            level = least[live] + step
            at, bits = spots(key[live], level, size[live])
            hit = (self.words[base[live] + at] & bits) == bits
            live, level = live[hit], level[hit]
            out[live] = np.where(level == 1, 1.0, np.ldexp(4 / 3, level - 1))
            step += 1
            if step > 60:
                break
        return out


def _merged(key: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(key, kind="stable")
    key, count = key[order], count[order]
    first = np.flatnonzero(np.append(True, key[1:] != key[:-1])) if len(key) else np.zeros(0, np.int64)
    return key[first], (np.add.reduceat(count, first) if len(first) else count)


@dataclass
class Model:
    filter: Filter
    hot: np.ndarray  # keys of words, ascending
    hot_count: np.ndarray
    tokens: int
    words: int
    texts: int
    threshold: int


def learn(docs: DataFrame, train: Column, text: str = "text") -> tuple[Model, DataFrame]:
    """The model, and (key, count) of the words whose counts are under its threshold."""
    spark = docs.sparkSession
    rows = docs.filter(train).select(F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))
    size, texts = rows.agg(F.sum(F.octet_length("text")), F.count("*")).first()
    buckets = int(max(64, (size or 0) // BUCKET_BYTES))  # so that a bucket stays small at every size

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, list[np.ndarray]] = {"word": [], "pair": []}
        size = 0
        for batch in batches:
            for w in W.chunks(batch.column(0), lower=True):
                t = Tokens(w)
                held["word"].append(word_keys(t.key))
                held["pair"].append(pair_keys(t.before, t.key))
                size += len(t.key)
                if size >= FLUSH_TOKENS:
                    yield from flush(held)
                    size = 0
        if size:
            yield from flush(held)

    def flush(held: dict[str, list[np.ndarray]]) -> Iterator[pa.RecordBatch]:
        for kind in held:
            keys = np.concatenate(held[kind])
            held[kind] = []
            key, count = np.unique(keys, return_counts=True)
            del keys
            count = count.astype(np.uint32)
            edges = np.searchsorted(bucket_of(key, buckets), np.arange(buckets + 1))
            at = np.flatnonzero(np.diff(edges))
            for part in np.array_split(at, max(1, len(at) // 64)):
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(part.astype(np.int32)),
                        pa.array([kind] * len(part), pa.string()),
                        pa.array([key[edges[i] : edges[i + 1]].tobytes() for i in part], pa.binary()),
                        pa.array([count[edges[i] : edges[i + 1]].tobytes() for i in part], pa.binary()),
                    ],
                    ["bucket", "kind", "keys", "counts"],
                )

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, list] = {"word": [], "pair": []}
        now = None
        for batch in batches:
            for b, kind, keys, counts in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
                if now is not None and b != now:
                    yield made(now, held)
                    held = {"word": [], "pair": []}
                now = b
                held[kind].append((np.frombuffer(keys, np.uint64), np.frombuffer(counts, np.uint32).astype(np.int64)))
        if now is not None:
            yield made(now, held)

    def made(b: int, held: dict[str, list]) -> pa.RecordBatch:
        parts = {k: _merged(*(np.concatenate(x) for x in zip(*v, strict=True))) if v else (np.zeros(0, np.uint64), np.zeros(0, np.int64)) for k, v in held.items()}
        (words, n), (pairs, m) = parts["word"], parts["pair"]
        out, least = segment(np.concatenate((words, pairs)), np.concatenate((n, m)))
        levels = np.bincount(level_of(n), minlength=65)
        values = [b, least, out.tobytes(), words.tobytes(), n.tobytes(), int(n.sum()), levels.tolist()]
        return pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(values, _BUILT, strict=True)], _NAMES)

    gathered = rows.mapInArrow(gather, "bucket int, kind string, keys binary, counts binary")
    columns_for_python(spark, 2000)
    dealt = settle_small_batches(gathered.repartition("bucket").sortWithinPartitions("bucket"), build)
    heads = dealt.select("bucket", "least", "tokens", "levels").collect()  # a few numbers a bucket, beside the filter's bytes
    levels = np.zeros(65, np.int64)
    for r in heads:
        levels += np.array(r["levels"], np.int64)
    above = np.cumsum(levels[::-1])[::-1]  # words at each level or higher
    hot_level = next(j for j in range(1, 66) if j == 65 or above[j] <= HOT)
    threshold = 1 << (hot_level - 1)
    segments: dict[int, bytes] = dict(dealt.select("bucket", "filter").toLocalIterator())  # the whole filter: BITS_A_KEY for each key and level
    first = np.zeros(buckets + 1, np.int64)
    least = np.ones(buckets, np.int64)
    for r in heads:
        least[r["bucket"]] = r["least"]
    parts = [np.frombuffer(segments[b], np.uint64) if b in segments else np.zeros(1, np.uint64) for b in range(buckets)]
    first[1:] = np.cumsum([len(p) for p in parts])
    words = dealt.select("words", "word_counts").mapInArrow(_unpack, "key long, count long")
    hot = words.filter(F.col("count") >= threshold).toArrow()  # HOT rows at most
    key, count = hot["key"].to_numpy().view(np.uint64), hot["count"].to_numpy()
    order = np.argsort(key)
    tokens, known = sum(r["tokens"] for r in heads), int(levels.sum())
    model = Model(Filter(np.concatenate(parts) if parts else np.zeros(1, np.uint64), first, least), key[order], count[order], tokens, known, int(texts), threshold)
    return model, words.filter(F.col("count") < threshold)


_BUILT = (pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.binary(), pa.int64(), pa.list_(pa.int64()))
_NAMES = ["bucket", "least", "filter", "words", "word_counts", "tokens", "levels"]


def settle_small_batches(dealt: DataFrame, build) -> DataFrame:
    """Settles what build makes of packed rows; these are large, so few go into an Arrow batch."""
    columns_for_python(dealt.sparkSession, 64)
    out = settle(dealt.mapInArrow(build, "bucket int, least int, filter binary, words binary, word_counts binary, tokens long, levels array<long>"))
    columns_for_python(dealt.sparkSession)
    return out


def _unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for keys, counts in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            yield pa.RecordBatch.from_arrays([pa.array(np.frombuffer(keys, np.int64)), pa.array(np.frombuffer(counts, np.int64))], ["key", "count"])


def score_tokens(t: Tokens, m: Model) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(log10 P of each token, exact counts of hot words or 0, hot)"""
    key = word_keys(t.key)
    at = np.searchsorted(m.hot, key)
    at[at == len(m.hot)] = 0
    hot = (m.hot[at] == key) if len(m.hot) else np.zeros(len(key), bool)
    exact = np.where(hot, m.hot_count[at], 0) if len(m.hot) else np.zeros(len(key), np.int64)
    near = exact.astype(float)
    near[~hot] = np.minimum(m.filter.counts(key[~hot]), max(0, m.threshold - 1))
    first = np.append(True, t.doc[1:] != t.doc[:-1]) if len(t.doc) else np.zeros(0, bool)
    history = np.empty_like(near)
    history[1:] = near[:-1]
    history[first] = m.texts
    seen = (near > 0) & (history > 0)
    both = np.zeros(len(key))
    both[seen] = m.filter.counts(pair_keys(t.before[seen], t.key[seen]))
    both = np.minimum(both, np.minimum(near, history))
    alone = (near + 1) / (m.tokens + m.words + 1)
    return np.log10((both + MU * alone) / (history + MU)), exact, hot


def _counted(doc: np.ndarray, key: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The different (doc, key), by doc, and how often each is there."""
    order = np.lexsort((key, doc))
    doc, key = doc[order], key[order]
    first = np.flatnonzero(np.append(True, (doc[1:] != doc[:-1]) | (key[1:] != key[:-1]))) if len(key) else np.zeros(0, np.int64)
    return doc[first], key[first], np.diff(np.append(first, len(key)))


def score(docs: DataFrame, train: Column, id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row of docs: id, trained, n_tokens, n_known, train_tokens, base_score, score."""
    spark = docs.sparkSession
    model, rare = learn(docs, train, text)
    sent = spark.sparkContext.broadcast(model)
    kind = docs.schema[id].dataType
    schema = T.StructType([T.StructField("id", kind), T.StructField("trained", T.BooleanType())])
    for name, k in (("row", "long"), ("n_tokens", "long"), ("hot_known", "long"), ("hot_sum", "double"), ("score", "double")):
        schema = schema.add(name, k)
    schema = schema.add("rare", T.ArrayType(T.LongType())).add("rare_n", T.ArrayType(T.IntegerType()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m, row = sent.value, TaskContext.get().partitionId() << 40
        for batch in batches:
            for w in W.chunks(batch.column(2), lower=True):
                t, n = Tokens(w), w.n_docs
                logs, exact, hot = score_tokens(t, m)
                cold_doc, cold, k = _counted(t.doc[~hot], word_keys(t.key[~hot]))
                edges = np.searchsorted(cold_doc, np.arange(n + 1)).astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [
                        *(batch.column(i).slice(w.row, n) for i in range(2)),
                        pa.array(np.arange(row, row + n)),
                        pa.array(t.sizes.astype(np.int64)),
                        pa.array(np.bincount(t.doc[hot], minlength=n)),
                        pa.array(W.doc_sum(np.log10(exact[hot] + 1.0), t.doc[hot], n)),
                        pa.array(W.doc_sum(logs, t.doc, n)),
                        pa.ListArray.from_arrays(edges, pa.array(cold.view(np.int64))),
                        pa.ListArray.from_arrays(edges, pa.array(k.astype(np.int32))),
                    ],
                    schema.names,
                )
                row += n

    rows = docs.select(F.col(id).alias("id"), train.alias("trained"), F.col(text).cast("string").alias("text"))
    scored = settle(rows.mapInArrow(run, schema))
    each = scored.select("row", F.explode(F.arrays_zip("rare", "rare_n")).alias("x")).select("row", F.col("x.rare").alias("key"), F.col("x.rare_n").alias("n"))
    sums = each.join(rare, "key").groupBy("row").agg(F.sum(F.col("n") * F.log10(F.col("count") + 1)).alias("s"), F.sum("n").alias("k"))
    whole = F.log10(F.lit(float(model.tokens + model.words + 1)))
    return scored.drop("rare", "rare_n").join(sums, "row", "left").select(
        F.col("id").alias(id),
        "trained",
        "n_tokens",
        (F.col("hot_known") + F.coalesce("k", F.lit(0))).alias("n_known"),
        F.lit(model.tokens).cast("long").alias("train_tokens"),
        (F.col("hot_sum") + F.coalesce("s", F.lit(0.0)) - F.col("n_tokens") * whole).alias("base_score"),
        "score",
    )
