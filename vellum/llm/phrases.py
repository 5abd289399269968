"""Substring dedup: repeated-phrase automata find every occurrence of every passage that recurs, and its words are removed.

A window is ``window`` consecutive words. Each window has an anchor: the run of ``anchor`` words in it with the smallest hash,
the leftmost of equals; equal windows have equal anchors in equal places. Consecutive windows with one anchor form a stretch.

1. Confirm. Stretches are counted by anchor and content. One that is there twice is a phrase. Only where an anchor has
   stretches of different content are single windows counted too; those that are there twice are phrases.
2. Write the phrases down. One document that holds a phrase, its owner, gives the phrase's words, so that each phrase is written
   once. Phrases of one owner that overlap are kept in one passage.
3. Compile. Documents are dealt out into blocks of ``BLOCK_BYTES`` or so. To each block come the passages of the phrases that
   may be in it, and it compiles Aho-Corasick automata of these, ``SHARD_LETTERS`` letters each at most.
4. Stream. Every document passes the automata of its block as a whole. What they find is removed, and nothing else is.

The automata's letters are words: each word is one of 2**bits letters, told by its hash, with at least 128 bits in a window.
Hashes of contents only say which phrases a block is sent, by joins; filters of them, of a bounded size, keep others from being
sent, and a false alarm in these costs time only. Texts that begin alike go to one block, so that it is sent their phrases once;
many of them are spread over several.

A null text counts as empty. Repeated rows are occurrences like any other, so all their windows recur. Null and tied ids are
rows like others. An empty table gives an empty result; other columns are ignored. Memory in a worker follows the longest
single text, and the phrases of a block.
"""

from __future__ import annotations

from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vellum.llm import words as W
from vellum.llm.shared import settle, small

BLOCK_BYTES, LEAST_BLOCKS = 4 << 20, 64
#: Letters of all phrases in one automaton, and words in which a passage's phrases begin.
SHARD_LETTERS, PASSAGE_WORDS = 2_000_000, 128
#: Texts that begin alike are mostly copies, and best dealt to one block, as long as it holds them.
OPENING = 100
FILTER_BYTES = 64 << 20
FILTER_PARTS = 64
FLUSH_ROWS = 400_000
#: Under 2**31, so that its products with 32 bits fit 64.
_OWNER = 0x5851F42D


class Stretches:
    """The stretches of some texts: anchor hash and place, first and last window, content hash; places count words in the chunk."""

    def __init__(self, w: W.Words, window: int, anchor: int):
        self.words, self.window, self.anchor = w, window, anchor
        self.prefix = w.prefix()
        doc, m = w.doc, len(w)
        at = np.arange(max(0, m - window + 1))
        at = at[doc[at] == doc[at + window - 1]] if len(at) else at
        self.a = self.b = self.place = at[:0]
        self.gram = self.content = np.zeros(0, np.uint64)
        if not len(at):
            return
        grams = np.arange(m - anchor + 1)
        g = W.run_hash(self.prefix, grams, grams + anchor)
        place = _argmin(g, window - anchor + 1)[at]
        cut = np.flatnonzero((place[1:] != place[:-1]) | (at[1:] != at[:-1] + 1)) + 1
        first, last = np.append(0, cut), np.append(cut, len(at)) - 1
        self.a, self.b, self.place = at[first], at[last], place[first]
        self.gram = W.mix(g[self.place])  # the least of some hashes is small: mixed again, it is evenly spread
        self.content = W.run_hash(self.prefix, self.a, self.b + window)

    def windows(self, chosen: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(stretch, content, place) of each window of the chosen stretches."""
        n = (self.b - self.a + 1)[chosen]
        of = np.repeat(chosen, n)
        at = self.a[of] + np.arange(len(of)) - np.repeat(np.cumsum(n) - n, n)
        return of, W.run_hash(self.prefix, at, at + self.window), at


def _argmin(v: np.ndarray, width: int) -> np.ndarray:
    """For each i, the leftmost place of the least of v[i : i + width]; by doubling, the last places unusable."""
    place, span = np.arange(len(v)), 1
    made: list[tuple[int, np.ndarray]] = [(1, place)]

    def join(p: np.ndarray, q: np.ndarray, shift: int) -> np.ndarray:
        left, right = p, q[shift:]
        n = min(len(left), len(right))
        left, right = left[:n], right[:n]
        return np.where(v[left] <= v[right], left, right)

    while span * 2 <= width:
        place = join(place, place, span)
        span *= 2
        made.append((span, place))
    out, have = made[-1][1], span
    for size, part in reversed(made[:-1]):
        if have + size <= width:
            out = join(out, part, have)
            have += size
    return out


def _spots(key: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    part = (key >> W.U(58)).astype(np.int64)
    x = W.mix(key)
    bits = np.zeros(len(x), np.uint64)
    for i in range(5):
        bits |= W.U(1) << ((x >> W.U(6 * i)) & W.U(63))
    return part, (((x >> W.U(32)) * W.U(size)) >> W.U(32)).astype(np.int64), bits


class KeyFilter:
    """A Bloom filter of a column of hashes, of at most FILTER_BYTES: built part by part on the executors, each part the size that the driver says."""

    def __init__(self, keys: DataFrame):
        n = keys.count()
        self.size = size = int(min(max(64, n * 16 // 64 // FILTER_PARTS), FILTER_BYTES // 8 // FILTER_PARTS))

        def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            made: dict[int, np.ndarray] = {}
            for batch in batches:
                part, at, bits = _spots(batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64), size)
                for p in np.unique(part).tolist():
                    np.bitwise_or.at(made.setdefault(p, np.zeros(size, np.uint64)), at[part == p], bits[part == p])
            for p, words in made.items():
                yield pa.RecordBatch.from_arrays([pa.array([p], pa.int32()), pa.array([words.tobytes()], pa.binary())], ["part", "words"])

        dealt = keys.repartition(F.shiftrightunsigned(keys.columns[0], 58))
        self.words = np.zeros((FILTER_PARTS, size), np.uint64)
        for p, words in dealt.mapInArrow(build, "part int, words binary").toLocalIterator():
            self.words[p] |= np.frombuffer(words, np.uint64)

    def has(self, key: np.ndarray) -> np.ndarray:
        part, at, bits = _spots(key, self.size)
        return (self.words[part, at] & bits) == bits


def _tallied(parts: list[tuple[np.ndarray, ...]]) -> Iterator[pa.RecordBatch]:
    """The different (anchor, content), how often each is there, and its least owner."""
    gram, content, owner = (np.concatenate(x) for x in zip(*parts, strict=True))
    order = np.lexsort((content, gram))
    gram, content, owner = gram[order], content[order], owner[order]
    first = np.flatnonzero(np.append(True, (gram[1:] != gram[:-1]) | (content[1:] != content[:-1]))) if len(gram) else np.zeros(0, np.int64)
    n = np.diff(np.append(first, len(gram)))
    low = np.minimum.reduceat(owner, first) if len(first) else owner
    yield pa.RecordBatch.from_arrays([pa.array(gram[first].view(np.int64)), pa.array(content[first].view(np.int64)), pa.array(n), pa.array(low)], ["gram", "content", "n", "owner"])


def _owners(batch: pa.RecordBatch, at: int, w: W.Words) -> np.ndarray:
    return batch.column(at).slice(w.row, w.n_docs).to_numpy(zero_copy_only=False)


def _doc_of(w: W.Words, place: np.ndarray) -> np.ndarray:
    return np.searchsorted(w.first, place, side="right") - 1


def _counts(rows: DataFrame, window: int, anchor: int, chosen: KeyFilter | None) -> DataFrame:
    """(gram, content, n, owner) of all stretches; of single windows of the stretches with chosen anchors where these are given."""
    sent = rows.sparkSession.sparkContext.broadcast(chosen)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, ...]] = []
        size, only = 0, sent.value
        for batch in batches:
            for w in W.chunks(batch.column(1)):
                s = Stretches(w, window, anchor)
                of, content, place = (slice(None), s.content, s.a) if only is None else s.windows(np.flatnonzero(only.has(s.gram)))
                held.append((s.gram[of], content, _owners(batch, 0, w)[_doc_of(w, place)]))
                size += len(content)
                if size >= FLUSH_ROWS:
                    yield from _tallied(held)
                    held, size = [], 0
        if held:
            yield from _tallied(held)

    counts = rows.select("owner", "text").mapInArrow(run, "gram long, content long, n long, owner int")
    return counts.groupBy("gram", "content").agg(F.sum("n").alias("n"), F.min("owner").alias("owner"))


def _joined(w: W.Words) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of the chunk's words with one space after each, and the place of each word in that."""
    place = np.concatenate(([0], np.cumsum(w.end - w.start + 1)))
    out = np.full(place[-1], 0x20, np.uint8)
    inner = np.ones(place[-1], bool)
    inner[place[1:] - 1] = False
    out[inner] = w.data[~W.SEPARATOR[w.data]]
    return out, place


def _winner(content: np.ndarray, owner: np.ndarray) -> np.ndarray:
    return content ^ (owner.astype(np.int64) * _OWNER).view(np.uint64)


def written_phrases(rows: DataFrame, window: int, anchor: int) -> tuple[DataFrame, DataFrame]:
    """The phrases of the rows (block, owner, text): passages (pid, text), and (block, pid, spans), where the word ranges [x, y)
    of a passage are its phrases that may be in a block."""
    stretches = settle(_counts(rows, window, anchor, None))
    grams = stretches.groupBy("gram").agg(F.count("*").alias("kinds")).filter("kinds > 1")
    mixed = KeyFilter(grams.select("gram"))
    single = _counts(rows, window, anchor, mixed).filter("n > 1")
    confirmed = settle(stretches.filter("n > 1").select("content", "owner").unionByName(single.select("content", "owner")))
    winners = KeyFilter(confirmed.select(F.col("content").bitwiseXOR(F.col("owner").cast("long") * _OWNER).alias("key")))
    sent = rows.sparkSession.sparkContext.broadcast((mixed, KeyFilter(confirmed.select("content")), winners))

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        several, known, won = sent.value
        held: list[np.ndarray] = []
        size = 0
        for batch in batches:
            for w in W.chunks(batch.column(2)):
                s = Stretches(w, window, anchor)
                whole, blocks, owners = known.has(s.content), _owners(batch, 0, w), _owners(batch, 1, w)
                unlike = np.flatnonzero(several.has(s.gram))
                of, content, at = s.windows(unlike)
                hit, inner = known.has(content), whole[of]
                if inner.any():  # the windows of such a stretch count if it turns out to be there once
                    yield _asked_whole(blocks, w, s, unlike[whole[unlike]])
                phrase, x = np.concatenate((s.content[whole], content[hit])), np.concatenate((s.a[whole], at[hit]))
                y = np.concatenate((s.b[whole] + window, at[hit] + window))
                doc = _doc_of(w, x)
                asks = np.append(np.ones(whole.sum(), bool), ~inner[hit])
                held.append(np.stack((blocks[doc[asks]].astype(np.uint64), phrase[asks])))
                size += int(asks.sum())
                mine = np.flatnonzero(won.has(_winner(phrase, owners[doc])))
                mine = mine[np.argsort(x[mine], kind="stable")]
                if len(mine):
                    yield _passages(w, x[mine], y[mine], phrase[mine], doc[mine])
                if size >= FLUSH_ROWS:
                    yield _asked(held)
                    held, size = [], 0
        if held:
            yield _asked(held)

    told = settle(rows.select("block", "owner", "text").mapInArrow(gather, _WRITTEN))
    passages, asked = told.filter("pid IS NOT NULL"), told.filter("pid IS NULL AND windows IS NULL").select("block", "content")
    alarms = told.filter("windows IS NOT NULL").join(confirmed.select("content"), "content", "left_anti")
    asked = asked.unionByName(alarms.select("block", F.explode("windows").alias("content")))
    items = passages.select("pid", F.explode("items").alias("i")).select("pid", "i.*").join(confirmed.select("content"), "content", "left_semi")
    wanted = asked.join(items, "content").groupBy("block", "pid").agg(F.collect_set(F.struct("x", "y")).alias("spans"))
    return passages.select("pid", "text"), wanted


_WRITTEN = "block long, content long, windows array<long>, pid long, text string, items array<struct<content:long,x:int,y:int>>"
_ITEMS = pa.list_(pa.struct([("content", pa.int64()), ("x", pa.int32()), ("y", pa.int32())]))
_KINDS = [pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.int64(), pa.string(), _ITEMS]
_COLUMNS = ["block", "content", "windows", "pid", "text", "items"]


def _row(n: int, **columns: pa.Array) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([columns.get(c, pa.nulls(n, k)) for c, k in zip(_COLUMNS, _KINDS, strict=True)], _COLUMNS)


def _asked_whole(blocks: np.ndarray, w: W.Words, s: Stretches, chosen: np.ndarray) -> pa.RecordBatch:
    """Stretches with their windows."""
    block = blocks[_doc_of(w, s.a[chosen])]
    edges = np.concatenate(([0], np.cumsum((s.b - s.a + 1)[chosen]))).astype(np.int32)
    windows = pa.ListArray.from_arrays(edges, pa.array(s.windows(chosen)[1].view(np.int64)))
    return _row(len(chosen), block=pa.array(block), content=pa.array(s.content[chosen].view(np.int64)), windows=windows)


def _asked(held: list[np.ndarray]) -> pa.RecordBatch:
    """The different (block, content)."""
    block, content = np.concatenate(held, axis=1)
    order = np.lexsort((content, block))
    block, content = block[order], content[order]
    first = np.flatnonzero(np.append(True, (block[1:] != block[:-1]) | (content[1:] != content[:-1])))
    return _row(len(first), block=pa.array(block[first].view(np.int64)), content=pa.array(content[first].view(np.int64)))


def _passages(w: W.Words, x: np.ndarray, y: np.ndarray, content: np.ndarray, doc: np.ndarray) -> pa.RecordBatch:
    """The phrases [x, y), by x, put together where they overlap."""
    apart = np.append(True, (doc[1:] != doc[:-1]) | (x[1:] > np.maximum.accumulate(y)[:-1]))
    run = np.flatnonzero(apart)
    part = (x - np.repeat(x[run], np.diff(np.append(run, len(x))))) // PASSAGE_WORDS
    first = np.flatnonzero(apart | np.append(True, part[1:] != part[:-1]))
    edges = np.append(first, len(x))
    low, high = x[first], np.maximum.reduceat(y, first)
    joined, place = _joined(w)
    told = joined.tobytes()
    text = [told[a:z] for a, z in zip(place[low].tolist(), (place[high] - 1).tolist(), strict=True)]
    pid = W.mix(content[first] * W.U(0xD1B54A32D192ED03) + W.run_hash(w.prefix(), low, high))
    start = np.repeat(low, np.diff(edges))
    items = pa.StructArray.from_arrays([pa.array(content.view(np.int64)), pa.array((x - start).astype(np.int32)), pa.array((y - start).astype(np.int32))], ["content", "x", "y"])
    told = pa.array(text, pa.binary()).cast(pa.string())
    return _row(len(first), pid=pa.array(pid.view(np.int64)), text=told, items=pa.ListArray.from_arrays(edges.astype(np.int32), items))


class Letters:
    """Words as letters of so many bits."""

    def __init__(self, window: int):
        if window < 7:
            raise ValueError("a window has 7 words at least")
        self.bits = max(10, -(-128 // window))

    def __call__(self, w: W.Words) -> str:
        code = (w.hash >> W.U(64 - self.bits)).astype("<u4") + np.uint32(1)
        code[code >= 0xD800] += np.uint32(0x800)  # no surrogates
        return code.tobytes().decode("utf-32-le")


class Automata:
    """The automata of a block's phrases."""

    def __init__(self, letters: Letters):
        self.letters, self.made, self.size = letters, [], 0
        self.ready = False

    def add(self, passages: pa.Array, spans: pa.Array) -> None:
        lists = spans.to_pylist()
        for w in W.chunks(passages):
            said = self.letters(w)
            for first, phrases in zip(w.first.tolist(), lists[w.row : w.row + w.n_docs], strict=False):
                for p in phrases:
                    if not self.made or self.size >= SHARD_LETTERS:
                        self.made.append(ahocorasick.Automaton(ahocorasick.STORE_LENGTH))
                        self.size = 0
                    self.made[-1].add_word(said[first + p["x"] : first + p["y"]])
                    self.size += p["y"] - p["x"]

    def found(self, w: W.Words) -> np.ndarray:
        """For each word of the texts whether a phrase that is found covers it."""
        if not self.ready:
            for automaton in self.made:
                automaton.make_automaton()
            self.ready = True
        covered = np.zeros(len(w) + 1, np.int64)
        said, doc = self.letters(w), w.doc
        for automaton in self.made:
            hits = np.array(list(automaton.iter(said)), np.int64).reshape(-1, 2)
            last = hits[:, 0]
            first = last - hits[:, 1] + 1
            one = doc[first] == doc[last]  # not across texts
            np.add.at(covered, first[one], 1)
            np.add.at(covered, last[one] + 1, -1)
        return np.cumsum(covered)[:-1] > 0


_SPANS = pa.list_(pa.struct([("x", pa.int32()), ("y", pa.int32())]))


def _cut(w: W.Words, gone: np.ndarray) -> list[pa.Array]:
    """spans, n_words, n_removed and kept of each text."""
    n, doc = w.n_docs, w.doc
    removed = np.bincount(doc[gone], minlength=n)
    edge = np.ones(len(w) + 1, bool)
    edge[1:-1] = (gone[1:] != gone[:-1]) | (doc[1:] != doc[:-1])
    a = np.flatnonzero(edge[:-1] & gone)
    z = np.flatnonzero(edge[1:] & gone) + 1
    lists = np.searchsorted(doc[a], np.arange(n + 1)).astype(np.int32)
    pairs = pa.StructArray.from_arrays([pa.array((v - w.first[doc[a]]).astype(np.int32)) for v in (a, z)], ["x", "y"])
    spans = pa.ListArray.from_arrays(pa.array(lists, mask=np.append(removed == 0, False)), pairs)
    joined, place = _joined(w)
    left = np.flatnonzero(~gone)
    keep = np.repeat(~gone, np.diff(place))
    of = doc[left]
    last = left[np.append(of[1:] != of[:-1], True)[: len(left)]]
    keep[place[last + 1] - 1] = False  # no space after a text's last word
    size = np.bincount(np.repeat(doc, np.diff(place))[keep], minlength=n)
    offsets = np.concatenate(([0], np.cumsum(size)))
    kept = pa.LargeStringArray.from_buffers(n, pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(joined[keep].tobytes())).cast(pa.string())
    return [spans, pa.array(w.counts.astype(np.int64)), pa.array(removed.astype(np.int64)), kept]


def remove_repeats(docs: DataFrame, id: str = "doc_id", text: str = "text", window: int = 35, anchor: int = 12) -> DataFrame:
    """One row per row of docs: id, spans (word ranges [x, y) covered by recurring windows, null if none), n_words, n_removed,
    kept (the words left, one space between them)."""
    letters = Letters(window)
    rows = docs.select(F.col(id).alias("id"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))
    rows = rows.withColumn("opening", F.xxhash64(F.substring("text", 1, OPENING)))
    sizes = settle(rows.groupBy("opening").agg(F.sum(F.octet_length("text")).alias("size")))
    size = sizes.agg(F.sum("size")).first()[0] or 0
    large = sizes.filter(F.col("size") > BLOCK_BYTES // 4).select("opening", F.ceil(F.col("size") / (BLOCK_BYTES // 4)).alias("cuts"))
    own = F.pmod(F.xxhash64("id", "text"), F.coalesce("cuts", F.lit(1)))
    block = F.pmod(F.xxhash64("opening", own), F.lit(max(LEAST_BLOCKS, size // BLOCK_BYTES)))
    rows = rows.join(small(large, 24), "opening", "left")
    rows = rows.select("id", block.alias("block"), F.hash("text", "id").alias("owner"), "text")
    passages, wanted = written_phrases(rows, window, anchor)
    kind = docs.schema[id].dataType
    none = F.lit(None)
    told = wanted.join(passages, "pid").select("block", F.lit(0).alias("kind"), none.cast(kind).alias("id"), "text", "spans")
    streamed = rows.select("block", F.lit(1).alias("kind"), "id", "text", none.cast("array<struct<x:int,y:int>>").alias("spans"))
    dealt = told.unionByName(streamed).repartition("block").sortWithinPartitions("block", "kind")
    schema = T.StructType([T.StructField("id", kind)])
    schema = schema.add("spans", T._parse_datatype_string("array<struct<x:int,y:int>>")).add("n_words", "long").add("n_removed", "long").add("kept", "string")

    def locate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, automata = None, Automata(letters)
        for batch in batches:
            block, kind = (batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 1))
            cut = np.flatnonzero((block[1:] != block[:-1]) | (kind[1:] != kind[:-1])) + 1
            for a, z in zip([0, *cut.tolist()], [*cut.tolist(), len(block)], strict=True):
                if a == z:
                    continue
                if block[a] != now:
                    now, automata = block[a], Automata(letters)
                if kind[a] == 0:
                    automata.add(batch.column(3).slice(a, z - a), batch.column(4).slice(a, z - a))
                    continue
                for w in W.chunks(batch.column(3).slice(a, z - a)):
                    yield pa.RecordBatch.from_arrays([batch.column(2).slice(a + w.row, w.n_docs), *_cut(w, automata.found(w))], schema.names)

    return dealt.mapInArrow(locate, schema).withColumnRenamed("id", id)
