"""Benchmark decontamination by latent semantic retrieval.

Terms are lower-cased runs of letters and digits. Passages are ``PASSAGE`` terms long and begin every ``STRIDE`` terms, so that
an item is cut by few of them. Terms weigh by their inverse frequency over all documents. A benchmark term's frequency is its
number of different surroundings (the terms before and after it), so copies of an item or a passage, however many, count once;
it always weighs something. Other terms only add to a passage's weight; very frequent ones among them weigh nothing.
The benchmark is taken in blocks of ``BLOCK`` items, blocks in groups of at most ``GROUP_TERMS`` terms; each group reads the
documents once to weigh its terms and count how often they share a passage, and once to search, with what it broadcasts bounded
by that. For each block a randomised SVD of the TF-IDF rows of its items and of all passages of all documents gives a latent
space for the block's terms; its products are taken over the counted pairs of terms, which are distributed and say all that the
passages' rows do. Every passage of every document is held against every item there by cosine; passages without enough weight on the block's terms are left out beforehand, as their
cosine can't reach the bound. Candidates are aligned to the item, and the longest common subsequence of terms decides: most of
the item, or a good part of it together with nearly all of its answer (its last sentence).

A null text counts as empty; texts and items without terms match nothing. Rows with tied ids are each judged alone, repeated
items are all reported. Empty tables give empty or clean results; other columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vellum.llm import words as W
from vellum.llm.shared import settle

PASSAGE, STRIDE = 32, 16
BLOCK = 256
#: Bounds of what is held at once: different terms of a group's blocks (each has BLOCK numbers), bytes of items on the driver.
GROUP_TERMS, SLICE_BYTES = 1 << 16, 32 << 20
BINS = 1 << 16
#: Pairs of terms are counted in a table of so many numbers, or sorted, so many at a time, where a group's blocks have more; they
#: are kept in panels of about so many numbers.
TABLE, SORTED, PANEL = 1 << 24, 1 << 21, 1 << 17
RANK, OVERSAMPLE, POWER_STEPS = 256, 16, 2
#: Of the passages; terms outside the benchmark that are more frequent weigh nothing.
FREQUENT = 0.05
#: Registers a term that different surroundings are counted with (Flajolet et al., 2007), and what corrects their mean.
REGISTERS, CORRECTION = 32, 0.697
_BEFORE, _AFTER = np.uint64(0x9FB21C651E98DF25), np.uint64(0xA0761D6478BD642F)
COSINE = 0.3
MOST, PART, ANSWER = 0.5, 0.4, 0.9
_NOT_TERM = np.ones(256, bool)
_NOT_TERM[[*range(48, 58), *range(65, 91), *range(97, 123), *range(0x80, 256)]] = False
_SENTENCE = re.compile(r"[.!?\n]+")


def _chunks(column: pa.Array) -> Iterator[W.Words]:
    return W.chunks(column, lower=True, separator=_NOT_TERM)


def _hashes(text: str) -> np.ndarray:
    return next(_chunks(pa.array([text]))).hash.copy()


@dataclass
class Vocabulary:
    terms: np.ndarray  # ascending
    table: np.ndarray  # for each bin whether a term falls in it

    def places(self, term: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(which of the terms are in the vocabulary, where)"""
        maybe = np.flatnonzero(self.table[_bin(term)])
        if not len(maybe):
            return maybe, maybe
        at = np.searchsorted(self.terms, term[maybe])
        at[at == len(self.terms)] = 0
        known = self.terms[at] == term[maybe]
        return maybe[known], at[known]


@dataclass
class Block:
    """Some items: ids, terms of each and of its answer, the different terms of all, in SVD space once fitted."""

    ids: list[int]
    terms: list[np.ndarray]
    answers: list[np.ndarray]
    vocabulary: Vocabulary
    idf: np.ndarray | None = None
    bin_square: np.ndarray | None = None  # by bin, the square of the idf of terms that aren't the block's
    near: np.ndarray | None = None  # for each term and item the product of their rows in the space; an item's row is a unit row
    weights: list[list[float]] | None = None  # idf of each item's terms
    spots: list[dict[int, list[int]]] | None = None  # where each term stands in an item

    def places(self, term: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return self.vocabulary.places(term)


def _bin(term: np.ndarray) -> np.ndarray:
    return (term >> W.U(48)).astype(np.int64)


def block_of(items: list[tuple[int, str | None]]) -> Block:
    ids, terms, answers = [], [], []
    for item, text in items:
        h = _hashes(text or "")
        if len(h):
            sentences = [s for s in _SENTENCE.split(text) if s.strip()]
            answer = _hashes(sentences[-1]) if sentences else h
            ids.append(item)
            terms.append(h)
            answers.append(answer if len(answer) else h)
    return Block(ids, terms, answers, _vocabulary(terms))


def _vocabulary(terms: list[np.ndarray]) -> Vocabulary:
    found = np.unique(np.concatenate(terms)) if terms else np.zeros(0, np.uint64)
    table = np.zeros(BINS, bool)
    table[_bin(found)] = True
    return Vocabulary(found, table)


def surroundings(w: W.Words, i: np.ndarray) -> np.ndarray:
    """Hashes of the i-th terms with the ones before and after them in their texts."""
    before, after = np.append(W.U(0), w.hash[:-1]), np.append(w.hash[1:], W.U(0))
    full = w.counts > 0
    before[w.first[:-1][full]] = 0
    after[w.first[1:][full] - 1] = 0
    return W.mix(w.hash[i] + W.mix(before[i] + _BEFORE) * _BEFORE + W.mix(after[i] + _AFTER) * _AFTER)


def different(registers: np.ndarray) -> np.ndarray:
    """For each row of registers, about how many different hashes it has seen."""
    n = CORRECTION * REGISTERS**2 / np.ldexp(1.0, -registers.astype(int)).sum(1)
    empty = (registers == 0).sum(1)
    return np.where((n <= 2.5 * REGISTERS) & (empty > 0), REGISTERS * np.log(REGISTERS / np.maximum(1, empty)), n)


class Pairs:
    """Counts by key, keys being under size: in a table if told so, else sorted. ``take`` gives them out and starts anew."""

    def __init__(self, size: int, table: bool, at_once: int):
        self.table = np.zeros(size, np.int32) if table else None
        self.at_once = at_once
        self.keys, self.n = np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.added, self.new = 0, []

    def add(self, keys: np.ndarray, n: int) -> None:
        if self.table is not None:
            np.add.at(self.table, keys, np.int32(n))
            self.added += n * len(keys)
            return
        self.new.append((keys, n))
        self.added += len(keys)
        if self.added >= self.at_once:
            self._merge()

    def _merge(self) -> None:
        n = np.concatenate((self.n, *(np.full(len(k), x) for k, x in self.new)))
        self.keys, at = np.unique(np.concatenate((self.keys, *(k for k, _ in self.new))), return_inverse=True)
        self.n = np.bincount(at, weights=n, minlength=len(self.keys)).astype(np.int64)
        self.added, self.new = 0, []

    def full(self) -> bool:
        """Whether a number of the table might soon not fit, or too many are held."""
        return self.added >= 1 << 30 if self.table is not None else len(self.keys) >= self.at_once

    def take(self) -> tuple[np.ndarray, np.ndarray]:
        """(keys, ascending, counts)"""
        if self.table is None:
            self._merge()
            out = self.keys, self.n
            self.keys, self.n = self.keys[:0], self.n[:0]
        else:
            keys = np.flatnonzero(self.table)
            out = keys, self.table[keys].astype(np.int64)
            self.table[keys] = 0
            self.added = 0
        return out


_COUNTS = "block int, panel int, at binary, n binary"
#: In place of a block, and panels of it: how often each bin's terms come, and all; what the registers hold.
_WEIGHTS, _BINS, _REGISTERS = -1, 0, 1


def _counted(block: int, panel: int, at: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
    row = [pa.array([block], pa.int32()), pa.array([panel], pa.int32()), pa.array([at.astype(np.int32).tobytes()], pa.binary()), pa.array([n.astype(np.int64).tobytes()], pa.binary())]
    return pa.RecordBatch.from_arrays(row, ["block", "panel", "at", "n"])


def _numbers(at: bytes, n: bytes) -> tuple[np.ndarray, np.ndarray]:
    return np.frombuffer(at, np.int32), np.frombuffer(n, np.int64)


def _panel_rows(n: int) -> int:
    """How many of n terms have their pairs in one panel."""
    return max(1, PANEL // max(1, n))


def _add_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of the same block and panel, which follow each other, made one: a panel is held at a time."""
    of, total = None, np.zeros(0, np.int64)
    for batch in batches:
        for block, panel, at, n in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if of != (block, panel):
                if of:
                    yield _counted(*of, np.flatnonzero(total), total[total != 0])
                of, total = (block, panel), np.zeros(0, np.int64)
            at, n = _numbers(at, n)
            if len(at) and at[-1] >= len(total):
                total = np.append(total, np.zeros(at[-1] + 1 - len(total), np.int64))
            total[at] = np.maximum(total[at], n) if of == (_WEIGHTS, _REGISTERS) else total[at] + n
    if of:
        yield _counted(*of, np.flatnonzero(total), total[total != 0])


def weigh(texts: DataFrame, blocks: list[Block]) -> DataFrame:
    """Sets idf for the blocks' terms and, by bin, for all others, from their frequencies over all documents: one reading. Returns
    what that reading counts beside them: for each block, in panels, how often two of its terms stand in one passage, the lesser
    term first. A pair counts 2, a term with itself 1, so that these numbers and their transpose add up to twice the product of
    the passages' rows of counts with themselves."""
    every = _vocabulary([t for b in blocks for t in b.terms])
    size = len(every.terms) * REGISTERS
    sizes = [len(b.vocabulary.terms) for b in blocks]
    starts = np.concatenate(([0], np.cumsum([n * n for n in sizes]))).astype(np.int64).tolist()
    in_table, at_once, high = starts[-1] <= TABLE, SORTED, [_panel_rows(n) for n in sizes]
    own = np.full((len(blocks), len(every.terms)), -1, np.int32)  # where a term stands in each block
    for b, block in enumerate(blocks):
        own[b, every.places(block.vocabulary.terms)[1]] = np.arange(sizes[b])

    def count(pairs: Pairs, w: W.Words, i: np.ndarray, at: np.ndarray) -> None:
        doc = w.doc[i]
        passage = doc * (1 << 32) + (i - w.first[doc]) // PASSAGE
        for b, n in enumerate(sizes):
            place = own[b, at].astype(np.int64)
            known = place >= 0
            place, here = place[known], passage[known]
            pairs.add(starts[b] + place * (n + 1), 1)
            for apart in range(1, PASSAGE):
                same = np.flatnonzero(here[apart:] == here[:-apart])
                if not len(same):
                    break
                x, y = place[same], place[same + apart]
                pairs.add(starts[b] + np.minimum(x, y) * n + np.maximum(x, y), 2)

    def panels(pairs: Pairs) -> Iterator[pa.RecordBatch]:
        keys, n = pairs.take()
        bounds = np.searchsorted(keys, starts)
        for b, wide in enumerate(sizes):
            mine, its = keys[bounds[b] : bounds[b + 1]] - starts[b], n[bounds[b] : bounds[b + 1]]
            span = wide * high[b]
            edges = np.searchsorted(mine, np.arange(0, wide * wide + span, span))
            for p in np.flatnonzero(np.diff(edges)).tolist():
                yield _counted(b, p, mine[edges[p] : edges[p + 1]] - p * span, its[edges[p] : edges[p + 1]])

    def tally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, most = np.zeros(BINS + 1, np.int64), np.zeros(size, np.int64)
        pairs = Pairs(starts[-1], in_table, at_once)
        for batch in batches:
            for w in _chunks(batch.column(0)):
                i, at = every.places(w.hash)
                x = surroundings(w, i) if len(i) else np.zeros(0, np.uint64)
                spot, rank = at * REGISTERS + (x % W.U(REGISTERS)).astype(np.int64), 54 - np.frexp((x >> W.U(11)).astype(float))[1]
                more = rank > most[spot]  # few, once the registers have filled
                np.maximum.at(most, spot[more], rank[more])
                total[:BINS] += np.bincount(_bin(w.hash), minlength=BINS)
                total[BINS] += len(w)
                count(pairs, w, i, at)
                if pairs.full():
                    yield from panels(pairs)
        yield from panels(pairs)
        yield _counted(_WEIGHTS, _BINS, np.flatnonzero(total), total[total != 0])
        yield _counted(_WEIGHTS, _REGISTERS, np.flatnonzero(most), most[most != 0])

    rows = texts.mapInArrow(tally, _COUNTS).repartition("block", "panel").sortWithinPartitions("block", "panel")
    counted = settle(rows.mapInArrow(_add_up, _COUNTS))
    total, most = np.zeros(BINS + 1), np.zeros(size, np.int64)
    for _, panel, at, n in counted.filter(F.col("block") == _WEIGHTS).collect():  # two rows, as long as the bins and registers
        at, n = _numbers(at, n)
        (total if panel == _BINS else most)[at] = n
    passages = max(1.0, total[BINS] / PASSAGE)
    bins, terms = total[:BINS], different(most.reshape(-1, REGISTERS))
    bin_idf = np.log(1 + passages / np.maximum(1, bins))
    bin_idf[bins > FREQUENT * passages] = 0
    idf = np.log(1 + passages / np.maximum(1, terms))
    for block in blocks:
        block.bin_square, block.idf = bin_idf**2, idf[every.places(block.vocabulary.terms)[1]]
    return counted.filter(F.col("block") != _WEIGHTS)


def sampled(docs: DataFrame, id: str, text: str) -> DataFrame:
    """The texts that terms are weighed and latent spaces fitted on: every one. (Callers know it by this name.)"""
    return docs.select(F.col(text).cast("string").alias("text"))


def fit(counted: DataFrame, block: Block, seed: int = 11) -> None:
    """Sets the block's latent space: the leading right singular vectors of the TF-IDF rows of its items and of all passages, whose
    pairs of terms are counted. Items as a whole weigh as much as all passages do, however many those are."""
    n, idf = len(block.vocabulary.terms), block.idf
    width, high = min(n, RANK + OVERSAMPLE), _panel_rows(n)
    places = [block.places(t)[1] for t in block.terms]
    rows = []  # the items': BLOCK at most, their squares adding up to 1
    for at, times in (np.unique(x, return_counts=True) for x in places):
        v = idf[at] * times
        rows.append((at, v / np.sqrt((v * v).sum() * len(places))))

    def passages_times(q: np.ndarray) -> tuple[np.ndarray, float]:
        """A' A q and the trace of A' A for the rows A of the passages, the counts staying where they are."""
        scaled = idf[:, None] * q

        def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            out, trace = np.zeros_like(scaled), 0.0
            for batch in batches:
                for panel, at, m in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                    at, m = _numbers(at, m)
                    low, top = panel * high, min(n, panel * high + high)
                    own = np.zeros((top - low, n))
                    own.reshape(-1)[at] = m
                    out[low:top] += own @ scaled / 2
                    out += own.T @ scaled[low:top] / 2
                    trace += float(own[np.arange(top - low), np.arange(low, top)] @ idf[low:top] ** 2)
            yield pa.RecordBatch.from_arrays([pa.array([out.astype(np.float32).tobytes()], pa.binary()), pa.array([trace])], ["part", "trace"])

        total, trace = np.zeros_like(q), 0.0
        for r in counted.select("panel", "at", "n").coalesce(4).mapInArrow(part, "part binary, trace double").toLocalIterator():
            total += np.frombuffer(r[0], np.float32).reshape(q.shape)
            trace += r[1]
        return idf[:, None] * total, trace

    def gram_times(q: np.ndarray) -> np.ndarray:
        out, trace = passages_times(q)
        out /= trace or 1.0
        for at, v in rows:
            out[at] += v[:, None] * (v @ q[at])[None, :]
        return out

    q = np.linalg.qr(np.random.default_rng(seed).normal(size=(n, width)))[0]
    for _ in range(POWER_STEPS):
        q = np.linalg.qr(gram_times(q))[0]
    values, turn = np.linalg.eigh(q.T @ gram_times(q))
    keep = np.argsort(values)[::-1][:RANK]
    basis = q @ turn[:, keep]
    latent = (idf[:, None] * basis).astype(np.float32)
    items = np.zeros((len(block.ids), basis.shape[1]), np.float32)
    for j, at in enumerate(places):
        items[j] = latent[at].sum(0) / max(1e-9, np.sqrt((idf[at] ** 2).sum()))
    block.near = latent @ items.T  # sums of these are a passage's products with the items
    block.weights = [idf[at].tolist() for at in places]
    block.spots = [_spots(t.tolist()) for t in block.terms]


def _spots(terms: list[int]) -> dict[int, list[int]]:
    spots: dict[int, list[int]] = {}
    for y, t in enumerate(terms):
        spots.setdefault(t, []).append(y)
    return spots


def lcs(item: list[int], passage: list[int]) -> int:
    """Length of the longest common subsequence, by bit-parallel steps (Hyyro, 2004)."""
    masks: dict[int, int] = {}
    for i, t in enumerate(item):
        masks[t] = masks.get(t, 0) | 1 << i
    full = (1 << len(item)) - 1
    v = full
    for t in passage:
        m = masks.get(t)
        if m:
            u = v & m
            v = ((v + u) | (v - u)) & full
    return len(item) - v.bit_count()


def find(w: W.Words, block: Block) -> list[tuple[int, int, float, float]]:
    """(text, item, share of the item in common, share of its answer) for the candidates of a chunk."""
    term, m = w.hash, len(w)
    known, at = block.places(term)
    if not len(known):
        return []
    # strides of terms within texts; a passage is a stride and the next one of the same text
    n_strides = -(-w.counts // STRIDE)
    base = np.concatenate(([0], np.cumsum(n_strides)))
    doc = w.doc
    stride = base[doc] + (np.arange(m) - w.first[doc]) // STRIDE
    square = block.bin_square[_bin(term)]
    total = np.bincount(stride, weights=square, minlength=base[-1])
    own = np.bincount(stride[known], weights=block.idf[at] ** 2, minlength=base[-1])
    last = np.zeros(base[-1], bool)
    last[base[1:][n_strides > 0] - 1] = True
    pair = lambda x: x + np.where(last, 0, np.append(x[1:], 0))
    other = np.bincount(stride[known], weights=square[known], minlength=base[-1])
    norm = np.sqrt(np.maximum(1e-9, pair(total - other + own)))
    able = np.flatnonzero(np.sqrt(pair(own)) >= COSINE * norm)
    if not len(able):
        return []
    out = []
    edges = np.searchsorted(stride[known], np.arange(base[-1] + 1))
    text_of = np.repeat(np.arange(w.n_docs), n_strides)
    for part in np.array_split(able, -(-len(able) // 4096)):
        need = np.unique(np.concatenate((part, part[~last[part]] + 1)))
        n = edges[need + 1] - edges[need]
        sums = np.zeros((len(need) + 1, block.near.shape[1]), np.float32)
        for k in range(int(n.max(initial=0))):  # the k-th known term of every stride that has so many
            some = np.flatnonzero(n > k)
            sums[some] += block.near[at[edges[need[some]] + k]]
        here = np.searchsorted(need, part)
        after = np.where(last[part], len(need), np.searchsorted(need, part + 1))
        cosine = (sums[here] + sums[after]) / norm[part][:, None].astype(np.float32)
        for p, j in zip(*(x.tolist() for x in np.nonzero(cosine >= COSINE)), strict=True):
            found = check(w, block, int(text_of[part[p]]), int(part[p] - base[text_of[part[p]]]), j)
            if found:
                out.append(found)
    return out


def check(w: W.Words, block: Block, text: int, stride: int, j: int) -> tuple[int, int, float, float] | None:
    """Lays the item where its terms stand in the passage, and compares it with what is there."""
    length, spots, weights = len(block.terms[j]), block.spots[j], block.weights[j]
    first, end = int(w.first[text]), int(w.first[text + 1])
    a = first + stride * STRIDE
    shifts = [(x - y, weights[y]) for x, t in enumerate(w.hash[a : min(end, a + PASSAGE)].tolist()) if t in spots for y in spots[t]]
    if not shifts:
        return None
    shifts.sort()
    half, summed = sum([s[1] for s in shifts]) / 2, 0.0
    for shift, weight in shifts:
        summed += weight
        if summed >= half:
            break
    slack = max(4, length // 4)
    region = w.hash[max(first, a + shift - slack) : max(first, min(end, a + shift + length + slack))].tolist()
    if sum([len(spots[t]) for t in spots.keys() & set(region)]) < PART * length:  # no subsequence is longer than the terms that are there
        return None
    share = lcs(block.terms[j].tolist(), region) / length
    if share < PART:
        return None
    answer = block.answers[j]
    return text, j, share, lcs(answer.tolist(), region) / len(answer)


def groups(benchmark: DataFrame, item: str, item_text: str) -> Iterator[tuple[list[Block], bool]]:
    """The benchmark, the stated query set, in groups of blocks; whether more may follow. The driver holds a slice at a time."""
    told = settle(benchmark.select(F.col(item).cast("long").alias("id"), F.col(item_text).cast("string").alias("text")).filter("text IS NOT NULL"))
    slices = -(-(told.agg(F.sum(F.octet_length("text") + 16)).first()[0] or 0) // SLICE_BYTES) or 1
    for i in range(slices):
        part = told.filter(F.pmod(F.xxhash64("id", "text"), F.lit(slices)) == i).orderBy("id", "text").collect()
        held, size = [], 0
        for a in range(0, len(part), BLOCK):
            block = block_of([(r[0], r[1]) for r in part[a : a + BLOCK]])
            if held and size + len(block.vocabulary.terms) > GROUP_TERMS:
                yield held, True
                held, size = [], 0
            if block.ids:
                held.append(block)
                size += len(block.vocabulary.terms)
        yield held, i + 1 < slices


def prepare(docs: DataFrame, texts: DataFrame, blocks: list[Block], text: str) -> list[Block]:
    """The blocks, weighed and fitted on all texts."""
    counted = weigh(texts, blocks) if blocks else None
    for b, block in enumerate(blocks):
        fit(counted.filter(F.col("block") == b), block)
    return blocks


def leaks(docs: DataFrame, benchmark: DataFrame, id: str = "doc_id", text: str = "text", item: str = "item_id", item_text: str = "text") -> DataFrame:
    """One row per row of docs: id, items (the items found in it, ascending), share (of the item it holds most of) and
    contaminated."""
    texts = sampled(docs, id, text)
    rows = docs.select(F.col(id).alias("id"), F.col(text).cast("string").alias("text"), F.lit(None).cast("array<bigint>").alias("items"), F.lit(0.0).alias("share"))
    schema = T.StructType([T.StructField("id", docs.schema[id].dataType), T.StructField("text", T.StringType()), T.StructField("items", T.ArrayType(T.LongType()))])
    schema = schema.add("share", "double")

    def search(blocks: list[Block], more: bool) -> DataFrame:
        sent = docs.sparkSession.sparkContext.broadcast(blocks)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for w in _chunks(batch.column(1)):
                    part = batch.slice(w.row, w.n_docs)
                    items, share = judged(w, sent.value)
                    items = [sorted({*(had or ()), *x}) for had, x in zip(part.column(2).to_pylist(), items, strict=True)]
                    said = part.column(1) if more else pa.nulls(w.n_docs, pa.string())
                    share = np.maximum(share, part.column(3).to_numpy(zero_copy_only=False))
                    yield pa.RecordBatch.from_arrays([part.column(0), said, pa.array(items, pa.list_(pa.int64())), pa.array(share)], schema.names)

        return rows.mapInArrow(run, schema)

    for blocks, more in groups(benchmark, item, item_text):
        rows = search(prepare(docs, texts, blocks, text), more)
        rows = settle(rows) if more else rows
    return rows.select(F.col("id").alias(id), "items", "share", (F.size("items") > 0).alias("contaminated"))


def drop_leaks(docs: DataFrame, benchmark: DataFrame, id: str = "doc_id", text: str = "text", item: str = "item_id", item_text: str = "text") -> DataFrame:
    """The rows of docs in which no item is found, all columns as they were."""
    texts, at, rows = sampled(docs, id, text), docs.columns.index(text), docs

    def clean(blocks: list[Block]) -> DataFrame:
        sent = docs.sparkSession.sparkContext.broadcast(blocks)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                none = [not x for w in _chunks(batch.column(at)) for x in judged(w, sent.value)[0]]
                yield batch.filter(pa.array(none, pa.bool_()))

        return rows.mapInArrow(run, docs.schema)

    for blocks, more in groups(benchmark, item, item_text):
        rows = clean(prepare(docs, texts, blocks, text))
        rows = settle(rows) if more else rows
    return rows


def judged(w: W.Words, blocks: list[Block]) -> tuple[list[list[int]], np.ndarray]:
    items: list[set[int]] = [set() for _ in range(w.n_docs)]
    share = np.zeros(w.n_docs)
    for block in blocks:
        for d, j, most, answer in find(w, block):
            if most >= MOST or answer >= ANSWER:
                items[d].add(block.ids[j])
                share[d] = max(share[d], most)
    return [sorted(x) for x in items], share
