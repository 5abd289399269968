"""Quality rules by weak supervision: rules vote or abstain, expectation-maximisation weighs them, a posterior decides.

Nulls and empty texts count as texts without words (they fail the base rule). Repeated rows and tied ids are judged row by
row, each alike. An empty table gives an empty result. Columns other than the id and the text are ignored by
``score_quality`` and passed through untouched by ``keep_good``. A text is always read whole.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vellum.llm import words as W

REPEAT_WINDOW = 8
SYMBOL = np.zeros(256, bool)
SYMBOL[list(b"#*$%&|<>")] = True
UPPER = np.zeros(256, bool)
UPPER[65:91] = True
LETTER = UPPER.copy()
LETTER[97:123] = True
LETTER[0xC0:] = True  # the first byte of a letter beyond ASCII; other such signs are rare in running text
SMALL = LETTER & ~UPPER
SMALL[0x80:] = True
STOP = np.zeros(256, bool)
STOP[list(b".,;:!?")] = True
CONTINUED = np.zeros(256, bool)
CONTINUED[0x80:0xC0] = True
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper", "n_letters", "n_stutters", "n_plain")


def counts(w: W.Words) -> dict[str, np.ndarray]:
    """The figures of each text that the rules look at."""
    n, doc, data, offsets = w.n_docs, w.doc, w.data, w.offsets
    out = {"n_words": w.counts.astype(np.int64)}
    upto = lambda flags: np.concatenate(([0], np.cumsum(flags, dtype=np.int64)))
    by_doc = lambda flags: np.diff(upto(flags)[offsets])
    inside = ~W.SEPARATOR[data] & ~CONTINUED[data]
    out["word_chars"] = by_doc(inside)
    out["n_symbols"] = by_doc(SYMBOL[data])
    out["n_upper"], out["n_letters"] = by_doc(UPPER[data]), by_doc(LETTER[data])
    # lines
    cut = np.flatnonzero(data == 10)
    cut_doc = np.searchsorted(offsets, cut, side="right") - 1
    a = np.concatenate((cut + 1, offsets[:-1]))
    a_doc = np.concatenate((cut_doc, np.arange(n)))
    order = np.lexsort((a, a_doc))
    a, a_doc = a[order], a_doc[order]
    z = np.empty_like(a)
    z[:-1] = a[1:] - 1
    is_last = np.append(a_doc[1:] != a_doc[:-1], True)
    z[is_last] = offsets[1:][a_doc[is_last]]
    worded = np.searchsorted(w.start, z) > np.searchsorted(w.start, a)
    a, z, a_doc = a[worded], z[worded], a_doc[worded]
    out["n_lines"] = np.bincount(a_doc, minlength=n)
    h = W.span_hash(data, a, z)
    order = np.lexsort((h, a_doc))
    same = (h[order][1:] == h[order][:-1]) & (a_doc[order][1:] == a_doc[order][:-1])
    out["n_dup_lines"] = np.bincount(a_doc[order][1:][same], minlength=n)
    # windows of words
    k, m = REPEAT_WINDOW, len(w)
    at = np.arange(max(0, m - k + 1))
    at = at[doc[at] == doc[at + k - 1]] if m >= k else at[:0]
    covered = np.zeros(m + 1, np.int64)
    if len(at):
        h = W.mix(W.run_hash(w.prefix(), at, at + k) ^ (doc[at].astype(np.uint64) * W.U(0x9E3779B97F4A7C15)))
        order = np.argsort(h)
        same = h[order][1:] == h[order][:-1]
        again = np.zeros(len(at), bool)
        again[order[1:][same]] = True
        again[order[:-1][same]] = True
        np.add.at(covered, at[again], 1)
        np.add.at(covered, at[again] + k, -1)
    out["n_repeat_words"] = np.bincount(doc[np.cumsum(covered)[:m] > 0], minlength=n)
    stutter = (w.hash[1:] == w.hash[:-1]) & (doc[1:] == doc[:-1])
    out["n_stutters"] = np.bincount(doc[1:][stutter], minlength=n)
    # plain words: small letters, perhaps a capital first and a stop last
    odd = np.concatenate(([0], np.cumsum(~SMALL[data], dtype=np.int64)))
    a, z = w.start + UPPER[data[w.start]], w.end - STOP[data[w.end - 1]]
    out["n_plain"] = np.bincount(doc[(a < z) & (odd[np.maximum(a, z)] == odd[a])], minlength=n)
    return out


@dataclass(frozen=True)
class Rule:
    """Votes against a text whose figure is over ``bad``, for it where it is under ``good``, and abstains otherwise."""

    name: str
    figure: object
    bad: float
    good: float = -np.inf

    def vote(self, x: dict[str, np.ndarray]) -> np.ndarray:
        v = self.figure(x)
        return np.where(v > self.bad, 0, np.where(v < self.good, 2, 1))


def _share(a: str, b: str):
    return lambda x: x[a] / np.maximum(1, x[b])


RULES = (
    Rule("short", lambda x: -x["n_words"], -20),
    Rule("symbols", _share("n_symbols", "word_chars"), 0.08),
    Rule("shouting", _share("n_upper", "n_letters"), 0.4),
    Rule("repeats", _share("n_repeat_words", "n_words"), 0.3),
    Rule("same lines", _share("n_dup_lines", "n_lines"), 0.4),
    Rule("stutter", _share("n_stutters", "n_words"), 0.2),
    Rule("word length", lambda x: abs(x["word_chars"] / np.maximum(1, x["n_words"]) - 6), 6),
    Rule("few letters", lambda x: 1 - x["n_letters"] / np.maximum(1, x["word_chars"]), 0.4),
    Rule("prose", lambda x: 1 - x["n_plain"] / np.maximum(1, x["n_words"]), 0.35, 0.1),
)


def patterns(x: dict[str, np.ndarray], rules: tuple[Rule, ...]) -> np.ndarray:
    """The votes of all rules as one number: a digit to the base of three each."""
    return sum(r.vote(x).astype(np.int64) * 3**j for j, r in enumerate(rules)) + np.zeros(len(x["n_words"]), np.int64)


def fit(pattern: np.ndarray, weight: np.ndarray, n_rules: int, rounds: int = 200) -> np.ndarray:
    """Posterior probability of good quality for each of the 3**n_rules vote patterns.

    A rule that votes is right with its own probability, whatever the class; abstaining says nothing. Expectation-maximisation
    estimates these and the share of good texts from the counted patterns. Accuracies stay between 0.75 and 0.999, so that no
    rule is ever read backwards, and start at 0.9.
    """
    all_votes = (np.arange(3**n_rules)[:, None] // 3 ** np.arange(n_rules)) % 3
    right, share, weight = np.full(n_rules, 0.9), 0.85, weight.astype(float)

    def posterior(votes: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(np.log(share / (1 - share)) + (votes - 1) @ np.log(right / (1 - right)), -700, 700)))

    votes = all_votes[pattern]
    for _ in range(rounds if len(pattern) else 0):
        good, before = posterior(votes), right
        agrees = np.where(votes == 2, good[:, None], np.where(votes == 0, 1 - good[:, None], 0))
        right = np.clip((weight @ agrees + 9) / (weight @ (votes != 1) + 10), 0.75, 0.999)
        share = float(np.clip(weight @ good / weight.sum(), 0.05, 0.95))
        if np.abs(right - before).max() < 1e-9:
            break
    return posterior(all_votes)


def learn(docs: DataFrame, text: str = "text", rules: tuple[Rule, ...] = RULES) -> np.ndarray:
    """Counts the vote patterns of all rows (3**len(rules) numbers at most) and fits their posteriors."""

    def tally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros(3 ** len(rules), np.int64)
        for batch in batches:
            for w in W.chunks(batch.column(0)):
                np.add.at(seen, patterns(counts(w), rules), 1)
        at = np.flatnonzero(seen)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(seen[at])], ["pattern", "n"])

    rows = docs.select(F.col(text).cast("string").alias("text")).mapInArrow(tally, "pattern long, n long").groupBy("pattern").agg(F.sum("n").alias("n")).collect()
    return fit(np.array([r[0] for r in rows], np.int64), np.array([r[1] for r in rows], np.int64), len(rules))


def judge(x: dict[str, np.ndarray], posterior: np.ndarray, rules: tuple[Rule, ...]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(base_failed, quality, kept)"""
    failed = (x["n_words"] < 20) | (100 * x["n_repeat_words"] > 30 * x["n_words"])
    quality = posterior[patterns(x, rules)]
    return failed, quality, ~failed & (quality >= 0.5)


def score_quality(docs: DataFrame, id: str = "doc_id", text: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """One row per row of docs: id, the counts, base_failed, quality (posterior probability) and kept."""
    posterior = learn(docs, text, rules)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for w in W.chunks(batch.column(1)):
                x = counts(w)
                failed, quality, kept = judge(x, posterior, rules)
                ids = batch.column(0).slice(w.row, w.n_docs)
                yield pa.RecordBatch.from_arrays(
                    [ids, *(pa.array(x[c], pa.int64()) for c in COUNTS), pa.array(failed), pa.array(quality), pa.array(kept)], schema.names
                )

    rows = docs.select(F.col(id).alias("id"), F.col(text).cast("string").alias("text"))
    schema = T.StructType([T.StructField("id", docs.schema[id].dataType), *(T.StructField(c, T.LongType()) for c in COUNTS)])
    schema = schema.add("base_failed", "boolean").add("quality", "double").add("kept", "boolean")
    return rows.mapInArrow(score, schema).withColumnRenamed("id", id)


def keep_good(docs: DataFrame, text: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """The rows of docs that are kept, all columns as they were."""
    posterior, at = learn(docs, text, rules), docs.columns.index(text)

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kept = [judge(counts(w), posterior, rules)[2] for w in W.chunks(batch.column(at))]
            yield batch.filter(pa.array(np.concatenate(kept)) if kept else pa.array([], pa.bool_()))

    return docs.mapInArrow(keep, docs.schema)
