from __future__ import annotations

import math
import zlib
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from tests.llm.conftest import EDGES, lowered, words
from vellum.llm import lm_scoring, queries


def tokens(text):
    return [*words(lowered(text)), None]


def test_base_matches_brute_force_and_the_model_beats_it(spark):
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect()}
    rows = queries.QUERIES["op1_lm"](spark, "/root/testdata/sf0.01").collect()
    held = {i: zlib.crc32(str(i).encode()) % 7 == 2 for i in docs}
    c = Counter(t for i, x in docs.items() if not held[i] for t in tokens(x))
    total = sum(c.values())
    assert len(rows) == len(docs)
    for r in rows:
        t = tokens(docs[r["doc_id"]])
        base = sum(math.log10((c[x] + 1) / (total + len(c) + 1)) for x in t)
        assert math.isclose(base, r["base_score"], rel_tol=1e-9)
        assert (r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]) == (held[r["doc_id"]], len(t), sum(c[x] > 0 for x in t), total)
    assert sum(r["score"] for r in rows if r["held_out"]) > sum(r["base_score"] for r in rows if r["held_out"])


def test_score_matches_a_model_with_exact_quantised_counts(spark):
    """The filter's false alarms can only raise counts, and seldom do."""
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()}
    held = {i: zlib.crc32(str(i).encode()) % 7 == 2 for i in docs}
    words_, pairs, texts = Counter(), Counter(), 0
    for i, x in docs.items():
        if not held[i]:
            t = tokens(x)
            words_.update(t)
            pairs.update(zip(["start", *t[:-1]], t, strict=True))
            texts += 1
    n, v = sum(words_.values()), len(words_)
    rough = lambda c: 0.0 if not c else 1.0 if c == 1 else math.ldexp(4 / 3, c.bit_length() - 1)
    rows = queries.QUERIES["op1_lm"](spark, "/root/testdata/sf0.001").collect()
    off = []
    for r in rows:
        want, before = 0.0, "start"
        for t in tokens(docs[r["doc_id"]]):
            c, h = words_[t], texts if before == "start" else words_[before]
            both = min(rough(pairs[before, t]), c, h) if c and h else 0.0
            want += math.log10((both + lm_scoring.MU * (c + 1) / (n + v + 1)) / (h + lm_scoring.MU))
            before = t
        off.append((r["score"] - want) / r["n_tokens"])
    assert np.abs(off).max() < 0.1 and abs(np.mean(off)) < 0.02, (min(off), max(off), np.mean(off))


def test_words_under_the_threshold_are_counted_by_the_join(spark, edges, monkeypatch):
    whole = {str(r[0]) + str(r["n_tokens"]): r for r in lm_scoring.score(edges, F.lit(True)).collect()}
    monkeypatch.setattr(lm_scoring, "HOT", 4)
    few = {str(r[0]) + str(r["n_tokens"]): r for r in lm_scoring.score(edges, F.lit(True)).collect()}
    assert whole.keys() == few.keys()
    for k, r in whole.items():
        assert math.isclose(r["base_score"], few[k]["base_score"], rel_tol=1e-9) and r["n_known"] == few[k]["n_known"] == r["n_tokens"]
    c = Counter(t for _, x in EDGES for t in tokens(x))
    assert next(iter(whole.values()))["train_tokens"] == sum(c.values())


def test_filter_gives_back_quantised_counts():
    rng = np.random.default_rng(6)
    key = rng.integers(0, 2**63, 20_000, dtype=np.uint64)
    count = np.maximum(1, rng.zipf(1.6, len(key)) % 5000)
    words_, least = lm_scoring.segment(key, count, 1 << 20)
    f = lm_scoring.Filter(words_, np.array([0, len(words_)]), np.array([least]))
    got = f.counts(key)
    true = np.where(count == 1, 1, np.ldexp(4 / 3, np.frexp(count.astype(float))[1] - 1))
    assert least == 1 and (got >= true).all()  # one-sided error
    assert (got == true).mean() > 0.9
    assert (f.counts(rng.integers(0, 2**63, 20_000, dtype=np.uint64)) > 0).mean() < 0.12


def test_a_bucket_over_its_bound_leaves_out_the_lowest_levels():
    key = np.arange(1, 5001, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    count = np.where(np.arange(5000) < 100, 64, 1)
    words_, least = lm_scoring.segment(key, count, 60)
    assert len(words_) <= 60 and least > 1
    f = lm_scoring.Filter(words_, np.array([0, len(words_)]), np.array([least]))
    assert (f.counts(key[:100]) >= 64).all()


def test_edges(nothing):
    assert lm_scoring.score(nothing, F.lit(True)).collect() == []


def test_every_pair_is_kept_however_large_the_filter_gets(spark, monkeypatch):
    monkeypatch.setattr(lm_scoring, "FILTER_BYTES", 1 << 12, raising=False)  # what once bounded it
    texts = [" ".join(f"w{(i * 37 + j * j) % 4001}" for j in range(200)) for i in range(100)]
    model, _ = lm_scoring.learn(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), F.lit(True))
    t = lm_scoring.Tokens(next(lm_scoring.W.chunks(lm_scoring.pa.array(texts), lower=True)))
    assert (model.filter.least == 1).all()
    assert (model.filter.counts(lm_scoring.pair_keys(t.before, t.key)) >= 1).all()
    assert model.filter.words.nbytes > 1 << 12
