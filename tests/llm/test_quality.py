from __future__ import annotations

from collections import Counter

import numpy as np

from tests.llm.conftest import EDGES, words
from vellum.llm import quality, queries


def brute(text):
    w = words(text)
    seen, dup = set(), 0
    for line in (text or "").split("\n"):
        if words(line):
            dup += line in seen
            seen.add(line)
    c = Counter(tuple(w[i : i + 8]) for i in range(len(w) - 7))
    covered = set()
    for i in range(len(w) - 7):
        if c[tuple(w[i : i + 8])] > 1:
            covered.update(range(i, i + 8))
    return len(w), sum(map(len, w)), sum((text or "").count(s) for s in "#*$%&|<>"), dup, len(covered)


def test_counts_match_brute_force(spark, edges):
    got = quality.score_quality(edges).collect()
    assert sorted(str((r["doc_id"], *r[1:6])) for r in got) == sorted(str((i, *brute(t))) for i, t in EDGES)
    for r in got:
        assert r["base_failed"] == (r["n_words"] < 20 or 100 * r["n_repeat_words"] > 30 * r["n_words"])
        assert not (r["kept"] and r["base_failed"])


def test_query_on_a_table(spark):
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()}
    got = queries.QUERIES["op10_quality"](spark, "/root/testdata/sf0.001").collect()
    assert len(got) == len(docs)
    assert all(tuple(r)[1:6] == brute(docs[r["doc_id"]]) for r in got)


def test_agrees_with_labels(spark):
    kept = quality.score_quality(spark.read.parquet("/root/testdata/sf0.01/documents.parquet"))
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    both = kept.join(labels.withColumnRenamed("quality", "label"), "doc_id").filter("not base_failed")
    assert both.filter("label = 1 and not kept").count() == 0
    assert both.filter("label = 0 and kept").count() <= 0.05 * both.filter("label = 0").count()


def test_keep_good_keeps_columns_and_whole_rows(edges, nothing):
    kept = quality.keep_good(edges)
    assert kept.columns == edges.columns
    judged = quality.score_quality(edges).filter("kept").count()
    assert kept.count() == judged
    assert quality.keep_good(nothing).collect() == [] and quality.score_quality(nothing).collect() == []


def test_expectation_maximisation_finds_the_rules_accuracies():
    rng = np.random.default_rng(1)
    good = rng.random(20_000) < 0.8
    right = np.array([0.95, 0.9, 0.8])
    votes = np.where(rng.random((20_000, 3)) < right, good[:, None], ~good[:, None]) * 2
    votes = np.where(rng.random((20_000, 3)) < 0.2, 1, votes)
    pattern, n = np.unique(votes @ 3 ** np.arange(3), return_counts=True)
    p = quality.fit(pattern, n, 3)[votes @ 3 ** np.arange(3)]
    assert ((p >= 0.5) == good).mean() > 0.93
    assert abs(p.mean() - 0.8) < 0.03
