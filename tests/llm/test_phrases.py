from __future__ import annotations

import hashlib
import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tests.llm.conftest import EDGES, words
from vellum.llm import phrases, queries


def brute(rows, window):
    seen = Counter(tuple(w[i : i + window]) for _, t in rows for w in [words(t)] for i in range(len(w) - window + 1))
    out = []
    for doc, t in rows:
        w = words(t)
        gone = [False] * len(w)
        for i in range(len(w) - window + 1):
            if seen[tuple(w[i : i + window])] > 1:
                gone[i : i + window] = [True] * window
        out.append((doc, len(w), sum(gone), " ".join(x for x, g in zip(w, gone, strict=True) if not g)))
    return sorted(map(str, out))


def got(df):
    return sorted(str((r["doc_id"], r["n_words"], r["n_removed"], r["kept"])) for r in df.collect())


@pytest.mark.parametrize("case", ["mixed", "two words"])
def test_matches_brute_force(spark, case, monkeypatch):
    monkeypatch.setattr(phrases, "FLUSH_ROWS", 50)
    rng = random.Random(case)
    alphabet = ["a", "b"] if case == "two words" else [f"w{i}" for i in range(300)]
    shared = [[rng.choice(alphabet) for _ in range(rng.randint(5, 40))] for _ in range(6)]
    rows = []
    for i in range(60):
        w = []
        for _ in range(rng.randint(0, 6)):
            w += rng.choice(shared) if rng.random() < 0.5 else [rng.choice(alphabet) for _ in range(rng.randint(1, 25))]
        rows.append((i, "  ".join(w) if i % 2 else "\n".join(w)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert got(phrases.remove_repeats(df, window=10, anchor=4)) == brute(rows, 10)


def test_edges(edges, nothing):
    assert got(phrases.remove_repeats(edges)) == brute(EDGES, 35)
    assert phrases.remove_repeats(nothing).collect() == []


def test_a_passage_in_every_document_goes_to_every_block(spark, monkeypatch):
    monkeypatch.setattr(phrases, "SHARD_LETTERS", 300)
    monkeypatch.setattr(phrases, "BLOCK_BYTES", 2000)
    passage = " ".join(f"p{i}" for i in range(50))
    rows = [(i, f"{'x' * (i % 7)} own{i} {passage} tail{i}") for i in range(80)] + [(None, passage), (None, passage)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(8)
    assert got(phrases.remove_repeats(df)) == brute(rows, 35)


def test_only_what_the_automata_find_is_removed(spark, monkeypatch):
    passage = " ".join(f"p{i}" for i in range(50))
    df = spark.createDataFrame([(i, f"own{i} {passage}") for i in range(9)], "doc_id long, text string")
    rows = df.selectExpr("doc_id AS id", "cast(0 AS bigint) AS block", "hash(text) AS owner", "text")
    passages, wanted = phrases.written_phrases(rows, 35, 12)
    assert [(r["text"], wanted.count()) for r in passages.collect()] == [(passage, 1)]  # written once, by its owner
    found = phrases.Automata(phrases.Letters(35))
    w = next(phrases.W.chunks(pa.array([f"own {passage}"])))
    assert not found.found(w).any()
    found = phrases.Automata(phrases.Letters(35))
    found.add(pa.array([passage]), pa.array([[{"x": 0, "y": 40}]]))
    assert found.found(w).tolist() == [False] + [True] * 40 + [False] * 10


def test_empty_automata_remove_nothing(spark, monkeypatch):
    passage = " ".join(f"p{i}" for i in range(50))
    df = spark.createDataFrame([(i, f"own{i} {passage}") for i in range(9)], "doc_id long, text string")
    told = phrases.written_phrases
    assert sum(r["n_removed"] for r in phrases.remove_repeats(df).collect()) == 450
    none = F.array().cast("array<struct<x:int,y:int>>")
    monkeypatch.setattr(phrases, "written_phrases", lambda *a: (told(*a)[0], told(*a)[1].withColumn("spans", none)))
    assert sum(r["n_removed"] for r in phrases.remove_repeats(df).collect()) == 0


def test_false_alarms_of_the_filters_change_nothing(spark, monkeypatch):
    monkeypatch.setattr(phrases.KeyFilter, "has", lambda self, key: np.ones(len(key), bool))
    rows = [(i, " ".join(f"{'abc'[i % 3]}{j % (20 + i)}" for j in range(60))) for i in range(12)]
    assert got(phrases.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string"), window=10, anchor=4)) == brute(rows, 10)


def test_query_matches_brute_force(spark):
    rows = [tuple(r) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").collect()]
    out = queries.QUERIES["op4_phrases"](spark, "/root/testdata/sf0.001").collect()
    want = {eval(x)[0]: eval(x) for x in brute(rows, 35)}  # noqa: S307
    assert len(out) == len(want)
    for r in out:
        w = want[r["doc_id"]]
        assert (r["n_words"], r["n_removed"], r["kept_sha256"]) == (w[1], w[2], hashlib.sha256(w[3].encode()).hexdigest())


def test_leftmost_least():
    v = np.random.default_rng(5).integers(0, 6, 200).astype(np.uint64)
    for width in (1, 2, 3, 7, 8, 24):
        p = phrases._argmin(v, width)
        assert len(p) == 200 - width + 1
        assert all(p[i] == i + int(np.argmin(v[i : i + width])) for i in range(len(p)))
