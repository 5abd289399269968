from __future__ import annotations

import zlib

import numpy as np

from tests.llm.conftest import EDGES
from vellum.llm import queries, toxicity


def test_held_out_accuracy(spark):
    rows = queries.QUERIES["op2_toxicity"](spark, "/root/testdata/sf0.1").toPandas()
    assert (rows.held_out == [zlib.crc32(str(i).encode()) % 5 == 0 for i in rows.doc_id]).all()
    assert ((rows.score >= 0.5) == (rows.predicted == 1)).all() and rows.score.between(0, 1).all()
    labels = spark.read.parquet("/root/testdata/sf0.1/labels.parquet").toPandas()
    both = rows[rows.held_out].merge(labels, on="doc_id")
    assert (both.predicted == both.toxic).mean() > 0.96
    assert both[both.toxic == 0].predicted.mean() < 0.01


def test_the_machine_learns_what_only_pairs_say():
    rng = np.random.default_rng(8)
    x = rng.random((3000, 3)) < 0.5
    label = (x[:, 0] & x[:, 1]).astype(float)  # an insult or a group alone is fine
    doc, at = np.nonzero(x)
    m = toxicity.train(np.arange(3), doc, at, label, rounds=600)
    p = m.logits(doc, at, len(label)) > 0
    assert (p == label).mean() == 1.0


def test_logits_match_brute_force():
    rng = np.random.default_rng(3)
    m = toxicity.Machine(np.arange(40), 0.7, rng.normal(size=40), rng.normal(size=(40, 4)))
    texts = [np.flatnonzero(rng.random(40) < 0.3) for _ in range(50)] + [np.zeros(0, int)]
    doc = np.repeat(np.arange(51), [len(t) for t in texts])
    got = m.logits(doc, np.concatenate(texts), 51)
    for t, y in zip(texts, got, strict=True):
        want = 0.7 + sum(m.weight[i] for i in t) + sum(m.factor[i] @ m.factor[j] for a, i in enumerate(t) for j in t[a + 1 :])
        assert abs(y - want) < 1e-9


def test_a_term_that_matters_only_beside_another_is_chosen(spark, monkeypatch):
    monkeypatch.setattr(toxicity, "TERMS", 6)
    monkeypatch.setattr(toxicity, "PAIRED", 2)
    monkeypatch.setattr(toxicity, "LEAD", 2)
    rng = np.random.default_rng(2)
    rows, labels = [], []
    for i in range(1200):
        insult, joke = rng.random(2) < 0.5
        noise = [f"w{'abcdefghij'[j // 10]}{'abcdefghij'[j % 10]}" for j in rng.choice(100, 6, replace=False)]
        rows.append((i, " ".join([*noise, *(["insult"] if insult else []), *(["joke"] if joke else [])])))
        labels.append((i, int(insult != joke) if insult else int(rng.random() < 0.25)))  # with a joke an insult is meant well
    machine = toxicity.learn(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int"))
    scores = {r["doc_id"]: r["score"] for r in toxicity.score(spark.createDataFrame([(0, "insult"), (1, "insult joke"), (2, "joke")], "doc_id long, text string"), machine).collect()}
    assert scores[0] > 0.6 > 0.5 > scores[1] and scores[2] < 0.5


def test_edges(spark, edges, nothing):
    labels = spark.createDataFrame([(4, 1), (4, 0), (None, 1), (8, 0), (99, 1), (10, None)], "doc_id long, toxic int")
    machine = toxicity.learn(edges, labels)
    scores = toxicity.score(edges, machine).collect()
    assert len(scores) == len(EDGES) and all(0 <= r["score"] <= 1 for r in scores)
    untaught = toxicity.learn(nothing, labels.limit(0))
    assert {round(r["score"], 9) for r in toxicity.score(edges, untaught).collect()} == {toxicity.PRIOR}
    assert toxicity.score(nothing, machine).collect() == []
