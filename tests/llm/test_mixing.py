from __future__ import annotations

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.llm.conftest import EDGES, words
from vellum.llm import mixing, queries


def brute_rake(table, targets, rounds=2000):
    """Plain iterative proportional fitting of a three-way array."""
    x = table.astype(float).copy()
    for _ in range(rounds):
        for axis, want in enumerate(targets):
            others = tuple(i for i in range(3) if i != axis)
            sums = x.sum(others)
            f = np.divide(want, sums, out=np.zeros_like(sums), where=sums > 0)
            x *= f.reshape([-1 if i == axis else 1 for i in range(3)])
    return x


def table_and_targets():
    rng = np.random.default_rng(4)
    table = rng.integers(1, 1000, (5, 3, 4)).astype(float)
    table[0, 1, 2] = 0
    names = [[f"{p}{i}" for i in range(n)] for p, n in zip("slt", table.shape, strict=True)]
    want = [rng.dirichlet(np.ones(n) * 5) for n in table.shape]
    cells = [(names[0][a], names[1][b], names[2][c], float(table[a, b, c])) for a, b, c in np.ndindex(*table.shape) if table[a, b, c]]
    return table, names, want, cells, [dict(zip(n, map(float, w), strict=True)) for n, w in zip(names, want, strict=True)]


CELLS = "source string, lang string, topic string, tokens double"


@pytest.mark.parametrize("few", [1000, 2])
def test_raking_matches_brute_force(spark, few, monkeypatch):
    """On the driver, and by joins."""
    monkeypatch.setattr(mixing, "FEW_CELLS", few)
    table, names, want, cells, told = table_and_targets()
    *factors, off = mixing.rake(spark.createDataFrame(cells, CELLS), *told, close=1e-10 if few > 2 else 1e-5)
    a, b, c = (dict(map(tuple, f.collect())) for f in factors)
    expect = brute_rake(table, want)
    for i, j, k in np.ndindex(*table.shape):
        got = table[i, j, k] * a[names[0][i]] * b[names[1][j]] * c[names[2][k]]
        assert abs(got - expect[i, j, k]) < (1e-6 if few > 2 else 1e-4)
    assert off < 1e-4


def test_targets_that_cannot_be_met_are_refused(spark):
    cells = spark.createDataFrame([("a", "en", "x", 10.0), ("b", "fr", "x", 10.0)], CELLS)
    with pytest.raises(ValueError, match="no tokens for the sources"):
        mixing.rake(cells, {"a": 0.5, "c": 0.5})
    with pytest.raises(ValueError, match="contradict"):
        mixing.rake(cells, {"a": 0.9, "b": 0.1}, {"en": 0.1, "fr": 0.9})
    odd = spark.createDataFrame([("a", "en", "x", 1000.0), ("b", "fr", "x", 10.0)], CELLS)
    assert mixing.rake(odd)[3] > mixing.CLOSE_ENOUGH  # targets from the data are fitted as well as can be, and told


def test_topics_follow_content_words(spark):
    rng = random.Random(3)
    themes = [[f"{a}{b}{c}ations" for a in x for b in "aeiou" for c in "nrstl"] for x in ("bd", "fg", "kp")]
    common = ["the", "of", "a", "with", "for", "and"]
    rows = [(i, " ".join(rng.choice(themes[i % 3]) if rng.random() < 0.4 else rng.choice(common) for _ in range(150))) for i in range(300)] + [(900, ""), (901, None)]
    out = {r["doc_id"]: r["topic"] for r in mixing.mix(spark.createDataFrame([(*r, "en", f"s{r[0] % 4}") for r in rows], "doc_id long, text string, lang string, source string")).collect()}
    assert out[900] == out[901] == ""
    by_topic = {}
    for i in range(300):
        by_topic.setdefault(out[i], []).append(i % 3)
    assert len(by_topic) >= 3 and sum(max(x.count(k) for k in range(3)) for x in by_topic.values()) > 290


def test_bins_are_counted(spark):
    row = spark.createDataFrame([("Mountains valleys mountains, été internationalement",)], "t string").select(mixing.content_bins(F.col("t")).alias("b")).first()
    assert sum(row["b"]) == 3 and max(row["b"]) >= 2


def test_query_meets_its_targets(spark):
    rows = queries.QUERIES["op6_mixing"](spark, "/root/testdata/sf0.01").toPandas()
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").toPandas()
    assert sorted(rows.doc_id) == sorted(docs.doc_id)
    count = dict(zip(docs.doc_id, (len(words(t)) for t in docs.text), strict=True))
    assert all(count[i] == n for i, n in zip(rows.doc_id, rows.n_tokens, strict=True))
    share = rows.rate * rows.n_tokens / rows.n_tokens.sum() / 0.5
    for column, power in (("source", mixing.SOURCE_POWER), ("lang", mixing.LANG_POWER), ("topic", mixing.TOPIC_POWER)):
        want = rows.groupby(column).n_tokens.sum() ** power
        got = share.groupby(rows[column]).sum()
        assert np.allclose(got, want / want.sum(), atol=1e-5)
    assert ((rows.copies == np.floor(rows.rate)) | (rows.copies == np.ceil(rows.rate))).all()
    assert abs((rows.copies * rows.n_tokens).sum() / rows.n_tokens.sum() - 0.5) < 0.06


def test_edges(edges, nothing):
    odd = edges.withColumns({"lang": F.when(F.col("doc_id") > 5, F.col("lang")), "source": F.lit(None).cast("string"), "rate": F.lit("taken")})
    out = mixing.mix(odd)
    assert out.count() == len(EDGES) and {"rate", "rate_", "copies"} <= set(out.columns)
    tied = out.filter("doc_id = 4").select("copies").distinct().count()
    assert tied == 1
    assert mixing.mix(nothing).collect() == []
