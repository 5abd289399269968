from __future__ import annotations

import numpy as np
import xxhash
from pyspark.sql import functions as F

from tests.llm.conftest import lowered, words
from vellum.llm import simhash
from vellum.llm.shared import components


def brute_fingerprint(text, k=4):
    w = words(lowered(text))
    shingles = [" ".join(w[i : i + k]) for i in range(len(w) - k + 1)] or ([" ".join(w)] if w else [])
    count = [0] * 64
    for s in shingles:
        h = xxhash.xxh64_intdigest(s.encode(), 42)
        for b in range(64):
            count[b] += h >> b & 1
    return sum((2 * c > len(shingles)) << b for b, c in enumerate(count))


def brute(rows):
    prints = [(i, brute_fingerprint(t)) for i, t in rows]
    group = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            if (prints[i][1] ^ prints[j][1]).bit_count() <= 4 and group[i] != group[j]:
                old, new = group[i], group[j]
                group = [new if g == old else g for g in group]
    low = {g: min((prints[i][0] for i in range(len(rows)) if group[i] == g and prints[i][0] is not None), default=None) for g in set(group)}
    return sorted(((i, f"{f:016x}", low[group[n]]) for n, (i, f) in enumerate(prints)), key=str)


def test_matches_brute_force(spark, edges):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    docs = edges.select((-F.col("doc_id")).alias("doc_id"), "text").unionByName(docs)
    got = simhash.near_duplicates(docs.withColumn("fp", F.lit("x")).withColumn("component_id", F.lit(0)))
    assert sorted(map(tuple, got.collect()), key=str) == brute([tuple(r) for r in docs.collect()])


def test_large_groups_are_cut_into_tiles(spark, monkeypatch):
    rng = np.random.default_rng(3)
    seeds = rng.integers(0, 2**63, 40, dtype=np.uint64)
    fps = {int(s) for s in seeds}
    for s in seeds[:20]:
        for _ in range(6):
            fps.add(int(s) ^ sum(1 << int(b) for b in rng.choice(64, 3, replace=False)))
    rows = spark.createDataFrame([(x - 2**64 if x >> 63 else x,) for x in fps], "fp long")

    def classes():
        return sorted(map(tuple, components(simhash.near_links(rows)).collect()))

    whole = classes()
    monkeypatch.setattr(simhash, "TILE", 4)
    assert classes() == whole
    roots = dict(whole)
    signed = [r[0] for r in rows.collect()]
    for a in signed:
        for b in signed:
            if ((a ^ b) % 2**64).bit_count() <= 4:
                assert roots.get(a, a) == roots.get(b, b)


def test_parts_grow_with_the_number_of_fingerprints():
    for n, parts in ((10, 5), (10**7, 6), (10**10, 7), (10**13, 8)):
        masks = simhash._masks(n, 4)
        assert len(masks) == {5: 5, 6: 15, 7: 35, 8: 70}[parts]
        x = 0b1011 << 20 | 1  # any four bits leave some choice of parts untouched
        assert any(not m & x for m in masks)


def test_components_of_a_long_chain(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(200)], "a long, b long")
    assert {r["root"] for r in components(edges).collect()} == {0}


def test_empty(nothing):
    assert simhash.near_duplicates(nothing).collect() == []
