from __future__ import annotations

import random
import re

import numpy as np
import pyarrow as pa

from tests.llm.conftest import EDGES
from vellum.llm import decontam


def brute_lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        new = [0]
        for j, y in enumerate(b):
            new.append(row[j] + 1 if x == y else max(row[j + 1], new[j]))
        row = new
    return row[-1]


def test_lcs():
    rng = random.Random(1)
    for _ in range(300):
        a, b = ([rng.randint(0, 5) for _ in range(rng.randint(1, 90))] for _ in "ab")
        assert decontam.lcs(a, b) == brute_lcs(a, b)


def corpus(rng, n):
    vocabulary = [f"{a}{b}{c}" for a in "bdfgklmnprst" for b in "aeiou" for c in ("n", "r", "st", "lo", "mi")]
    weights = [1 / (i + 1) for i in range(len(vocabulary))]
    return [" ".join(rng.choices(vocabulary, weights, k=rng.randint(30, 300))) for _ in range(n)]


def test_exact_and_paraphrased_items_are_found_and_clean_texts_left(spark):
    rng = random.Random(2)
    texts = corpus(rng, 400)
    items = [f"{' '.join(rng.choices([f'{x}{y}' for x in 'abcdefghij' for y in 'klmnop'] + texts[0].split(), k=30))}. Answer {i} zeta{i} {rng.random()}" for i in range(20)]
    rows, planted = [], {}
    for i, t in enumerate(texts):
        w = t.split()
        if i % 10 == 0:
            j = i // 10 % 20
            passage = items[j].split()
            if i % 20:  # paraphrase: one word in six is another, one in ten is left out
                passage = [rng.choice(w) if rng.random() < 1 / 6 else x for x in passage if rng.random() > 0.1]
            at = rng.randint(0, len(w))
            w[at:at] = passage
            planted[i] = j
        elif i % 10 == 1:
            w[5:5] = items[i % 20].split()[3:9]  # a phrase of an item is no leak
        rows.append((i, " ".join(w)))
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    benchmark = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    out = {r["doc_id"]: r for r in decontam.leaks(docs, benchmark).collect()}
    assert {i for i, r in out.items() if r["contaminated"]} == set(planted)
    assert all(planted[i] in out[i]["items"] for i in planted)


def test_recall_on_the_tables_against_shared_runs_of_words(spark):
    sf = "/root/testdata/sf0.01"
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    items = {r["item_id"]: re.findall(r"[^\W_]+", r["text"].lower()) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()}
    runs: dict = {}
    for j, w in items.items():
        for i in range(len(w) - 4):
            runs.setdefault(tuple(w[i : i + 5]), set()).add(j)
    want = set()
    for i, t in docs.items():
        w = re.findall(r"[^\W_]+", t.lower())
        hits: dict = {}
        for k in range(len(w) - 4):
            for j in runs.get(tuple(w[k : k + 5]), ()):
                hits.setdefault(j, set()).add(tuple(w[k : k + 5]))
        want |= {(i, j) for j, h in hits.items() if len(h) >= 0.6 * (len(items[j]) - 4)}
    rows = decontam.leaks(spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/benchmark.parquet")).collect()
    got = {(r["doc_id"], j) for r in rows for j in r["items"]}
    assert want and len(want & got) >= 0.98 * len(want)
    assert not {i for i, _ in got} - {i for i, _ in want}


def test_edges(spark, edges, nothing):
    benchmark = spark.createDataFrame([(1, None), (2, ""), (3, "..."), (4, "one"), (5, "w0 w1 w2 w3 w4 w5 w6 w7 w8 w9 w10"), (5, "w0 w1 w2 w3 w4 w5 w6 w7 w8 w9 w10")], "item_id long, text string")
    out = decontam.leaks(edges, benchmark).collect()
    assert len(out) == len(EDGES) and {r["doc_id"] for r in out if 5 in r["items"]} == {10, 12}
    assert all(not r["contaminated"] for r in decontam.leaks(edges, benchmark.limit(0)).collect())
    assert decontam.leaks(nothing, benchmark).collect() == []
    assert decontam.drop_leaks(edges, benchmark).columns == edges.columns


def test_an_item_in_a_third_of_the_rows_is_found_in_all_of_them_and_others_too(spark):
    rng = random.Random(4)
    items = [" ".join(f"{rng.choice('bdfgk')}{rng.choice('aeiou')}{rng.randint(0, 400)}" for _ in range(30)) for _ in range(6)]
    hot = " ".join(rng.choices(corpus(rng, 1)[0].split(), k=10)) + " " + items[0]
    rows, planted = [], {}
    for i, t in enumerate(corpus(rng, 300)):
        w = t.split()
        if i % 3 == 0:
            w, planted[i] = hot.split(), 0
        elif i % 3 == 1:  # the same passage at any place of different texts
            at = rng.randint(0, len(w))
            w[at:at] = items[1].split()
            planted[i] = 1
        elif i % 15 == 2:
            planted[i] = i // 15 % 6
            w[9:9] = [rng.choice(w) if rng.random() < 1 / 6 else x for x in items[planted[i]].split()]
        rows.append((i, " ".join(w)))
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    out = {r["doc_id"]: r["items"] for r in decontam.leaks(docs, spark.createDataFrame(list(enumerate(items)), "item_id long, text string")).collect()}
    assert {i: x for i, x in out.items() if x} == {i: [j] for i, j in planted.items()}


def test_different_surroundings_are_counted_once_however_often_they_come():
    w = next(decontam._chunks(pa.array(["a hot b"] * 5000 + [f"{i} cold {i + 1}" for i in range(5000)])))
    for term, n in (("hot", 1), ("cold", 5000)):
        x = decontam.surroundings(w, (w.hash == decontam._hashes(term)[0]).nonzero()[0])
        assert len(x) == 5000 and len(set(x.tolist())) == n


def test_one_document_and_one_that_all_documents_hold(spark):
    item = "when the old lighthouse keeper counted nineteen lanterns along the harbour wall he wrote the number in a blue ledger. The answer is nineteen"
    benchmark = spark.createDataFrame([(1, item)], "item_id long, text string")
    alone = spark.createDataFrame([(5, item), (6, "two other words"), (7, None)], "doc_id long, text string")
    assert {r["doc_id"]: r["items"] for r in decontam.leaks(alone, benchmark).collect()} == {5: [1], 6: [], 7: []}
    rows = [(i, f"{t} {item} and {t}") for i, t in enumerate(corpus(random.Random(3), 60))]
    out = decontam.leaks(spark.createDataFrame(rows, "doc_id long, text string"), benchmark).collect()
    assert all(r["items"] == [1] for r in out) and len(out) == 60


def test_the_cosine_search_loses_nothing_that_the_subsequence_test_accepts(spark):
    """Against check() on every passage of every document and every item."""
    rng = random.Random(7)
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").orderBy("doc_id").collect()]
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet("/root/testdata/sf0.001/benchmark.parquet").collect()]
    for k in range(60):  # exact, partial and paraphrased plants
        w = rng.choice(items)[1].split()
        if k % 3 == 1:
            w = w[: max(4, 3 * len(w) // 4)]
        elif k % 3 == 2:
            w = [rng.choice(["thing", "other", "some"]) if rng.random() < 0.25 else x for x in w if rng.random() > 0.08]
        host = rng.choice(rows)[1].split()[:200]
        at = rng.randint(0, len(host))
        rows.append((10_000 + k, " ".join(host[:at] + w + host[at:])))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    got = {(r["doc_id"], j) for r in decontam.leaks(docs, benchmark).collect() for j in r["items"]}
    blocks = decontam.prepare(docs, decontam.sampled(docs, "doc_id", "text"), next(decontam.groups(benchmark, "item_id", "text"))[0], "text")
    want = set()
    for i, t in rows:
        w = next(decontam._chunks(pa.array([t])))
        for block in blocks:
            for j, terms in enumerate(block.terms):
                if not set(terms.tolist()) & set(w.hash.tolist()):
                    continue
                for stride in range(-(-len(w) // decontam.STRIDE)):
                    found = decontam.check(w, block, 0, stride, j)
                    if found and (found[2] >= decontam.MOST or found[3] >= decontam.ANSWER):
                        want.add((i, block.ids[j]))
                        break
    assert got <= want and len(want) >= 50 and len(got) >= 0.97 * len(want)
    assert {i for i, _ in want if i >= 10_000} == {i for i, _ in got if i >= 10_000}


def test_groups_of_blocks_give_what_one_group_gives(spark, monkeypatch):
    sf = "/root/testdata/sf0.001"
    docs, benchmark = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/benchmark.parquet")
    whole = sorted((r["doc_id"], r["items"]) for r in decontam.leaks(docs, benchmark).collect())
    monkeypatch.setattr(decontam, "BLOCK", 8)
    monkeypatch.setattr(decontam, "GROUP_TERMS", 400)
    monkeypatch.setattr(decontam, "SLICE_BYTES", 4000)
    found = list(decontam.groups(benchmark, "item_id", "text"))
    assert len(found) > 2 and [m for _, m in found] == [True] * (len(found) - 1) + [False]
    assert sorted((r["doc_id"], r["items"]) for r in decontam.leaks(docs, benchmark).collect()) == whole
    kept = {r["doc_id"] for r in decontam.drop_leaks(docs, benchmark).collect()}
    assert kept == {i for i, x in whole if not x}


def test_latent_spaces_are_fitted_on_every_passage_of_every_document(spark, monkeypatch):
    """Against all passages' rows multiplied out; more documents than the 256 that were once chosen, copies counted as often as they come."""
    rng = random.Random(9)
    texts = [t for t in corpus(rng, 320) for _ in range(rng.choice([1, 1, 3]))] + [None, "", "..."]
    items = [" ".join(rng.sample(texts[i].split(), k=20)) for i in range(12)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(5)
    benchmark = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    monkeypatch.setattr(decontam, "PANEL", 500)
    monkeypatch.setattr(decontam, "BLOCK", 7)
    monkeypatch.setattr(decontam, "RANK", 9)
    monkeypatch.setattr(decontam, "OVERSAMPLE", 1000)  # the subspace is the whole space, so that the leading vectors are exact
    for table, at_once in ((1 << 24, 1 << 21), (0, 1000)):  # counted in a table; sorted, and given out many times
        monkeypatch.setattr(decontam, "TABLE", table)
        monkeypatch.setattr(decontam, "SORTED", at_once)
        found = decontam.prepare(docs, decontam.sampled(docs, "doc_id", "text"), next(decontam.groups(benchmark, "item_id", "text"))[0], "text")
        assert len(found) == 2
        for block in found:
            n, gram, own = len(block.idf), 0, 0
            for t in texts:
                w = next(decontam._chunks(pa.array([t])))
                for a in range(0, len(w), decontam.PASSAGE):
                    row = np.bincount(block.places(w.hash[a : a + decontam.PASSAGE])[1], minlength=n) * block.idf
                    gram = gram + np.outer(row, row)
            rows = [np.bincount(block.places(t)[1], minlength=n) for t in block.terms]
            for r in rows:
                own = own + np.outer(r * block.idf, r * block.idf) / ((r * block.idf) ** 2).sum()
            lead = np.linalg.eigh(gram / np.trace(gram) + own / np.trace(own))[1][:, -decontam.RANK :]
            latent = block.idf[:, None] * lead
            sizes = [np.sqrt((block.idf[block.places(t)[1]] ** 2).sum()) for t in block.terms]
            want = latent @ np.stack([r @ latent / s for r, s in zip(rows, sizes, strict=True)]).T
            assert np.allclose(block.near, want, atol=1e-3 * np.abs(want).max())
