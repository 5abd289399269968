from __future__ import annotations

import re

import corpus_pipeline
from tests.llm.test_secret_scan import brute as secrets
from tests.llm.test_simhash import brute_fingerprint
from vellum.llm import decontam, mixing, pipeline_stages, quality, simhash
from vellum.llm.shared import settle

SF = "/root/testdata/sf0.01"
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def test_each_stage_decides_on_all_that_the_one_before_kept(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    assert [len(corpus_pipeline.STAGES), [n for n, _ in corpus_pipeline.STAGES][0]] == [5, "quality rules"]
    kept = {}
    given = {}
    for name, stage in corpus_pipeline.STAGES:
        given[name] = docs
        docs = settle(stage(spark, docs, SF))
        assert docs.columns[:5] == COLUMNS
        kept[name] = {r["doc_id"]: r for r in docs.collect()}
    good = {r["doc_id"] for r in quality.score_quality(given["quality rules"]).filter("kept").collect()}
    assert set(kept["quality rules"]) == good
    groups = simhash.near_duplicates(given["simhash near-dedup"]).collect()
    assert set(kept["simhash near-dedup"]) == {r["component_id"] for r in groups}
    prints = [brute_fingerprint(r["text"]) for r in kept["simhash near-dedup"].values()]
    assert all((a ^ b).bit_count() > 4 for i, a in enumerate(prints) for b in prints[:i])
    leaks = decontam.leaks(given["benchmark decontamination"], spark.read.parquet(f"{SF}/benchmark.parquet")).filter("contaminated").collect()
    assert set(kept["benchmark decontamination"]) == set(kept["simhash near-dedup"]) - {r["doc_id"] for r in leaks} and leaks
    scanned = kept["secret scans"]
    assert set(scanned) == set(kept["benchmark decontamination"])
    for i, r in scanned.items():
        before = kept["benchmark decontamination"][i]["text"]
        assert not secrets(r["text"]) and r["n_chars"] == len(r["text"])
        assert (r["text"] == before) == (not secrets(before)) or "[SECRET]" in r["text"]
        assert re.sub(r"\s", "", r["text"])
    mixed = mixing.mix(given["mixing sources to target weights"]).collect()
    assert {i: r["copies"] for i, r in kept["mixing sources to target weights"].items()} == {r["doc_id"]: r["copies"] for r in mixed if r["copies"]}


def test_edges(spark, edges, nothing):
    for stage in (pipeline_stages.quality_rules, pipeline_stages.near_dedup, pipeline_stages.decontamination, pipeline_stages.secret_scans):
        assert stage(spark, edges, SF).columns == edges.columns
        assert stage(spark, nothing, SF).collect() == []
    assert pipeline_stages.mixing_weights(spark, nothing, SF).collect() == []
    one = pipeline_stages.near_dedup(spark, edges, SF).select("doc_id", "text").collect()
    prints = [brute_fingerprint(r["text"]) for r in one]
    assert len(prints) == len(set(prints))  # of repeated rows, too, one stays


def test_one_of_each_group_stays_whatever_the_ids(spark):
    text = " ".join(f"w{i}" for i in range(90))
    rows = [(None, text), (None, text), (7, text), (7, text), (7, text + " x"), (None, "alone here"), (None, "alone here"), (9, "nine"), (9, "nine"), (9, "other nine"), (3, None), (3, None)]
    docs = spark.createDataFrame([(i, t, "clash") for i, t in rows], "doc_id long, text string, key string").repartition(3)
    out = sorted((str(r["doc_id"]), r["text"] or "") for r in pipeline_stages.near_dedup(spark, docs, SF).collect())
    near = [r for r in out if r[1].startswith("w0 ")]
    assert len(near) == 1 and near[0][0] == "7" and out == sorted([near[0], ("None", "alone here"), ("9", "nine"), ("9", "other nine"), ("3", "")])


def test_the_stages_learn_from_all_rows_that_they_are_given(spark, monkeypatch):
    """More rows than were once chosen for the models of secrets (2,000) and the latent spaces (256)."""
    rows = [(i, f"only{i:06d}once " + " ".join(f"w{i * 7 % 50 + k}" for k in range(40)), "en", "src0", 9) for i in range(2300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(4)
    seen, train, fit = {}, pipeline_stages.secret_scan.train, decontam.fit
    monkeypatch.setattr(pipeline_stages.secret_scan, "train", lambda samples: [train(samples), seen.update(words={r[0] for r in samples.filter("kind = 'word'").collect()})][0])
    monkeypatch.setattr(decontam, "fit", lambda counted, block: [fit(counted, block), seen.update(block=block, rows=counted.collect())][0])
    assert pipeline_stages.secret_scans(spark, docs, SF).count() == 2300
    assert {r[1].split()[0] for r in rows} <= seen["words"]
    item = " ".join(f"w{k}" for k in range(3, 33))
    benchmark = spark.createDataFrame([(1, item + " zeta")], "item_id long, text string")
    decontam.drop_leaks(docs, benchmark).count()
    own = {int(a) // len(seen["block"].idf): int(n) for r in seen["rows"] for a, n in zip(*decontam._numbers(r["at"], r["n"]), strict=True) if int(a) % (len(seen["block"].idf) + 1) == 0 and r["panel"] == 0}
    want = {t: sum(f"w{t}" in x[1].split() for x in rows) for t in range(3, 33)}
    assert sorted(own.values()) == sorted(n for n in want.values() if n)
