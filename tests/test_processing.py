"""Recognition, page and document states, kept files and exports."""

from __future__ import annotations

import threading
import time

import pytest
from pyspark.sql import functions as F

from vellum.operators import ocr
from vellum.operators import processing as pr
from vellum.sources import files


class Engine(ocr.OcrEngine):
    id = "letters"

    def recognize(self, image):
        if image == b"bad":
            raise ValueError("unreadable")
        edge = {"x0": 0.0, "y0": 0.0, "x1": 9.0, "y1": 9.0}
        line = lambda t: {"text": t, "bbox": edge, "baseline": None, "confidence": 80.0, "words": [{"text": w, "bbox": edge, "confidence": 50.0} for w in t.split("_")] if "_" in t else []}
        return [{"paragraphs": [{"lines": [line(t) for t in part.split(",")]}]} for part in image.decode().split("|")]


def test_an_engine_is_run_and_its_failures_are_told(spark):
    pages = spark.createDataFrame([(1, 0, bytearray(b"a_b,c|d_ ")), (1, 1, bytearray(b"bad"))], "doc_id int, page_index int, image binary")
    out = ocr.recognise(pages, Engine, ["doc_id", "page_index"])
    assert {(r["page_index"], r["error"]) for r in out.collect()} == {(0, None), (1, "unreadable")}
    lines = ocr.flatten(out, ["doc_id", "page_index"])
    assert [(r["line_no"], r["text"], r["confidence"], len(r["words"])) for r in lines.orderBy("line_no").collect()] == [(0, "a_b", 0.8, 2), (1, "c", 0.8, 0), (2, "d_ ", 0.8, 2)]
    items = ocr.word_items(lines, ["doc_id", "page_index"]).orderBy("line_no", "item_index").collect()
    assert [(r["line_no"], r["item_index"], r["text"], r["confidence"]) for r in items] == [(0, 0, "a", 0.5), (0, 1, "b", 0.5), (1, 0, "c", 0.8), (2, 0, "d", 0.5)]


def test_a_page_needs_recognition_if_it_has_an_image_and_little_text(spark):
    rows = spark.createDataFrame([(True, ["x", "paintImageXObject"]), (True, ["x"]), (False, ["paintImageXObject"]), (True, None)], "little boolean, ops array<string>")
    assert [r[0] for r in rows.select(ocr.needs_ocr(F.col("little"), F.col("ops"))).collect()] == [True, False, False, False]


def test_page_states(spark):
    rows = spark.createDataFrame([(None, None, True, True, None), (None, None, True, True, "blurred"), (None, None, True, False, None), ("torn", None, True, True, None), (None, "lost", False, True, None)], "a string, b string, scanned boolean, enabled boolean, c string")
    states = [r[0] for r in rows.select(pr.page_state(*map(F.col, ("a", "b", "scanned", "enabled", "c")))).collect()]
    assert [(s["state"], s["ocr"], s["ocr_error"], s["error"]) for s in states] == [("ready", True, None, None), ("ready", False, "blurred", None), ("ready", False, None, None), ("error", False, None, "torn"), ("error", False, None, "lost")]


def test_counts_are_observed_as_numbers(spark):
    rows, seen = pr.observed(spark.range(10), "ten", n=F.count("*"), most=F.max("id"))
    rows.collect()
    assert seen() == {"n": 10.0, "most": 9.0}


def test_jobs_can_be_cancelled(spark):
    slow = F.udf(lambda x: time.sleep(30) or x, "long")
    with pr.cancellable(spark) as stop:
        threading.Timer(3, stop).start()
        begin = time.time()
        with pytest.raises(Exception, match="(?i)cancel"):
            spark.range(1).select(slow("id")).collect()
        assert time.time() - begin < 25
    assert spark.range(3).count() == 3


def test_files_are_written_whole_or_not_at_all(tmp_path):
    files.write_file(str(tmp_path / "a.PDF"), b"%PDF-1.7 x")
    assert [p.name for p in tmp_path.iterdir()] == ["a.PDF"]
    for name, content in (("a.txt", b"%PDF-1"), ("no/a.pdf", b"%PDF-1"), ("b.pdf", b"PK")):
        with pytest.raises(ValueError):
            files.write_file(str(tmp_path / name), content)
    assert [p.name for p in tmp_path.iterdir()] == ["a.PDF"]


def test_an_export_is_written_only_if_every_check_is_clean(spark, tmp_path):
    docs = spark.createDataFrame([(1, "a secret"), (2, "plain")], "doc_id int, text string")
    hide = lambda df: df.withColumn("text", F.replace("text", F.lit("secret"), F.lit("")))
    check = lambda engine: lambda df: df.select("doc_id", F.lit(engine).alias("engine"), F.lit(1).alias("checked"), F.contains("text", F.lit("secret")).cast("long").alias("n_leaks"))
    report = files.export(docs, hide, [check("a"), check("b")], str(tmp_path / "out")).orderBy("doc_id").collect()
    assert [(r["doc_id"], r["ok"], r["engines"]) for r in report] == [(1, True, ["a", "b"]), (2, True, ["a", "b"])]
    with pytest.raises(ValueError, match=r"can still be extracted from \[1\]"):
        files.export(docs, lambda df: df, [check("a")], str(tmp_path / "leaky"))
    assert sorted(p.name for p in tmp_path.iterdir()) == ["out"]


def test_what_is_kept_is_not_done_again(spark):
    wanted = spark.createDataFrame([("h", True), ("h", False), ("g", True)], "hash string, ocr_enabled boolean")
    assert sorted(map(tuple, pr.to_analyse(wanted, wanted.limit(1)).collect())) == [("g", True), ("h", False)]
    again = pr.restored(spark.createDataFrame([("h", "k", "ignored"), ("g", "k", "x")], "hash string, key string, override string"), "h").collect()
    assert [(r["key"], r["override"], r["can_undo"], r["can_redo"]) for r in again] == [("k", "ignored", False, False)]
