from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from vellum.operators import decisions as dc
from vellum.operators.trigrams import guess, profiles
from vellum.sources import files
from vellum.streaming import updates as up

UPDATES = "doc_id int, page_index int, seq int, state string, at timestamp"


def test_files_and_quarantine(spark, tmp_path):
    for name, data in (("a.pdf", b"%PDF-1.7 x"), ("b.PDF", b"nothing"), ("c.txt", b"%PDF-")):
        (tmp_path / name).write_bytes(data)
    good, bad = files.quarantine(files.read_files(spark, str(tmp_path)))
    assert [r["name"] for r in good.collect()] == ["a.pdf"] and [(r["name"], r["error"]) for r in bad.collect()] == [("b.PDF", "not-pdf")]
    large = files.read_files(spark, str(tmp_path), most=8).filter("name = 'a.pdf'").first()
    assert large["error"] == "too-large" and large["content"] is None


def test_a_document_that_fails_does_not_stop_the_others(spark):
    docs = spark.createDataFrame([("a", b"1"), ("b", b"x")], "doc_id string, content binary")
    out = files.parse_pages(docs, lambda content: [{"n": int(content)}], "n long").collect()
    assert {(r["doc_id"], r["page"] and r["page"]["n"], bool(r["error"])) for r in out} == {("a", 1, False), ("b", None, True)}


def test_nothing_is_written_when_there_are_leaks(spark, tmp_path):
    with pytest.raises(ValueError):
        files.write_checked(spark.range(3), spark.range(1), str(tmp_path / "out"))
    assert not (tmp_path / "out").exists()
    files.write_checked(spark.range(3), spark.range(0), str(tmp_path / "out"))
    assert spark.read.parquet(str(tmp_path / "out")).count() == 3


def log(spark):
    rows = [(d, p, s, ("ready", "error", "ocr")[(d + p + s) % 3], None) for d in range(5) for p in range(3) for s in range(7)]
    return spark.createDataFrame(rows, UPDATES).withColumn("at", F.timestamp_seconds(F.col("seq") * 60))


def test_the_stream_ends_where_the_batch_does(spark, tmp_path):
    rows = log(spark)
    rows.repartition(4).write.parquet(str(tmp_path / "in"))
    stream = up.current_pages(up.read_updates(spark, str(tmp_path / "in"), UPDATES, files=1), ["doc_id", "page_index"])
    q = stream.writeStream.outputMode("complete").format("memory").queryName("pages_now").start()
    q.processAllAvailable()
    q.stop()
    want = dc.latest(rows, ["doc_id", "page_index"])
    assert sorted(map(tuple, spark.table("pages_now").collect())) == sorted(map(tuple, want.collect()))


def test_batches_are_handed_on_with_their_numbers(spark, tmp_path):
    log(spark).repartition(2).write.parquet(str(tmp_path / "in"))
    seen = []
    q = up.upsert_into(up.read_updates(spark, str(tmp_path / "in"), UPDATES, files=1), str(tmp_path / "state"), lambda df, n: seen.append((n, df.count())), ["doc_id", "page_index"])
    q.processAllAvailable()
    q.stop()
    assert [n for n, _ in seen] == [0, 1] and all(c <= 15 for _, c in seen)


def test_counts_over_time(spark, tmp_path):
    log(spark).write.parquet(str(tmp_path / "in"))
    q = up.counts_over_time(up.read_updates(spark, str(tmp_path / "in"), UPDATES), "at", "1 minute", "2 minutes").writeStream.outputMode("append").format("memory").queryName("state_counts").start()
    q.processAllAvailable()
    q.stop()
    assert spark.table("state_counts").agg(F.sum("count")).first()[0] == 60  # the last window is still open


def test_trigrams(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    long = docs.filter("n_chars > 500")
    out = guess(long.select("doc_id", "text"), profiles(docs), ["doc_id"]).join(docs, "doc_id").selectExpr("avg(cast(language = lang AS int))").first()[0]
    assert out > 0.9
    short = spark.createDataFrame([(1, "short"), (2, None)], "doc_id long, text string")
    assert {(r["language"], r["score"]) for r in guess(short, profiles(docs), ["doc_id"]).collect()} == {("und", 0.0)}
