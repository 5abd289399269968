"""Files and tables in and out. Parsing and writing the document format itself is left to functions that the caller gives."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator
from pathlib import Path

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from vellum.functions import text as tx
from vellum.operators.verify import merge_reports, require_clean

#: Fixed value: the largest file that is read.
MOST_BYTES = 512 << 20


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spread(spark.read.parquet(f"{folder}/{name}.parquet"))


def spread(df: DataFrame) -> DataFrame:
    """df, dealt out anew if it comes in fewer partitions than there are cores, as a file of one row group does."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= cores else df.repartition(cores)


def read_files(spark: SparkSession, folder: str, most: int = MOST_BYTES) -> DataFrame:
    """(doc_id, path, name, content, error): files whose names end in .pdf, in any case. What is too large or lacks the magic
    bytes has its error told and no content."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder)
    files = files.filter(tx.is_pdf_name(F.col("path")))
    error = F.when(F.col("length") > most, "too-large").when(F.substring(F.col("content"), 1, 4) != F.lit(b"%PDF"), "not-pdf")
    kept = F.when(error.isNull(), F.col("content"))
    return files.select(F.sha2("content", 256).alias("doc_id"), "path", tx.basename(F.col("path")).alias("name"), kept.alias("content"), error.alias("error"))


def load_error(kind: Column, message: Column, wrong_code: Column, password: Column) -> Column:
    """The class of an error on opening a document."""
    return (
        F.when((kind == "password") & (wrong_code | password), "password-incorrect")
        .when(kind == "password", "password-required")
        .when(kind == "invalid", "corrupt")
        .when(F.regexp_like(message, F.lit("(?i)encrypt")), "unsupported")
        .otherwise("unknown")
    )


def quarantine(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(good rows, rows with an error)"""
    return docs.filter("error IS NULL"), docs.filter("error IS NOT NULL")


def parse_pages(docs: DataFrame, parse: Callable[[bytes], list[dict]], schema: str) -> DataFrame:
    """The rows that parse makes of each document's bytes, with doc_id; a document that fails gives one row with its error."""

    out = docs.sparkSession.createDataFrame([], f"doc_id string, error string, page struct<{schema}>").schema
    arrow = to_arrow_schema(out)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for doc, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                try:
                    rows += [{"doc_id": doc, "error": None, "page": p} for p in parse(content)]
                except Exception as e:  # one bad document must not stop the others
                    rows.append({"doc_id": doc, "error": str(e) or type(e).__name__, "page": None})
            if rows:
                yield pa.RecordBatch.from_pylist(rows, schema=arrow)

    return docs.select("doc_id", "content").mapInArrow(run, out)


def write_file(path: str, content: bytes) -> None:
    """Writes a document's bytes where they will stand, whole or not at all: a file beside it is renamed once it is complete."""
    target = Path(path)
    if target.suffix.lower() != ".pdf":
        raise ValueError("the name must end in .pdf")
    if not target.parent.is_dir():
        raise ValueError("the folder isn't there")
    if not content.startswith(b"%PDF-"):
        raise ValueError("not a document of this format")
    beside = target.with_name(f".{target.name}.{uuid.uuid4().hex}")
    try:
        beside.write_bytes(content)
        beside.replace(target)
    finally:
        beside.unlink(missing_ok=True)


def export(docs: DataFrame, redact: Callable[[DataFrame], DataFrame], checks: list[Callable[[DataFrame], DataFrame]], path: str) -> DataFrame:
    """Redacts, lets every check look at what came out, and writes it unless one of them finds a leak. checks give reports (doc_id,
    engine, checked, n_leaks); the merged report is returned. What is checked is what is written: it is settled in between."""
    out = redact(docs)
    kept = f"{path}.checking-{uuid.uuid4().hex}"
    spark = docs.sparkSession
    out.write.parquet(kept)
    out = spark.read.schema(out.schema).parquet(kept)
    try:
        report = merge_reports([check(out) for check in checks])
        told = [r.asDict() for r in report.filter("NOT ok").limit(20).collect()]
        if told:
            raise ValueError(f"validation failed: redacted content can still be extracted from {[r['doc_id'] for r in told]}")
        out.write.mode("error").parquet(path)
        final = spark.read.schema(out.schema).parquet(path)
        return merge_reports([check(final) for check in checks])
    finally:
        jvm = spark.sparkContext._jvm
        place = jvm.org.apache.hadoop.fs.Path(kept)
        place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(place, True)


def write_checked(out: DataFrame, leaks: DataFrame, path: str) -> None:
    """Writes out as a table, unless there are leaks: then it raises and nothing is written."""
    require_clean(leaks)
    out.write.mode("error").parquet(path)
