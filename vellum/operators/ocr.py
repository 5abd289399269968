"""Recognised text: engines as plug-ins, their nested results as lines, words as items, and which pages need them."""

from __future__ import annotations

from abc import ABC, abstractmethod
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from vellum.functions import text as tx

# Drawing operations that paint a raster image.
IMAGE_OPS = ["paintImageXObject", "paintInlineImageXObject", "paintImageXObjectRepeat"]
BOX = "struct<x0:double,y0:double,x1:double,y1:double>"
WORD = f"struct<text:string,bbox:{BOX},confidence:double>"
LINE = f"struct<text:string,bbox:{BOX},baseline:{BOX},confidence:double,words:array<{WORD}>>"
BLOCKS = f"array<struct<paragraphs:array<struct<lines:array<{LINE}>>>>>"


class OcrEngine(ABC):
    """Recognises an image: a list of blocks of paragraphs of lines of words, confidences in hundredths. One is made for each
    task and disposed of when the task ends."""

    id: str

    @abstractmethod
    def recognize(self, image: bytes) -> list[dict]: ...

    def dispose(self) -> None:  # noqa: B027 - engines without resources have nothing to do
        pass


def recognise(pages: DataFrame, make: type[OcrEngine] | object, keys: list[str]) -> DataFrame:
    """(keys, blocks, error) of pages (keys, image). An image that fails gives its error and no blocks; the others go on."""
    schema = pages.select(*keys).limit(0).withColumns({"blocks": F.lit(None).cast(BLOCKS), "error": F.lit(None).cast("string")}).schema
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        engine = make()
        try:
            for batch in batches:
                blocks, errors = [], []
                for image in batch.column(len(keys)).to_pylist():
                    try:
                        blocks.append(engine.recognize(image))
                        errors.append(None)
                    except Exception as e:  # one bad image must not stop the others
                        blocks.append(None)
                        errors.append(str(e) or type(e).__name__)
                yield pa.RecordBatch.from_arrays([*batch.columns[: len(keys)], pa.array(blocks, arrow.field("blocks").type), pa.array(errors, pa.string())], schema=arrow)
        finally:
            engine.dispose()

    return pages.select(*keys, "image").mapInArrow(run, schema)


def flatten(scans: DataFrame, keys: list[str], blocks: str = "blocks") -> DataFrame:
    """(keys, line_no, text, bbox, baseline, confidence, words) for all lines of all paragraphs of all blocks, in order;
    confidences become shares of one."""
    paragraphs = F.flatten(F.transform(blocks, lambda b: b["paragraphs"]))
    lines = F.flatten(F.transform(paragraphs, lambda p: p["lines"]))
    share = lambda w: F.struct(w["text"], w["bbox"], (w["confidence"] / 100).alias("confidence"))
    rows = scans.select(*keys, F.posexplode(lines).alias("line_no", "line"))
    return rows.select(
        *keys, "line_no", "line.text", "line.bbox", "line.baseline", (F.col("line.confidence") / 100).alias("confidence"), F.transform("line.words", share).alias("words")
    )


def word_items(lines: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, line_no, item_index, text, bbox, confidence): the words that aren't blank; a line without any words is one item."""
    clean = lambda c: tx.squash(tx.drop_controls(c))
    whole = F.array(F.struct(F.col("text").alias("text"), F.col("bbox").alias("bbox"), F.col("confidence").alias("confidence")))
    words = F.when(F.size(F.coalesce("words", F.array().cast(f"array<{WORD}>"))) > 0, F.col("words")).otherwise(whole)
    words = F.transform(words, lambda w: F.struct(clean(w["text"]).alias("text"), w["bbox"], w["confidence"]))
    rows = lines.select(*keys, "line_no", F.posexplode(F.filter(words, lambda w: w["text"] != "")).alias("item_index", "w"))
    return rows.select(*keys, "line_no", "item_index", "w.text", "w.bbox", "w.confidence")


def has_image(ops: Column) -> Column:
    """Whether one of a page's drawing operations paints an image."""
    return F.exists(ops, lambda x: x.isin(IMAGE_OPS))


def needs_ocr(little: Column, ops: Column) -> Column:
    """A page with little text and an image."""
    return little & F.coalesce(has_image(ops), F.lit(False))


def with_recognised(lines: DataFrame, recognised: DataFrame) -> DataFrame:
    """Lines of the text layer and recognised ones, told apart by source; what one kind lacks is null."""
    told = lambda df, source: df.withColumn("source", F.lit(source))
    return told(lines, "text").unionByName(told(recognised, "ocr"), allowMissingColumns=True)
