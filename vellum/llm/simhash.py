"""Near-duplicates by SimHash fingerprints, compared exactly, tile against tile, with exclusive-or and bit counts.

Two fingerprints that differ in at most ``radius`` of 64 bits agree in at least ``parts - radius`` of any ``parts`` parts of
them. So fingerprints meet only in the groups of those that agree in some choice of that many parts, which loses no link;
parts grow with the number of different fingerprints, to keep groups small. Within a group, tiles sorted by population count
are compared with numpy, and tile pairs whose population counts differ by more than the radius are skipped. A group over
``TILE`` is split into such tiles beforehand, one task for each pair of tiles. What a task returns is a spanning forest of
the links it has found, never all pairs.

A null text counts as empty; texts without words have fingerprint zero and link like any other. Equal fingerprints are one
class from the start, so that copies are never compared. A null id takes part, but is never a component's name unless no
other id is there (then null). Repeated rows give repeated rows. An empty table gives an empty result. Other columns are
ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vellum.llm import words as W
from vellum.llm.shared import components, settle, small

TILE = 4096
SEED = 42


def fingerprints(docs: DataFrame, id: str = "doc_id", text: str = "text", shingle: int = 4) -> DataFrame:
    """(id, fp): SimHash over XXH64 (seed 42) of lower-cased word shingles, as a signed long; repeated shingles count."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for w in W.chunks(batch.column(1), lower=True):
                fp = pa.array(_simhash(w, shingle).view(np.int64))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(w.row, w.n_docs), fp], ["id", "fp"])

    schema = T.StructType([T.StructField("id", docs.schema[id].dataType), T.StructField("fp", T.LongType())])
    return docs.select(F.col(id).alias("id"), F.col(text).cast("string").alias("text")).mapInArrow(run, schema)


def _simhash(w: W.Words, k: int) -> np.ndarray:
    # words with one space between them, wherever they stood
    keep = ~W.SEPARATOR[w.data]
    after = w.end[w.end < len(w.data)]
    keep[after] = True
    place = np.concatenate(([0], np.cumsum(keep)))
    data = w.data[keep]
    data[W.SEPARATOR[data]] = 0x20
    joined = data.tobytes()
    # a word that ends its text has no space after it, and a word of the next text may follow at once; no shingle crosses that
    n = w.counts
    size = np.where(n >= k, n - k + 1, np.minimum(n, 1))
    bounds = np.concatenate(([0], np.cumsum(size)))
    first = np.arange(bounds[-1]) - np.repeat(bounds[:-1], size) + np.repeat(w.first[:-1], size)
    last = np.minimum(first + k, np.repeat(w.first[1:], size)) - 1
    digest = xxhash.xxh64_digest
    hashes = b"".join([digest(joined[a:z], SEED) for a, z in zip(place[w.start[first]].tolist(), place[w.end[last]].tolist(), strict=True)])
    bits = np.unpackbits(np.frombuffer(hashes, np.uint8).reshape(-1, 8), axis=1)
    out = np.zeros(w.n_docs, np.uint64)
    some = np.flatnonzero(size)
    if len(some):
        ones = np.add.reduceat(bits, bounds[:-1][some], axis=0, dtype=np.int64)
        packed = np.packbits(2 * ones > size[some][:, None], axis=1)
        out[some] = np.ascontiguousarray(packed).view(">u8").ravel()
    return out


def _masks(n: int, radius: int) -> list[int]:
    """Masks of the choices of parts; enough parts for groups of 256 evenly spread fingerprints at most."""
    parts = next((p for p in range(radius + 1, radius + 4) if n <= 256 * 2 ** (64 * (p - radius) // p)), radius + 4)
    edges = [64 * i // parts for i in range(parts + 1)]
    part = [(1 << edges[i + 1]) - (1 << edges[i]) for i in range(parts)]
    return [sum(part[i] for i in chosen) for chosen in combinations(range(parts), parts - radius)]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


class Forest:
    """Union-find over 0..n-1 for whole arrays of links; the smallest member is the root."""

    def __init__(self, n: int):
        self.root = np.arange(n)

    def link(self, a: np.ndarray, b: np.ndarray) -> None:
        while len(a):
            a, b = self.root[a], self.root[b]
            differ = a != b
            a, b = a[differ], b[differ]
            np.minimum.at(self.root, np.maximum(a, b), np.minimum(a, b))
            while True:
                up = self.root[self.root]
                if np.array_equal(up, self.root):
                    break
                self.root = up


def tile_links(fp: np.ndarray, radius: int, tile: int = 512) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest of the links among different fingerprints, as (fingerprint, root) arrays."""
    count = np.bitwise_count(fp)
    order = np.argsort(count, kind="stable")
    fp, count = fp[order], count[order].astype(np.int64)
    forest = Forest(len(fp))
    for i in range(0, len(fp), tile):
        a = fp[i : i + tile]
        for j in range(i, len(fp), tile):
            if count[j] - count[min(i + tile, len(fp)) - 1] > radius:
                break  # sorted by population count: no later tile can be within the radius either
            x, y = np.nonzero(np.bitwise_count(a[:, None] ^ fp[None, j : j + tile]) <= radius)
            off = i + x != j + y
            forest.link(i + x[off], j + y[off])
    moved = np.flatnonzero(forest.root != np.arange(len(fp)))
    return fp[moved], fp[forest.root[moved]]


def near_links(fps: DataFrame, radius: int = 4, fp: str = "fp") -> DataFrame:
    """(a, b): links that connect just what links at ``radius`` or fewer differing bits connect; fps has different values."""
    masks = _masks(fps.count(), radius)
    keys = F.explode(F.array(*[F.struct(F.lit(i).alias("choice"), F.col(fp).bitwiseAND(F.lit(_signed(m))).alias("part")) for i, m in enumerate(masks)]))
    rows = settle(fps.select(F.col(fp).alias("fp"), keys.alias("k")).select("fp", "k.choice", "k.part"))
    large = small(settle(rows.groupBy("choice", "part").count().filter(F.col("count") > TILE).drop("count")))
    plain = rows.join(large, ["choice", "part"], "left_anti").withColumns({"one": F.lit(0), "other": F.lit(0)})
    # groups over TILE: tiles of one population count each, cut further by hash, every tile with those within the radius
    hot = rows.join(large, ["choice", "part"]).withColumn("ones", F.bit_count("fp"))
    tiles = hot.groupBy("choice", "part", "ones").count().withColumn("cuts", F.ceil(F.col("count") / TILE).cast("int"))
    tiles = tiles.groupBy("choice", "part").agg(F.collect_list(F.struct("ones", "cuts")).alias("tiles"))  # 65 at most
    hot = hot.join(tiles, ["choice", "part"])
    own = F.col("ones") * (1 << 20) + F.pmod(F.xxhash64("fp"), F.expr("filter(tiles, t -> t.ones = ones)[0].cuts")).cast("int")
    near = f"flatten(transform(filter(tiles, t -> abs(t.ones - ones) <= {radius}), t -> transform(sequence(0, t.cuts - 1), c -> t.ones * {1 << 20} + c)))"
    hot = hot.withColumn("own", own).withColumn("next", F.explode(F.expr(near)))
    hot = hot.select("fp", "choice", "part", F.least("own", "next").alias("one"), F.greatest("own", "next").alias("other"))
    rows = plain.select(hot.columns).unionByName(hot)
    dealt = rows.repartition("choice", "part", "one", "other").sortWithinPartitions("choice", "part", "one", "other")
    dealt = dealt.select("fp", F.xxhash64("choice", "part", "one", "other").alias("g1"), F.hash("choice", "part", "one", "other").alias("g2"))

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in _groups(batches):
            a, b = tile_links(group, radius)
            if len(a):
                yield pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], ["a", "b"])

    return dealt.mapInArrow(compare, "a long, b long")


def _groups(batches: Iterator[pa.RecordBatch]) -> Iterator[np.ndarray]:
    """The fingerprints of each group; rows come sorted by group."""
    held, key = [], None
    for batch in batches:
        if not batch.num_rows:
            continue
        fp, g1, g2 = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(3))
        cut = np.flatnonzero((g1[1:] != g1[:-1]) | (g2[1:] != g2[:-1])) + 1
        edges = [0, *cut.tolist(), len(fp)]
        for a, z in zip(edges, edges[1:], strict=False):
            if key != (g1[a], g2[a]) and held:
                yield np.concatenate(held).view(np.uint64)
                held = []
            key = (g1[a], g2[a])
            held.append(fp[a:z])
    if held:
        yield np.concatenate(held).view(np.uint64)


def near_duplicates(docs: DataFrame, id: str = "doc_id", text: str = "text", shingle: int = 4, radius: int = 4) -> DataFrame:
    """One row per row of docs: id, fingerprint (16 hex digits), component_id (the smallest id that links lead to)."""
    fps = settle(fingerprints(docs, id, text, shingle))
    classes = settle(fps.groupBy("fp").agg(F.min("id").alias("low")))
    roots = components(near_links(classes.select("fp"), radius))
    linked = classes.join(roots.withColumnRenamed("node", "fp"), "fp")
    name = linked.groupBy("root").agg(F.min("low").alias("component_id"))
    named = small(settle(linked.join(name, "root").select("fp", "component_id")), 16)
    named = classes.join(named, "fp", "left").select("fp", F.coalesce("component_id", "low").alias("component_id"))
    out = fps.join(named, "fp")
    return out.select(F.col("id").alias(id), F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
