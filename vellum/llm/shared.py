"""What the operators share: materialising in the shared folder, size-checked broadcasts, connected components."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Largest side, in bytes as estimated by ``small``, that is broadcast; anything above is joined by a shuffle.
BROADCAST_BYTES = 32 << 20
_made: list[tuple[SparkSession, str]] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder the cluster names in spark.checkpoint.dir; one of our own only where that is unset on a single machine."""
    told = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if not told:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        told = "file://" + tempfile.mkdtemp(prefix="vellum-")
        spark.conf.set("spark.checkpoint.dir", told)
    return told.rstrip("/")


def settle(df: DataFrame) -> DataFrame:
    """Writes df as a table in the shared folder and reads it back: lineage ends, and a lost executor costs nothing before it."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/vellum-{uuid.uuid4().hex}"
    df.write.parquet(path)
    if not _made:
        atexit.register(_clear)
    _made.append((spark, path))
    return spark.read.schema(df.schema).parquet(path)


def _clear() -> None:
    for spark, path in _made:
        try:
            jvm = spark.sparkContext._jvm
            p = jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
        except Exception:  # the session may be gone; the folder is the cluster's to clear
            return


def small(df: DataFrame, row_bytes: int = 64, limit: int = BROADCAST_BYTES) -> DataFrame:
    """df, marked for broadcast if its counted rows at row_bytes each stay within limit; else left for a shuffled join."""
    return F.broadcast(df) if df.count() * row_bytes <= limit else df


def columns_for_python(spark: SparkSession, rows: int = 2000) -> None:
    """Arrow batches of so many rows at most, so that long texts don't add up in a Python worker."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", rows)


def free_column(df: DataFrame, name: str) -> str:
    """name, or name with underscores added until no column of df (in either case) has it."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, root) for every node of an undirected edge list: root is the smallest node that can be reached.

    Alternates large-star and small-star steps (Kiveris et al., 2014) until the edges stop changing; each step is a grouped
    minimum (combined before the shuffle) and an equi-join, and is settled, so no component is ever gathered in one place.
    """
    stars = settle(edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).filter("u <> v").distinct())
    mark = _mark(stars)
    if not mark[0]:
        return stars.select(F.col("u").alias("node"), F.col("v").alias("root"))
    while True:
        both = stars.unionByName(stars.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(low, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.filter("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        joined = large.join(low, "u")
        parts = joined.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(joined.select("u", F.col("m").alias("v")))
        stars = settle(parts.filter("u <> v").distinct())
        mark, before = _mark(stars), mark
        if mark == before:
            return stars.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(
                stars.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
            )


def _mark(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first())
