"""Helpers that several training-data operators share."""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: ASCII white space that separates words: space and \t \n \v \f \r.
WORD_BREAK = r"[\x20\x09-\x0D]+"


#: Caches by which workers keep what they have met for later tasks.
CACHES: list = []


def small_batches(spark: SparkSession) -> None:
    """Arrow batches of at most 2,000 rows from here on, where the session has
    Spark's default: five times fewer texts at once outside an executor's heap."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if spark.conf.get(name) == "10000":
        spark.conf.set(name, "2000")


def release_memory() -> None:
    """Give what a worker has freed back to the system, which else counts as its own."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # another C library
        pass


def clear_caches(but: str) -> None:
    for cache in CACHES:
        if cache.__module__ != but:
            cache.cache_clear()


def lean(function: Callable[[Iterator], Iterable], caches: str = "") -> Callable[[Iterator], Iterator]:
    """``function`` for mapInArrow in workers that hold little besides: what they
    keep for other modules than ``caches`` goes first, and freed memory at the end."""

    def run(batches: Iterator) -> Iterator:
        clear_caches(caches)
        try:
            yield from function(batches)
        finally:
            release_memory()

    return run


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share.

    It is ``spark.checkpoint.dir`` of the session; only where that is unset
    (tests on one machine) a folder of this process is used.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if spark.sparkContext.master.split("[")[0] != "local":
            raise ValueError("spark.checkpoint.dir names no folder that driver and executors share")
        folder = tempfile.mkdtemp(prefix="quillon-checkpoint-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


def materialize(df: DataFrame, tag: str, codec: str | None = None) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back.

    This cuts the lineage with files that survive the loss of an executor.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/quillon-{tag}-{uuid.uuid4().hex}"
    df.write.parquet(path, compression=codec)
    return spark.read.schema(df.schema).parquet(path)


def drop_table(df: DataFrame) -> None:
    """Delete the files of a table made by ``materialize`` that no later plan reads."""
    jvm = df.sparkSession._jvm
    conf = df.sparkSession._jsc.hadoopConfiguration()
    for folder in {name.rsplit("/", 1)[0] for name in df.inputFiles()}:
        path = jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(conf).delete(path, True)


def text_or_empty(name: str = "text") -> Column:
    return F.coalesce(F.col(name), F.lit(""))


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def connected_components(
    links: DataFrame, max_rounds: int = 60, tag: str = "components"
) -> DataFrame:
    """Smallest node reachable from each node of ``links`` (columns a, b).

    Alternating large-star and small-star rounds: every round hooks each
    node's neighbours to the smallest one, so the number of rounds grows with
    the logarithm of the longest chain.  Nothing is gathered on the driver but
    one count a round.  A node with very many neighbours is only ever read by
    aggregates that combine before the exchange, never held as a group.

    Returns (node, component) for every node that has a link, the smallest
    itself included; an empty input gives an empty result.
    """
    edges = materialize(
        links.select(
            F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")
        ).where("u <> v").distinct(),
        tag,
    )
    def print_of(table: DataFrame) -> tuple:
        """Row count and two hashes: rounds are alike when these are."""
        h = F.xxhash64("u", "v")
        return tuple(table.agg(F.count("*"), F.bit_xor(h), F.bit_xor(F.xxhash64(h, "u"))).head())

    last = print_of(edges)
    for _ in range(max_rounds):
        both = edges.union(edges.select(F.col("v"), F.col("u"))).toDF("x", "y")
        low = both.groupBy("x").agg(F.least(F.col("x"), F.min("y")).alias("m"))
        large = (
            both.where("y > x").join(low, "x").select(F.col("y").alias("u"), F.col("m").alias("v"))
        ).distinct()
        large = materialize(large, tag)
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select("u", "v", "m")
        after = materialize(
            small.select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
            .union(small.select("u", F.col("m").alias("v")))
            .distinct(),
            tag,
        )
        now = print_of(after)
        drop_table(edges)
        drop_table(large)
        edges = after
        if now == last:
            break
        last = now
    else:
        raise RuntimeError("components did not settle")
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).union(
        edges.select(F.col("v"), F.col("v")).distinct()
    )
