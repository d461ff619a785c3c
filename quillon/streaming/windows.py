"""Event-time windows and sessions, as batch and as a stream."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _hourly(events: DataFrame) -> DataFrame:
    return (
        events.withColumn("ts", F.col("ts").cast("timestamp"))
        .withWatermark("ts", "10 minutes")
        .groupBy(F.window("ts", "1 hour").alias("w"), "event_type")
        .agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"))
        .select(F.unix_timestamp("w.start").alias("window_start"), "event_type", "n", "total")
    )


def batch_windows(events: DataFrame) -> DataFrame:
    return _hourly(events)


def stream_windows(spark: SparkSession, path: str) -> DataFrame:
    """The same windows by Structured Streaming, run over what is there now.

    Every micro-batch writes the windows that it changed to the shared folder;
    the last state of each window is read back.  State is kept only for windows
    that the watermark has not passed; rows later than that are left out."""
    schema = spark.read.parquet(path).schema
    folder = path.rsplit("/", 1)
    events = (
        spark.readStream.schema(schema)
        .option("pathGlobFilter", folder[1])
        .parquet(folder[0])
    )
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if spark.sparkContext.master.split("[")[0] != "local":
            raise ValueError("spark.checkpoint.dir names no shared folder")
        base = tempfile.mkdtemp(prefix="quillon-stream-")
    target = f"{base.rstrip('/')}/windows_{uuid.uuid4().hex}"
    changed = _hourly(events)

    def write(rows: DataFrame, batch: int) -> None:
        rows.withColumn("batch", F.lit(batch)).write.mode("append").parquet(f"{target}/rows")

    query = (
        changed.writeStream.outputMode("update")
        .foreachBatch(write)
        .option("checkpointLocation", f"{target}/state")
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
    written = spark.read.schema(changed.schema.add("batch", "long")).parquet(f"{target}/rows")
    # a batch that was tried again has written equal rows
    return written.groupBy("window_start", "event_type").agg(
        F.max_by("n", "batch").alias("n"), F.max_by("total", "batch").alias("total")
    )


def sessions(events: DataFrame, gap: str = "30 minutes") -> DataFrame:
    """Runs of a user's events with less than ``gap`` between neighbours."""
    return (
        events.withColumn("ts", F.col("ts").cast("timestamp"))
        .groupBy("user_id", F.session_window("ts", gap).alias("w"))
        .agg(F.count("*").alias("n"))
        .select("user_id", F.unix_micros("w.start").alias("start_us"), "n")
    )
