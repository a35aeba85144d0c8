"""Snapshots that grow as results arrive, and event counts by window (an addition: event time isn't part of the core)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from sievework.sources.sinks import upsert_latest


def snapshots(answers: DataFrame, path: str, checkpoint: str, key: str = "model", order: str = "finished") -> StreamingQuery:
    """Write, after each batch, all keys' latest answers so far: a batch's folder holds the whole snapshot.

    A batch that runs again after a failure writes the same folder again.
    """

    def write(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        if number:
            batch = spark.read.schema(batch.schema).parquet(f"{path}/batch={number - 1}").unionByName(batch)
        upsert_latest(batch, key, order).write.mode("overwrite").parquet(f"{path}/batch={number}")

    return answers.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def event_windows(events: DataFrame, length: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Counts and sums by event type and window; with a stream, windows close when the watermark has passed them."""
    timed = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    return timed.groupBy(F.window("ts", length), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("value")).select("window.start", "event_type", "n", "value")
