"""Sliding epochs on an event-time stream: the half-overlapping epoch grid as a windowed aggregate with a watermark."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import stage_path


def stream_epoch_power(events: DataFrame, keys: list[str], epoch: str, hop: str, delay: str) -> DataFrame:
    """(keys, epoch_start, n, mean, power) of each complete epoch; rows later than ``delay`` are dropped.

    events(<keys>, ts, value) may be a stream or a table; each row lands in every epoch that covers it.
    State holds one running aggregate per key and open epoch.
    """
    watermarked = events.withWatermark("ts", delay) if events.isStreaming else events
    return watermarked.groupBy(*keys, F.window("ts", epoch, hop).alias("w")).agg(
        F.count(F.lit(1)).alias("n"), F.avg("value").alias("mean"), F.avg(F.col("value") * F.col("value")).alias("power")
    ).select(*keys, F.col("w.start").alias("epoch_start"), "n", "mean", "power")


def run_available(spark: SparkSession, result: DataFrame, name: str) -> DataFrame:
    """Process everything that is available in append mode, and return the written epochs."""
    target = stage_path(spark, name)
    started = result.writeStream.outputMode("append").format("parquet").option("checkpointLocation", stage_path(spark, f"{name}-progress")).option(
        "path", target).trigger(availableNow=True).start()
    started.awaitTermination()
    return spark.read.schema(result.schema).parquet(target)
