"""Incremental runs: files that arrive are read as a stream, aggregated by event time with a watermark, and written once each."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def arrivals(spark: SparkSession, path: str, schema, glob: str = "*.parquet") -> DataFrame:
    """New files below a folder as a stream."""
    return spark.readStream.schema(schema).option("pathGlobFilter", glob).parquet(path)


def windowed(stream: DataFrame, time: str, width: str, late: str, by: list[str], aggs: list) -> DataFrame:
    """Aggregates of event-time windows; rows later than the watermark are dropped."""
    stream = stream.withColumn(time, F.col(time).cast("timestamp"))
    grouped = stream.withWatermark(time, late).groupBy(F.window(time, width), *by).agg(*aggs)
    return grouped.select(F.col("window.start").alias("window_start"), *by, *[c for c in grouped.columns if c not in ("window", *by)])


def run_available(stream: DataFrame, checkpoint: str, sink: Callable[[DataFrame, int], None] | str, mode: str = "append") -> None:
    """Processes all files there are, then stops: to a Parquet folder, or to a function once a batch."""
    w = stream.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True)
    q = w.foreachBatch(sink).start() if callable(sink) else w.format("parquet").start(sink)
    q.awaitTermination()
