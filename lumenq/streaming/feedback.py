"""Feedback events as a stream: an append-only JSON log, counted in event-time windows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenq import schema


def append(events: DataFrame, path: str) -> None:
    """Adds feedback records to the log."""
    events.write.mode("append").json(path)


def read(spark: SparkSession, path: str) -> DataFrame:
    """The log as a stream; records that can't be read are left out."""
    return spark.readStream.schema(schema.FEEDBACK).option("mode", "DROPMALFORMED").json(path)


def windowed(events: DataFrame, width: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Counts of each failure type in tumbling windows, helpful and not. Works on a stream (events later than ``late`` are dropped) and on a table alike."""
    marked = events.withWatermark("ts", late) if events.isStreaming else events
    kind = F.coalesce("failure_type", F.lit("unknown"))
    out = marked.groupBy(F.window("ts", width).alias("w"), kind.alias("failure_type")).agg(F.count("*").alias("n"), F.count_if(F.col("helpful")).alias("n_helpful"))
    return out.select(F.col("w.start").alias("window_start"), "failure_type", "n", "n_helpful")


def run(spark: SparkSession, source: str, sink: str, checkpoint: str, width: str = "1 hour", late: str = "2 hours"):
    """Everything that is in the log by now, counted and appended to a Parquet sink; returns the finished query. Windows that the watermark hasn't closed stay in state."""
    counts = windowed(read(spark, source), width, late)
    q = counts.writeStream.format("parquet").outputMode("append").option("path", sink).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()
    return q


def tail(spark: SparkSession, source: str, sink: str, checkpoint: str):
    """The log itself into Parquet, once each, however often this is started."""
    q = read(spark, source).writeStream.format("parquet").option("path", sink).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()
    return q
