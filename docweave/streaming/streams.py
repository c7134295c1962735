"""Streams: incremental ingest of table folders, windows with late data, first-seen rows, idle sessions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def table_stream(spark: SparkSession, path: str, schema: T.StructType, files_per_trigger: int = 16) -> DataFrame:
    """A folder (or glob) of parquet files as a stream; each file is read once."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def windowed_counts(events: DataFrame, at: str, key: str, value: str, size: str = "1 hour", late: str = "2 hours", slide: str | None = None) -> DataFrame:
    """(window_start, key, n, total) over tumbling windows, or sliding ones; rows later than the watermark are left out.

    In append mode a window comes out once the watermark has passed its end, and its state goes.
    """
    counted = events.withWatermark(at, late).groupBy(F.window(at, size, slide or size).alias("w"), key).agg(F.count("*").alias("n"), F.sum(value).alias("total"))
    return counted.select(F.col("w.start").alias("window_start"), key, "n", "total")


def session_counts(events: DataFrame, at: str, key: str, idle: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """(key, started, ended, n): sessions that end after `idle` without an event."""
    counted = events.withWatermark(at, late).groupBy(F.session_window(at, idle).alias("w"), key).agg(F.count("*").alias("n"))
    return counted.select(key, F.col("w.start").alias("started"), F.col("w.end").alias("ended"), "n")


def first_seen(rows: DataFrame, keys: list[str], at: str, late: str = "1 day") -> DataFrame:
    """Each key once within the watermark: the state forgets keys older than it."""
    return rows.withWatermark(at, late).dropDuplicatesWithinWatermark(keys)


def run_available(stream: DataFrame, out: str, checkpoint: str, mode: str = "append") -> None:
    """Process what is there and stop; a later run with the same checkpoint goes on from there."""
    query = stream.writeStream.format("parquet").outputMode(mode).option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
