"""Line operators on streams: every stateless operator is a plain transform of a streaming DataFrame."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_line_stream(spark: SparkSession, path: str, files_per_trigger: int = 100) -> DataFrame:
    """(value): lines of files as they arrive in a folder."""
    return spark.readStream.option("maxFilesPerTrigger", files_per_trigger).text(path)


def run_available(stream: DataFrame, transform: Callable[[DataFrame], DataFrame], path: str, checkpoint: str) -> None:
    """Transforms what is there now into Parquet files and ends; a second run goes on where the first stopped."""
    query = transform(stream).writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()


def windowed_counts(events: DataFrame, ts: str, key: str, late: str = "1 hour", width: str = "1 day") -> DataFrame:
    """An extension beyond line operators: events per key and time window, late rows dropped by watermark."""
    return events.withWatermark(ts, late).groupBy(F.window(ts, width), key).agg(F.count("*").alias("n"))
