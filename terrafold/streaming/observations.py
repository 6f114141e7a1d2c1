"""Observations as a stream: statistics of time windows, with late rows up to a watermark."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_stream(spark: SparkSession, folder: str, schema) -> DataFrame:
    return spark.readStream.schema(schema).parquet(folder)


def windowed_stats(stream: DataFrame, ts: str, keys: list[str], value: str, length: str = "1 day", late: str = "2 days") -> DataFrame:
    """Count, mean and extremes of each key and window; a window is emitted once the watermark has passed it."""
    return stream.withWatermark(ts, late).groupBy(F.window(ts, length), *keys).agg(
        F.count(value).alias("n"), F.avg(value).alias("mean"), F.min(value).alias("min"), F.max(value).alias("max")).select(
        F.col("window.start").alias("start"), *keys, "n", "mean", "min", "max")
