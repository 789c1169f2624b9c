"""Windowed counts and sessions of event streams, with watermarks for late rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def read_events(spark: SparkSession, folder: str, schema: StructType, files_at_once: int = 16) -> DataFrame:
    """A stream of the Parquet files that appear in a folder."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_at_once).parquet(folder)


def windowed_counts(events: DataFrame, time: str, key: str, width: str, late: str) -> DataFrame:
    """window_start, key, n, total of tumbling windows; rows later than ``late`` are left out."""
    rows = events.withWatermark(time, late).groupBy(F.window(time, width), key).agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    return rows.select(F.col("window.start").alias("window_start"), key, "n", "total")


def sessions(events: DataFrame, time: str, key: str, gap: str, late: str) -> DataFrame:
    """first, last, n of each key's sessions, which end after a ``gap``."""
    rows = events.withWatermark(time, late).groupBy(F.session_window(time, gap), key).agg(F.count("*").alias("n"))
    return rows.select(key, F.col("session_window.start").alias("first"), F.col("session_window.end").alias("last"), "n")


def first_of_each(events: DataFrame, time: str, key: str, late: str) -> DataFrame:
    """Rows without repeats of a key within the watermark."""
    return events.withWatermark(time, late).dropDuplicatesWithinWatermark([key])
