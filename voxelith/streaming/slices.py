"""Slices that keep arriving: gap checks over a stream of slice positions.

Files dropped into a folder become events; per series the stream keeps the
count, the extremes and the last position, and a watermark bounds how long a
late slice is waited for.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

EVENT = "series_id int, instance int, position double, ts timestamp"


def source(spark: SparkSession, path: str, files_per_trigger: int = 64) -> DataFrame:
    """A stream of slice events from Parquet files in a folder."""
    return spark.readStream.schema(EVENT).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def progress(events: DataFrame, late: str = "10 minutes", window: str = "5 minutes") -> DataFrame:
    """Slices and span of each series in event-time windows; repeated slices count once."""
    once = events.withWatermark("ts", late).dropDuplicatesWithinWatermark(["series_id", "instance"])
    return once.groupBy("series_id", F.window("ts", window)).agg(F.count("*").alias("slices"), F.min("position").alias("low"), F.max("position").alias("high"))


def run_available(df: DataFrame, name: str, checkpoint: str, mode: str = "append"):
    """Process all that is there into an in-memory table and stop."""
    query = df.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return query
