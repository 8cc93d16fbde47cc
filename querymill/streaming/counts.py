"""Analyses over unbounded logs: an extension, as the batch analyses know no streams."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def bucket_counts(stream: DataFrame, time_col: str, keys: list[str], width: str = "1 day", late: str = "14 days") -> DataFrame:
    """(start, end, keys, n): counts by time window and keys. Rows later than the watermark are dropped and closed windows leave the state."""
    timed = stream.where(F.col(time_col).isNotNull()).withWatermark(time_col, late)
    counted = timed.groupBy(F.window(time_col, width), *keys).agg(F.count("*").alias("n"))
    return counted.select(F.col("window.start").alias("start"), F.col("window.end").alias("end"), *keys, "n")


def without_repeats(stream: DataFrame, time_col: str, keys: list[str], late: str = "14 days") -> DataFrame:
    """Rows delivered again within the watermark are dropped; state is kept no longer than that."""
    return stream.withWatermark(time_col, late).dropDuplicatesWithinWatermark(keys)


def run_available(counts: DataFrame, path: str, checkpoint: str, mode: str = "append"):
    """Processes what is there, exactly once, and stops."""
    return counts.writeStream.outputMode(mode).format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
