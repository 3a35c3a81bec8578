"""Running counts of unique sequences over a stream of reads; an addition to the batch operators."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def running_counts(reads: DataFrame) -> DataFrame:
    """reads of each sequence by round so far; for update or complete output."""
    return reads.groupBy("round", "seq").agg(F.count(F.lit(1)).alias("reads"))


def windowed_counts(events: DataFrame, time: str, key: str, size: str = "1 hour", delay: str = "10 minutes") -> DataFrame:
    """Events by key in tumbling windows, late ones within the delay included; for append output."""
    return events.withWatermark(time, delay).groupBy(F.window(time, size).alias("w"), key).agg(F.count(F.lit(1)).alias("n")).select(F.col("w.start").alias("start"), key, "n")
