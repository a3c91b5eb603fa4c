"""Depth in bins over a stream of reads: an addition to the batch operators."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def streaming_depth(reads: DataFrame, keys: list[str], start: str, end: str, width: int, time: str, lateness: str = "10 minutes") -> DataFrame:
    """keys, window, bin, depth of reads that arrive within a watermark; bins are as in the batch operator."""
    first, last = (F.floor(F.col(c) / F.lit(width)).cast("long") for c in (start, end))
    bins = reads.withWatermark(time, lateness).filter(last > first).withColumn("bin", F.explode(F.sequence(first, last - 1)))
    return bins.groupBy(F.window(time, lateness), *keys, "bin").agg(F.count(F.lit(1)).alias("depth"))
