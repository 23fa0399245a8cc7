"""Histograms of event streams: windows of event time with a watermark, bins as in batch histograms."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.binning import bin_index


def stream_hist(events: DataFrame, time: str, x: Column, edges: np.ndarray, value: Column | None = None, window: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Sums of ``value`` (or counts) per window and bin; only bins with events appear, as a stream has no end to fill the rest at."""
    value = F.lit(1.0) if value is None else value
    binned = events.withWatermark(time, late).withColumn("bin", bin_index(x, np.asarray(edges))).where("bin IS NOT NULL")
    found = binned.groupBy(F.window(time, window), "bin").agg(F.sum(value).alias("value"), F.count(F.lit(1)).alias("n"))
    return found.select(F.col("window.start").alias("start"), "bin", "value", "n")
