"""Checks of arriving bars.

The batch audit needs the bar before; what can be judged from a bar alone is also available on a stream, with counts per
day of arrival that close once the watermark has passed.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewright.operators.spikes import physical_bounds


def impossible_bars(stream: DataFrame) -> DataFrame:
    """Arriving rows whose own values cannot be; stateless."""
    return stream.filter(physical_bounds())


def daily_counts(stream: DataFrame, late: str = "2 days") -> DataFrame:
    """window_start, feed, n_bars, n_bad per day of loaded_at; rows later than the watermark are left out of closed days."""
    timed = stream.withColumn("at", F.col("loaded_at").cast("timestamp")).withWatermark("at", late)
    out = timed.groupBy(F.window("at", "1 day"), "feed").agg(F.count(F.lit(1)).alias("n_bars"), F.count_if(physical_bounds()).alias("n_bad"))
    return out.select(F.col("window.start").alias("window_start"), "feed", "n_bars", "n_bad")
