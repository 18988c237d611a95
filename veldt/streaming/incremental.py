"""Structured Streaming forms of two operators; an extension of the batch engine."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def first_of_each(stream: DataFrame, time: str, keys: list[str], late: str = "7 days") -> DataFrame:
    """Observations without repeats: of equal keys the first to arrive within the watermark stays."""
    return stream.withWatermark(time, late).dropDuplicatesWithinWatermark(keys)


def cold_days(stream: DataFrame, time: str, value: str, below: float = 2.0, every: str = "30 days", late: str = "7 days") -> DataFrame:
    """Days colder than the threshold by cell and window; NULL while a window holds no value.

    State is one row for each cell and open window. Closed windows are
    emitted once and forgotten.
    """
    v = F.col(value)
    window = F.window(time, every)
    by = stream.withWatermark(time, late).groupBy("cell_id", window.alias("period"))
    counted = by.agg(F.count(v).alias("n_values"), F.count_if(v < below).alias("n_cold"))
    return counted.select("cell_id", F.col("period.start").alias("start"), F.when(F.col("n_values") > 0, F.col("n_cold")).alias("cold_days"))
