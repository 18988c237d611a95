"""Places in a sorted table, without sorting it in one task."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from veldt.sources.scratch import written


def placed(df: DataFrame, order: Sequence[Column], name: str = "place") -> DataFrame:
    """df with the place of each row, from 1, in the given order.

    Rows are dealt to ranges of the order, counted, and ranked within their
    range; what stands before a range is added. The ranges are drawn from a
    sample, so the dealt rows are written once and keep them. Rows that the
    order doesn't tell apart lie in one range, so it should end with a key.
    """
    ranges = written(df.repartitionByRange(*order).withColumn("range_of_rows", F.spark_partition_id()), "ranges")
    counts = ranges.groupBy("range_of_rows").agg(F.count("*").alias("rows_of_range"))
    # a row for each range
    before = counts.withColumn("rows_before", F.sum("rows_of_range").over(Window.orderBy("range_of_rows")) - F.col("rows_of_range"))
    within = F.row_number().over(Window.partitionBy("range_of_rows").orderBy(*order))
    return ranges.withColumn(name, within).join(before, "range_of_rows").withColumn(name, F.col(name) + F.col("rows_before")).drop("range_of_rows", "rows_before", "rows_of_range")
