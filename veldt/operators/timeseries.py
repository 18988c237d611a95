"""Ordered operators on daily and monthly series."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def rolling_sum(df: DataFrame, keys: list[str], month_index: str, value: str, k: int, name: str) -> DataFrame:
    """Trailing k-month sum; NULL unless all k months are present.

    The frame is a range over the month index, so a gap is a gap.
    """
    w = Window.partitionBy(*keys).orderBy(month_index).rangeBetween(-(k - 1), 0)
    return df.withColumn(name, F.when(F.count(value).over(w) == k, F.sum(value).over(w)))


def range_mean(df: DataFrame, keys: list[str], day: str, value: str, start: int, end: int, name: str) -> DataFrame:
    """Mean of what exists from `start` to `end` days around each row; day is a day number."""
    w = Window.partitionBy(*keys).orderBy(day).rangeBetween(start, end)
    return df.withColumn(name, F.avg(value).over(w))


def longest_run(df: DataFrame, keys: list[str], day: str, condition: Column, name: str, seen: str | None = None) -> DataFrame:
    """keys and the longest run of consecutive rows that meet the condition; 0 if none does.

    A row that doesn't meet it begins an island, to which the rows behind it
    belong up to the next such row: one running count and one sort. With
    `seen`, a column, there is also the count of its values, as `seen`.
    """
    upto = Window.partitionBy(*keys).orderBy(day).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    marked = df.withColumn("met", F.coalesce(condition, F.lit(False)))
    islands = marked.withColumn("island", F.sum(F.when(F.col("met"), 0).otherwise(1)).over(upto))
    runs = islands.groupBy(*keys, "island").agg(F.count_if("met").alias("n"), *([F.count(seen).alias("values")] if seen else []))
    return runs.groupBy(*keys).agg(F.max("n").cast("int").alias(name), *([F.sum("values").alias("seen")] if seen else []))


def dealt(df: DataFrame, *keys: str) -> DataFrame:
    """df in partitions by keys, as many as spark.sql.shuffle.partitions says.

    The number is fixed: left to itself Spark merges partitions to one a core
    or to a size, so a task's rows grow with the input's until all are full.
    """
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys)


def densified(df: DataFrame, keys: DataFrame, day: str, first: Column, last: Column) -> DataFrame:
    """One row for each key and day between two dates, df's values where it has them.

    Keys meet df's rows first, and each row then makes the days up to the
    key's next one. So df's rows are all that is sent and sorted, made days
    never are, and what is grouped by the keys later finds them in place.
    Keys that stand more than once have their rows as often. The number of
    partitions is fixed, because Spark would merge those whose rows are few
    before the days are made.
    """
    own, here = keys.columns, F.col("densified_day")
    values = [c for c in df.columns if c not in (*own, day)]
    held = df.filter(F.col(day).between(first, last)).withColumnRenamed(day, "densified_day")
    met = dealt(keys, *own).groupBy(*own).agg(F.count("*").cast("int").alias("densified_copies")).join(held, own, "left")
    along = Window.partitionBy(*own).orderBy("densified_day")
    before, after = F.lag(here).over(along), F.lead(here).over(along)
    # rows of one day: the last one makes the days behind it
    until = F.when(F.col("densified_after").isNull(), last).otherwise(F.greatest(here, F.date_sub("densified_after", 1)))
    days = F.sequence(F.when(F.col("densified_before").isNull(), first).otherwise(here), until)
    copies = F.col("densified_copies")
    made = met.withColumns({"densified_before": before, "densified_after": after}).withColumn(day, F.explode(F.when(copies > 1, F.flatten(F.array_repeat(days, copies))).otherwise(days)))
    return made.select(*own, day, *[F.when(F.col(day) == here, F.col(v)).alias(v) for v in values])


def keep_last(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """Of rows with equal keys the last one in the given order."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("keep_last_rank", F.row_number().over(w)).filter("keep_last_rank = 1").drop("keep_last_rank")


def share_of_total(df: DataFrame, value: str, name: str) -> DataFrame:
    """value over its total, which comes from an aggregate of its own rather than an unpartitioned window."""
    return df.crossJoin(F.broadcast(df.agg(F.sum(value).alias("share_total")))).withColumn(name, F.try_divide(F.col(value).cast("double"), F.col("share_total"))).drop("share_total")


def anomaly(df: DataFrame, baseline: DataFrame, keys: list[str], value: str, base: str, name: str) -> DataFrame:
    return df.join(baseline.select(*keys, F.col(base).alias("anomaly_base")), keys, "left").withColumn(name, F.col(value) - F.col("anomaly_base")).drop("anomaly_base")
