"""Set comparisons between frames, as tables of what differs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def orphans(a: DataFrame, b: DataFrame, column: str) -> DataFrame:
    """value, side: values that only one side has ("left" or "right"); NULL is no value."""
    left, right = (d.select(column).filter(F.col(column).isNotNull()).distinct() for d in (a, b))
    only = lambda x, y, side: x.join(y, column, "left_anti").select(F.col(column).alias("value"), F.lit(side).alias("side"))
    return only(left, right, "left").unionByName(only(right, left, "right"))


def common(a: DataFrame, b: DataFrame, column: str) -> DataFrame:
    return a.select(column).intersect(b.select(column)).filter(F.col(column).isNotNull())


def missing_from(part: DataFrame, whole: DataFrame, columns: list[str]) -> DataFrame:
    """Rows of part whose keys whole lacks; empty if part is a subset."""
    return part.join(whole.select(*columns).distinct(), columns, "left_anti")


def suggestions(wanted: DataFrame, key: str, part: str, names: DataFrame, name: str) -> DataFrame:
    """For each row of wanted the names that hold its part in any case, sorted and joined by ";"; NULL if none does.

    Parts and names meet on the first two letters of the part, which a name
    has to hold somewhere; an empty part is held by every name.
    """
    letters = F.sequence(F.lit(1), F.char_length("low"))
    twos = F.when(F.char_length("low") > 0, F.flatten(F.array(F.transform(letters, lambda i: F.substring("low", i, F.lit(2))), F.transform(letters, lambda i: F.substring("low", i, F.lit(1))))))
    hooks = F.explode(F.array_distinct(F.concat(F.array(F.lit("")), F.coalesce(twos, F.array(F.lit("")))))).alias("hook")
    known = names.select(F.col(name).alias("name"), F.lower(name).alias("low")).dropna().distinct().select("name", "low", hooks)
    asked = wanted.select(F.lower(part).alias("part")).dropna().distinct().withColumn("hook", F.left("part", F.lit(2)))
    held = asked.join(known, "hook").filter(F.contains("low", "part")).groupBy("part").agg(F.array_join(F.array_sort(F.collect_set("name")), ";").alias("suggestions"))
    return wanted.select(F.col(key), F.lower(part).alias("part")).join(held, "part", "left").select(key, "suggestions")
