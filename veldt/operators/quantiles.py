"""Exact percentiles of groups of any size: distributed selection by histograms."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from veldt.sources.scratch import written

#: Bins of a histogram, rows of a span that is sorted rather than cut again, and rounds of cutting at most.
BINS, SORTED_ROWS, ROUNDS = 1024, 100_000, 64


def _matched(rows: DataFrame, spans: DataFrame, keys: Sequence[str]) -> DataFrame:
    """rows with the span of their group that holds them; NULL is a group like any other."""
    named = spans.withColumnsRenamed({k: f"span_{k}" for k in keys})
    same = [F.col(k).eqNullSafe(F.col(f"span_{k}")) for k in keys]
    inside = F.col("v").between(F.col("lo"), F.col("hi"))
    return rows.join(named, [*same, inside]).drop(*[f"span_{k}" for k in keys])


def _narrowed(spans: DataFrame, parts: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Each rank's span replaced by the part that holds the rank; parts follow each other by `order`."""
    of = [*keys, "lo", "hi"]
    upto = F.sum("n").over(Window.partitionBy(*of).orderBy("order").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    placed = parts.withColumn("first", F.col("below") + upto - F.col("n")).select(*[F.col(c).alias(f"of_{c}") for c in of], "first", F.col("n").alias("part_n"), "part_lo", "part_hi")
    same = [F.col(c).eqNullSafe(F.col(f"of_{c}")) for c in of]
    holds = (F.col("rank") >= F.col("first")) & (F.col("rank") < F.col("first") + F.col("part_n"))
    return spans.join(placed, [*same, holds]).select(*keys, "rank", F.col("part_lo").alias("lo"), F.col("part_hi").alias("hi"), F.col("first").alias("below"), F.col("part_n").alias("n"))


def _share() -> Column:
    """Where v lies between lo and hi, from 0 to 1, never falling: by the logarithm where these are of different magnitudes, so that few rounds settle values far apart."""
    v, lo, hi = (F.col(c) for c in ("v", "lo", "hi"))
    size = lambda x: F.when(F.abs(x) > 1e-300, F.signum(x) * F.least(F.ln(F.abs(x)) + 691.0, F.lit(1500.0))).otherwise(0.0)
    even = (v / 2 - lo / 2) / (hi / 2 - lo / 2)
    return F.when(size(hi) - size(lo) < 3, even).otherwise((size(v) - size(lo)) / (size(hi) - size(lo)))


def group_percentiles(df: DataFrame, keys: Sequence[str], value: Column, fractions: Mapping[str, float]) -> DataFrame:
    """keys, and a column for each fraction: the exact percentile of a group's values, interpolated between neighbours.

    NULL and NaN values are passed over; groups without other values have no
    row; a NULL key is a group. No task holds a group: each rank begins with
    the span of its group's values, a histogram tells which bin of the span
    holds it, and that bin is the next span, until few rows are left, or one
    value. Only these are sorted. The values are written once and read in
    each round; the spans are as many as groups times ranks.
    """
    keys = list(keys)
    number = value.cast("double")
    rows = written(df.select(*keys, number.alias("v")).filter("v IS NOT NULL AND NOT isnan(v)"), "values")
    groups = rows.groupBy(*keys).agg(F.count("*").alias("n"), F.min("v").alias("lo"), F.max("v").alias("hi"))
    places = [(F.col("n") - 1) * F.lit(float(p)) for p in fractions.values()]
    ranks = F.array_distinct(F.flatten(F.array(*[F.array(F.floor(p), F.ceil(p)) for p in places])))
    spans = written(groups.select(*keys, F.explode(ranks).alias("rank"), "lo", "hi", F.lit(0).cast("long").alias("below"), "n"), "spans")
    still = F.col("lo") < F.col("hi")
    for round_ in range(ROUNDS + 1):
        most = spans.filter(still).agg(F.max("n")).first()[0]
        if most is None:
            break
        open_spans = spans.filter(still)
        met = _matched(rows, open_spans.select(*keys, "lo", "hi", "below").distinct(), keys)
        if most <= SORTED_ROWS or round_ == ROUNDS:
            parts = met.groupBy(*keys, "lo", "hi", "below", F.col("v").alias("order")).agg(F.count("*").alias("n")).withColumns({"part_lo": F.col("order"), "part_hi": F.col("order")})
        else:
            bin_ = F.least(F.floor(_share() * BINS), F.lit(BINS - 1)).alias("order")
            parts = met.groupBy(*keys, "lo", "hi", "below", bin_).agg(F.count("*").alias("n"), F.min("v").alias("part_lo"), F.max("v").alias("part_hi"))
        spans = written(spans.filter(~still).unionByName(_narrowed(open_spans, parts, keys)), "spans")
    found = spans.select(*[F.col(k).alias(f"of_{k}") for k in keys], "rank", F.col("lo").alias("found"))
    same = [F.col(k).eqNullSafe(F.col(f"of_{k}")) for k in keys]
    at = lambda rank: F.max(F.when(F.col("rank") == rank, F.col("found")))
    below, above = (lambda p: at(F.floor(p))), (lambda p: at(F.ceil(p)))
    between = lambda p: F.when(below(p) == above(p), below(p)).otherwise(below(p) + (above(p) - below(p)) * (F.max(p) - F.max(F.floor(p))))
    return groups.select(*keys, "n").join(found, same).groupBy(*keys).agg(*[between(p).alias(name) for name, p in zip(fractions, places)])
