"""Mixing sources to target weights along a time-varying curriculum.

DataFrame functions only. The training run is the interval 0 to 1. Each
source has a weight schedule over it; its integral is the source's weight in
the whole mix, and the running integral is its cumulative demand for words.
Documents of a source, in hashed order and repeated while the source's target
allows, stand where that demand reaches their place in the source.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import text_or_empty, written

#: Schedules at equally spaced times, linear between them. Their means are 5, 2 and 1.
CURRICULUM = ((4.0, 5.0, 6.0), (2.0, 2.0, 2.0), (1.5, 1.0, 0.5))

#: Documents that share a place in the two-level prefix sum, on average.
BUCKET_ROWS = 64
MOST_BUCKETS = 1 << 20


def word_count(column: str = "text") -> Column:
    """Runs of code points other than blank and the controls 9 to 13."""
    return F.regexp_count(text_or_empty(column), F.lit(r"[^\x20\x09-\x0D]+")).cast("long")


def _mean(schedule: Sequence[float]) -> float:
    return sum((a + b) / 2 for a, b in zip(schedule, schedule[1:])) / (len(schedule) - 1)


def source_targets(sized: DataFrame, curriculum: Sequence[Sequence[float]], cap: float) -> DataFrame:
    """place, source, n_docs, source_size, weight and target of each source.

    Sources stand by code point, null last, and take the schedules in turn.
    All sizes together are shared by weight; no target exceeds cap times its
    source, and what lies above is shared again by weight: each target is the
    smaller of its cap and level * weight, with one level for all.
    """
    weights = F.array(*[F.lit(_mean(s)) for s in curriculum])
    per_source = sized.groupBy("source").agg(F.count("*").alias("n_docs"), F.sum("size").alias("source_size"))
    every = Window.orderBy(F.col("source").asc_nulls_last())
    per_source = per_source.withColumn("place", F.row_number().over(every) - 1)
    per_source = per_source.withColumn("weight", F.get(weights, F.col("place") % len(curriculum)))
    limit = F.col("source_size") * F.lit(float(cap))
    filled = Window.orderBy(limit / F.col("weight"), "place")
    before = F.sum(limit).over(filled.rowsBetween(Window.unboundedPreceding, -1))
    behind = F.sum("weight").over(filled.rowsBetween(0, Window.unboundedFollowing))
    everything = F.sum("source_size").over(filled.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    level = (everything - F.coalesce(before, F.lit(0.0))) / behind
    per_source = per_source.withColumn("level", F.when(level <= limit / F.col("weight"), level))
    whole = filled.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    return per_source.withColumn("target", F.least(limit, F.max("level").over(whole) * F.col("weight"))).drop("level")


def _time(share: Column, place: Column, curriculum: Sequence[Sequence[float]]) -> Column:
    """When a source's schedule has asked for this share of its words."""
    found = F.lit(None).cast("double")
    for k, schedule in enumerate(curriculum):
        step = 1.0 / (len(schedule) - 1)
        ends = [0.0]
        for a, b in zip(schedule, schedule[1:]):
            ends.append(ends[-1] + (a + b) / 2 * step)
        asked = share * F.lit(ends[-1])
        at = F.lit(1.0)
        for i in reversed(range(len(schedule) - 1)):
            a, slope = schedule[i], (schedule[i + 1] - schedule[i]) / step
            rest = F.greatest(asked - F.lit(ends[i]), F.lit(0.0))
            root = F.sqrt(F.greatest(F.lit(a * a) + F.lit(2 * slope) * rest, F.lit(0.0)))
            inside = F.lit(i * step) + F.when(rest > 0, F.lit(2.0) * rest / (F.lit(a) + root)).otherwise(0.0)
            at = F.when(asked < F.lit(ends[i + 1]), inside).otherwise(at)
        found = F.when(place % len(curriculum) == k, at).otherwise(found)
    return F.least(found, F.lit(1.0))


def mix(df: DataFrame, curriculum: Sequence[Sequence[float]] = CURRICULUM, cap: int = 3, keep: Sequence[str] = ()) -> DataFrame:
    """One row for each document, sorted by its first position in the run.

    df needs doc_id, text and source; columns in `keep` come along, others do
    not. Returns doc_id, size, source_size, target, taken (size times
    repeats), repeats, position (of the first copy; null if none is taken)
    and positions (of all copies), then `keep`.

    A copy is taken if more than half of it lies below its source's target,
    so a source's words miss the target by half a document at most. Null
    texts have size 0; null sources are one source, the last; null ids sort
    as empty; equal rows may swap their counts. Empty tables give no rows.
    A hot source is summed by hash bucket before its documents are placed, so
    that no task holds a source.
    """
    spark = df.sparkSession
    sized = df.select("doc_id", "source", word_count().alias("size"), F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))).alias("order"), *[F.col(c).alias(f"kept_{c}") for c in keep])
    sized = written(sized, "mix-sized")
    targets = written(source_targets(sized, curriculum, float(cap)), "mix-targets")
    placed = sized.join(targets.select(F.col("source").alias("of"), "place", "n_docs", "source_size", "target"), F.col("source").eqNullSafe(F.col("of")), "left").drop("of", "source")
    buckets = F.least(F.ceil(F.col("n_docs") / BUCKET_ROWS), F.lit(MOST_BUCKETS))
    placed = placed.withColumn("bucket", F.shiftright(F.conv(F.substring("order", 1, 8), 16, 10).cast("long") * buckets, 32))
    sums = placed.groupBy("place", "bucket").agg(F.sum("size").alias("bucket_size"))
    ahead = Window.partitionBy("place").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select("place", "bucket", F.coalesce(F.sum("bucket_size").over(ahead), F.lit(0)).alias("bucket_start"))
    within = Window.partitionBy("place", "bucket").orderBy("order", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    placed = placed.withColumn("inside", F.coalesce(F.sum("size").over(within), F.lit(0)))
    placed = placed.join(sums, ["place", "bucket"])
    start = F.col("bucket_start") + F.col("inside")
    starts = [F.lit(copy) * F.col("source_size") + start for copy in range(cap)]
    fits = [(s + F.col("size") / F.lit(2.0) < F.col("target")) & (F.col("size") > 0) for s in starts]
    times = F.filter(F.array(*[F.when(f, _time(s / F.col("target"), F.col("place"), curriculum)) for s, f in zip(starts, fits)]), lambda x: x.isNotNull())
    out = placed.withColumn("positions", times).withColumn("repeats", F.size("positions"))
    out = out.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("repeats")).alias("taken"), "repeats", F.get("positions", F.lit(0)).alias("position"), "positions", *[F.col(f"kept_{c}").alias(c) for c in keep])
    return out.orderBy(F.col("position").asc_nulls_last(), "doc_id")


#: DuckDB's rendering of the contract's columns.
ORACLE = """
WITH sized AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+'))::BIGINT AS size,
         md5(coalesce(doc_id::VARCHAR, '')) AS ord FROM documents),
per_source AS (
  SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS place FROM sized GROUP BY source),
weighted AS (SELECT *, CASE place % 3 WHEN 0 THEN 5e0 WHEN 1 THEN 2e0 ELSE 1e0 END AS weight, 3e0 * source_size AS lim FROM per_source),
levels AS (
  SELECT *, ((SELECT sum(source_size) FROM weighted)
    - coalesce(sum(lim) OVER (ORDER BY lim / weight, place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0e0))
    / sum(weight) OVER (ORDER BY lim / weight, place ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM weighted),
targets AS (SELECT source, source_size, least(lim, (SELECT max(level) FROM levels WHERE level <= lim / weight) * weight) AS target FROM levels),
starts AS (
  SELECT s.doc_id, s.size, t.source_size, t.target,
    coalesce(sum(s.size) OVER (PARTITION BY s.source ORDER BY s.ord, s.doc_id, s.size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS start
  FROM sized s JOIN targets t ON s.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target,
  size * ((start + size / 2e0 < target)::INT + (source_size + start + size / 2e0 < target)::INT + (2 * source_size + start + size / 2e0 < target)::INT)::BIGINT AS taken
FROM starts
"""
