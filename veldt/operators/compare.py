"""Comparing two providers, and station coverage."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veldt.functions.stats import guarded_corr

from .survey import BROADACRE_ZONES

SPARSE_MOST = 2  # stations that still make a region sparse


def paired(ours: DataFrame, theirs: DataFrame, keys: list[str], variables: list[str]) -> DataFrame:
    """keys, variable, a, b: the days both sides have, long; a pair is dropped where either side is missing."""
    named = theirs.select(*keys, *[F.col(v).alias(f"{v}|b") for v in variables])
    both = ours.select(*keys, *variables).join(named, keys)
    rows = F.explode(F.array(*[F.struct(F.lit(v).alias("variable"), F.col(v).alias("a"), F.col(f"{v}|b").alias("b")) for v in variables]))
    return both.select(*keys, rows.alias("p")).select(*keys, "p.*").filter(F.col("a").isNotNull() & F.col("b").isNotNull())


def metrics(pairs: DataFrame, key: str) -> DataFrame:
    """n, bias, rmse and r by key and variable, and by variable alone (key NULL): one pass over grouping sets."""
    d = F.col("a") - F.col("b")
    found = pairs.groupingSets([[F.col(key), F.col("variable")], [F.col("variable")]], key, "variable").agg(
        F.count("*").alias("n"), F.avg(d).alias("bias"), F.sqrt(F.avg(d * d)).alias("rmse"), guarded_corr(F.col("a"), F.col("b"), 2).alias("r"), F.grouping_id().alias("pooled_level")
    )
    return found.withColumn("pooled", F.col("pooled_level") > 0).drop("pooled_level")


def region_coverage(stations: DataFrame, regions: DataFrame, sparse: int = SPARSE_MOST) -> DataFrame:
    """Available and unavailable stations of every region, with flags for broadacre regions that have none or few."""
    counts = stations.filter(F.col("aagis_code").isNotNull()).groupBy("aagis_code").agg(F.count_if("available").cast("int").alias("n_available"), F.count_if(~F.col("available")).cast("int").alias("n_unavailable"))
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    found = regions.select("aagis_code", "region_name", "zone").join(counts, "aagis_code", "left").select("aagis_code", "region_name", "zone", zero("n_available"), zero("n_unavailable"))
    broad = F.coalesce(F.col("zone").isin(*BROADACRE_ZONES), F.lit(False))
    n = F.col("n_available")
    return found.withColumns({"n_total": n + F.col("n_unavailable"), "is_broadacre": broad, "no_station": broad & (n == 0), "sparse": broad & (n > 0) & (n <= sparse)}).orderBy(F.desc("is_broadacre"), "n_available", "aagis_code")


def coverage_summary(coverage: DataFrame) -> DataFrame:
    return coverage.agg(F.count("*").alias("n_regions"), F.sum("n_available").alias("n_available"), F.sum("n_unavailable").alias("n_unavailable"), F.count_if("no_station").alias("n_no_station"), F.count_if("sparse").alias("n_sparse"))


def reference_check(regions: DataFrame, reference: DataFrame, temperature: float = 3.0, rain_percent: float = 45.0) -> DataFrame:
    """Region climate against station normals (aagis_code, ref_max, ref_min, ref_rain), with tolerance flags; values to one place."""
    both = regions.join(reference, "aagis_code")
    dmax, dmin = F.col("max_temp") - F.col("ref_max"), F.col("min_temp") - F.col("ref_min")
    drain = F.lit(100.0) * F.try_divide(F.col("daily_rain") - F.col("ref_rain"), F.col("ref_rain"))
    return both.select(
        "aagis_code",
        F.bround(dmax, 1).alias("d_max_temp"),
        F.bround(dmin, 1).alias("d_min_temp"),
        F.bround(drain, 1).alias("d_rain_percent"),
        ((F.abs(dmax) <= temperature) & (F.abs(dmin) <= temperature)).alias("temperature_ok"),
        (F.abs(drain) <= rain_percent).alias("rain_ok"),
    )
