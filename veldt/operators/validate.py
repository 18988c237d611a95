"""Checks as tables: each returns rows of check, ok and detail, and raises only where it says so."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veldt.functions.scalars import state_of
from veldt.functions.stats import guarded_corr

from .sets import missing_from, orphans
from .spatial import assign_regions


def report(df: DataFrame, checks: dict[str, Column]) -> DataFrame:
    """Aggregate conditions over df in one pass, as rows (check, ok); an undecided condition is not ok."""
    one = df.agg(*[F.coalesce(c, F.lit(False)).alias(f"c{i}") for i, c in enumerate(checks.values())])
    return one.select(F.explode(F.array(*[F.struct(F.lit(name).alias("check"), F.col(f"c{i}").alias("ok")) for i, name in enumerate(checks)])).alias("r")).select("r.*")


def none_in(df: DataFrame, check: str) -> DataFrame:
    """A row (check, ok) that is ok if df is empty; at most one row of df is read."""
    return df.limit(1).agg((F.count("*") == 0).alias("ok")).select(F.lit(check).alias("check"), "ok")


def region_mapping(mapping: DataFrame, names: DataFrame, regions: int = 32) -> DataFrame:
    """Seven checks of a region mapping (aagis_code, region_name[, alt_code]) against survey names (region)."""
    code, name = F.col("aagis_code"), F.col("region_name")
    alt = F.col("alt_code") if "alt_code" in mapping.columns else code
    checks = report(
        mapping,
        {
            "row_count_ok": F.count("*") == regions,
            "codes_unique": F.countDistinct(code) == F.count("*"),
            "codes_well_formed": F.count_if(~F.coalesce(code.rlike("^[0-9]{3}$"), F.lit(False))) == 0,
            "names_unique": F.countDistinct(name) == F.count("*"),
            "code_redundancy_ok": F.count_if(~alt.eqNullSafe(code)) == 0,
            "state_prefix_ok": F.count_if(~F.coalesce(name.startswith(state_of(code)), F.lit(False))) == 0,
        },
    )
    return checks.unionByName(none_in(orphans(mapping.select(name.alias("region")), names, "region"), "zero_orphans"))


def internal_consistency(regions: DataFrame, least_max: float = 0.85, least_min: float = 0.80) -> DataFrame:
    """No gaps, positive rain, temperature rising with latitude towards the equator, and winter or summer rain where it is expected (column regime)."""
    expected = F.when(F.col("regime") == "winter", F.col("winter_share") > F.col("summer_share")).when(F.col("regime") == "summer", F.col("summer_share") > F.col("winter_share")).otherwise(True)
    missing = F.col("max_temp").isNull() | F.col("min_temp").isNull() | F.col("daily_rain").isNull()
    return report(
        regions,
        {
            "no_missing": F.count_if(missing) == 0,
            "rain_positive": F.bool_and(F.col("daily_rain") > 0),
            "max_temp_follows_latitude": guarded_corr(F.col("lat"), F.col("max_temp"), 3) >= least_max,
            "min_temp_follows_latitude": guarded_corr(F.col("lat"), F.col("min_temp"), 3) >= least_min,
            "seasonality_as_expected": F.bool_and(expected),
        },
    )


def full_record(series: DataFrame, regions: int, first: int, last: int) -> DataFrame:
    """Checks of annual series (aagis_code, year, variable, value)."""
    by_region = series.filter(F.col("variable").isin("max_temp", "min_temp")).groupBy("aagis_code", "year").agg((F.max(F.when(F.col("variable") == "max_temp", F.col("value"))) > F.max(F.when(F.col("variable") == "min_temp", F.col("value")))).alias("above"))
    checks = report(
        series,
        {
            "regions": F.countDistinct("aagis_code") == regions,
            "year_range": (F.min("year") == first) & (F.max("year") == last),
            "no_missing": F.count_if(F.col("value").isNull()) == 0,
            "rain_not_negative": F.bool_and(F.when(F.col("variable") == "daily_rain", F.col("value") >= 0).otherwise(True)),
        },
    )
    return checks.unionByName(report(by_region, {"tmax_gt_tmin": F.bool_and("above")}))


def subset(part: DataFrame, whole: DataFrame, columns: list[str], check: str) -> DataFrame:
    return none_in(missing_from(part, whole, columns), check)


def required(df: DataFrame, checks: DataFrame, what: str) -> DataFrame:
    """df, if every check (check, ok) holds; else the query fails and names those that don't. An undecided check doesn't hold.

    The gate is a branch of a union without rows, so it is tried also where df is empty.
    """
    failed = F.sort_array(F.collect_list(F.when(~F.coalesce("ok", F.lit(False)), F.col("check"))))  # as many as checks
    message = F.concat(F.lit(f"{what}: "), F.array_join("failed", ", "))
    gate = checks.agg(failed.alias("failed")).select(F.when(F.size("failed") > 0, F.raise_error(message)).cast("int").alias("gate"))
    none = [F.lit(None).cast(f.dataType).alias(f.name) for f in df.schema.fields]
    return df.union(gate.filter(F.col("gate").isNotNull()).select(*none))


def grid_shape(cells: DataFrame, rows: int, cols: int) -> DataFrame:
    """cells, if they make a grid of this many latitudes and longitudes; the query fails if not."""
    shape = {"latitudes": F.countDistinct("lat") == rows, "longitudes": F.countDistinct("lon") == cols}
    return required(cells, report(cells, shape), "grid shape differs")


def alignment(kept: DataFrame, mask: DataFrame, within: float = 0.01, degrees: float = 1.0) -> DataFrame:
    """Whether masked data have the mask's number of cells (within a share) and mean latitude (within degrees); a mask without cells fails both."""
    a = kept.agg(F.count("*").alias("n"), F.avg("lat").alias("lat"))
    b = mask.agg(F.count("*").alias("mask_n"), F.avg("lat").alias("mask_lat"))
    some = F.col("mask_n") > 0
    return report(a.crossJoin(b), {"count_ok": F.max(some & (F.abs(F.col("n") - F.col("mask_n")) <= within * F.col("mask_n"))), "latitude_ok": F.max(some & (F.abs(F.col("lat") - F.col("mask_lat")) <= degrees))})


def aligned(kept: DataFrame, mask: DataFrame, within: float = 0.01, degrees: float = 1.0) -> DataFrame:
    """kept, if it lies as the mask does; the query fails if cells were lost or moved, as by a grid turned upside down."""
    return required(kept, alignment(kept, mask, within, degrees), "masked cells differ from the mask")


def monotone_thresholds(cells: DataFrame, levels: list[str]) -> DataFrame:
    """check, violations, ok: cells over a threshold that are not over the next lower one; levels ascend."""
    counts = cells.agg(*[F.count_if(F.col(b) & ~F.col(a)).alias(f"{b}_subset_of_{a}") for a, b in zip(levels, levels[1:])])
    rows = counts.unpivot([], counts.columns, "check", "violations")
    return rows.withColumn("ok", F.col("violations") == 0)


def conservation(coarse: DataFrame, fine_pixels: DataFrame, pixel_km2: float, tolerance_pct: float = 5.0) -> DataFrame:
    """computed_area_km2, expected_area_km2, relative_diff_pct, ok: whether a coarse area (area_km2) keeps that of the fine pixels (rows of fine_pixels)."""
    fine = fine_pixels.agg((F.count("*") * F.lit(float(pixel_km2))).alias("expected_area_km2"))
    both = coarse.agg(F.sum("area_km2").alias("computed_area_km2")).crossJoin(fine)
    share = F.try_divide(F.lit(100.0) * F.abs(F.col("computed_area_km2") - F.col("expected_area_km2")), F.col("expected_area_km2"))
    return both.withColumn("relative_diff_pct", share).withColumn("ok", F.coalesce(F.col("relative_diff_pct") <= tolerance_pct, F.lit(False)))


def cells_by_region(cells: DataFrame, rings: DataFrame, least: int = 50, code: str = "aagis_code") -> DataFrame:
    """code, cells, ok: how many cells (lat, lon) lie in each region, and whether that is enough; regions without cells count 0."""
    inside = assign_regions(cells, rings, "inner", code=code).groupBy(code).agg(F.count("*").alias("cells"))
    counted = rings.select(code).distinct().join(inside, code, "left").select(code, F.coalesce("cells", F.lit(0)).alias("cells"))
    return counted.withColumn("ok", F.col("cells") >= least)


#: How many regions the boundaries may have, and the zones they lie in. Fixed values.
REGION_COUNT, ZONES = (28, 38), ("Pastoral", "Wheat Sheep", "High Rainfall")


def region_boundaries(regions: DataFrame, zones: tuple[str, ...] = ZONES, count: tuple[int, int] = REGION_COUNT) -> DataFrame:
    """zone, n_regions, expected: the zones of the regions, and the expected ones that none lies in.

    A NULL zone is a zone of its own that nobody expects. The query fails if
    there are fewer or more regions than count says.
    """
    spark = regions.sparkSession
    wanted = spark.createDataFrame([(z,) for z in zones], "wanted string")
    found = regions.groupBy("zone").agg(F.count("*").alias("n_regions")).join(wanted, F.col("zone").eqNullSafe(F.col("wanted")), "full")
    rows = found.select(F.coalesce("zone", "wanted").alias("zone"), F.coalesce("n_regions", F.lit(0)).alias("n_regions"), F.col("wanted").isNotNull().alias("expected"))
    return required(rows, report(regions, {f"between {count[0]} and {count[1]} regions": F.count("*").between(*count)}), "unexpected boundaries")


def in_range(df: DataFrame, column: str, low: float, high: float, check: str) -> DataFrame:
    """Whether all values present lie strictly between two bounds."""
    v = F.col(column)
    return report(df, {check: F.count_if((v <= low) | (v >= high)) == 0})


def spei_gates(params: DataFrame, values: DataFrame) -> DataFrame:
    """At least 80 % of fits with beta above 1; mean within 0.5 of 0 and spread between 0.5 and 1.5 over the baseline."""
    share = F.try_divide(F.count_if(F.col("beta") > 1).cast("double"), F.count("*"))
    return report(params, {"beta_share": share >= 0.8}).unionByName(report(values, {"mean": F.abs(F.avg("spei")) <= 0.5, "spread": (F.stddev_pop("spei") > 0.5) & (F.stddev_pop("spei") < 1.5)}))


def station_file(lines: DataFrame, size: int, least_bytes: int = 100, least_rows: int = 100) -> DataFrame:
    """Size, number of rows and ISO dates of a station's text lines (value)."""
    row = F.col("value").rlike(r"^[0-9]{4}-[0-9]{2}-[0-9]{2},")
    return report(lines, {"bytes": F.lit(size >= least_bytes) & (F.count("*") >= 0), "rows": F.count_if(row) >= least_rows, "iso_dates": F.count_if(row) >= F.count_if(F.col("value").rlike(r"^[0-9]")) })
