"""Survey, census and yield operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veldt.functions.stats import coefficient_of_variation, detrended, detrended_cv, guarded_corr, slope

#: Fixed values.
BROADACRE_ZONES = ("Wheat Sheep", "High Rainfall")
RELIABLE_FROM = {"wheat": 1990, "barley": 1990, "canola": 1994}
MIN_YEARS, HIGH_RSE = 10, 30.0
TOLERANCE, RSE_GATE, N_REGIONS = 0.05, 20.0, 32
EVENTS = {"Millennium Drought (2001-2009)": tuple(range(2001, 2010)), "2018 drought": (2018, 2019), "2013/2017 heat": (2013, 2017)}


def wide(long: DataFrame, keys: list[str], column: str, value: str, names: list[str]) -> DataFrame:
    """One column for each name, the first value present; rows without any value disappear."""
    return long.filter(F.col(value).isNotNull()).groupBy(*keys).pivot(column, names).agg(F.first(value, ignorenulls=True))


def commodity_panel(long: DataFrame, area: str, production: str) -> DataFrame:
    """Schema COMMODITY from the long survey table: values and relative standard errors in one pivot, yield where the area is positive."""
    pick = lambda v, c: F.max(F.when(F.col("variable") == v, F.col(c)))
    one = long.filter(F.col("variable").isin(area, production) & F.col("value").isNotNull())
    panel = one.groupBy("region", "year").agg(pick(area, "value").alias("area_ha"), pick(production, "value").alias("production_t"), pick(area, "rse").alias("area_rse"), pick(production, "rse").alias("production_rse"))
    ratio = F.when(F.col("area_ha") > 0, F.col("production_t") / F.col("area_ha"))
    return panel.select("region", "year", "area_ha", "production_t", ratio.alias("yield_t_ha"), "area_rse", "production_rse")


def region_totals(per_farm: DataFrame, population: DataFrame) -> DataFrame:
    """Per-farm averages times the population of farms; without a population the total is NULL, never 0."""
    joined = per_farm.join(population.select("region", "year", "population"), ["region", "year"], "left")
    return joined.select("region", "year", "population", (F.col("area_ha") * F.col("population")).alias("area_total_ha"), (F.col("production_t") * F.col("population")).alias("production_total_t"), "yield_t_ha")


def national_totals(per_farm: DataFrame, population: DataFrame) -> DataFrame:
    """year, national_total_t, national_rse of the national per-farm series (year, production_t, production_rse)."""
    total = F.col("production_t") * F.col("population")
    return per_farm.join(population, "year").withColumn("national_total_t", total).filter(F.col("national_total_t").isNotNull()).select("year", "national_total_t", F.col("production_rse").alias("national_rse"))


def reconstruction(totals: DataFrame, national: DataFrame, tolerance: float = TOLERANCE, gate: float = RSE_GATE, regions: int = N_REGIONS) -> DataFrame:
    """A row for each year: regional sum against the national total, and whether the year is graded and within tolerance."""
    sums = totals.filter(F.col("production_total_t").isNotNull()).groupBy("year").agg(F.sum("production_total_t").alias("region_sum_t"), F.countDistinct("region").cast("int").alias("n_regions"))
    years = sums.join(national, "year").withColumn("rel_error", F.abs(F.try_divide(F.col("region_sum_t") - F.col("national_total_t"), F.col("national_total_t"))))
    years = years.withColumns({"full_coverage": F.col("n_regions") == regions, "reliable": F.coalesce(F.col("national_rse") <= gate, F.lit(False))})
    return years.withColumn("graded", F.col("full_coverage") & F.col("reliable")).withColumn("within", F.coalesce(F.col("rel_error") <= tolerance, F.lit(False)))


def reconstruction_verdict(years: DataFrame) -> DataFrame:
    """One row: valid if some year is graded and all graded ones are within tolerance."""
    graded = F.when(F.col("graded"), F.col("within"))
    return years.agg(
        (F.count(graded) > 0).alias("any_graded"),
        (F.coalesce(F.bool_and(graded), F.lit(False))).alias("valid"),
        F.count(graded).alias("n_graded_years"),
        F.max(F.when(F.col("graded"), F.col("rel_error"))).alias("worst_rel_error"),
        F.count_if(~F.col("full_coverage")).alias("n_partial_years"),
        F.count_if(F.col("full_coverage") & ~F.col("reliable")).alias("n_high_rse_years"),
    ).drop("any_graded")


def regional_against_national(regional: DataFrame, national: DataFrame) -> DataFrame:
    """Plain sums of regional values against national ones by year; a year without any value has a NULL sum."""
    sums = regional.groupBy("year").agg(F.sum("value").alias("regional_sum"))
    return sums.join(national, "year").withColumn("ratio", F.try_divide(F.col("regional_sum"), F.col("national_value")))


def yield_summary(panel: DataFrame, keys: list[str], min_years: int = MIN_YEARS) -> DataFrame:
    """Twelve descriptive statistics of each series of yields (year, yield_t_ha, production_rse)."""
    v, y = F.col("yield_t_ha"), F.col("year")
    base = detrended(panel, keys, "year", "yield_t_ha", "resid")
    stats = base.groupBy(*keys).agg(
        F.count("*").cast("int").alias("n_years"),
        F.avg(v).alias("mean_yield"),
        F.median(v).alias("median_yield"),
        (F.lit(10.0) * slope(y, v)).alias("trend_t_ha_decade"),
        coefficient_of_variation(v).alias("cv"),
        detrended_cv(F.col("resid"), v).alias("detrended_cv"),
        F.percentile(v, F.lit(0.1)).alias("p10_yield"),
        F.min(v).alias("min_yield"),
        F.median("production_rse").alias("median_prod_rse"),
    )
    median = F.nullif(F.col("median_yield"), F.lit(0.0))
    return stats.withColumns({"p10_over_median": F.try_divide(F.col("p10_yield"), median), "worst_over_median": F.try_divide(F.col("min_yield"), median), "adequate": F.col("n_years") >= min_years}).drop("min_yield")


def availability(ratios: DataFrame, broadacre: DataFrame, min_years: int = MIN_YEARS) -> DataFrame:
    """Years, median yield and median error of each region, with broadacre and adequate flags."""
    found = ratios.groupBy("region").agg(F.countDistinct("year").cast("int").alias("n_years"), F.median("yield_t_ha").alias("median_yield"), F.median("production_rse").alias("median_prod_rse"))
    flags = broadacre.select("region", F.lit(True).alias("broadacre")).distinct()
    return found.join(flags, "region", "left").withColumns({"broadacre": F.coalesce("broadacre", F.lit(False)), "adequate": F.col("n_years") >= min_years})


def build_panel(yields: DataFrame, climate: DataFrame, key: str = "region") -> DataFrame:
    """Yields and climate of each region and year, with each series' residual from its trend."""
    panel = yields.join(climate, [key, "year"])
    for value, name in (("yield_t_ha", "resid_yield"), ("rain", "resid_rain"), ("tmax", "resid_tmax")):
        panel = detrended(panel, [key], "year", value, name)
    return panel


def linkage(panel: DataFrame, key: str = "region") -> DataFrame:
    """Correlations of residuals and the variability of rain (sample) and yield (about its trend)."""
    return panel.groupBy(key).agg(
        F.count("*").cast("int").alias("n_years"),
        guarded_corr(F.col("resid_yield"), F.col("resid_rain")).alias("corr_detr_rain_yield"),
        guarded_corr(F.col("resid_yield"), F.col("resid_tmax")).alias("corr_detr_tmax_yield"),
        coefficient_of_variation(F.col("rain"), sample=True).alias("rain_cv"),
        detrended_cv(F.col("resid_yield"), F.col("yield_t_ha")).alias("yield_detrended_cv"),
    )


def event_summary(panel: DataFrame, events: dict[str, tuple[int, ...]] = EVENTS) -> DataFrame:
    """Mean residual in each event's years, and in the years of none; every event has a row.

    One pass: events become array elements of a row, not joins.
    """
    flags = {name: F.col("year").isin(*years) for name, years in events.items()}
    none = ~F.coalesce(F.array_contains(F.array(*flags.values()), True), F.lit(False))
    picks: dict[str, Column] = flags | {"non-event": none}
    agg = []
    for i, cond in enumerate(picks.values()):
        agg += [F.count_if(cond).cast("int").alias(f"n{i}"), F.avg(F.when(cond, F.col("resid_yield"))).alias(f"m{i}")]
    rows = F.array(*[F.struct(F.lit(name).alias("event"), F.col(f"n{i}").alias("region_years"), F.col(f"m{i}").alias("mean_resid_yield")) for i, name in enumerate(picks)])
    return panel.agg(*agg).select(F.explode(rows).alias("e")).select("e.*")


def class_shares(codes: DataFrame, code: str) -> DataFrame:
    """Histogram of class codes with each one's share of all non-missing values."""
    counted = codes.filter(F.col(code).isNotNull()).groupBy(code).agg(F.count("*").alias("n"))
    total = counted.agg(F.sum("n").alias("total"))
    return counted.crossJoin(F.broadcast(total)).select(code, "n", F.try_divide(F.col("n").cast("double"), F.col("total")).alias("fraction"))


#: Classes of land-use codes: dryland cropping, irrigated cropping, land in transition. Fixed values.
CODE_CLASSES = {"dryland": (330, 338), "irrigated": (430, 439), "transition": (360, 365)}


def class_fractions(codes: DataFrame, code: str, classes: dict[str, tuple[int, int]] = CODE_CLASSES) -> DataFrame:
    """Share of each group of codes (inclusive ranges) among non-missing values."""
    n = F.count(code)
    return codes.agg(*[F.try_divide(F.count_if(F.col(code).between(a, b)).cast("double"), n).alias(name) for name, (a, b) in classes.items()])
