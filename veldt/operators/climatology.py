"""Reductions over time, and area-weighted region means."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veldt.functions.stats import weighted_mean

#: How each variable is reduced over time. Fixed values.
RULES = {"daily_rain": "sum", "max_temp": "mean", "min_temp": "mean", "vp": "mean", "radiation": "mean", "evap_pan": "mean"}
#: The first year of variables that begin after the others. Fixed values.
EFFECTIVE_FROM = {"evap_pan": 1970}


def region_means(cells: DataFrame, keys: list[str], value: str = "value", weight: str = "weight") -> DataFrame:
    """value and n_cells by keys: missing cells are dropped first, so a group without any disappears; zero weight gives NULL."""
    present = cells.filter(F.col(value).isNotNull())
    for k in keys:
        present = present.filter(F.col(k).isNotNull())
    return present.groupBy(*keys).agg(weighted_mean(F.col(value), F.col(weight)).alias("value"), F.count("*").cast("int").alias("n_cells"))


def indicator_means(regions: DataFrame, cells: DataFrame, keys: list[str], value: str, name: str, weight: str = "weight") -> DataFrame:
    """As region_means, but every row of `regions` stays, with NULL where no cell has a value."""
    means = cells.groupBy(*keys).agg(weighted_mean(F.col(value), F.col(weight)).alias(name))
    return regions.join(means, keys, "left")


def unpivoted(obs: DataFrame, variables: list[str]) -> DataFrame:
    return obs.unpivot(["cell_id", "date"], variables, "variable", "value")


def monthly_parts(obs: DataFrame, variables: list[str]) -> DataFrame:
    """cell_id, year, month and variable with total and n: what every longer reduction is made of, in one pass."""
    by = obs.groupBy("cell_id", F.year("date").alias("year"), F.month("date").alias("month"))
    parts = by.agg(*[e for v in variables for e in (F.sum(v).alias(f"{v}|total"), F.count(v).alias(f"{v}|n"))])
    stacked = F.explode(F.array(*[F.struct(F.lit(v).alias("variable"), F.col(f"{v}|total").alias("total"), F.col(f"{v}|n").alias("n")) for v in variables]))
    return parts.select("cell_id", "year", "month", stacked.alias("p")).select("cell_id", "year", "month", "p.variable", "p.total", "p.n")


def reduced(total: Column, n: Column, rules: dict[str, str] = RULES) -> Column:
    """Sum or mean over time as the variable's rule says; NULL without any value."""
    summed = [v for v, rule in rules.items() if rule == "sum"]
    return F.when(F.col("variable").isin(*summed), total).otherwise(F.try_divide(total, n))


def annual(parts: DataFrame, effective_from: dict[str, int] = EFFECTIVE_FROM) -> DataFrame:
    """cell_id, variable, year and value from monthly parts; years before a variable's first are left out."""
    late = F.lit(False)
    for variable, first in effective_from.items():
        late = late | ((F.col("variable") == variable) & (F.col("year") < first))
    return parts.filter(~late).groupBy("cell_id", "variable", "year").agg(reduced(F.sum("total"), F.sum("n")).alias("value"))


def monthly_climatology(parts: DataFrame) -> DataFrame:
    """cell_id, variable, month and value: each month reduced, then averaged over the years."""
    months = parts.withColumn("value", reduced(F.col("total"), F.col("n")))
    return months.groupBy("cell_id", "variable", "month").agg(F.avg("value").alias("value"))


def baselines(series: DataFrame, periods: DataFrame, keys: list[str]) -> DataFrame:
    """Mean and number of years of annual values in each period (baseline, first, last); periods may overlap."""
    years = periods.select("baseline", F.explode(F.sequence("first", "last")).alias("year"))
    inside = series.join(years, "year")
    return inside.groupBy(*keys, "baseline").agg(F.avg("value").alias("mean_value"), F.countDistinct("year").cast("int").alias("n_years"))


def seasonal_share(months: DataFrame, keys: list[str], value: str, wanted: tuple[int, ...], name: str) -> DataFrame:
    """Percent of a year's total in the wanted months."""
    part = F.sum(F.when(F.col("month").isin(*wanted), F.col(value)))
    return months.groupBy(*keys).agg(F.try_divide(F.lit(100.0) * part, F.nullif(F.sum(value), F.lit(0.0))).alias(name))
