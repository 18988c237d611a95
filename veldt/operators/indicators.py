"""Drought, heat, growing-season and frost indicators of each cell."""

from __future__ import annotations

import math
from dataclasses import dataclass
from datetime import date

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from veldt.functions.scalars import clip, daily_gdd, excess_heat, fisk_cdf, gamma_cdf, month_index, normal_quantile_sql, season_year
from veldt.functions.stats import strict_sum, thom_shape, zero_probability

from .timeseries import longest_run, range_mean, rolling_sum


@dataclass(frozen=True)
class GrowingWindow:
    label: str
    months: tuple[int, ...]
    next_year_months: tuple[int, ...] = ()

    @property
    def cross_year(self) -> bool:
        return bool(self.next_year_months)

    def year_of(self, date: Column) -> Column:
        return season_year(date, self.months, self.next_year_months)


#: Fixed values.
GROWING_WINDOWS = {
    "southern_winter": GrowingWindow("southern_winter", (4, 5, 6, 7, 8, 9, 10)),
    "qld_summer": GrowingWindow("qld_summer", (9, 10, 11, 12), (1, 2)),
}
CDF_EDGE = 1e-6


def in_season(daily: DataFrame, window: GrowingWindow) -> DataFrame:
    """Days of the window with season_year; a season that reaches into a year without data is left out."""
    days = daily.withColumn("season_year", window.year_of(F.col("date"))).filter(F.col("season_year").isNotNull())
    if window.cross_year:
        ends = daily.agg(F.max(F.year("date")).alias("last_year"))
        days = days.join(F.broadcast(ends), F.col("season_year") < F.col("last_year")).drop("last_year")
    return days


def monthly_totals(daily: DataFrame, value: str, name: str) -> DataFrame:
    """Totals of calendar months; NULL if any day of the month is missing, as a value or as a row."""
    by = daily.groupBy("cell_id", F.year("date").alias("year"), F.month("date").alias("month"))
    whole = F.count(value) == F.dayofmonth(F.last_day(F.max("date")))
    out = by.agg(F.when(whole, F.sum(value)).alias(name))
    return out.withColumn("month_index", F.col("year") * 12 + F.col("month"))


def water_balance(daily: DataFrame, rain: str = "daily_rain", evap: str = "evap_pan") -> DataFrame:
    """Monthly rain less evaporation; both in one pass."""
    by = daily.groupBy("cell_id", F.year("date").alias("year"), F.month("date").alias("month"))
    days = F.dayofmonth(F.last_day(F.max("date")))
    total = lambda c: F.when(F.count(c) == days, F.sum(c))
    return by.agg((total(rain) - total(evap)).alias("balance")).withColumn("month_index", F.col("year") * 12 + F.col("month"))


def accumulated(months: DataFrame, value: str, k: int) -> DataFrame:
    return rolling_sum(months, ["cell_id"], "month_index", value, k, "accumulated").filter(F.col("accumulated").isNotNull())


def fit_spi(months: DataFrame, value: str, k: int, first: int, last: int) -> DataFrame:
    """cell_id, month, shape, scale, prob_zero of each calendar month's k-month totals.

    The series starts with the baseline, so its first k - 1 months have no total.
    """
    base = accumulated(months.filter(F.col("year").between(first, last)), value, k)
    x = F.col("accumulated")
    fitted = base.groupBy("cell_id", "month").agg(thom_shape(x).alias("shape"), F.avg(F.when(x > 0, x)).alias("wet_mean"), zero_probability(x).alias("prob_zero"))
    return fitted.select("cell_id", "month", "shape", (F.col("wet_mean") / F.col("shape")).alias("scale"), "prob_zero")


def spi(months: DataFrame, params: DataFrame, value: str, k: int) -> DataFrame:
    """Standardised precipitation index of every month that has k months of totals and a fit."""
    x = F.col("accumulated")
    cdf = gamma_cdf(x, F.col("shape"), F.col("scale"))
    mixed = F.when(x <= 0, F.col("prob_zero")).otherwise(F.col("prob_zero") + (F.lit(1.0) - F.col("prob_zero")) * cdf)
    p = clip(F.when(F.col("shape").isNotNull(), mixed), CDF_EDGE, 1 - CDF_EDGE)
    return _standardised(accumulated(months, value, k).join(params, ["cell_id", "month"]), p, "spi")


def fit_spei(months: DataFrame, value: str, k: int, first: int, last: int) -> DataFrame:
    """cell_id, month, alpha, beta, gamma of log-logistic fits by probability-weighted moments.

    NULL below 6 values, for a vanishing denominator, for beta <= 1 or alpha <= 0.
    """
    base = accumulated(months.filter(F.col("year").between(first, last)), value, k)
    ranked = Window.partitionBy("cell_id", "month").orderBy("accumulated", "year")
    f = (F.row_number().over(ranked) - F.lit(0.35)) / F.count("*").over(Window.partitionBy("cell_id", "month"))
    x = F.col("accumulated")
    w = base.withColumn("f", f).groupBy("cell_id", "month").agg(F.count("*").alias("n"), F.avg(x).alias("w0"), F.avg(x * F.col("f")).alias("w1"), F.avg(x * F.col("f") * F.col("f")).alias("w2"))
    bottom = F.lit(6.0) * F.col("w1") - F.col("w0") - F.lit(6.0) * F.col("w2")
    w = w.withColumn("beta", F.when((F.col("n") >= 6) & (F.abs(bottom) >= 1e-12), F.try_divide(F.col("w0") - F.lit(2.0) * F.col("w1"), bottom)))
    w = w.withColumn("beta", F.when(F.col("beta") > 1, F.col("beta")))
    angle = F.lit(math.pi) / F.col("beta")
    w = w.withColumn("factor", angle / F.sin(angle)).withColumn("alpha", (F.lit(2.0) * F.col("w1") - F.col("w0")) * F.col("beta") / F.col("factor"))
    good = F.col("alpha") > 0
    return w.select("cell_id", "month", *[F.when(good, F.col(c)).alias(c) for c in ("alpha", "beta")], F.when(good, F.col("w0") - F.col("alpha") * F.col("factor")).alias("gamma"))


def spei(months: DataFrame, params: DataFrame, value: str, k: int) -> DataFrame:
    """Standardised precipitation-evapotranspiration index; NULL at or below the support of the fit."""
    cdf = fisk_cdf(F.col("accumulated"), F.col("alpha"), F.col("beta"), F.col("gamma"))
    return _standardised(accumulated(months, value, k).join(params, ["cell_id", "month"]), clip(cdf, CDF_EDGE, 1 - CDF_EDGE), "spei")


def _standardised(df: DataFrame, p: Column, name: str) -> DataFrame:
    return df.withColumn("p", p).withColumn(name, F.expr(normal_quantile_sql("p"))).select("cell_id", "year", "month", "accumulated", name)


def dry_spell(daily: DataFrame, window: GrowingWindow, rain: str = "daily_rain", below: float = 1.0) -> DataFrame:
    """Longest run of dry days in each season; a missing day counts as dry, a season without any value is NULL."""
    days = in_season(daily, window)
    runs = longest_run(days, ["cell_id", "season_year"], "date", F.coalesce(F.col(rain), F.lit(0.0)) < below, "run", seen=rain)
    return runs.select("cell_id", "season_year", F.when(F.col("seen") > 0, F.col("run")).alias("cdd"))


def growing_degree_days(daily: DataFrame, window: GrowingWindow, base: float = 0.0, cap: float | None = None) -> DataFrame:
    """Season's sum of daily degrees; NULL if any day of it is missing."""
    days = in_season(daily, window).withColumn("gdd_day", daily_gdd(F.col("max_temp"), F.col("min_temp"), base, cap))
    return days.groupBy("cell_id", "season_year").agg(strict_sum(F.col("gdd_day")).alias("gdd"))


def frost_days(daily: DataFrame, window: GrowingWindow, below: float = 2.0) -> DataFrame:
    """Days of the season colder than the threshold; missing days count none, a season without any value is NULL."""
    t = F.col("min_temp")
    return in_season(daily, window).groupBy("cell_id", "season_year").agg(F.when(F.count(t) > 0, F.count_if(t < below)).cast("int").alias("frost_days"))


def t90(daily: DataFrame, first: int, last: int, q: float = 0.9) -> DataFrame:
    """The percentile of the daily mean temperature over the baseline, by linear interpolation."""
    mean = (F.col("max_temp") + F.col("min_temp")) / 2
    return daily.filter((F.col("date") >= F.lit(date(first, 1, 1))) & (F.col("date") < F.lit(date(last + 1, 1, 1)))).groupBy("cell_id").agg(F.percentile(mean, F.lit(q)).alias("t90"))


def excess_heat_factor(daily: DataFrame, thresholds: DataFrame) -> DataFrame:
    """cell_id, date, t3, t30 and ehf of each day.

    t3 is the mean of the last three days, t30 that of the thirty before them.
    """
    days = _with_means(daily).join(thresholds, "cell_id")
    return days.select("cell_id", "date", "t3", "t30", excess_heat(F.col("t3"), F.col("t30"), F.col("t90")).alias("ehf"))


def excess_heat_factor_of_baseline(daily: DataFrame, first: int, last: int, q: float = 0.9) -> DataFrame:
    """The same with the threshold from the baseline's days of the same cell, in the same pass over the cell's days; cells without such days are left out."""
    base = F.col("date").between(F.lit(date(first, 1, 1)), F.lit(date(last, 12, 31)))
    t90 = F.percentile(F.when(base, F.col("tmean")), F.lit(q)).over(Window.partitionBy("cell_id"))
    inside = F.max(base).over(Window.partitionBy("cell_id"))
    days = _with_means(daily).withColumns({"t90": t90, "inside": inside}).filter("inside")
    return days.select("cell_id", "date", "t3", "t30", excess_heat(F.col("t3"), F.col("t30"), F.col("t90")).alias("ehf"))


def _with_means(daily: DataFrame) -> DataFrame:
    days = daily.withColumns({"day": F.unix_date("date"), "tmean": (F.col("max_temp") + F.col("min_temp")) / 2})
    return range_mean(range_mean(days, ["cell_id"], "day", "tmean", -2, 0, "t3"), ["cell_id"], "day", "tmean", -32, -3, "t30")


def heatwave_days(ehf: DataFrame, window: GrowingWindow) -> DataFrame:
    v = F.col("ehf")
    return in_season(ehf, window).groupBy("cell_id", "season_year").agg(F.when(F.count(v) > 0, F.count_if(v > 0)).cast("int").alias("heatwave_days"))


def with_month_index(daily: DataFrame) -> DataFrame:
    return daily.withColumn("month_index", month_index(F.col("date")))
