"""Queries over daily observations: reductions, windows and indicators."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from veldt.functions import stats
from veldt.functions.scalars import cell_area_km2, normal_quantile_sql
from veldt.operators import climatology as C
from veldt.operators import indicators as I
from veldt.operators import timeseries as W
from veldt.operators.quantiles import group_percentiles
from veldt.sources.scratch import written

from .adapt import VARIABLES, Tables, made_once
from .catalogue import query

SOUTHERN, SUMMER = I.GROWING_WINDOWS["southern_winter"], I.GROWING_WINDOWS["qld_summer"]
PERIODS = "baseline string, first int, last int"
TWO_PERIODS = [("early", 1995, 1997), ("late", 1999, 2001)]


@query("dom_01", "SELECT region, region_name, variable, year, value, n_cells FROM annual JOIN regions USING (region)", "value")
def annual_climatology(t: Tables) -> DataFrame:
    """Region climatology, annual branch: daily to monthly parts to years to area-weighted regions."""
    return t.annual.join(t.regions.select("region", "region_name"), "region").select("region", "region_name", "variable", "year", "value", "n_cells")


@query("agg_01", "SELECT region, sum(daily_rain * weight) / sum(weight) AS value, count(*)::INT AS n_cells FROM obs JOIN cells USING (cell_id) WHERE daily_rain IS NOT NULL GROUP BY region", "value")
def weighted_region_means(t: Tables) -> DataFrame:
    return C.region_means(t.in_regions(t.obs), ["region"], "daily_rain")


@query("agg_02", "SELECT cell_id, variable, year, value FROM annual_cell", "value")
def annual_reduction(t: Tables) -> DataFrame:
    return C.annual(t.parts)


@query("agg_03", "SELECT region, variable, month, sum(value * weight) / sum(weight) AS value, count(*)::INT AS n_cells FROM (SELECT cell_id, variable, month, avg(value) AS value FROM month_cell GROUP BY ALL) m JOIN cells USING (cell_id) GROUP BY ALL", "value")
def monthly_climatology(t: Tables) -> DataFrame:
    return C.region_means(t.in_regions(C.monthly_climatology(t.parts)), ["region", "variable", "month"])


@query("dom_02", "SELECT region, variable, year, value, n_cells FROM annual WHERE variable <> 'evap_pan' OR year >= 1970", "value")
def full_record(t: Tables) -> DataFrame:
    return t.annual.select("region", "variable", "year", "value", "n_cells")


@query("agg_04", "SELECT region, variable, CASE WHEN year <= 1997 THEN 'early' ELSE 'late' END AS baseline, avg(value) AS mean_value, count(DISTINCT year)::INT AS n_years FROM annual WHERE year <= 1997 OR year >= 1999 GROUP BY ALL", "mean_value")
def two_baselines(t: Tables) -> DataFrame:
    return C.baselines(t.annual, t.spark.createDataFrame(TWO_PERIODS, PERIODS), ["region", "variable"])


@query(
    "agg_28",
    "SELECT e.region, e.variable, e.early, l.late, l.late - e.early AS delta, 1e2 * (l.late - e.early) / e.early AS delta_percent FROM (SELECT region, variable, avg(value) AS early FROM annual WHERE year BETWEEN 1995 AND 1997 GROUP BY ALL) e JOIN (SELECT region, variable, avg(value) AS late FROM annual WHERE year BETWEEN 1999 AND 2001 GROUP BY ALL) l USING (region, variable)",
    "early late delta delta_percent",
)
def baseline_shift(t: Tables) -> DataFrame:
    means = two_baselines(t).groupBy("region", "variable").pivot("baseline", ["early", "late"]).agg(F.first("mean_value"))
    delta = F.col("late") - F.col("early")
    return means.filter("early IS NOT NULL AND late IS NOT NULL").withColumns({"delta": delta, "delta_percent": F.try_divide(F.lit(100.0) * delta, F.col("early"))})


@query("win_08", "SELECT a.region, a.variable, a.year, a.value - b.base AS anomaly FROM annual a JOIN (SELECT region, variable, avg(value) AS base FROM annual WHERE year BETWEEN 1995 AND 1997 GROUP BY ALL) b USING (region, variable)", "anomaly")
def anomalies(t: Tables) -> DataFrame:
    base = t.annual.filter(F.col("year").between(1995, 1997)).groupBy("region", "variable").agg(F.avg("value").alias("base"))
    return W.anomaly(t.annual, base, ["region", "variable"], "value", "base", "anomaly").filter(F.col("anomaly").isNotNull()).select("region", "variable", "year", "anomaly")


@query("join_20", "SELECT a.year, avg(a.value - b.base) AS mean_anomaly FROM annual a JOIN (SELECT region, avg(value) AS base FROM annual WHERE variable = 'max_temp' GROUP BY region) b USING (region) WHERE variable = 'max_temp' GROUP BY a.year", "mean_anomaly")
def mean_anomaly(t: Tables) -> DataFrame:
    warm = t.annual.filter("variable = 'max_temp'")
    base = warm.groupBy("region").agg(F.avg("value").alias("base"))
    return W.anomaly(warm, base, ["region"], "value", "base", "anomaly").groupBy("year").agg(F.avg("anomaly").alias("mean_anomaly"))


@query(
    "agg_05",
    "SELECT region, avg(value) FILTER (variable = 'daily_rain') AS daily_rain, avg(value) FILTER (variable = 'evap_pan') AS evap_pan, avg(value) FILTER (variable = 'max_temp') AS max_temp, avg(value) FILTER (variable = 'min_temp') AS min_temp FROM annual GROUP BY region",
    "daily_rain evap_pan max_temp min_temp",
)
def region_annual_wide(t: Tables) -> DataFrame:
    return t.annual.groupBy("region").pivot("variable", VARIABLES).agg(F.avg("value"))


@query("agg_06", "SELECT cell_id, 1e2 * sum(CASE WHEN month BETWEEN 5 AND 8 THEN value END) / sum(value) AS winter_share FROM month_cell WHERE variable = 'daily_rain' GROUP BY cell_id", "winter_share")
def winter_share(t: Tables) -> DataFrame:
    rain = t.parts.filter("variable = 'daily_rain'").withColumnRenamed("total", "value")
    return C.seasonal_share(rain, ["cell_id"], "value", (5, 6, 7, 8), "winter_share")


@query("agg_07", "SELECT region, sum(lat * weight) / sum(weight) AS latitude FROM cells GROUP BY region", "latitude")
def region_latitude(t: Tables) -> DataFrame:
    return t.cells.groupBy("region").agg(stats.weighted_mean(F.col("lat"), F.col("weight")).alias("latitude"))


@query("agg_18", "SELECT sum((cell_id % 10) / 1e1 * 6371e0 * 6371e0 * radians(5e-2) * radians(5e-2) * cos(radians(lat))) AS area_km2 FROM cells", "area_km2")
def area_integral(t: Tables) -> DataFrame:
    return t.cells.agg(F.sum(F.col("cell_id") % 10 / 10.0 * cell_area_km2(F.col("lat"), 0.05, 0.05)).alias("area_km2"))


@query("agg_22", "SELECT r.region, y.season_year, v.value FROM regions r CROSS JOIN (SELECT DISTINCT season_year FROM southern) y LEFT JOIN (SELECT region, season_year, sum(n * weight) / sum(weight) AS value FROM (SELECT cell_id, season_year, count(*) FILTER (min_temp < 2) AS n FROM southern GROUP BY ALL) f JOIN cells USING (cell_id) GROUP BY ALL) v ON r.region = v.region AND y.season_year = v.season_year", "value")
def indicator_region_means(t: Tables) -> DataFrame:
    frost = I.frost_days(t.dense, SOUTHERN)
    frame = t.regions.select("region").crossJoin(frost.select("season_year").distinct())  # regions by seasons: as many rows as the result
    return C.indicator_means(frame, t.in_regions(frost), ["region", "season_year"], "frost_days", "value")


@query("agg_27", "SELECT region, stddev_samp(value) / avg(value) AS cv FROM annual WHERE variable = 'daily_rain' GROUP BY region", "cv")
def rain_variability(t: Tables) -> DataFrame:
    return t.annual.filter("variable = 'daily_rain'").groupBy("region").agg(stats.coefficient_of_variation(F.col("value"), sample=True).alias("cv"))


@query(
    "agg_29",
    "SELECT region, avg(max_temp) AS mean, quantile_cont(max_temp, 0.1) AS p10, quantile_cont(max_temp, 0.25) AS p25, quantile_cont(max_temp, 0.75) AS p75, quantile_cont(max_temp, 0.9) AS p90, stddev_pop(max_temp) AS std FROM obs JOIN cells USING (cell_id) GROUP BY region",
    "mean p10 p25 p75 p90 std",
)
def within_region_distribution(t: Tables) -> DataFrame:
    temperatures = written(t.in_regions(t.obs).select("region", "max_temp"), "temperatures")
    tails = group_percentiles(temperatures, ["region"], F.col("max_temp"), {"p10": 0.1, "p25": 0.25, "p75": 0.75, "p90": 0.9})
    return temperatures.groupBy("region").agg(F.avg("max_temp").alias("mean"), F.stddev_pop("max_temp").alias("std")).join(tails, "region")


@query("win_01", "SELECT cell_id, year, month, CASE WHEN count(rain) OVER w = 3 THEN sum(rain) OVER w END AS rain_3 FROM rain_months WINDOW w AS (PARTITION BY cell_id ORDER BY month_index RANGE BETWEEN 2 PRECEDING AND CURRENT ROW)", "rain_3")
def three_month_rain(t: Tables) -> DataFrame:
    months = I.monthly_totals(t.dense, "daily_rain", "rain")
    return W.rolling_sum(months, ["cell_id"], "month_index", "rain", 3, "rain_3").select("cell_id", "year", "month", "rain_3")


@query("win_02", "SELECT cell_id, date, avg(max_temp) OVER (PARTITION BY cell_id ORDER BY date RANGE BETWEEN INTERVAL 2 DAY PRECEDING AND CURRENT ROW) AS t3 FROM obs", "t3")
def three_day_mean(t: Tables) -> DataFrame:
    return W.range_mean(t.obs.withColumn("day", F.unix_date("date")), ["cell_id"], "day", "max_temp", -2, 0, "t3").select("cell_id", "date", "t3")


@query("win_03", "SELECT cell_id, date, avg(max_temp) OVER (PARTITION BY cell_id ORDER BY date RANGE BETWEEN INTERVAL 32 DAY PRECEDING AND INTERVAL 3 DAY PRECEDING) AS t30 FROM obs", "t30")
def lagged_thirty_day_mean(t: Tables) -> DataFrame:
    return W.range_mean(t.obs.withColumn("day", F.unix_date("date")), ["cell_id"], "day", "max_temp", -32, -3, "t30").select("cell_id", "date", "t30")


@query("win_04", "SELECT cell_id, coalesce(max(n), 0)::INT AS longest FROM (SELECT DISTINCT cell_id FROM obs) c LEFT JOIN (SELECT cell_id, count(*) AS n FROM (SELECT cell_id, date, row_number() OVER (PARTITION BY cell_id ORDER BY date) AS rn, row_number() OVER (PARTITION BY cell_id, daily_rain < 30 ORDER BY date) AS rm, daily_rain < 30 AS dry FROM obs) q WHERE dry GROUP BY cell_id, rn - rm) r USING (cell_id) GROUP BY cell_id")
def longest_dry_run(t: Tables) -> DataFrame:
    return W.longest_run(t.obs, ["cell_id"], "date", F.col("daily_rain") < 30, "longest")


@query("win_06", "SELECT cell_id, month, year, (row_number() OVER (PARTITION BY cell_id, month ORDER BY balance, year) - 3.5e-1) / count(*) OVER (PARTITION BY cell_id, month) AS position FROM full_months WHERE balance IS NOT NULL", "position")
def plotting_positions(t: Tables) -> DataFrame:
    months = I.water_balance(t.whole).filter(F.col("balance").isNotNull())
    group = Window.partitionBy("cell_id", "month")
    return months.select("cell_id", "month", "year", ((F.row_number().over(group.orderBy("balance", "year")) - F.lit(0.35)) / F.count("*").over(group)).alias("position"))


@query("win_09", "SELECT cell_id, year, month, CASE WHEN count(rain) OVER w = 12 THEN sum(rain) OVER w END AS rain_12 FROM full_months WINDOW w AS (PARTITION BY cell_id ORDER BY month_index RANGE BETWEEN 11 PRECEDING AND CURRENT ROW)", "rain_12")
def twelve_months_over_years(t: Tables) -> DataFrame:
    """A window over the whole record: no year needs the one before it prepended."""
    months = I.monthly_totals(t.whole, "daily_rain", "rain")
    return W.rolling_sum(months, ["cell_id"], "month_index", "rain", 12, "rain_12").select("cell_id", "year", "month", "rain_12")


@query("ind_01", "SELECT cell_id, year, month, rain FROM rain_months", "rain")
def monthly_rain(t: Tables) -> DataFrame:
    return I.monthly_totals(t.dense, "daily_rain", "rain").select("cell_id", "year", "month", "rain")


@query("ind_02", "SELECT cell_id, year, month, CASE WHEN n_evap = day(last_day(first_day)) THEN evap END AS pet FROM month_days", "pet")
def monthly_pet(t: Tables) -> DataFrame:
    return I.monthly_totals(t.dense, "evap_pan", "pet").select("cell_id", "year", "month", "pet")


@query("ind_03", "SELECT cell_id, year, month, balance FROM full_months", "balance")
def monthly_balance(t: Tables) -> DataFrame:
    return I.water_balance(t.whole).select("cell_id", "year", "month", "balance")


RAIN_SUMS = "SELECT cell_id, year, month, x FROM (SELECT cell_id, year, month, CASE WHEN count(rain) OVER w = 3 THEN sum(rain) OVER w END AS x FROM full_months {where} WINDOW w AS (PARTITION BY cell_id ORDER BY month_index RANGE BETWEEN 2 PRECEDING AND CURRENT ROW)) q WHERE x IS NOT NULL"
SPI_FIT = (
    "SELECT cell_id, month, CASE WHEN n >= 4 AND a > 0 THEN (1e0 + sqrt(1e0 + 4e0 * a / 3e0)) / (4e0 * a) END AS shape, CASE WHEN n >= 4 AND a > 0 THEN m / ((1e0 + sqrt(1e0 + 4e0 * a / 3e0)) / (4e0 * a)) END AS scale, q AS prob_zero FROM "
    f"(SELECT cell_id, month, count(*) FILTER (x > 0) AS n, avg(x) FILTER (x > 0) AS m, ln(avg(x) FILTER (x > 0)) - avg(ln(CASE WHEN x > 0 THEN x END)) AS a, count(*) FILTER (x <= 0)::DOUBLE / count(x) AS q FROM ({RAIN_SUMS.format(where='WHERE year BETWEEN 1995 AND 1999')}) b GROUP BY ALL) f"
)


def spi_params(t: Tables) -> DataFrame:
    return I.fit_spi(I.monthly_totals(t.whole, "daily_rain", "rain"), "rain", 3, 1995, 1999)


@query("ind_04", SPI_FIT, "shape scale prob_zero")
def spi_fit(t: Tables) -> DataFrame:
    return spi_params(t)


@query("stat_08", f"SELECT cell_id, month, shape FROM ({SPI_FIT}) s", "shape")
def gamma_shapes(t: Tables) -> DataFrame:
    return spi_params(t).select("cell_id", "month", "shape")


@query("stat_09", f"SELECT cell_id, month, prob_zero FROM ({SPI_FIT}) s", "prob_zero")
def zero_probabilities(t: Tables) -> DataFrame:
    return spi_params(t).select("cell_id", "month", "prob_zero")


GAMMA_CDF = "CASE WHEN x <= 0 THEN 0e0 ELSE least(1e0, list_sum(list_transform(range((60 + 10 * sqrt(shape + 1) + greatest(x / scale - shape, 0))::BIGINT), lambda n: exp((shape + n) * ln(x / scale) - x / scale - lgamma(shape + n + 1))))) END"


@query("stat_11", f"SELECT cell_id, year, s.month, {GAMMA_CDF} AS cdf FROM ({RAIN_SUMS.format(where='')}) s JOIN ({SPI_FIT}) p USING (cell_id, month) WHERE shape IS NOT NULL", "cdf")
def gamma_probabilities(t: Tables) -> DataFrame:
    months = made_once(I.monthly_totals(t.whole, "daily_rain", "rain"), "rain-months")
    sums = I.accumulated(months, "rain", 3).join(I.fit_spi(months, "rain", 3, 1995, 1999), ["cell_id", "month"])
    from veldt.functions.scalars import gamma_cdf

    return sums.filter("shape IS NOT NULL").select("cell_id", "year", "month", gamma_cdf(F.col("accumulated"), F.col("shape"), F.col("scale")).alias("cdf"))


SPI_P = f"least(greatest(CASE WHEN x <= 0 THEN prob_zero ELSE prob_zero + (1e0 - prob_zero) * {GAMMA_CDF} END, 1e-6), 1e0 - 1e-6)"


@query("ind_05", f"SELECT cell_id, year, month, {normal_quantile_sql('p')} AS spi FROM (SELECT cell_id, year, s.month, {SPI_P} AS p FROM ({RAIN_SUMS.format(where='')}) s JOIN ({SPI_FIT}) f USING (cell_id, month) WHERE shape IS NOT NULL) z", "spi")
def spi_values(t: Tables) -> DataFrame:
    """Months are made once, for the fit and for the values: a thirtieth of the days."""
    months = made_once(I.monthly_totals(t.whole, "daily_rain", "rain"), "rain-months")
    params = I.fit_spi(months, "rain", 3, 1995, 1999).filter("shape IS NOT NULL")
    return I.spi(months, params, "rain", 3).select("cell_id", "year", "month", "spi")


BALANCE_SUMS = RAIN_SUMS.replace("rain", "balance")
SPEI_W = f"SELECT cell_id, month, count(*) AS n, avg(x) AS w0, avg(x * f) AS w1, avg(x * f * f) AS w2 FROM (SELECT cell_id, month, x, (row_number() OVER (PARTITION BY cell_id, month ORDER BY x, year) - 3.5e-1) / count(*) OVER (PARTITION BY cell_id, month) AS f FROM ({BALANCE_SUMS.format(where='')}) b) r GROUP BY ALL"
SPEI_B = f"SELECT *, CASE WHEN n >= 6 AND abs(6e0 * w1 - w0 - 6e0 * w2) >= 1e-12 AND (w0 - 2e0 * w1) / (6e0 * w1 - w0 - 6e0 * w2) > 1 THEN (w0 - 2e0 * w1) / (6e0 * w1 - w0 - 6e0 * w2) END AS b FROM ({SPEI_W}) w"
SPEI_A = f"SELECT *, (2e0 * w1 - w0) * b / (pi() / b / sin(pi() / b)) AS a FROM ({SPEI_B}) q"
SPEI_FIT = f"SELECT cell_id, month, CASE WHEN a > 0 THEN a END AS alpha, CASE WHEN a > 0 THEN b END AS beta, CASE WHEN a > 0 THEN w0 - a * (pi() / b / sin(pi() / b)) END AS gamma FROM ({SPEI_A}) q"


def spei_params(t: Tables) -> DataFrame:
    return I.fit_spei(I.water_balance(t.whole), "balance", 3, 1995, 2001)


def balances_with_fits(t: Tables) -> DataFrame:
    """Months are made once, for the sums and for the fits."""
    months = made_once(I.water_balance(t.whole), "balance-months")
    return I.accumulated(months, "balance", 3).join(I.fit_spei(months, "balance", 3, 1995, 2001), ["cell_id", "month"])


@query("ind_06", SPEI_FIT, "alpha beta gamma")
def spei_fit(t: Tables) -> DataFrame:
    return spei_params(t)


@query("stat_10", f"SELECT cell_id, month, beta FROM ({SPEI_FIT}) s", "beta")
def loglogistic_shapes(t: Tables) -> DataFrame:
    return spei_params(t).select("cell_id", "month", "beta")


FISK = "CASE WHEN x > gamma THEN 1e0 / (1e0 + pow((x - gamma) / alpha, -beta)) END"


@query("stat_12", f"SELECT cell_id, year, s.month, {FISK} AS cdf FROM ({BALANCE_SUMS.format(where='')}) s JOIN ({SPEI_FIT}) p USING (cell_id, month)", "cdf")
def loglogistic_probabilities(t: Tables) -> DataFrame:
    from veldt.functions.scalars import fisk_cdf

    return balances_with_fits(t).select("cell_id", "year", "month", fisk_cdf(F.col("accumulated"), F.col("alpha"), F.col("beta"), F.col("gamma")).alias("cdf"))


SPEI_VALUES = f"SELECT cell_id, year, month, CASE WHEN p IS NOT NULL THEN {normal_quantile_sql('p')} END AS spei FROM (SELECT cell_id, year, s.month, least(greatest({FISK}, 1e-6), 1e0 - 1e-6) * CASE WHEN x > gamma THEN 1 END AS p FROM ({BALANCE_SUMS.format(where='')}) s JOIN ({SPEI_FIT}) f USING (cell_id, month)) z"


@query("ind_07", SPEI_VALUES, "spei")
def spei_values(t: Tables) -> DataFrame:
    months = made_once(I.water_balance(t.whole), "balance-months")
    return I.spei(months, I.fit_spei(months, "balance", 3, 1995, 2001), "balance", 3).select("cell_id", "year", "month", "spei")


@query("join_18", f"SELECT cell_id, year, s.month, x AS accumulated, alpha FROM ({BALANCE_SUMS.format(where='')}) s JOIN ({SPEI_FIT}) p USING (cell_id, month)", "accumulated alpha")
def parameters_by_month(t: Tables) -> DataFrame:
    return balances_with_fits(t).select("cell_id", "year", "month", "accumulated", "alpha")


@query("stat_13", f"SELECT p_partkey, {normal_quantile_sql('p')} AS z FROM (SELECT p_partkey, ((p_partkey * 7919) % 9973 + 5e-1) / 9973e0 AS p FROM part) q", "z")
def normal_quantiles(t: Tables) -> DataFrame:
    p = t.raw("part").select("p_partkey", ((F.col("p_partkey") * 7919 % 9973 + F.lit(0.5)) / F.lit(9973.0)).alias("p"))
    return p.select("p_partkey", F.expr(normal_quantile_sql("p")).alias("z"))


def cdd_sql(season: str) -> str:
    return f"""SELECT b.cell_id, b.season_year, CASE WHEN seen > 0 THEN coalesce(longest, 0) END::INT AS cdd FROM (SELECT cell_id, season_year, count(daily_rain) AS seen FROM {season} GROUP BY ALL) b LEFT JOIN
      (SELECT cell_id, season_year, max(n) AS longest FROM (SELECT cell_id, season_year, count(*) AS n FROM (SELECT cell_id, season_year, dry, row_number() OVER (PARTITION BY cell_id, season_year ORDER BY date) - row_number() OVER (PARTITION BY cell_id, season_year, dry ORDER BY date) AS g
        FROM (SELECT *, coalesce(daily_rain, 0) < 1 AS dry FROM {season}) x) y WHERE dry GROUP BY cell_id, season_year, g) z GROUP BY ALL) r USING (cell_id, season_year)"""


@query("ind_08", cdd_sql("southern"))
def dry_days_winter(t: Tables) -> DataFrame:
    return I.dry_spell(t.dense, SOUTHERN)


@query("ind_08_summer", cdd_sql("summer"))
def dry_days_summer(t: Tables) -> DataFrame:
    return I.dry_spell(t.dense, SUMMER)


GDD = "SELECT cell_id, season_year, CASE WHEN count(g) = count(*) THEN sum(g) END AS gdd FROM (SELECT cell_id, season_year, CASE WHEN max_temp IS NOT NULL AND min_temp IS NOT NULL THEN greatest({mean}, 0e0) END AS g FROM {season}) d GROUP BY ALL"


@query("ind_09", GDD.format(mean="(max_temp + min_temp) / 2", season="southern"), "gdd")
def degree_days(t: Tables) -> DataFrame:
    return I.growing_degree_days(t.dense, SOUTHERN)


@query("ind_10", "SELECT s.cell_id, s.season_year AS year, region, gdd FROM (" + GDD.format(mean="(least(max_temp, 3e1) + least(min_temp, 3e1)) / 2 - 5e0", season="summer") + ") s JOIN cells USING (cell_id)", "gdd")
def degree_days_of_cells(t: Tables) -> DataFrame:
    wanted = t.cells.select("cell_id", "region")
    return I.growing_degree_days(t.dense, SUMMER, 5.0, 30.0).join(wanted, "cell_id").select("cell_id", F.col("season_year").alias("year"), "region", "gdd")


@query("stat_14", "SELECT cell_id, t90 FROM t90", "t90")
def t90_baseline(t: Tables) -> DataFrame:
    return I.t90(t.dense, 1995, 1997)


@query("ind_11", "SELECT cell_id, date, t3, t30, ehf FROM ehf", "t3 t30 ehf")
def heat_factor(t: Tables) -> DataFrame:
    return I.excess_heat_factor_of_baseline(t.dense, 1995, 1997)


@query("ind_12", "SELECT cell_id, (CASE WHEN month(date) >= 9 THEN year(date) ELSE year(date) - 1 END)::INT AS season_year, CASE WHEN count(ehf) > 0 THEN count(*) FILTER (ehf > 0) END::INT AS heatwave_days FROM ehf WHERE month(date) IN (9, 10, 11, 12, 1, 2) AND (CASE WHEN month(date) >= 9 THEN year(date) ELSE year(date) - 1 END) < (SELECT max(year(date)) FROM ehf) GROUP BY ALL")
def heatwaves(t: Tables) -> DataFrame:
    return I.heatwave_days(heat_factor(t), SUMMER)


FROST = "SELECT cell_id, season_year, CASE WHEN count(min_temp) > 0 THEN count(*) FILTER (min_temp < 2) END::INT AS frost_days FROM {season} GROUP BY ALL"


@query("ind_13", FROST.format(season="southern"))
def frosts_winter(t: Tables) -> DataFrame:
    return I.frost_days(t.dense, SOUTHERN)


@query("ind_13_summer", FROST.format(season="summer"))
def frosts_summer(t: Tables) -> DataFrame:
    return I.frost_days(t.dense, SUMMER)


@query("mth_05", "SELECT cell_id, date, greatest((least(max_temp, 3e1) + least(min_temp, 3e1)) / 2 - 1e1, 0e0) AS gdd FROM obs", "gdd")
def daily_degrees(t: Tables) -> DataFrame:
    from veldt.functions.scalars import daily_gdd

    return t.obs.select("cell_id", "date", daily_gdd(F.col("max_temp"), F.col("min_temp"), 10.0, 30.0).alias("gdd"))


@query("flt_07", "SELECT season_year, count(*) AS n_days, count(DISTINCT cell_id) AS n_cells FROM summer GROUP BY season_year")
def season_days(t: Tables) -> DataFrame:
    return I.in_season(t.dense, SUMMER).groupBy("season_year").agg(F.count("*").alias("n_days"), F.countDistinct("cell_id").alias("n_cells"))


@query("flt_08", "SELECT variable, count(*) AS n FROM annual_cell WHERE variable <> 'evap_pan' OR year >= 1997 GROUP BY variable")
def effective_years(t: Tables) -> DataFrame:
    return C.annual(t.parts, {"evap_pan": 1997}).groupBy("variable").agg(F.count("*").alias("n"))


@query("join_17", "SELECT cell_id, date, (max_temp + min_temp) / 2 AS tmean, daily_rain - evap_pan AS balance FROM obs", "tmean balance")
def aligned_arithmetic(t: Tables) -> DataFrame:
    return t.obs.select("cell_id", "date", ((F.col("max_temp") + F.col("min_temp")) / 2).alias("tmean"), (F.col("daily_rain") - F.col("evap_pan")).alias("balance"))
