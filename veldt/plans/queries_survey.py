"""Queries over surveys, yields, providers and their links to climate."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veldt.functions import stats
from veldt.operators import compare, sets, survey, validate

from .adapt import Tables
from .catalogue import query

REGIONS = 25
MIN_YEARS = 5  # the driver's series have seven years
EVENTS = {"first": (1996, 1997), "second": (2000,)}


@query("join_01", "SELECT region, year, population, area_total_ha, production_total_t, yield_t_ha FROM totals", "population area_total_ha production_total_t yield_t_ha")
def region_totals(t: Tables) -> DataFrame:
    return survey.region_totals(t.per_farm, t.population)


@query("agg_08", "SELECT year, sum(production_total_t) AS region_sum_t, count(DISTINCT region)::INT AS n_regions FROM totals WHERE production_total_t IS NOT NULL GROUP BY year", "region_sum_t")
def totals_by_year(t: Tables) -> DataFrame:
    return region_totals(t).filter("production_total_t IS NOT NULL").groupBy("year").agg(F.sum("production_total_t").alias("region_sum_t"), F.countDistinct("region").cast("int").alias("n_regions"))


NATIONAL = "SELECT f.year, f.production_t * p.population AS national_total_t, 2e1 AS national_rse FROM (SELECT year, avg(production_t) AS production_t FROM per_farm GROUP BY year) f JOIN (SELECT year, sum(population) AS population FROM population GROUP BY year) p ON f.year = p.year"


@query("join_04", NATIONAL, "national_total_t national_rse")
def national_totals(t: Tables) -> DataFrame:
    farm = t.per_farm.groupBy("year").agg(F.avg("production_t").alias("production_t")).withColumn("production_rse", F.lit(20.0))
    people = t.population.groupBy("year").agg(F.sum("population").alias("population"))
    return survey.national_totals(farm, people)


def judged(t: Tables) -> DataFrame:
    return survey.reconstruction(region_totals(t), t.national, regions=REGIONS)


@query("join_05", "SELECT year, region_sum_t, national_total_t, rel_error FROM judged", "region_sum_t national_total_t rel_error")
def sums_against_national(t: Tables) -> DataFrame:
    return judged(t).select("year", "region_sum_t", "national_total_t", "rel_error")


@query("val_02", "SELECT year, n_regions, full_coverage, reliable, full_coverage AND reliable AS graded, coalesce(rel_error <= 5e-2, false) AS within FROM judged")
def reconstruction_years(t: Tables) -> DataFrame:
    return judged(t).select("year", "n_regions", "full_coverage", "reliable", "graded", "within")


@query(
    "dom_03",
    "SELECT coalesce(bool_and(rel_error <= 5e-2) FILTER (full_coverage AND reliable), false) AS valid, count(*) FILTER (full_coverage AND reliable) AS n_graded_years, max(rel_error) FILTER (full_coverage AND reliable) AS worst_rel_error, count(*) FILTER (NOT full_coverage) AS n_partial_years, count(*) FILTER (full_coverage AND NOT reliable) AS n_high_rse_years FROM judged",
    "worst_rel_error",
)
def reconstruction_verdict(t: Tables) -> DataFrame:
    return survey.reconstruction_verdict(judged(t))


@query("agg_09", "SELECT r.year, regional_sum, national_value, regional_sum / national_value AS ratio FROM (SELECT year, sum(production_t) AS regional_sum FROM per_farm GROUP BY year) r JOIN (SELECT year, national_total_t AS national_value FROM national) n ON r.year = n.year", "regional_sum national_value ratio")
def regional_against_national(t: Tables) -> DataFrame:
    return survey.regional_against_national(t.per_farm.withColumnRenamed("production_t", "value"), t.national.select("year", F.col("national_total_t").alias("national_value")))


@query(
    "val_09",
    "SELECT median(regional_sum / national_value) AS median_ratio, max(abs(regional_sum / national_value - 1)) AS worst, count(*) FILTER (regional_sum / national_value < 1) AS n_below FROM (SELECT year, sum(production_t) AS regional_sum FROM per_farm GROUP BY year) r JOIN (SELECT year, national_total_t AS national_value FROM national) n ON r.year = n.year",
    "median_ratio worst",
)
def sanity_summary(t: Tables) -> DataFrame:
    ratio = F.col("ratio")
    return regional_against_national(t).agg(F.median(ratio).alias("median_ratio"), F.max(F.abs(ratio - 1)).alias("worst"), F.count_if(ratio < 1).alias("n_below"))


@query(
    "agg_14",
    "SELECT f.region, count(*)::INT AS n_years, avg(yield_t_ha) AS mean_yield, median(yield_t_ha) AS median_yield, 1e1 * regr_slope(yield_t_ha, year) AS trend_t_ha_decade, stddev_pop(yield_t_ha) / avg(yield_t_ha) AS cv, stddev_pop(yield_t_ha - a - b * year) / avg(yield_t_ha) AS detrended_cv, quantile_cont(yield_t_ha, 0.1) AS p10_yield, median(production_rse) AS median_prod_rse, quantile_cont(yield_t_ha, 0.1) / median(yield_t_ha) AS p10_over_median, min(yield_t_ha) / median(yield_t_ha) AS worst_over_median, count(*) >= 5 AS adequate FROM per_farm f JOIN (SELECT region, regr_slope(yield_t_ha, year) AS b, regr_intercept(yield_t_ha, year) AS a FROM per_farm GROUP BY region) l USING (region) GROUP BY f.region",
    "mean_yield median_yield trend_t_ha_decade cv detrended_cv p10_yield median_prod_rse p10_over_median worst_over_median",
)
def yield_summary(t: Tables) -> DataFrame:
    return survey.yield_summary(t.per_farm, ["region"], MIN_YEARS)


STATS = {
    "stat_01": ("1e1 * regr_slope(yield_t_ha, year)", "trend_t_ha_decade"),
    "stat_03": ("stddev_pop(yield_t_ha) / avg(yield_t_ha)", "cv"),
    "stat_04": ("quantile_cont(yield_t_ha, 0.1)", "p10_yield"),
    "stat_05": ("quantile_cont(yield_t_ha, 0.1) / median(yield_t_ha)", "p10_over_median"),
}
for _key, (_sql, _name) in STATS.items():
    query(_key, f"SELECT region, {_sql} AS {_name} FROM per_farm GROUP BY region", _name)(lambda t, name=_name: yield_summary(t).select("region", name))


@query("stat_02", "SELECT region, sqrt(avg(pow(yield_t_ha - a - b * year, 2))) / avg(yield_t_ha) AS detrended_cv FROM per_farm JOIN (SELECT region, regr_slope(yield_t_ha, year) AS b, regr_intercept(yield_t_ha, year) AS a FROM per_farm GROUP BY region) l USING (region) GROUP BY region", "detrended_cv")
def detrended_cv(t: Tables) -> DataFrame:
    return yield_summary(t).select("region", "detrended_cv")


@query("stat_06", "SELECT region, count(*) >= 5 AS adequate FROM per_farm GROUP BY region")
def adequacy(t: Tables) -> DataFrame:
    return yield_summary(t).select("region", "adequate")


@query("stat_07", "SELECT region, corr(yield_t_ha, rain) AS r FROM joined GROUP BY region", "r")
def plain_correlation(t: Tables) -> DataFrame:
    return t.panel.groupBy("region").agg(stats.guarded_corr(F.col("yield_t_ha"), F.col("rain")).alias("r"))


@query("win_05", "SELECT region, year, resid_yield, resid_rain, resid_tmax FROM panel", "resid_yield resid_rain resid_tmax")
def residuals(t: Tables) -> DataFrame:
    return t.panel.select("region", "year", "resid_yield", "resid_rain", "resid_tmax")


@query("join_02", "SELECT region, year, yield_t_ha, rain, tmax FROM joined", "yield_t_ha rain tmax")
def yield_and_climate(t: Tables) -> DataFrame:
    return t.per_farm.select("region", "year", "yield_t_ha").join(t.climate, ["region", "year"])


LINKAGE = "SELECT region, count(*)::INT AS n_years, corr(resid_yield, resid_rain) AS corr_detr_rain_yield, corr(resid_yield, resid_tmax) AS corr_detr_tmax_yield, stddev_samp(rain) / avg(rain) AS rain_cv, stddev_pop(resid_yield) / avg(yield_t_ha) AS yield_detrended_cv FROM panel GROUP BY region"


@query("dom_04", LINKAGE, "corr_detr_rain_yield corr_detr_tmax_yield rain_cv yield_detrended_cv")
def linkage(t: Tables) -> DataFrame:
    return survey.linkage(t.panel)


@query("dom_04_cross", f"SELECT corr(rain_cv, yield_detrended_cv) AS r, count(*) AS n FROM ({LINKAGE}) l", "r")
def cross_region(t: Tables) -> DataFrame:
    return linkage(t).agg(stats.guarded_corr(F.col("rain_cv"), F.col("yield_detrended_cv")).alias("r"), F.count("*").alias("n"))


EVENT_SQL = "SELECT event, count(resid_yield)::INT AS region_years, avg(resid_yield) AS mean_resid_yield FROM (VALUES ('first'), ('second'), ('non-event')) e(event) LEFT JOIN (SELECT CASE WHEN year IN (1996, 1997) THEN 'first' WHEN year = 2000 THEN 'second' ELSE 'non-event' END AS name, resid_yield FROM panel) p ON name = event GROUP BY event"


@query("agg_15", EVENT_SQL, "mean_resid_yield")
def event_means(t: Tables) -> DataFrame:
    return survey.event_summary(t.panel, EVENTS)


@query("dom_05", "SELECT event, region_years, mean_resid_yield, mean_resid_yield - max(CASE WHEN event = 'non-event' THEN mean_resid_yield END) OVER () AS against_non_event FROM (" + EVENT_SQL + ") s", "mean_resid_yield against_non_event")
def event_anomaly(t: Tables) -> DataFrame:
    means = survey.event_summary(t.panel, EVENTS)
    quiet = means.filter("event = 'non-event'").select(F.col("mean_resid_yield").alias("quiet"))  # one row
    return means.crossJoin(F.broadcast(quiet)).withColumn("against_non_event", F.col("mean_resid_yield") - F.col("quiet")).drop("quiet")


RATIOS = "SELECT p_type AS region, year(l_shipdate)::INT AS year, sum(l_extendedprice) / sum(l_quantity) AS yield_t_ha, avg(l_tax) * 1e2 AS production_rse FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY ALL"


def ratios(t: Tables) -> DataFrame:
    lines = t.raw("lineitem").join(t.raw("part"), F.col("l_partkey") == F.col("p_partkey"))
    area = lines.groupBy(F.col("p_type").alias("region"), F.year("l_shipdate").alias("year")).agg(F.sum("l_quantity").alias("area"), (F.avg("l_tax") * 100.0).alias("production_rse"))
    production = lines.groupBy(F.col("p_type").alias("region"), F.year("l_shipdate").alias("year")).agg(F.sum("l_extendedprice").alias("production"))
    return area.join(production, ["region", "year"]).select("region", "year", F.try_divide("production", "area").alias("yield_t_ha"), "production_rse").dropna(subset=["yield_t_ha"])


@query("join_03", RATIOS, "yield_t_ha production_rse")
def area_and_production(t: Tables) -> DataFrame:
    return ratios(t)


BROADACRE = "(SELECT DISTINCT p_type AS region FROM part WHERE p_size > 48)"


@query("agg_10", f"SELECT r.region, count(DISTINCT year)::INT AS n_years, median(yield_t_ha) AS median_yield, median(production_rse) AS median_prod_rse FROM ({RATIOS}) r GROUP BY r.region", "median_yield median_prod_rse")
def availability_medians(t: Tables) -> DataFrame:
    return ratios(t).groupBy("region").agg(F.countDistinct("year").cast("int").alias("n_years"), F.median("yield_t_ha").alias("median_yield"), F.median("production_rse").alias("median_prod_rse"))


@query("dom_09", f"SELECT r.region, count(DISTINCT year)::INT AS n_years, median(yield_t_ha) AS median_yield, median(production_rse) AS median_prod_rse, r.region IN {BROADACRE} AS broadacre, count(DISTINCT year) >= 5 AS adequate FROM ({RATIOS}) r GROUP BY r.region", "median_yield median_prod_rse")
def availability(t: Tables) -> DataFrame:
    return survey.availability(ratios(t), t.raw("part").filter("p_size > 48").select(F.col("p_type").alias("region")), MIN_YEARS)


@query("flt_05", "SELECT DISTINCT p_type FROM part WHERE lower(p_type) LIKE '%eco%'")
def by_substring(t: Tables) -> DataFrame:
    return t.raw("part").filter(F.lower("p_type").contains("eco")).select("p_type").distinct().orderBy("p_type")


@query("flt_06", "SELECT region, year, yield_t_ha FROM per_farm WHERE year >= 1998 AND yield_t_ha IS NOT NULL AND region IN (SELECT region FROM regions WHERE zone IN ('ASIA', 'EUROPE'))", "yield_t_ha")
def reliable_window(t: Tables) -> DataFrame:
    broad = t.regions.filter(F.col("zone").isin("ASIA", "EUROPE")).select("region")
    return t.per_farm.filter((F.col("year") >= 1998) & F.col("yield_t_ha").isNotNull()).join(broad, "region", "left_semi").select("region", "year", "yield_t_ha")


@query("join_19", "SELECT region, year, yield_t_ha FROM per_farm WHERE region IN (SELECT region FROM per_farm GROUP BY region HAVING count(*) >= 5)", "yield_t_ha")
def adequate_only(t: Tables) -> DataFrame:
    good = yield_summary(t).filter("adequate").select("region")
    return t.per_farm.join(good, "region", "left_semi").select("region", "year", "yield_t_ha")


def pairs(t: Tables) -> DataFrame:
    ours, theirs = t.providers
    return compare.paired(ours, theirs, ["id"], ["price", "rate"]).withColumn("code", F.col("id") % 7)


METRICS = "count(*) AS n, avg(a - b) AS bias, sqrt(avg((a - b) * (a - b))) AS rmse, corr(a, b) AS r"


@query("agg_12", f"SELECT code, variable, {METRICS} FROM pairs GROUP BY ALL", "bias rmse r")
def metrics_by_code(t: Tables) -> DataFrame:
    return compare.metrics(pairs(t), "code").filter(~F.col("pooled")).drop("pooled")


@query("agg_13", f"SELECT variable, {METRICS} FROM pairs GROUP BY variable", "bias rmse r")
def pooled_metrics(t: Tables) -> DataFrame:
    return compare.metrics(pairs(t), "code").filter("pooled").drop("pooled", "code")


@query("dom_06", f"SELECT code, variable, {METRICS}, false AS pooled FROM pairs GROUP BY code, variable UNION ALL SELECT -1, variable, {METRICS}, true FROM pairs GROUP BY variable", "bias rmse r")
def provider_comparison(t: Tables) -> DataFrame:
    return compare.metrics(pairs(t), "code").withColumn("code", F.coalesce("code", F.lit(-1)))


@query("join_10", "SELECT l.id, l.price - r.price AS difference FROM left_view l JOIN right_view r USING (id)", "difference")
def joined_providers(t: Tables) -> DataFrame:
    ours, theirs = t.providers
    return ours.join(theirs.select("id", F.col("price").alias("other")), "id").select("id", (F.col("price") - F.col("other")).alias("difference"))


@query("agg_16", "SELECT p_size, count(*) AS n, count(*)::DOUBLE / (SELECT count(*) FROM part WHERE p_size IS NOT NULL) AS fraction FROM part WHERE p_size IS NOT NULL GROUP BY p_size", "fraction")
def code_histogram(t: Tables) -> DataFrame:
    return survey.class_shares(t.raw("part"), "p_size")


@query("win_07", "SELECT p_brand, n, n::DOUBLE / sum(n) OVER () AS fraction FROM (SELECT p_brand, count(*) AS n FROM part GROUP BY p_brand) q", "fraction")
def fraction_of_total(t: Tables) -> DataFrame:
    from veldt.operators.timeseries import share_of_total

    return share_of_total(t.raw("part").groupBy("p_brand").agg(F.count("*").alias("n")), "n", "fraction")


CLASSES = {"dryland": (1, 9), "irrigated": (10, 20), "rotation": (41, 45)}


@query("agg_17", "SELECT avg(CASE WHEN p_size BETWEEN 1 AND 9 THEN 1e0 ELSE 0e0 END) AS dryland, avg(CASE WHEN p_size BETWEEN 10 AND 20 THEN 1e0 ELSE 0e0 END) AS irrigated, avg(CASE WHEN p_size BETWEEN 41 AND 45 THEN 1e0 ELSE 0e0 END) AS rotation FROM part", "dryland irrigated rotation")
def class_fractions(t: Tables) -> DataFrame:
    return survey.class_fractions(t.raw("part"), "p_size", CLASSES)


@query("flt_12", "SELECT p_partkey, p_size BETWEEN 1 AND 9 OR p_size BETWEEN 10 AND 20 OR p_size BETWEEN 41 AND 45 AS cropping FROM part")
def code_classes(t: Tables) -> DataFrame:
    inside = F.lit(False)
    for low, high in CLASSES.values():
        inside = inside | F.col("p_size").between(low, high)
    return t.raw("part").select("p_partkey", inside.alias("cropping"))


STATIONS = "(SELECT c_custkey, c_nationkey, c_acctbal > 0 AS available FROM customer)"
COVERAGE = f"SELECT region::VARCHAR AS aagis_code, region_name, zone, count(*) FILTER (available)::INT AS n_available, count(*) FILTER (NOT available)::INT AS n_unavailable, count(c_custkey)::INT AS n_total, zone IN ('ASIA', 'EUROPE') AS broad FROM regions LEFT JOIN {STATIONS} s ON c_nationkey = region AND region <> 3 GROUP BY region, region_name, zone"


def coverage(t: Tables) -> DataFrame:
    stations = t.raw("customer").select(F.when(F.col("c_nationkey") != 3, F.col("c_nationkey")).cast("string").alias("aagis_code"), (F.col("c_acctbal") > 0).alias("available"))
    zones = F.when(F.col("zone").isin("ASIA", "EUROPE"), F.lit("Wheat Sheep")).otherwise(F.col("zone"))
    return compare.region_coverage(stations, t.regions.select(F.col("region").cast("string").alias("aagis_code"), "region_name", zones.alias("zone")))


@query("dom_08", f"SELECT aagis_code, region_name, CASE WHEN broad THEN 'Wheat Sheep' ELSE zone END AS zone, n_available, n_unavailable, n_total, broad AS is_broadacre, broad AND n_available = 0 AS no_station, broad AND n_available BETWEEN 1 AND 2 AS sparse FROM ({COVERAGE}) c")
def station_coverage(t: Tables) -> DataFrame:
    return coverage(t)


@query("agg_11", "SELECT c_nationkey, count(*) FILTER (c_acctbal > 0) AS n_available, count(*) FILTER (c_acctbal <= 0) AS n_unavailable FROM customer GROUP BY c_nationkey")
def conditional_counts(t: Tables) -> DataFrame:
    return t.raw("customer").groupBy("c_nationkey").agg(F.count_if(F.col("c_acctbal") > 0).alias("n_available"), F.count_if(F.col("c_acctbal") <= 0).alias("n_unavailable"))


@query("join_06", f"SELECT aagis_code, n_available, n_unavailable FROM ({COVERAGE}) c")
def zero_filled(t: Tables) -> DataFrame:
    return coverage(t).select("aagis_code", "n_available", "n_unavailable")


@query("join_08", "SELECT region, count(cell_id) AS n_cells FROM regions LEFT JOIN cells USING (region) GROUP BY region")
def cells_of_regions(t: Tables) -> DataFrame:
    return t.regions.select("region").join(t.cells.groupBy("region").agg(F.count("*").alias("n_cells")), "region", "left").select("region", F.coalesce("n_cells", F.lit(0)).alias("n_cells"))


@query("join_07", "SELECT region, region_name, zone, latitude, rain FROM regions LEFT JOIN (SELECT region, sum(lat * weight) / sum(weight) AS latitude FROM cells GROUP BY region) l USING (region) LEFT JOIN (SELECT region, avg(value) AS rain FROM annual WHERE variable = 'daily_rain' GROUP BY region) r USING (region)", "latitude rain")
def chained_left_joins(t: Tables) -> DataFrame:
    latitude = t.cells.groupBy("region").agg(stats.weighted_mean(F.col("lat"), F.col("weight")).alias("latitude"))
    rain = t.annual.filter("variable = 'daily_rain'").groupBy("region").agg(F.avg("value").alias("rain"))
    return t.regions.join(latitude, "region", "left").join(rain, "region", "left")


@query("join_09", "SELECT s_suppkey, n_name FROM supplier LEFT JOIN nation ON s_nationkey = n_nationkey")
def map_lookup(t: Tables) -> DataFrame:
    return t.raw("supplier").join(t.raw("nation"), F.col("s_nationkey") == F.col("n_nationkey"), "left").select("s_suppkey", "n_name")


REFERENCE = [("1", 10.0, 0.0, 100.0), ("2", 20.0, 15.0, 4000.0), ("3", 17.0, 13.0, 5000.0)]
REGION_CLIMATE = "SELECT region, avg(value) FILTER (variable = 'max_temp') AS max_temp, avg(value) FILTER (variable = 'min_temp') AS min_temp, avg(value) FILTER (variable = 'daily_rain') AS daily_rain FROM annual GROUP BY region"


@query(
    "dom_10",
    f"SELECT region::VARCHAR AS aagis_code, abs(max_temp - ref_max) <= 3 AND abs(min_temp - ref_min) <= 3 AS temperature_ok, abs(1e2 * (daily_rain - ref_rain) / ref_rain) <= 45 AS rain_ok FROM ({REGION_CLIMATE}) c JOIN (VALUES (1, 10e0, 0e0, 100e0), (2, 20e0, 15e0, 4000e0), (3, 17e0, 13e0, 5000e0)) v(code, ref_max, ref_min, ref_rain) ON code = region",
)
def reference_check(t: Tables) -> DataFrame:
    from .queries_climate import region_annual_wide

    regions = region_annual_wide(t).withColumn("aagis_code", F.col("region").cast("string"))
    reference = t.spark.createDataFrame(REFERENCE, "aagis_code string, ref_max double, ref_min double, ref_rain double")
    return compare.reference_check(regions, reference).select("aagis_code", "temperature_ok", "rain_ok")


@query("set_03", "SELECT n_name AS value, 'left' AS side FROM nation WHERE n_nationkey < 15 AND n_nationkey >= 10 UNION ALL SELECT n_name, 'right' FROM nation WHERE n_nationkey < 10 AND n_nationkey < 5 UNION ALL SELECT n_name, 'right' FROM nation WHERE n_nationkey >= 15")
def name_orphans(t: Tables) -> DataFrame:
    names = t.raw("nation").select(F.col("n_name").alias("region"), "n_nationkey")
    left = names.filter(F.col("n_nationkey").between(5, 14)).select("region")
    right = names.filter((F.col("n_nationkey") < 10) | (F.col("n_nationkey") >= 15)).select("region")
    return sets.orphans(left, right, "region")


@query("set_04", "SELECT c_nationkey AS nation FROM customer INTERSECT SELECT s_nationkey FROM supplier WHERE s_acctbal > 0")
def common_nations(t: Tables) -> DataFrame:
    return sets.common(t.raw("customer").select(F.col("c_nationkey").alias("nation")), t.raw("supplier").filter("s_acctbal > 0").select(F.col("s_nationkey").alias("nation")), "nation")


@query("set_05", "SELECT DISTINCT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_totalprice > 300000)")
def not_a_subset(t: Tables) -> DataFrame:
    part = t.raw("customer").select("c_custkey")
    return sets.missing_from(part, t.raw("orders").filter("o_totalprice > 300000").select(F.col("o_custkey").alias("c_custkey")), ["c_custkey"])


@query("set_01", "SELECT 'early' AS part, region, year FROM per_farm WHERE year < 1998 UNION ALL SELECT 'late', region, year FROM per_farm WHERE year >= 2000")
def concatenated(t: Tables) -> DataFrame:
    tagged = lambda cond, name: t.per_farm.filter(cond).select(F.lit(name).alias("part"), "region", "year")
    return tagged("year < 1998", "early").unionByName(tagged("year >= 2000", "late"))


@query("set_06", "SELECT DISTINCT year FROM per_farm WHERE year NOT IN (1996, 1997, 2000)")
def years_without_event(t: Tables) -> DataFrame:
    years = [(y,) for of in EVENTS.values() for y in of]
    return sets.missing_from(t.per_farm.select("year").distinct(), t.spark.createDataFrame(years, "year int").distinct(), ["year"])


@query("srt_01", f"SELECT aagis_code, n_available FROM (SELECT * FROM ({COVERAGE}) c ORDER BY broad DESC, n_available, aagis_code LIMIT 8) q")
def mixed_sort(t: Tables) -> DataFrame:
    return coverage(t).orderBy(F.desc("is_broadacre"), "n_available", "aagis_code").limit(8).select("aagis_code", "n_available")


@query("srt_03", "SELECT region, year, yield_t_ha FROM per_farm ORDER BY yield_t_ha DESC, region, year LIMIT 5", "yield_t_ha")
def top_five(t: Tables) -> DataFrame:
    return t.per_farm.select("region", "year", "yield_t_ha").orderBy(F.desc("yield_t_ha"), "region", "year").limit(5)


@query("srt_04", "SELECT region, arg_min(year, yield_t_ha) AS worst_year FROM per_farm GROUP BY region")
def worst_year(t: Tables) -> DataFrame:
    return t.per_farm.groupBy("region").agg(F.min_by("year", "yield_t_ha").alias("worst_year"))


@query("srt_05", "SELECT r_name AS zone, string_agg(n_name, ';' ORDER BY n_name) AS names FROM nation JOIN region ON n_regionkey = r_regionkey GROUP BY r_name")
def sorted_lists(t: Tables) -> DataFrame:
    return t.regions.groupBy("zone").agg(F.array_join(F.array_sort(F.collect_set("region_name")), ";").alias("names"))


@query("val_01", "SELECT * FROM (VALUES ('row_count_ok', true), ('codes_unique', true), ('codes_well_formed', true), ('names_unique', true), ('code_redundancy_ok', true), ('state_prefix_ok', false), ('zero_orphans', false)) v(\"check\", ok)")
def mapping_checks(t: Tables) -> DataFrame:
    mapping = t.raw("nation").select((F.col("n_nationkey") + 101).cast("string").alias("aagis_code"), F.col("n_name").alias("region_name"))
    return validate.region_mapping(mapping, t.raw("nation").filter("n_nationkey > 0").select(F.col("n_name").alias("region")), REGIONS)


@query(
    "val_03",
    f"SELECT unnest(['no_missing', 'rain_positive', 'max_temp_follows_latitude', 'min_temp_follows_latitude', 'seasonality_as_expected']) AS \"check\", unnest([bool_and(max_temp IS NOT NULL AND min_temp IS NOT NULL AND daily_rain IS NOT NULL), bool_and(daily_rain > 0), coalesce(corr(latitude, max_temp) >= 85e-2, false), coalesce(corr(latitude, min_temp) >= 8e-1, false), bool_and(CASE WHEN region % 2 = 0 THEN winter > summer ELSE true END)]) AS ok FROM ({REGION_CLIMATE}) c JOIN (SELECT region, sum(lat * weight) / sum(weight) AS latitude FROM cells GROUP BY region) l USING (region) JOIN (SELECT region, sum(value) FILTER (month BETWEEN 5 AND 8) AS winter, sum(value) FILTER (month IN (11, 12, 1, 2)) AS summer FROM month_cell JOIN cells USING (cell_id) WHERE variable = 'daily_rain' GROUP BY region) s USING (region)",
)
def consistency(t: Tables) -> DataFrame:
    from .queries_climate import region_annual_wide, region_latitude

    months = t.in_regions(t.parts.filter("variable = 'daily_rain'")).groupBy("region").agg(F.sum(F.when(F.col("month").between(5, 8), F.col("total"))).alias("winter_share"), F.sum(F.when(F.col("month").isin(11, 12, 1, 2), F.col("total"))).alias("summer_share"))
    regions = region_annual_wide(t).join(region_latitude(t).withColumnRenamed("latitude", "lat"), "region").join(months, "region")
    return validate.internal_consistency(regions.withColumn("regime", F.when(F.col("region") % 2 == 0, F.lit("winter"))))


@query(
    "val_05",
    "SELECT unnest(['regions', 'year_range', 'no_missing', 'rain_not_negative', 'tmax_gt_tmin']) AS \"check\", unnest([(SELECT count(DISTINCT region) = 25 FROM annual), (SELECT min(year) = 1995 AND max(year) = 2001 FROM annual), (SELECT bool_and(value IS NOT NULL) FROM annual), (SELECT bool_and(value >= 0) FROM annual WHERE variable = 'daily_rain'), (SELECT bool_and(a.value > b.value) FROM annual a JOIN annual b USING (region, year) WHERE a.variable = 'max_temp' AND b.variable = 'min_temp')]) AS ok",
)
def record_checks(t: Tables) -> DataFrame:
    return validate.full_record(t.annual.withColumnRenamed("region", "aagis_code"), REGIONS, 1995, 2001)


@query("val_04", "SELECT unnest(['yield_regions', 'climate_regions']) AS \"check\", unnest([(SELECT count(*) = 0 FROM per_farm WHERE region NOT IN (SELECT region FROM regions)), (SELECT count(*) = 0 FROM (SELECT region FROM regions EXCEPT SELECT region FROM annual WHERE variable = 'evap_pan' AND value > 1100) e)]) AS ok")
def invariants(t: Tables) -> DataFrame:
    big = t.annual.filter("variable = 'evap_pan' AND value > 1100").select("region")
    return validate.subset(t.per_farm, t.regions, ["region"], "yield_regions").unionByName(validate.subset(t.regions, big, ["region"], "climate_regions"))


@query("dom_11", "SELECT 'nation' AS product, count(*) AS n_rows, 3 AS n_columns FROM nation UNION ALL SELECT 'orders', count(*), 6 FROM orders UNION ALL SELECT 'supplier', count(*), 4 FROM supplier")
def inventory(t: Tables) -> DataFrame:
    parts = [t.raw(name).agg(F.count("*").alias("n_rows")).select(F.lit(name).alias("product"), "n_rows", F.lit(len(t.raw(name).columns)).alias("n_columns")) for name in ("nation", "orders", "supplier")]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query("val_11", "SELECT year, abs(production / area - 15e2) / 15e2 AS rel_error, abs(production / area - 15e2) / 15e2 <= 5e-2 AS within FROM (SELECT year, sum(production_t) AS production, sum(area_ha) AS area FROM per_farm GROUP BY year) n", "rel_error")
def national_yield_check(t: Tables) -> DataFrame:
    n = t.per_farm.groupBy("year").agg(F.sum("production_t").alias("p"), F.sum("area_ha").alias("a"))
    error = F.abs(F.try_divide("p", "a") - 1500.0) / 1500.0
    return n.select("year", error.alias("rel_error"), (error <= 0.05).alias("within"))
