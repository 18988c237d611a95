"""Operators on small tables with hand-computed answers."""

import datetime as dt
import math

import pytest
from pyspark.sql import functions as F

from veldt import schema
from veldt.operators import climatology, compare, sets, spatial, survey, timeseries, validate
from veldt.operators import indicators as I

WINTER, SUMMER = I.GROWING_WINDOWS["southern_winter"], I.GROWING_WINDOWS["qld_summer"]


def cube(spark, first, last, **columns):
    """Two cells by every day; columns as SQL text over date."""
    days = spark.range(2).select(F.col("id").alias("cell_id"), F.explode(F.expr(f"sequence(DATE'{first}', DATE'{last}')")).alias("date"))
    return days.withColumns({k: F.expr(v).cast("double") for k, v in columns.items()})


def values(df, column):
    return sorted((r["season_year"], r[column]) for r in df.filter("cell_id = 0").collect())


def test_frost_days(spark):
    whole = cube(spark, "2010-01-01", "2010-12-31", min_temp="-5")
    assert values(I.frost_days(cube(spark, "2010-01-01", "2010-12-31", min_temp="2.0"), WINTER), "frost_days") == [(2010, 0)]
    assert values(I.frost_days(whole.withColumn("min_temp", F.lit(1.99)), WINTER), "frost_days") == [(2010, 214)]
    june = whole.withColumn("min_temp", F.when(F.month("date") == 6, -5.0).otherwise(10.0))
    assert values(I.frost_days(june, WINTER), "frost_days") == [(2010, 30)]
    january = whole.withColumn("min_temp", F.when(F.month("date") == 1, -5.0).otherwise(10.0))
    assert values(I.frost_days(january, WINTER), "frost_days") == [(2010, 0)]
    missing = whole.withColumn("min_temp", F.when(F.col("cell_id") == 1, F.lit(1.0)))
    assert values(I.frost_days(missing, WINTER), "frost_days") == [(2010, None)]


def test_season_across_years(spark):
    days = cube(spark, "2010-01-01", "2011-12-31", min_temp="if((year(date) = 2010 and month(date) = 11) or (year(date) = 2011 and month(date) = 2), -5, 10)")
    assert values(I.frost_days(days, SUMMER), "frost_days") == [(2009, 0), (2010, 58)]  # 2011 lacks its next year


def test_growing_degrees_are_strict(spark):
    days = cube(spark, "2010-01-01", "2010-12-31", max_temp="20", min_temp="10")
    assert values(I.growing_degree_days(days, WINTER), "gdd") == [(2010, 214 * 15.0)]
    holes = days.withColumn("max_temp", F.when(F.col("date") != "2010-06-01", F.col("max_temp")))
    assert values(I.growing_degree_days(holes, WINTER), "gdd") == [(2010, None)]


def test_dry_spell_counts_missing_days(spark):
    days = cube(spark, "2010-04-01", "2010-10-31", daily_rain="if(dayofmonth(date) = 15, 5, if(dayofmonth(date) = 16, null, 0))")
    assert values(I.dry_spell(days, WINTER), "cdd") == [(2010, 30)]
    wet = days.withColumn("daily_rain", F.lit(1.0))
    assert values(I.dry_spell(wet, WINTER), "cdd") == [(2010, 0)]


def test_excess_heat_of_constant_temperature_is_zero(spark):
    days = cube(spark, "1999-01-01", "2000-12-31", max_temp="30", min_temp="20")
    t = I.t90(days, 1999, 2000)
    assert [r["t90"] for r in t.collect()] == [25.0, 25.0]
    assert I.excess_heat_factor(days, t).filter("ehf <> 0 or ehf is null").count() == 0
    hot = days.withColumns({"max_temp": F.col("max_temp") + F.when(F.year("date") == 2000, 15).otherwise(0), "min_temp": F.col("min_temp") + F.when(F.year("date") == 2000, 15).otherwise(0)})
    low = t.withColumn("t90", F.lit(20.0))
    assert I.excess_heat_factor(hot, low).filter("ehf <= 0 and date > '2000-01-05'").count() == 0


def test_monthly_totals_need_whole_months(spark):
    days = cube(spark, "2010-01-01", "2010-03-15", daily_rain="2", evap_pan="0.5")
    got = {r["month"]: r["rain"] for r in I.monthly_totals(days, "daily_rain", "rain").filter("cell_id = 0").collect()}
    assert got == {1: 62.0, 2: 56.0, 3: None}
    got = {r["month"]: r["balance"] for r in I.water_balance(days).filter("cell_id = 0").collect()}
    assert got[1] == pytest.approx(46.5)


def test_spei_is_standard_normal_like(spark):
    rows = [(0, y, m, y * 12 + m, 50 + 30 * ((y * 7919 + m * 104729) % 1000 / 1000) ** 2) for y in range(1970, 2000) for m in range(1, 13)]
    months = spark.createDataFrame(rows, "cell_id long, year int, month int, month_index int, balance double")
    out = I.spei(months, I.fit_spei(months, "balance", 3, 1970, 1999), "balance", 3).agg(F.avg("spei"), F.stddev_pop("spei"), F.count("*")).first()
    assert abs(out[0]) < 0.5 and 0.5 < out[1] < 1.5 and out[2] == 358
    flat = months.withColumn("balance", F.lit(1.0))
    assert I.fit_spei(flat, "balance", 3, 1970, 1999).filter("alpha is not null or beta is not null or gamma is not null").count() == 0


def test_rolling_sum_stops_at_gaps(spark):
    df = spark.createDataFrame([("a", i, 1.0) for i in (1, 2, 3, 5, 6)], "k string, m int, v double")
    got = [r["s"] for r in timeseries.rolling_sum(df, ["k"], "m", "v", 3, "s").orderBy("m").collect()]
    assert got == [None, None, 3.0, None, None]


def test_region_means(spark):
    df = spark.createDataFrame([("121", "A", 10.0, 1.0), ("121", "A", 20.0, 3.0), ("521", "B", 5.0, 2.0), ("9", "C", None, 1.0), (None, "D", 1.0, 1.0)], "code string, name string, value double, weight double")
    got = {r["code"]: (r["value"], r["n_cells"]) for r in climatology.region_means(df, ["code", "name"]).collect()}
    assert got == {"121": (17.5, 2), "521": (5.0, 1)}
    zero = df.withColumn("weight", F.lit(0.0))
    assert {r["code"]: (r["value"], r["n_cells"]) for r in climatology.region_means(zero, ["code"]).collect()}["121"] == (None, 2)


def test_baselines(spark):
    series = spark.createDataFrame([(r, y, 25.0) for r in ("a", "b") for y in range(1961, 2021)], "region string, year int, value double")
    periods = spark.createDataFrame([("old", 1961, 1990), ("new", 1991, 2020)], "baseline string, first int, last int")
    got = climatology.baselines(series, periods, ["region"]).collect()
    assert len(got) == 4 and all((r["mean_value"], r["n_years"]) == (25.0, 30) for r in got)


def test_survey_totals_and_reconstruction(spark):
    farm = spark.createDataFrame([("R1", 2020, 100.0, 300.0, 3.0), ("R2", 2020, 200.0, 400.0, 2.0), ("R1", 1991, 1.0, 1.0, 1.0)], "region string, year int, area_ha double, production_t double, yield_t_ha double")
    people = spark.createDataFrame([("R1", 2020, 10.0), ("R2", 2020, 5.0), ("R1", 1990, 7.0)], "region string, year int, population double")
    got = {(r["region"], r["year"]): (r["area_total_ha"], r["production_total_t"], r["yield_t_ha"]) for r in survey.region_totals(farm, people).collect()}
    assert got == {("R1", 2020): (1000.0, 3000.0, 3.0), ("R2", 2020): (1000.0, 2000.0, 2.0), ("R1", 1991): (None, None, 1.0)}

    def verdict(regions, national, rse):
        totals = spark.createDataFrame([(f"r{i}", 2020, 1e6) for i in range(regions)], "region string, year int, production_total_t double")
        years = survey.reconstruction(totals, spark.createDataFrame([(2020, national, rse)], "year int, national_total_t double, national_rse double"))
        return survey.reconstruction_verdict(years).first()

    assert verdict(32, 32e6, 5.0)["valid"] and not verdict(32, 50e6, 5.0)["valid"]
    high = verdict(32, 32e6, 23.0)
    assert not high["valid"] and high["n_graded_years"] == 0 and high["n_high_rse_years"] == 1
    part = verdict(2, 2e6, 5.0)
    assert not part["valid"] and part["n_partial_years"] == 1


def test_event_summary_keeps_empty_events(spark):
    panel = spark.createDataFrame([("a", 2018, 1.0), ("a", 2019, 3.0), ("a", 1999, -1.0)], "region string, year int, resid_yield double")
    got = {r["event"]: (r["region_years"], r["mean_resid_yield"]) for r in survey.event_summary(panel).collect()}
    assert got == {"Millennium Drought (2001-2009)": (0, None), "2018 drought": (2, 2.0), "2013/2017 heat": (0, None), "non-event": (1, -1.0)}


def test_provider_metrics(spark):
    a = spark.createDataFrame([(1, 11.0, 5.0), (2, 12.0, None), (3, 13.0, 1.0)], "id long, tmax double, rain double")
    b = spark.createDataFrame([(1, 10.0, 5.0), (2, 11.0, 2.0), (3, 12.0, 1.0), (4, 0.0, 0.0)], "id long, tmax double, rain double")
    pairs = compare.paired(a, b, ["id"], ["tmax", "rain"]).withColumn("code", F.lit("x"))
    got = {(r["variable"], r["pooled"]): (r["n"], r["bias"], r["rmse"], r["r"]) for r in compare.metrics(pairs, "code").collect()}
    assert got[("tmax", False)] == (3, 1.0, 1.0, pytest.approx(1)) and got[("rain", True)] == (2, 0.0, 0.0, pytest.approx(1))


def test_station_coverage(spark):
    regions = spark.createDataFrame([("521", "a", "Wheat Sheep"), ("631", "b", "High Rainfall"), ("421", "c", "Wheat Sheep"), ("711", "d", "Pastoral")], "aagis_code string, region_name string, zone string")
    stations = spark.createDataFrame([("521", True), ("521", True), ("521", True), ("521", False), ("421", True), (None, True)], "aagis_code string, available boolean")
    got = {r["aagis_code"]: (r["n_available"], r["n_unavailable"], r["no_station"], r["sparse"]) for r in compare.region_coverage(stations, regions).collect()}
    assert got == {"521": (3, 1, False, False), "631": (0, 0, True, False), "421": (1, 0, False, True), "711": (0, 0, False, False)}


def test_point_in_polygon(spark):
    ring = lambda *v: [{"x": float(x), "y": float(y)} for x, y in v]
    rings = spark.createDataFrame([("c", 0, ring((0, 0), (4, 0), (4, 4), (2, 1), (0, 4))), ("h", 0, ring((10, 10), (14, 10), (14, 14), (10, 14))), ("h", 1, ring((11, 11), (13, 11), (13, 13), (11, 13)))], "aagis_code string, ring_id int, verts array<struct<x: double, y: double>>")
    points = spark.createDataFrame([(1, 0.5, 2.0), (2, 3.0, 2.0), (3, 2.0, 3.5), (4, 12.0, 12.0), (5, 10.5, 10.5)], "id int, lat double, lon double")
    got = {r["id"]: r["aagis_code"] for r in spatial.assign_regions(points, rings).collect()}
    assert got == {1: "c", 2: None, 3: "c", 4: None, 5: "h"}
    assert spatial.assign_regions(points, rings, "inner").count() == 3


def test_nearest_prefers_small_id_and_finds_far_cells(spark):
    cells = spark.createDataFrame([(1, -31.0, 117.0), (2, -31.0, 117.0), (3, -35.0, 120.0)], "cell_id long, lat double, lon double")
    points = spark.createDataFrame([("near", -31.1, 117.05), ("far", 60.0, -100.0)], "id string, lat double, lon double")
    got = {r["id"]: (r["cell_id"], r["km"]) for r in spatial.nearest(points, cells, "id").collect()}
    assert got["near"][0] == 1 and got["near"][1] < 15 and got["far"][1] > 10_000


def test_grid_keys(spark):
    grid = spatial.grid_coordinates(spark, -20.0, 110.0, 0.05, 3, 4)
    assert grid.count() == 12
    cells = spark.createDataFrame([(7, -19.95, 110.1)], "cell_id long, lat double, lon double")
    r = spatial.resolve_grid(cells, grid).first()
    assert (r["row"], r["col"]) == (1, 2)
    with pytest.raises(Exception, match="off the grid"):
        spatial.resolve_grid(cells.withColumn("lat", F.lit(0.0)), grid).collect()


def test_sets_and_checks(spark):
    a, b = (spark.createDataFrame([(x,) for x in v], "name string") for v in (["x", "y", "z"], ["y", "z", "w"]))
    assert {(r["value"], r["side"]) for r in sets.orphans(a, b, "name").collect()} == {("x", "left"), ("w", "right")}
    assert {r[0] for r in sets.common(a, b, "name").collect()} == {"y", "z"}
    mapping = spark.createDataFrame([("101", "NSW A"), ("201", "VIC B"), ("301", "QLD C")], "aagis_code string, region_name string")
    names = mapping.select(F.col("region_name").alias("region"))
    assert all(r["ok"] for r in validate.region_mapping(mapping, names, 3).collect())
    typo = {r["check"]: r["ok"] for r in validate.region_mapping(mapping, names.filter("region <> 'QLD C'"), 3).collect()}
    assert typo.pop("zero_orphans") is False and all(typo.values())


def test_latitude_guard(spark):
    mask = spark.createDataFrame([(float(x),) for x in (-18, -19, -20)], "lat double")
    flipped = spark.createDataFrame([(float(x),) for x in (-10, -11, -12)], "lat double")
    assert all(r["ok"] for r in validate.alignment(mask, mask).collect())
    assert {r["check"]: r["ok"] for r in validate.alignment(flipped, mask).collect()} == {"count_ok": True, "latitude_ok": False}


def test_empty_frames_and_schema_guards(spark):
    empty = spark.createDataFrame([], "cell_id long, date date, daily_rain double, min_temp double")
    assert I.frost_days(empty, WINTER).count() == 0 and I.dry_spell(empty, SUMMER).count() == 0
    with pytest.raises(schema.SchemaError):
        schema.require_columns(empty, ["nothing"])
    df = spark.createDataFrame([(float("nan"), 1.0)], "a double, b double")
    assert schema.nan_to_null(df).first()["a"] is None
    assert dt.date(2024, 1, 1) == spark.sql("select DATE'2024-01-01'").first()[0]


def test_nearest_far_from_all_cells_and_over_the_date_line(spark):
    cells = spark.createDataFrame([(1, 0.0, 179.8), (2, 0.0, -170.0), (3, -40.0, 60.0), (4, 0.0, 179.8)], "cell_id long, lat double, lon double")
    points = spark.createDataFrame([("line", 0.0, -179.9), ("far", 60.0, 10.0), ("near", -40.2, 60.1), ("pole", 89.9, 0.0)], "key string, lat double, lon double")
    found = {r["key"]: r["cell_id"] for r in spatial.nearest(points, cells, "key").collect()}
    rows, asked = cells.collect(), points.collect()

    def km(p, c):
        a, b, d = math.radians(p["lat"]), math.radians(c["lat"]), math.radians(c["lon"] - p["lon"])
        return math.sin((b - a) / 2) ** 2 + math.cos(a) * math.cos(b) * math.sin(d / 2) ** 2

    assert found == {p["key"]: min((round(km(p, c), 12), c["cell_id"]) for c in rows)[1] for p in asked}


def test_points_that_repeat_keep_their_region(spark):
    rings = spark.createDataFrame([("a", 0, [(0.0, 0.0), (4.0, 0.0), (4.0, 4.0), (0.0, 4.0), (0.0, 0.0)]), ("a", 1, [(1.0, 1.0), (2.0, 1.0), (2.0, 2.0), (1.0, 2.0), (1.0, 1.0)])], "aagis_code string, ring_id int, verts array<struct<x: double, y: double>>")
    points = spark.createDataFrame([(1, 3.0, 3.0), (2, 3.0, 3.0), (3, 1.5, 1.5), (4, None, 3.0)], "id int, lat double, lon double")
    found = {r["id"]: r["aagis_code"] for r in spatial.assign_regions(points, rings).collect()}
    assert found == {1: "a", 2: "a", 3: None, 4: None}


def test_densified_makes_days_behind_the_join(spark):
    """As a join of all made days gives it: rows of one day, days outside, keys without rows, keys that are NULL or stand twice."""
    rows = [(1, "2000-01-03", 1.0), (1, "2000-01-03", 2.0), (1, "2000-01-07", None), (2, "2000-01-01", 3.0), (2, "2000-01-09", 4.0), (3, "1999-12-31", 5.0), (3, "2000-01-10", 6.0), (3, None, 7.0), (5, "2000-01-02", 8.0), (5, "2000-01-02", 8.5), (None, "2000-01-02", 9.0)]
    df = spark.createDataFrame(rows, "k int, d string, v double").withColumn("d", F.col("d").cast("date"))
    keys = spark.createDataFrame([(1,), (2,), (3,), (4,), (5,), (5,), (None,)], "k int").coalesce(1)
    first, last = F.lit(dt.date(2000, 1, 1)), F.lit(dt.date(2000, 1, 9))
    got = timeseries.densified(df, keys, "d", first, last)
    want = keys.withColumn("d", F.explode(F.sequence(first, last))).join(df, ["k", "d"], "left")
    assert got.columns == want.columns and got.count() == want.count() == 7 * 9 + 3
    assert got.exceptAll(want).count() == want.exceptAll(got).count() == 0
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("Generate") < plan.index("Join LeftOuter")
    assert "Exchange" not in got.groupBy("k").agg(F.sum("v"))._jdf.queryExecution().executedPlan().toString().split("Generate")[0]


def test_days_lines_are_dealt_before_they_are_reduced(spark, tmp_path):
    """No task holds the groups of a whole split."""
    from veldt.plans.adapt import Tables

    lines = [(1, dt.date(2000, 1, 1), 3.0, 6000.0, 0.5, 0.25), (1, dt.date(2000, 1, 1), 4.0, 3000.0, 0.25, 0.0), (2, None, 1.0, 3000.0, 0.0, 0.0), (None, dt.date(2000, 1, 1), None, None, None, None)]
    spark.createDataFrame(lines, "l_suppkey long, l_shipdate date, l_quantity double, l_extendedprice double, l_discount double, l_tax double").write.parquet(f"{tmp_path}/lineitem.parquet")
    obs = Tables(spark, str(tmp_path)).obs
    assert sorted(map(tuple, obs.collect()), key=str) == sorted([(1, dt.date(2000, 1, 1), 7.0, 75.0, 1.5, -11.0), (2, None, 1.0, 0.0, 1.0, 1.0), (None, dt.date(2000, 1, 1), None, None, None, None)], key=str)
    steps = [line for line in obs._jdf.queryExecution().sparkPlan().toString().splitlines() if "Aggregate" in line or "Repartition" in line or "Exchange" in line]
    assert "Aggregate" not in steps[-1]


def test_days_have_a_fixed_number_of_partitions(spark, tmp_path):
    """Spark would merge few rows into one task, whose load would then grow with the input."""
    from veldt.plans.adapt import Tables

    lines = [(k, dt.date(2000, 1, 1 + d), 3.0, 6000.0, 0.5, 0.25) for k in range(20) for d in range(5)]
    spark.createDataFrame(lines, "l_suppkey long, l_shipdate date, l_quantity double, l_extendedprice double, l_discount double, l_tax double").write.parquet(f"{tmp_path}/lineitem.parquet")
    obs = Tables(spark, str(tmp_path)).obs
    assert obs.count() == 100
    assert obs.rdd.getNumPartitions() == int(spark.conf.get("spark.sql.shuffle.partitions"))


def test_months_made_once_are_read_in_a_fixed_number_of_partitions(spark):
    from veldt.plans.adapt import made_once

    months = spark.createDataFrame([(k, m, float(k + m)) for k in range(20) for m in range(3)], "cell_id int, month int, rain double")
    held = made_once(months, "rain-months")
    assert held.exceptAll(months).count() == months.exceptAll(held).count() == 0
    sums = held.groupBy("cell_id").agg(F.sum("rain"))
    assert sums.count() == 20
    assert sums.rdd.getNumPartitions() == int(spark.conf.get("spark.sql.shuffle.partitions"))
