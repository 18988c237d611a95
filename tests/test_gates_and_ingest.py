"""Percentiles of hot groups, ingest by units, and gates that fail."""

import datetime as dt
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from veldt.operators import quantiles, validate
from veldt.plans import catalogue, queries_files
from veldt.sources import ingest, netcdf

SMALL = "/root/testdata/sf0.001"


@pytest.mark.parametrize("most", [10, 100_000])
def test_percentiles_equal_sorted_lists(spark, monkeypatch, most):
    """Cut again and again as well as sorted: ties, one value, infinities, values far apart, a NULL key."""
    monkeypatch.setattr(quantiles, "SORTED_ROWS", most)
    r = np.random.default_rng(3)
    groups = {"hot": r.normal(size=4000), "ties": r.integers(0, 3, 500).astype(float), "one": [7.0], "two": [1.0, 2.0], None: r.exponential(size=50), "far": [1e-300, 1e300, -1e300, 5.0, 5.0, 1e-5], "skewed": 10.0 ** r.uniform(-200, 200, 300), "endless": [math.inf, 1.0, -math.inf, 2.0, 3.0]}
    rows = [(k, "x", float(v)) for k, vs in groups.items() for v in vs] + [("hot", "x", None), ("hot", "x", float("nan")), ("nothing", "x", None)]
    df = spark.createDataFrame(rows, "g string, h string, v double").repartition(6)
    fractions = {"p0": 0.0, "p10": 0.1, "p50": 0.5, "p99": 0.99, "p100": 1.0}
    got = {x["g"]: x for x in quantiles.group_percentiles(df, ["g", "h"], F.col("v"), fractions).collect()}
    assert set(got) == set(groups)
    for k, vs in groups.items():
        if k != "endless":
            for name, p in fractions.items():
                assert got[k][name] == pytest.approx(np.quantile(vs, p), rel=1e-9, abs=1e-12)
    assert (got["endless"]["p0"], got["endless"]["p50"], got["endless"]["p100"]) == (-math.inf, 2.0, math.inf)
    assert quantiles.group_percentiles(df.limit(0), ["g"], F.col("v"), fractions).count() == 0


def test_ingest_repeats_what_failed_only(spark, tmp_path):
    days = spark.range(6).select(F.date_add(F.lit("2000-12-29").cast("date"), F.col("id").cast("int")).alias("date"), "id")
    cells = spark.createDataFrame([(a, o) for a in (-30.0, -29.95, -10.0) for o in (140.0, 140.05)], "lat double, lon double")
    values = days.crossJoin(cells).select(F.lit("rain").alias("variable"), "date", "lat", "lon", F.when(F.col("id") != 2, F.col("id") + F.col("lat")).alias("value"))
    plan = ingest.Ingest(str(tmp_path / "landed"), str(tmp_path / "masked"), str(tmp_path / "log"), {"pan": 1970})
    netcdf.write_cube(values, plan.landed).count()
    broken = tmp_path / "landed" / "rain" / "2002.rain.nc"
    broken.write_bytes(b"no cube")
    units = spark.createDataFrame([("rain", 2000), ("rain", 2001), ("rain", 2002), ("rain", 2002), ("pan", 1969), ("wind", 2000), (None, 1)], "variable string, year int")
    mask = cells.filter("lat < -20 or lon > 140.01")
    status = lambda rows: {(r["variable"], r["year"]): r["status"] for r in rows}
    first = ingest.ingest(units, mask, plan).collect()
    assert status(first) == {("rain", 2000): "done", ("rain", 2001): "done", ("rain", 2002): "error", ("pan", 1969): "skipped", ("wind", 2000): "error"}
    by = {(r["variable"], r["year"]): r for r in first}
    assert (by["rain", 2000]["records"], by["rain", 2000]["cells"], by["rain", 2000]["present"]) == (3, 5, 10)
    assert "NetCDF" in by["rain", 2002]["message"] and "landed" in by["wind", 2000]["message"]
    assert {tuple(r) for r in ingest.unfinished(units.dropna(), plan.log).collect()} == {("rain", 2002), ("pan", 1969), ("wind", 2000)}
    files = {p: p.stat().st_mtime_ns for p in (tmp_path / "masked").rglob("*.nc")}
    broken.write_bytes((tmp_path / "landed" / "rain" / "2001.rain.nc").read_bytes())
    second = ingest.ingest(units, mask, plan).collect()
    assert status(second) == {**status(first), ("rain", 2000): "already", ("rain", 2001): "already", ("rain", 2002): "done"}
    assert all(p.stat().st_mtime_ns == t for p, t in files.items())
    got = netcdf.cube(spark, plan.masked, missing="drop").filter("year < 2002")
    want = values.join(mask, ["lat", "lon"]).filter("value is not null")
    assert got.select("date", "lat", "lon", "value").exceptAll(want.select("date", "lat", "lon", "value")).count() == 0 and got.count() == want.count()
    with pytest.raises(ValueError, match="no cells"):
        ingest.ingest(units, mask.limit(0), plan)


def test_a_turned_grid_is_an_error(spark, tmp_path):
    cells = spark.range(40).select((F.lit(-44.0) + F.col("id") * 0.5).alias("lat"), F.lit(140.0).alias("lon"), F.lit(dt.date(2000, 1, 1)).alias("date"), F.lit("rain").alias("variable"), F.lit(1.0).alias("value"))
    plan = ingest.Ingest(str(tmp_path / "landed"), str(tmp_path / "masked"), str(tmp_path / "log"), {})
    netcdf.write_cube(cells, plan.landed).count()
    units = spark.createDataFrame([("rain", 2000)], "variable string, year int")
    elsewhere = cells.select((F.col("lat") + 10).alias("lat"), "lon")
    (r,) = ingest.ingest(units, elsewhere, plan).collect()
    assert r["status"] == "error" and "40 cells" in r["message"] and not list((tmp_path / "masked").rglob("*.nc"))


def test_gates_fail_the_query(spark):
    cells = spark.createDataFrame([(float(i), 1.0, i) for i in range(10)], "lat double, lon double, n int")
    assert validate.aligned(cells, cells).count() == 10
    for moved in (cells.withColumn("lat", F.col("lat") + 5), cells.limit(5), cells.limit(0)):
        with pytest.raises(Exception, match="masked cells differ from the mask: .*ok"):
            validate.aligned(moved, cells).collect()
    with pytest.raises(Exception, match="latitudes"):
        validate.grid_shape(cells, 9, 1).collect()
    undecided = spark.createDataFrame([("a", True), ("b", None), ("c", False)], "check string, ok boolean")
    with pytest.raises(Exception, match="what: b, c"):
        validate.required(cells, undecided, "what").collect()
    assert validate.required(cells, undecided.limit(0), "what").count() == 10


def test_region_boundaries(spark):
    regions = spark.createDataFrame([(str(i), ["Pastoral", "Wheat Sheep", None][i % 3]) for i in range(30)], "code string, zone string")
    got = {r["zone"]: (r["n_regions"], r["expected"]) for r in validate.region_boundaries(regions).collect()}
    assert got == {"Pastoral": (10, True), "Wheat Sheep": (10, True), None: (10, False), "High Rainfall": (0, True)}
    for n in (27, 0):
        with pytest.raises(Exception, match="between 28 and 38"):
            validate.region_boundaries(regions.limit(n)).collect()


def test_conservation_and_cells_by_region(spark):
    coarse = spark.createDataFrame([(1.0,), (3.06,)], "area_km2 double")
    fine = spark.range(1600)
    (r,) = validate.conservation(coarse, fine, 0.0025).collect()
    assert r["ok"] and r["relative_diff_pct"] == pytest.approx(1.5)
    assert not validate.conservation(coarse, fine, 0.0025, 1.0).first()["ok"]
    assert not validate.conservation(coarse, fine.limit(0), 0.0025).first()["ok"]
    cells = spark.createDataFrame([(0.5, 0.5), (0.25, 0.5), (9.0, 9.0)], "lat double, lon double")
    ring = lambda x: [{"x": x, "y": 0.0}, {"x": x + 1, "y": 0.0}, {"x": x + 1, "y": 1.0}, {"x": x, "y": 1.0}]
    rings = spark.createDataFrame([("a", 0, ring(0.0)), ("b", 0, ring(20.0))], "aagis_code string, ring_id int, verts array<struct<x: double, y: double>>")
    assert {tuple(x) for x in validate.cells_by_region(cells, rings, 2).collect()} == {("a", 2, True), ("b", 0, False)}
    levels = spark.createDataFrame([(True, True), (False, True), (True, False)], "t005 boolean, t010 boolean")
    assert [tuple(x) for x in validate.monotone_thresholds(levels, ["t005", "t010"]).collect()] == [("t010_subset_of_t005", 1, False)]


def test_places_over_many_ranges(spark):
    from veldt.operators.ranking import placed

    df = spark.range(3000).select((F.col("id") * 7919 % 3001).alias("k"), (F.col("id") % 10).alias("v"), F.lit("x").alias("rows_before_all"))
    got = {r["k"]: r["place"] for r in placed(df.repartition(7), [F.desc("v"), F.asc("k")]).collect()}
    order = sorted(((i % 10, i * 7919 % 3001) for i in range(3000)), key=lambda x: (-x[0], x[1]))
    assert got == {k: i + 1 for i, (_, k) in enumerate(order)}
    assert placed(df.limit(0), [F.asc("k")]).count() == 0


@pytest.mark.parametrize("key", ["val_14", "join_18", "stat_11", "stat_12"])
def test_months_are_made_once(spark, key):
    """Fits and values read the same table of months, not the lines again."""
    plan = catalogue.queries()[key](spark, SMALL)._jdf.queryExecution().optimizedPlan().toString()
    assert "l_shipdate" not in plan and "Relation" in plan


def test_years_to_ingest_are_read_once(spark, monkeypatch):
    seen = []
    monkeypatch.setattr(queries_files.ingest, "ingest", lambda units, mask, plan: seen.append(units) or spark.createDataFrame([], ingest.STATUS))
    catalogue.queries()["src_20"](spark, SMALL)
    assert len(seen) == 2 and all("l_shipdate" not in units._jdf.queryExecution().optimizedPlan().toString() for units in seen)
