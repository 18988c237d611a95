"""Scans and sinks on small files."""

import csv
import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from veldt.schema import SchemaError
from veldt.sources import csv_ranges, sinks, tables, versions


def test_csv_of_old_encoding(spark, tmp_path):
    (tmp_path / "a.csv").write_bytes("name, value\nCafé,1.5\nNA,x\n,2\n".encode("cp1252"))
    got = [tuple(r) for r in tables.csv_safe(spark, str(tmp_path / "a.csv"), "name string, value double").collect()]
    assert got == [("Café", 1.5), ("NA", None), (None, 2.0)]


FIELDS = ["plain", "é" * 7, 'a "quoted" one', "two\nlines", "a,b", "", "NA", "\r\n", "€\"", "x" * 50]


@pytest.mark.parametrize("encoding,letters", [("utf-8", ""), ("cp1252", ""), ("latin-1", "\x81")])
@pytest.mark.parametrize("step", [7, 64, 1000])
def test_ranges_meet_at_ends_of_records(tmp_path, encoding, letters, step):
    """Whatever the ranges, every record is read once: with quoted line ends, and letters of several bytes at their edges."""
    r = random.Random(step)
    rows = [[str(i), r.choice(FIELDS).replace("€", "" if encoding == "latin-1" else "€") + letters, r.choice(FIELDS[:3])] for i in range(60)]
    path = tmp_path / "x.csv"
    with path.open("w", encoding=encoding, newline="") as f:
        csv.writer(f, lineterminator=r.choice(["\n", "\r\n"])).writerows([["id", "b", " c"], *rows])
    raw = path.read_bytes()
    cuts = [(at, min(at + step, len(raw))) for at in range(0, len(raw), step)]
    got = []
    with path.open("rb") as f:
        for a, b in cuts:
            got += csv_ranges.records(f, a, b, raw[:a].count(b'"') % 2 == 1, encoding)
    assert got == rows
    for e in ("utf-8", "cp1252", "latin-1"):
        whole = True
        try:
            raw.decode(e)
        except UnicodeDecodeError:
            whole = False
        assert all(csv_ranges._fits(raw[a:b], a > 0, raw[b : b + 3], e) for a, b in cuts) == whole


def test_a_large_file_is_read_by_several_tasks(spark, tmp_path):
    with (tmp_path / "big.csv").open("w", encoding="cp1252", newline="") as f:
        csv.writer(f).writerows([["k", "name"], *([i, f'Caf\xe9 "{i}"\nnext' if i % 3 else "plain"] for i in range(5000))])
    (tmp_path / "utf.csv").write_text("name,other,k\nÖ,1,5000\n\nshort\n", encoding="utf-8")
    (tmp_path / "empty.csv").write_text("")
    df = tables.csv_safe(spark, str(tmp_path), "k int, name string", range_bytes=8192)
    assert df.rdd.getNumPartitions() > 8
    assert df.select(F.spark_partition_id().alias("p")).distinct().count() > 8
    got = {r["k"]: r["name"] for r in df.collect()}
    assert got == {**{i: f'Caf\xe9 "{i}"\nnext' if i % 3 else "plain" for i in range(5000)}, 5000: "Ö", None: "short"}


def test_survey_file(spark, tmp_path):
    (tmp_path / "s.csv").write_text("Variable,Year,ABARES region,Value,RSE\nWheat area (ha), 2020 , R1 ,100,5\nWheat area (ha),bad,R2,,\n")
    rows = tables.survey(spark, str(tmp_path / "s.csv"), "regional").collect()
    assert [(r["year"], r["region"], r["value"], r["rse"]) for r in rows] == [(2020, "R1", 100.0, 5.0), (None, "R2", None, None)]


def test_census_marks(spark):
    raw = spark.createDataFrame([(" 101 ", ".."), ("2", "12.5"), ("3", "np")], "`Region code ` string, Estimate string")
    got = tables.census(raw, {"Region code": "region_code", "Estimate": "estimate"}, ["estimate"]).collect()
    assert [tuple(r) for r in got] == [("101", None), ("2", 12.5), ("3", None)]


def test_station_synonyms(spark):
    raw = spark.createDataFrame([("7", "Perth", "-31.9", "115.9", "12.5", "1910"), ("123456", "X", "bad", "1", "", None)], "Number string, station_name string, Lat string, LNG string, Elev string, first_year string")
    got = [tuple(r) for r in tables.stations(raw, ["123456"]).collect()]
    assert got == [("000007", "Perth", -31.9, 115.9, 12.5, 1910, True), ("123456", "X", None, 1.0, None, None, False)]
    with pytest.raises(SchemaError, match="start_year"):
        tables.stations(raw.drop("first_year"))


def test_rings_from_geojson(spark, tmp_path):
    (tmp_path / "r.geojson").write_text('{"type": "FeatureCollection", "features": [{"properties": {"aagis": "121"}, "geometry": {"type": "Polygon", "coordinates": [[[0, 0], [1, 0], [1, 1]]]}}, {"properties": {"aagis_code": "5"}, "geometry": {"type": "MultiPolygon", "coordinates": [[[[0, 0], [2, 0], [2, 2]]], [[[5, 5], [6, 5], [6, 6]]]]}}]}')
    got = {(r["aagis_code"], r["ring_id"]): len(r["verts"]) for r in tables.rings(spark, str(tmp_path / "r.geojson")).collect()}
    assert got == {("121", 0): 3, ("5", 0): 3, ("5", 1): 3}


def test_day_summary_json(spark, tmp_path):
    (tmp_path / "d.json").write_text('{"date": "2024-01-02", "lat": 1.0, "lon": 2.0, "tz": "+08:00", "temperature": {"min": 3.0}, "wind": {"max": {"speed": 9.0}}}')
    r = tables.day_summaries(spark, str(tmp_path / "d.json")).first()
    assert (str(r["date"]), r["temp_min"], r["temp_max"], r["wind_speed"]) == ("2024-01-02", 3.0, None, 9.0)


def parts(path):
    return {str(p.relative_to(path)) for p in path.rglob("*.parquet")}


def test_merge_append_touches_new_keys_only(spark, tmp_path):
    """The last row by the given order stays, the buckets of other keys keep their files, and older versions stay readable."""
    path = tmp_path / "t"
    rows = lambda *r: spark.createDataFrame(r, "k int, day date, v string, n int")
    day = dt.date(2020, 1, 1)
    sinks.merge_append(rows(*[(k, day, "old", 9) for k in range(40)], (None, None, "none", 1)), str(path), ["k", "day"], ("n",), buckets=8)
    first = parts(path)
    new = rows((3, day, "b", 2), (3, day, "c", 3), (3, day, "a", 1), (None, None, "again", 0), (3, day, "c", 3))
    got = {r["k"]: (r["v"], r["n"]) for r in sinks.merge_append(new, str(path), ["k", "day"], ("n",)).collect()}
    assert got == {**{k: ("old", 9) for k in range(40)}, 3: ("c", 3), None: ("again", 0)}
    table = versions.VersionedTable(spark, str(path), ["k", "day"])
    assert table.buckets == 8 and table.version == 2
    assert first < parts(path) and len({p.split("bucket=")[1][0] for p in parts(path) - first}) <= 2
    assert {r["v"] for r in table.read(1).collect()} == {"old", "none"}
    assert table.merge(new.limit(0)) == 2
    assert table.vacuum(keep=1) == 0 and table.read().count() == 41  # both writes still hold buckets
    wider = spark.createDataFrame([(7, day, "w", 1, 2.5)], "k int, day date, v string, n int, more double")
    assert sinks.merge_append(wider, str(path), ["k", "day"]).filter("more = 2.5").count() == 1


def test_a_merge_that_fails_leaves_the_old_version(spark, tmp_path):
    path = str(tmp_path / "t")
    table = versions.VersionedTable(spark, path, ["k"])
    with pytest.raises(FileNotFoundError):
        table.read()
    table.merge(spark.createDataFrame([(1, "a")], "k int, v string"))
    broken = spark.range(3).select(F.col("id").cast("int").alias("k"), F.when(F.col("id") < 2, F.lit("b")).otherwise(F.raise_error(F.lit("broken"))).alias("v"))
    with pytest.raises(Exception, match="broken"):
        table.merge(broken)
    assert table.version == 1 and [tuple(r) for r in table.read().collect()] == [(1, "a")]
    other = versions.VersionedTable(spark, path, ["k"])
    other._publish(2, other._writes(1))
    with pytest.raises(versions.Conflict):
        table._publish(2, {})
    table.merge(spark.createDataFrame([(1, "c")], "k int, v string"))
    assert table.vacuum(keep=1) >= 1 and [tuple(r) for r in other.read().collect()] == [(1, "c")]


def test_written_csv_is_whole(spark, tmp_path):
    sinks.write_csv(spark.createDataFrame([(1, "x")], "k int, v string"), str(tmp_path / "c"))
    assert spark.read.option("header", True).csv(str(tmp_path / "c")).first()["v"] == "x"
    assert not [p for p in tmp_path.iterdir() if "part-" in p.name or "old-" in p.name]


def test_grid_prunes(spark, tmp_path):
    df = spark.createDataFrame([(1, "a", 2000, float("nan")), (2, "b", 2001, 1.0)], "cell_id int, variable string, year int, value double")
    sinks.write_parquet(df, str(tmp_path / "g"), ("variable", "year"))
    assert tables.grid(spark, str(tmp_path / "g"), ["a"], [2000]).first()["value"] is None
    assert tables.land_path("/x/", "a", 2000) == "/x/variable=a/year=2000"


def test_missing_column_is_named(spark, tmp_path):
    (tmp_path / "s.csv").write_text("Variable,Year\nx,1\n")
    with pytest.raises(ValueError, match="ABARES region"):
        tables.survey(spark, str(tmp_path / "s.csv"), "regional")


def test_missing_inputs_are_all_named(spark, tmp_path):
    there = tmp_path / "there"
    there.mkdir()
    tables.require_inputs(spark, {"there": str(there)})
    with pytest.raises(FileNotFoundError, match="first.*second"):
        tables.require_inputs(spark, {"there": str(there), "first": str(tmp_path / "a"), "second": str(tmp_path / "b")})


def test_national_production_needs_both_variables(spark):
    rows = [("Wheat", 2000, "All Broadacre", 3.0, 9.0), ("Population", 2000, "All Broadacre", 4.0, 1.0), ("Wheat", 2001, "All Broadacre", 3.0, 9.0), ("Wheat", 2000, "Sheep", 7.0, 7.0)]
    national = spark.createDataFrame(rows, "variable string, year int, industry string, value double, rse double")
    assert tables.national_production(national, "Wheat").collect() == [(2000, 12.0, 9.0)]


def test_population_reads_its_variable_only(spark):
    rows = [("Population", 2000, "a", 5.0, 1.0), ("Size", 2000, "a", 6.0, 1.0)]
    regional = spark.createDataFrame(rows, "variable string, year int, region string, value double, rse double")
    assert tables.population(regional).collect() == [("a", 2000, 5.0)]


def test_station_list_is_cached(spark, tmp_path):
    landed = tmp_path / "list.csv"
    landed.write_bytes("Number,station_name,Lat,LNG,Elev,first_year\n7,Café,-31.9,115.9,12.5,1910\n".encode("cp1252"))
    cache = str(tmp_path / "cache")
    assert [tuple(r) for r in tables.cached_stations(spark, str(landed), cache, ["000007"]).collect()] == [("000007", "Café", -31.9, 115.9, 12.5, 1910, False)]
    landed.write_text("Number,station_name,Lat,LNG,Elev,first_year\n8,New,-30,115,1,1900\n")
    assert tables.cached_stations(spark, str(landed), cache).first()["station_id"] == "000007"
    assert tables.cached_stations(spark, str(landed), cache, fresh=True).first()["station_id"] == "000008"
    with pytest.raises(FileNotFoundError):
        tables.cached_stations(spark, str(tmp_path / "none.csv"), str(tmp_path / "other"))


def test_region_mapping_of_a_boundary_file(spark, tmp_path):
    path = tmp_path / "b.geojson"
    path.write_text('{"features": [{"properties": {"class": " 121", "name": "NSW A ", "zone": "Pastoral", "aagis": "121"}}, {"properties": {"class": "999", "name": null, "zone": "x"}}]}')
    rows = {tuple(r) for r in tables.region_mapping(spark, str(path)).collect()}
    assert rows == {("121", "NSW A", "Pastoral", "121", "NSW"), ("999", None, "x", None, None)}
    path.write_text('{"features": [{"properties": {"name": "a"}}]}')
    with pytest.raises(Exception, match="lacks class, zone"):
        tables.region_mapping(spark, str(path)).collect()


def test_suggestions_in_any_case(spark):
    from veldt.operators import sets

    names = spark.createDataFrame([("Asia",), ("asian Sea",), ("Äs",), ("",), (None,)], "n string")
    wanted = spark.createDataFrame([(1, "AS"), (2, "a"), (3, ""), (4, "asiatic"), (5, None), (6, "SIA"), (1, "as")], "k int, p string")
    got = sorted((r["k"], r["suggestions"]) for r in sets.suggestions(wanted, "k", "p", names, "n").collect())
    assert got == [(1, "Asia;asian Sea"), (1, "Asia;asian Sea"), (2, "Asia;asian Sea"), (3, ";Asia;asian Sea;Äs"), (4, None), (5, None), (6, "Asia;asian Sea")]
