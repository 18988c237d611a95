"""Queries over files: sinks write the driver's rows, scans read them again."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veldt.operators import sets, validate
from veldt.operators.ranking import placed
from veldt.sources import geotiff, ingest, netcdf, sinks, tables, xlsx
from veldt.sources.scratch import scratch, written

from .adapt import Tables
from .catalogue import query
from .landed import land_workbooks

SUPPLIERS = "SELECT s_suppkey, s_name, s_nationkey, s_acctbal FROM supplier"


@query("snk_01", f"SELECT s_suppkey::VARCHAR AS s_suppkey, s_name, s_nationkey::VARCHAR AS s_nationkey, s_acctbal FROM ({SUPPLIERS}) s", "s_acctbal")
def csv_round_trip(t: Tables) -> DataFrame:
    path = scratch(t.spark, "csv")
    sinks.write_csv(t.raw("supplier"), path)
    return tables.plain_csv(t.spark, path, "s_suppkey string, s_name string, s_nationkey string, s_acctbal double")


@query("src_10", "SELECT lpad(c_custkey::VARCHAR, 6, '0') AS code, c_mktsegment FROM customer")
def codes_as_text(t: Tables) -> DataFrame:
    """Codes keep their leading zeros."""
    path = scratch(t.spark, "codes")
    sinks.write_csv(t.raw("customer").select(F.lpad(F.col("c_custkey").cast("string"), 6, "0").alias("code"), "c_mktsegment"), path, one_file=False)
    return tables.plain_csv(t.spark, path, "code string, c_mktsegment string")


@query("src_01", "SELECT s_suppkey, s_name || ' é' AS s_name, CASE WHEN s_suppkey % 2 = 0 THEN s_acctbal END AS s_acctbal FROM supplier", "s_acctbal")
def encodings_in_turn(t: Tables) -> DataFrame:
    """A file that is no UTF-8 falls back to the next encoding; what is no number is NULL."""
    path = scratch(t.spark, "latin")
    balance = F.when(F.col("s_suppkey") % 2 == 0, F.col("s_acctbal").cast("string")).otherwise("n/k")
    t.raw("supplier").select("s_suppkey", F.concat("s_name", F.lit(" é")).alias("s_name"), balance.alias("s_acctbal")).write.option("header", True).option("encoding", "ISO-8859-1").csv(path)
    return tables.csv_safe(t.spark, path, "s_suppkey long, s_name string, s_acctbal double", range_bytes=1 << 16)


@query("src_02", "SELECT 'Size' AS variable, year(o_orderdate)::INT AS year, o_orderpriority AS region, sum(o_totalprice) AS value, CASE WHEN count(*) > 20 THEN count(*)::DOUBLE END AS rse FROM orders GROUP BY ALL", "value rse")
def survey_file(t: Tables) -> DataFrame:
    path = scratch(t.spark, "survey")
    n = F.count("*")
    long = t.raw("orders").groupBy(F.lit(" Size ").alias("Variable"), F.year("o_orderdate").alias("Year"), F.col("o_orderpriority").alias("ABARES region")).agg(F.sum("o_totalprice").alias("Value"), F.when(n > 20, n.cast("double").cast("string")).otherwise("..").alias("RSE"))
    sinks.write_csv(long, path)
    return tables.survey(t.spark, path, "regional")


@query("src_03", "SELECT p_partkey::VARCHAR AS region_code, p_name AS region_name, CASE WHEN p_size > 10 THEN p_retailprice END AS estimate FROM part", "estimate")
def census_sheet(t: Tables) -> DataFrame:
    """A sheet of several workbooks, its header in row 7: untrimmed headers, marks of missing values."""
    folder = scratch(t.spark, "workbooks")
    mark = F.element_at(F.array(*[F.lit(m) for m in ("..", "np", "-", "nil")]), (F.col("p_size") % 4 + 1).cast("int"))
    raw = t.raw("part").select("p_brand", F.concat(F.lit(" "), F.col("p_partkey").cast("string")), "p_name", F.when(F.col("p_size") > 10, F.col("p_retailprice").cast("string")).otherwise(mark))
    land_workbooks(raw, "p_brand", folder, "Table 1", 7, ["Code ", " Region", "Estimate "]).count()
    return tables.census(xlsx.sheet(t.spark, folder, "Table 1", 7), {"Code": "region_code", "Region": "region_name", "Estimate": "estimate"}, ["estimate"])


CUBE = "SELECT variable, year(date)::INT AS year, date, lat, lon, max(value) AS value FROM stacked JOIN cells USING (cell_id) GROUP BY ALL"


def cube_files(t: Tables, variables: tuple[str, ...]) -> tuple[str, DataFrame]:
    """A folder of gridded files of daily values by place, and what was written."""
    folder = scratch(t.spark, "cubes")
    placed = t.obs.join(t.cells.select("cell_id", "lat", "lon"), "cell_id")
    long = placed.unpivot(["date", "lat", "lon"], list(variables), "variable", "value")
    return folder, netcdf.write_cube(long, folder)


@query("src_04", f"SELECT * FROM ({CUBE}) q WHERE variable = 'daily_rain' AND year IN (1995, 1996) AND value IS NOT NULL", "lat lon value")
def cube_scan(t: Tables) -> DataFrame:
    """Two years of one variable; the other files stay closed."""
    folder, files = cube_files(t, ("daily_rain", "max_temp"))
    files.count()
    return netcdf.cube(t.spark, folder, missing="drop").filter("variable = 'daily_rain' AND year IN (1995, 1996)")


@query("src_05", f"SELECT month(date)::INT AS month, lat, lon, avg(value) AS value FROM ({CUBE}) q WHERE variable = 'min_temp' AND year = 1996 GROUP BY ALL HAVING avg(value) IS NOT NULL", "lat lon value")
def indicator_cube(t: Tables) -> DataFrame:
    """Monthly means of one file by name, as indicators read them."""
    folder, files = cube_files(t, ("min_temp",))
    files.count()
    return netcdf.cube_year(t.spark, folder, "min_temp", 1996).groupBy(F.month("date").alias("month"), "lat", "lon").agg(F.avg("value").alias("value")).dropna(subset=["value"])


@query("snk_04", "SELECT variable || '/' || year(date) || '.' || variable || '.nc' AS file, count(DISTINCT date)::INT AS records FROM stacked JOIN cells USING (cell_id) WHERE variable IN ('daily_rain', 'max_temp') GROUP BY variable, year(date)")
def cubes_written(t: Tables) -> DataFrame:
    folder, files = cube_files(t, ("daily_rain", "max_temp"))
    return files.select(F.substring_index("path", "/", -2).alias("file"), "records")


INGESTED = ", ".join(f"('{v}', {a}, '{x}', '{y}')" for v, a, x, y in (("daily_rain", 1, "done", "already"), ("max_temp", 1, "done", "already"), ("min_temp", 1, "error", "done"), ("evap_pan", 0, "skipped", "skipped")))
MASKED = f"SELECT variable, count(*) AS present FROM ({CUBE}) q WHERE (lat, lon) IN (SELECT (lat, lon) FROM cells WHERE cell_id % 10 >= 5) AND value IS NOT NULL GROUP BY variable"


@query("src_20", f"SELECT run::INT AS run, s.variable, CASE run WHEN 1 THEN first ELSE second END AS status, CASE WHEN all_years = 1 THEN (SELECT count(DISTINCT year(date)) FROM obs) ELSE 1 END AS units, CASE WHEN CASE run WHEN 1 THEN first ELSE second END = 'done' THEN present ELSE 0 END AS present FROM (VALUES {INGESTED}) s(variable, all_years, first, second) CROSS JOIN (VALUES (1), (2)) r(run) LEFT JOIN ({MASKED}) m ON m.variable = s.variable")
def ingest_runs(t: Tables) -> DataFrame:
    """Two runs over the same units: what had not landed fails at first and is all that the second run does; a year before the variable's first is skipped."""
    landed, cubes = cube_files(t, ("daily_rain", "max_temp"))
    cubes.count()
    plan = ingest.Ingest(landed, scratch(t.spark, "masked"), scratch(t.spark, "ingest-log"), {"evap_pan": 1970})
    years = written(t.raw("lineitem").select(F.year("l_shipdate").alias("year")).distinct(), "years")
    units = years.select(F.explode(F.array(*map(F.lit, ("daily_rain", "max_temp", "min_temp")))).alias("variable"), "year")
    units = units.unionByName(t.spark.range(1).select(F.lit("evap_pan").alias("variable"), F.lit(1969).alias("year")))
    mask = t.cells.filter("cell_id % 10 >= 5")
    first = ingest.ingest(units, mask, plan).withColumn("run", F.lit(1))
    placed = t.obs.join(t.cells.select("cell_id", "lat", "lon"), "cell_id").select(F.lit("min_temp").alias("variable"), "date", "lat", "lon", F.col("min_temp").alias("value"))
    netcdf.write_cube(placed, landed).count()
    second = ingest.ingest(units, mask, plan).withColumn("run", F.lit(2))
    return first.unionByName(second).groupBy("run", "variable", "status").agg(F.count("*").alias("units"), F.coalesce(F.sum("present"), F.lit(0)).alias("present"))


RASTER_WIDTH, RASTER_TILE = 90, 16
RASTER = f"SELECT (p_partkey // {RASTER_WIDTH})::INT AS \"row\", (p_partkey % {RASTER_WIDTH})::INT AS col, CASE WHEN p_size > 5 THEN p_size END AS code FROM part"


def raster_files(t: Tables) -> tuple[str, DataFrame]:
    """Rasters of parts in rows of 90 pixels, sizes up to 5 being nodata."""
    folder, key = scratch(t.spark, "rasters"), F.col("p_partkey")
    pixels = t.raw("part").select(F.floor(key / RASTER_WIDTH).cast("int").alias("row"), (key % RASTER_WIDTH).cast("int").alias("col"), F.when(F.col("p_size") > 5, F.col("p_size")).alias("value"))
    return folder, geotiff.write_raster(pixels, folder, geotiff.Grid(112.0, -10.0, 0.5, 0.25, tile=RASTER_TILE, tile_rows=2))


@query("src_13", f"SELECT code::DOUBLE AS value, count(*) AS pixels, sum(112 + (col + 5e-1) * 5e-1) AS x, sum(-10 - (\"row\" + 5e-1) * 25e-2) AS y FROM ({RASTER}) r WHERE code IS NOT NULL GROUP BY code", "value x y")
def raster_histogram(t: Tables) -> DataFrame:
    """Codes counted over the blocks of tiled files, with the sums of their pixels' coordinates."""
    folder, files = raster_files(t)
    files.count()
    pixels = geotiff.raster_pixels(t.spark, folder, blocks=4).dropna(subset=["value"])
    return pixels.groupBy("value").agg(F.count("*").alias("pixels"), F.sum("x").alias("x"), F.sum("y").alias("y"))


RASTER_BANDS = f"SELECT \"row\" // {2 * RASTER_TILE} AS band, max(col) + 1 AS width, max(\"row\") + 1 - min(\"row\" // {2 * RASTER_TILE}) * {2 * RASTER_TILE} AS height, count(DISTINCT (\"row\" // {RASTER_TILE}, col // {RASTER_TILE})) AS tiles FROM ({RASTER}) r GROUP BY 1"


@query("src_14", f"SELECT 'EPSG:4326' AS crs, width::INT AS width, height::INT AS height, 1::INT AS count, 'uint8' AS dtype, 0e0 AS nodata, 112e0 AS west, -10 - band * {2 * RASTER_TILE} * 25e-2 AS north, 112 + width * 5e-1 AS east, -10 - (band * {2 * RASTER_TILE} + height) * 25e-2 AS south, 5e-1 AS res_x, 25e-2 AS res_y FROM ({RASTER_BANDS}) b", "nodata west north east south res_x res_y")
def raster_files_described(t: Tables) -> DataFrame:
    folder, files = raster_files(t)
    files.count()
    return geotiff.raster_metadata(t.spark, folder).drop("path", "blocks")


@query("snk_08", f"SELECT format('band-{{:06d}}.tif', band::INT) AS file, tiles::INT AS tiles FROM ({RASTER_BANDS}) b")
def rasters_written(t: Tables) -> DataFrame:
    folder, files = raster_files(t)
    return files.select(F.substring_index("path", "/", -1).alias("file"), "tiles")


UNAVAILABLE = ("000003", "000007")
STATION_LIST = "SELECT lpad(s_suppkey::VARCHAR, 6, '0') AS station_id, s_name AS name, -1e1 - s_suppkey % 34 AS latitude, 1.12e2 + s_suppkey % 42 AS longitude, s_acctbal AS elevation_m, (1900 + s_suppkey % 60)::INT AS start_year, s_suppkey NOT IN (3, 7) AS available FROM supplier"


def station_list(t: Tables) -> DataFrame:
    """A landed list in an old encoding, cached by a first call and read from the cache by a second one."""
    path, cache, key = scratch(t.spark, "stations"), scratch(t.spark, "station-cache"), F.col("s_suppkey")
    landed = t.raw("supplier").select(key.alias("stn_num"), F.concat(F.lit(" "), F.col("s_name")).alias("STN_NAME"), (F.lit(-10) - key % 34).alias("lat"), (F.lit(112) + key % 42).alias("lng"), F.col("s_acctbal").alias("elev"), (F.lit(1900) + key % 60).alias("start"))
    sinks.write_csv(landed, path)
    tables.cached_stations(t.spark, path, cache)
    return tables.cached_stations(t.spark, f"{path}-gone", cache, UNAVAILABLE)


@query("src_11", f"SELECT * EXCLUDE (available) FROM ({STATION_LIST}) s", "latitude longitude elevation_m")
def stations_by_synonyms(t: Tables) -> DataFrame:
    return station_list(t).drop("available")


@query("src_12", f"SELECT station_id, available FROM ({STATION_LIST}) s")
def stations_with_availability(t: Tables) -> DataFrame:
    return station_list(t).select("station_id", "available")


@query("flt_11", f"SELECT station_id FROM ({STATION_LIST}) s WHERE NOT available")
def known_unavailable(t: Tables) -> DataFrame:
    return station_list(t).filter(~F.col("available")).select("station_id")


@query("val_12", "SELECT unnest(['bytes', 'rows', 'iso_dates']) AS \"check\", unnest([true, (SELECT count(*) >= 100 FROM orders), true]) AS ok")
def station_file_structure(t: Tables) -> DataFrame:
    path = scratch(t.spark, "station-file")
    sinks.write_csv(t.raw("orders").select(F.date_format("o_orderdate", "yyyy-MM-dd").alias("date"), "o_totalprice"), path)
    size = t.spark.read.format("binaryFile").load(f"{path}/*.csv").agg(F.sum("length")).first()[0] or 0
    return validate.station_file(t.spark.read.text(path), size)


@query("snk_02", "SELECT o_orderkey, o_totalprice, year(o_orderdate)::INT AS year FROM orders", "o_totalprice")
def parquet_round_trip(t: Tables) -> DataFrame:
    """A second write takes the place of the first."""
    path, orders = scratch(t.spark, "parquet"), t.raw("orders").select("o_orderkey", "o_totalprice", F.year("o_orderdate").alias("year"))
    sinks.write_parquet(orders.filter("o_orderkey < 100"), path)
    sinks.write_parquet(orders, path, partition_by=("year",), sort_by=("o_orderkey",))
    return t.spark.read.parquet(path)


@query("snk_06", "SELECT region, variable, avg(value) AS value FROM annual GROUP BY ALL", "value")
def sorted_indicators(t: Tables) -> DataFrame:
    path = scratch(t.spark, "indicators")
    sinks.write_parquet(t.annual.groupBy("region", "variable").agg(F.avg("value").alias("value")), path, sort_by=("region", "variable"))
    return t.spark.read.parquet(path)


@query("snk_03", "SELECT user_id, ts::DATE AS day, arg_max(value, event_id) AS value FROM events GROUP BY ALL", "value")
def merged_append(t: Tables) -> DataFrame:
    """Two merge-appends, of earlier and of later events: of equal keys the later row stays, among the new ones that of the larger id."""
    path, keys = scratch(t.spark, "merged"), ["user_id", "day"]
    middle = t.events.agg(((F.min("event_id") + F.max("event_id")) / 2).alias("middle")).first()["middle"] or 0
    days = t.events.select("user_id", F.col("ts").cast("date").alias("day"), "event_id", "value")
    sinks.merge_append(days.filter(F.col("event_id") <= middle), path, keys, ("event_id",))
    return sinks.merge_append(days.filter(F.col("event_id") > middle), path, keys, ("event_id",)).select(*keys, "value")


@query("srt_02", "SELECT region, n_cells, row_number() OVER (ORDER BY n_cells DESC, region) AS place FROM (SELECT region, count(*) AS n_cells FROM cells GROUP BY region) c")
def sorted_regions(t: Tables) -> DataFrame:
    """One sort key, ties by region; the place is that of the row in the sorted list of regions."""
    return _placed(t.cells.groupBy("region").agg(F.count("*").alias("n_cells")), "n_cells")


@query("srt_06", "SELECT region, cv, row_number() OVER (ORDER BY cv DESC, region) AS place FROM (SELECT region, round(stddev_samp(value) / avg(value), 6) AS cv FROM annual WHERE variable = 'daily_rain' GROUP BY region) c", "cv")
def sorted_by_statistic(t: Tables) -> DataFrame:
    rain = t.annual.filter("variable = 'daily_rain'").groupBy("region").agg(F.round(F.stddev_samp("value") / F.avg("value"), 6).alias("cv"))
    return _placed(rain, "cv")


def _placed(regions: DataFrame, by: str) -> DataFrame:
    """regions with their place in descending order, ties by name."""
    return placed(regions, [F.desc(by), F.asc("region")])


@query("set_02", "SELECT cell_id, date, daily_rain FROM obs WHERE year(date) IN (1996, 1997)", "daily_rain")
def year_and_next(t: Tables) -> DataFrame:
    """A season's two years, one after the other."""
    of = lambda y: t.obs.filter((F.col("date") >= F.make_date(F.lit(y), F.lit(1), F.lit(1))) & (F.col("date") < F.make_date(F.lit(y + 1), F.lit(1), F.lit(1))))
    return of(1996).unionByName(of(1997)).select("cell_id", "date", "daily_rain")


@query("str_12", "SELECT n_name, (SELECT string_agg(r_name, ';' ORDER BY r_name) FROM region WHERE contains(lower(r_name), lower(left(n_name, 2)))) AS suggestions FROM nation")
def name_suggestions(t: Tables) -> DataFrame:
    """For each nation the regions whose names hold its first two letters, in any case."""
    wanted = t.raw("nation").select("n_name", F.left("n_name", F.lit(2)).alias("part"))
    return sets.suggestions(wanted, "n_name", "part", t.raw("region"), "r_name")


GRID = "SELECT s_suppkey AS cell_id, -1e1 - s_suppkey % 34 AS lat, 1.12e2 + s_suppkey % 42 AS lon FROM supplier"


@query("src_06", f"SELECT g.* FROM ({GRID}) g JOIN supplier ON s_suppkey = cell_id WHERE s_acctbal >= 5000", "lat lon")
def masked_cells(t: Tables) -> DataFrame:
    """A mask landed as 0 and 1 is read as true and false."""
    path, key = scratch(t.spark, "mask"), F.col("s_suppkey")
    cells = t.raw("supplier").select(key.alias("cell_id"), (F.lit(-10.0) - key % 34).alias("lat"), (F.lit(112.0) + key % 42).alias("lon"), (F.col("s_acctbal") >= 5000).cast("int").alias("t005"))
    sinks.write_parquet(cells, path)
    return tables.mask(t.spark, path)


def region_file(t: Tables) -> DataFrame:
    """Rings read from a GeoJSON of one square a nation; odd nations are multipolygons of two, one code is unknown."""
    path, n = scratch(t.spark, "geojson"), F.col("n_nationkey").cast("double")

    def square(at):
        corners = ((0, 0), (1, 0), (1, 1), (0, 1), (0, 0))
        return F.array(F.array(*[F.array(at + F.lit(float(x)), F.lit(float(y))) for x, y in corners]))

    one, two = F.to_json(square(n)), F.to_json(F.array(square(n), square(n + 0.5)))
    odd = F.col("n_nationkey") % 2 == 1
    shape = F.format_string('{"type":"%s","coordinates":%s}', F.when(odd, "MultiPolygon").otherwise("Polygon"), F.when(odd, two).otherwise(one))
    feature = F.format_string('{"properties":{"aagis_code":"%d"},"geometry":%s}', "n_nationkey", shape)
    whole = t.raw("nation").agg(F.format_string('{"type":"FeatureCollection","features":[%s]}', F.array_join(F.collect_list(feature), ",")).alias("value"))
    whole.coalesce(1).write.text(path)
    return tables.rings(t.spark, f"{path}/*.txt").withColumn("verts_n", F.size("verts"))


RINGS = "SELECT n_nationkey::VARCHAR AS aagis_code, part::INT AS ring_id, 5 AS n_verts, n_nationkey + 1e0 + part / 2e0 AS x, 1e0 AS y FROM nation, (SELECT unnest([0, 1]) AS part) p WHERE part = 0 OR n_nationkey % 2 = 1"


@query("src_07", RINGS, "x y")
def polygons(t: Tables) -> DataFrame:
    corner = F.col("verts")[2]
    return region_file(t).select("aagis_code", "ring_id", F.col("verts_n").alias("n_verts"), corner["x"].alias("x"), corner["y"].alias("y"))


@query("src_08", f"SELECT aagis_code, ring_id, r.region_name FROM ({RINGS}) g LEFT JOIN (SELECT * FROM regions WHERE zone <> 'ASIA') r ON r.region::VARCHAR = aagis_code")
def named_polygons(t: Tables) -> DataFrame:
    known = t.regions.filter("zone <> 'ASIA'").select(F.col("region").cast("string").alias("aagis_code"), "region_name")
    return tables.named_rings(region_file(t), known).select("aagis_code", "ring_id", "region_name")


@query("src_15", "SELECT DATE '1995-01-01' + n_nationkey::INT AS date, n_nationkey * 1e0 AS lat, n_nationkey + 1e1 AS temp_max, CASE WHEN n_nationkey > 9 THEN n_nationkey / 2e0 END AS rain_total, NULL::DOUBLE AS wind_speed FROM nation", "lat temp_max rain_total")
def landed_summaries(t: Tables) -> DataFrame:
    """Landed JSON, one object a file; absent fields are NULL."""
    path, n = scratch(t.spark, "summaries"), F.col("n_nationkey").cast("double")
    rain = F.when(n > 9, F.struct((n / 2).alias("total")))
    body = F.to_json(F.struct(F.date_add(F.lit("1995-01-01").cast("date"), F.col("n_nationkey").cast("int")).cast("string").alias("date"), n.alias("lat"), rain.alias("precipitation"), F.struct((n + 10).alias("max")).alias("temperature")))
    t.raw("nation").select("n_nationkey", body.alias("value")).write.partitionBy("n_nationkey").text(path)
    return tables.day_summaries(t.spark, path).select("date", "lat", "temp_max", "rain_total", "wind_speed")


@query("src_18", "SELECT DISTINCT variable, year, 'land/variable=' || variable || '/year=' || year AS path FROM annual")
def built_paths(t: Tables) -> DataFrame:
    return tables.land_paths(t.annual.select("variable", "year").distinct(), "land/")


@query("src_21", "SELECT 'annual' AS product, count(*) AS n FROM annual UNION ALL SELECT 'cells', count(*) FROM cells")
def existing_products(t: Tables) -> DataFrame:
    """Two products are written and a third is asked for that isn't there."""
    paths = {name: scratch(t.spark, name) for name in ("annual", "cells", "absent")}
    sinks.write_parquet(t.annual, paths["annual"])
    sinks.write_parquet(t.cells, paths["cells"])
    counts = [df.agg(F.count("*").alias("n")).select(F.lit(name).alias("product"), "n") for name, df in tables.products(t.spark, paths).items()]
    return counts[0].unionByName(counts[1])


@query("src_22", "SELECT year(o_orderdate)::INT AS year, avg(o_totalprice) * count(*) AS national_total_t, (month(max(o_orderdate)))::DOUBLE AS national_rse FROM orders WHERE o_orderstatus <> 'P' GROUP BY 1", "national_total_t")
def national_reader(t: Tables) -> DataFrame:
    """Production of a farm times farms, from the long national file; another industry is passed over."""
    path = scratch(t.spark, "national")
    years = t.raw("orders").filter("o_orderstatus <> 'P'").groupBy(F.year("o_orderdate").alias("Year")).agg(F.avg("o_totalprice").alias("mean"), F.count("*").cast("double").alias("n"), F.month(F.max("o_orderdate")).cast("double").alias("rse"))
    row = lambda variable, industry, value, rse: F.struct(F.lit(variable).alias("Variable"), F.lit(industry).alias("Industry"), value.alias("Value"), rse.alias("RSE"))
    of = tables.NATIONAL_INDUSTRY
    rows = F.array(row("Wheat", of, F.col("mean"), F.col("rse")), row(tables.POPULATION_VARIABLE, of, F.col("n"), F.lit(0.0)), row("Wheat", "Sheep", F.lit(1.0), F.lit(1.0)))
    sinks.write_csv(years.select("Year", F.explode(rows).alias("r")).select("Year", "r.*"), path)
    return tables.national_production(tables.survey(t.spark, path, "national"), "Wheat")


@query("src_22_population", "SELECT c_nationkey::VARCHAR AS region, year(o_orderdate)::INT AS year, count(DISTINCT o_custkey)::DOUBLE AS population FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY ALL", "population")
def population_reader(t: Tables) -> DataFrame:
    """The population of a region's years, from the long regional file beside another variable."""
    path = scratch(t.spark, "regional")
    both = F.explode(F.array(F.struct(F.lit(tables.POPULATION_VARIABLE).alias("Variable"), F.col("population").alias("Value")), F.struct(F.lit("Size").alias("Variable"), F.lit(1.0).alias("Value")))).alias("v")
    long = t.population.select("year", F.concat(F.lit(" "), F.col("region").cast("string")).alias("name"), both, "population")
    sinks.write_csv(long.select(F.col("v.Variable"), F.col("year").alias("Year"), F.col("name").alias("ABARES region"), F.col("v.Value"), F.lit(None).cast("string").alias("RSE")), path)
    return tables.population(tables.survey(t.spark, path, "regional"))


@query("src_22_per_farm", "SELECT region::VARCHAR AS region, year, area_ha, production_t, yield_t_ha, NULL::DOUBLE AS area_rse, production_rse FROM per_farm", "area_ha production_t yield_t_ha production_rse")
def per_farm_reader(t: Tables) -> DataFrame:
    path = scratch(t.spark, "per-farm")
    sinks.write_csv(t.per_farm.withColumn("region", F.concat(F.col("region").cast("string"), F.lit(" "))), path)
    return tables.per_farm(t.spark, path)


MAPPING = "SELECT lpad((100 + n_nationkey * 29)::VARCHAR, 3, '0') AS aagis_code, n_name AS region_name, r_name AS zone FROM nation JOIN region ON n_regionkey = r_regionkey"


@query("src_23", f"SELECT m.*, aagis_code AS alt_code, CASE left(aagis_code, 1) WHEN '1' THEN 'NSW' WHEN '2' THEN 'VIC' WHEN '3' THEN 'QLD' WHEN '4' THEN 'SA' WHEN '5' THEN 'WA' WHEN '6' THEN 'TAS' WHEN '7' THEN 'NT' END AS state FROM ({MAPPING}) m")
def region_attributes(t: Tables) -> DataFrame:
    """The regions' attributes from a boundary file."""
    path, code = scratch(t.spark, "boundaries"), (F.col("region") * 29 + 100).cast("string")
    attributes = F.to_json(F.struct(F.concat(code, F.lit(" ")).alias("class"), F.concat(F.lit(" "), "region_name").alias("name"), "zone", code.alias("aagis")))
    feature = F.format_string('{"type":"Feature","properties":%s,"geometry":null}', attributes)
    whole = t.regions.agg(F.format_string('{"type":"FeatureCollection","features":[%s]}', F.array_join(F.collect_list(feature), ",")).alias("value"))
    whole.coalesce(1).write.text(path)
    return tables.region_mapping(t.spark, f"{path}/*.txt")


@query("snk_07", "SELECT n_name AS name, length(n_name) + 1 AS length, sha256(n_name || chr(10)) AS sha256, CASE WHEN r_name = 'ASIA' THEN 'checked' ELSE 'landed' END AS note FROM nation JOIN region ON n_regionkey = r_regionkey")
def manifest(t: Tables) -> DataFrame:
    """Digests of files landed one a nation; a later patch replaces the entries of one region."""
    files, path = scratch(t.spark, "landed"), scratch(t.spark, "manifest")
    t.raw("nation").select(F.col("n_nationkey").alias("key"), F.col("n_name").alias("value")).write.partitionBy("key").text(files)
    key = F.regexp_extract("path", "key=([0-9]+)/", 1).cast("long").alias("n_nationkey")
    found = tables.file_digests(t.spark, f"{files}/*/*.txt").select(key, "length", "sha256").join(t.raw("nation"), "n_nationkey").withColumnRenamed("n_name", "name")
    sinks.patch_manifest(found.withColumn("note", F.lit("landed")), path)
    asia = t.regions.filter("zone = 'ASIA'").select(F.col("region_name").alias("name"))
    return sinks.patch_manifest(found.join(asia, "name", "left_semi").withColumn("note", F.lit("checked")), path)


@query("val_17", "SELECT region, variable, year, value FROM annual", "value")
def preflight(t: Tables) -> DataFrame:
    """Inputs are there before the work begins; tests hold the failure."""
    path = scratch(t.spark, "needed")
    sinks.write_parquet(t.annual, path)
    tables.require_inputs(t.spark, {"annual": path})
    return t.spark.read.parquet(path).select("region", "variable", "year", "value")


@query("prj_02", "SELECT c_custkey AS id, c_mktsegment AS segment FROM customer")
def renamed(t: Tables) -> DataFrame:
    return t.raw("customer").select("c_custkey", "c_mktsegment").withColumnsRenamed({"c_custkey": "id", "c_mktsegment": "segment"})


@query("prj_03", "SELECT region, year, area_ha * yield_t_ha AS production FROM per_farm", "production")
def derived(t: Tables) -> DataFrame:
    return t.per_farm.withColumn("production", F.col("area_ha") * F.col("yield_t_ha")).select("region", "year", "production")


@query("prj_04", "SELECT region, year, 'wheat' AS commodity, '1995-1997' AS baseline FROM per_farm")
def tagged(t: Tables) -> DataFrame:
    return t.per_farm.select("region", "year", F.lit("wheat").alias("commodity"), F.lit("1995-1997").alias("baseline"))


@query("flt_01", "SELECT region, year, value FROM annual WHERE variable = 'daily_rain'", "value")
def equal(t: Tables) -> DataFrame:
    return t.annual.filter(F.col("variable") == "daily_rain").select("region", "year", "value")


@query("flt_02", "SELECT region, year, variable FROM annual WHERE variable IN ('max_temp', 'min_temp') AND year NOT IN (1995, 1996)")
def in_and_not_in(t: Tables) -> DataFrame:
    return t.annual.filter(F.col("variable").isin("max_temp", "min_temp") & ~F.col("year").isin(1995, 1996)).select("region", "year", "variable")


@query("flt_03", "SELECT region, year FROM per_farm WHERE year BETWEEN 1994 AND 1996")
def year_range(t: Tables) -> DataFrame:
    return t.per_farm.filter(F.col("year").between(1994, 1996)).select("region", "year")


@query("flt_04", "SELECT region, year, production_rse FROM per_farm WHERE production_rse IS NOT NULL", "production_rse")
def present(t: Tables) -> DataFrame:
    return t.per_farm.dropna(subset=["production_rse"]).select("region", "year", "production_rse")
