"""Queries over geometry, scalars, pivots of events, and further checks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veldt.functions import scalars as S
from veldt.operators import geometry, spatial, survey, timeseries, validate
from veldt.operators import indicators as I
from veldt.sources import sinks
from veldt.sources import tables as sources
from veldt.sources.scratch import scratch, written

from .adapt import Tables, made_once
from .catalogue import query
from .queries_climate import SPEI_FIT, SPEI_VALUES

#: Two convex rings over the cells' box: code, vertices counter-clockwise.
RINGS = [("101", [(115.0, -40.0), (135.0, -38.0), (140.0, -20.0), (118.0, -15.0)]), ("202", [(141.0, -43.5), (153.5, -43.5), (153.5, -21.5), (141.0, -21.5)])]
KINDS = ["click", "login", "purchase", "signup", "view"]


def rings(t: Tables) -> DataFrame:
    rows = [(code, 0, [{"x": x, "y": y} for x, y in verts]) for code, verts in RINGS]
    return t.spark.createDataFrame(rows, "aagis_code string, ring_id int, verts array<struct<x: double, y: double>>")


def _inside(code: str) -> str:
    verts = dict(RINGS)[code]
    return " AND ".join(f"({x2:e} - {x1:e}) * (lat - {y1:e}) - ({y2:e} - {y1:e}) * (lon - {x1:e}) > 0" for (x1, y1), (x2, y2) in zip(verts, verts[1:] + verts[:1]))


SHIFTED = "(SELECT cell_id, lat + 3.1e-1 AS lat, lon + 2.7e-1 AS lon, weight FROM cells)"
IN_POLYGON = f"SELECT cell_id, CASE WHEN {_inside('101')} THEN '101' WHEN {_inside('202')} THEN '202' END AS aagis_code FROM {SHIFTED} s"


def shifted(t: Tables) -> DataFrame:
    return t.cells.select("cell_id", (F.col("lat") + F.lit(0.31)).alias("lat"), (F.col("lon") + F.lit(0.27)).alias("lon"), "weight")


@query("join_11", f"SELECT * FROM ({IN_POLYGON}) q WHERE aagis_code IS NOT NULL")
def cells_in_regions(t: Tables) -> DataFrame:
    return spatial.assign_regions(shifted(t), rings(t), "inner").select("cell_id", "aagis_code")


@query("join_12", IN_POLYGON)
def stations_in_regions(t: Tables) -> DataFrame:
    return spatial.assign_regions(shifted(t), rings(t)).select("cell_id", "aagis_code")


@query("join_22", f"SELECT aagis_code, count(*) AS n_cells FROM ({IN_POLYGON}) q WHERE aagis_code IS NOT NULL GROUP BY aagis_code")
def cells_per_region(t: Tables) -> DataFrame:
    return spatial.assign_regions(shifted(t), rings(t), "inner").groupBy("aagis_code").agg(F.count("*").alias("n_cells"))


HAVERSINE = "2e0 * 6371e0 * asin(sqrt(least(pow(sin(radians({b}.lat - {a}.lat) / 2), 2) + cos(radians({a}.lat)) * cos(radians({b}.lat)) * pow(sin(radians({b}.lon - {a}.lon) / 2), 2), 1e0)))"
POINTS = "(SELECT n_nationkey AS id, -1.2e1 - n_nationkey * 1.1e0 AS lat, 1.13e2 + n_nationkey * 1.3e0 AS lon FROM nation)"


def points(t: Tables) -> DataFrame:
    n = F.col("n_nationkey")
    return t.raw("nation").select(n.alias("id"), (F.lit(-12.0) - n * F.lit(1.1)).alias("lat"), (F.lit(113.0) + n * F.lit(1.3)).alias("lon"))


@query("join_13", f"SELECT p.id, arg_min(c.cell_id, ({HAVERSINE.format(a='p', b='c')}, c.cell_id)) AS cell_id, min({HAVERSINE.format(a='p', b='c')}) AS km FROM {POINTS} p CROSS JOIN cells c GROUP BY p.id", "km")
def nearest_cells(t: Tables) -> DataFrame:
    return spatial.nearest(points(t), t.cells, "id")


@query("mth_02", f"SELECT p.id, {HAVERSINE.format(a='p', b='c')} AS km FROM {POINTS} p JOIN cells c ON c.cell_id = p.id + 1", "km")
def distances(t: Tables) -> DataFrame:
    cells = t.cells.select((F.col("cell_id") - 1).alias("id"), F.col("lat").alias("cell_lat"), F.col("lon").alias("cell_lon"))
    return points(t).join(cells, "id").select("id", S.haversine_km(F.col("lat"), F.col("lon"), F.col("cell_lat"), F.col("cell_lon")).alias("km"))


@query("join_14", "SELECT a.cell_id, b.cell_id AS other FROM cells a JOIN cells b ON abs(a.lat - b.lat) < 1e-9 AND abs(a.lon - b.lon) < 1e-9")
def aligned_grids(t: Tables) -> DataFrame:
    moved = t.cells.select(F.col("cell_id").alias("other"), (F.col("lat") + 0.011).alias("lat"), (F.col("lon") - 0.013).alias("lon"))
    return spatial.aligned(t.cells.select("cell_id", "lat", "lon"), moved, 0.05).select("cell_id", "other")


@query("join_15", 'SELECT cell_id, (lat + 43)::INT AS "row", (lon - 112)::INT AS col FROM cells')
def grid_indices(t: Tables) -> DataFrame:
    grid = spatial.grid_coordinates(t.spark, -43.0, 112.0, 1.0, 34, 42)
    return spatial.resolve_grid(t.cells, grid).select("cell_id", "row", "col")


@query("join_16", "SELECT cell_id, date, max_temp FROM obs JOIN cells USING (cell_id)", "max_temp")
def sampled_cells(t: Tables) -> DataFrame:
    return t.obs.join(t.cells.select("cell_id"), "cell_id", "left_semi").select("cell_id", "date", "max_temp")


@query("mth_09", "SELECT r.range::INT AS \"row\", c.range::INT AS col, (SELECT min(lat) FROM cells) + r.range AS lat, (SELECT min(lon) FROM cells) + c.range AS lon FROM range((SELECT (max(lat) - min(lat))::INT + 1 FROM cells)) r CROSS JOIN range((SELECT (max(lon) - min(lon))::INT + 1 FROM cells)) c", "lat lon")
def grid_centres(t: Tables) -> DataFrame:
    """The whole grid of one-degree centres over the box of the cells."""
    box = t.cells.agg(F.min("lat").alias("south"), F.max("lat").alias("north"), F.min("lon").alias("west"), F.max("lon").alias("east")).first()
    return spatial.grid_coordinates(t.spark, box["south"], box["west"], 1.0, round(box["north"] - box["south"]) + 1, round(box["east"] - box["west"]) + 1)


COARSE = "SELECT floor(lat / 5e0)::BIGINT AS grid_row, floor(lon / 5e0)::BIGINT AS grid_col, avg(CASE WHEN cell_id % 3 = 0 THEN 1e0 ELSE 0e0 END) AS fraction FROM cells GROUP BY ALL"


def coarse(t: Tables) -> DataFrame:
    return spatial.resample_mean(t.cells, F.when(F.col("cell_id") % 3 == 0, F.lit(1.0)).otherwise(F.lit(0.0)), 5.0)


@query("agg_19", COARSE, "fraction")
def resampled(t: Tables) -> DataFrame:
    return coarse(t)


@query("flt_10", f"SELECT grid_row, grid_col, fraction >= 5e-2 AS t005, fraction >= 1e-1 AS t010, fraction >= 2e-1 AS t020 FROM ({COARSE}) c")
def mask_thresholds(t: Tables) -> DataFrame:
    return spatial.thresholds(coarse(t), "fraction").drop("fraction")


@query("dom_07", f"SELECT count(*) FILTER (fraction >= 5e-2) AS n005, count(*) FILTER (fraction >= 1e-1) AS n010, count(*) FILTER (fraction >= 2e-1) AS n020, sum(fraction * 6371e0 * 6371e0 * radians(5e0) * radians(5e0) * cos(radians((grid_row + 5e-1) * 5))) AS area_km2 FROM ({COARSE}) c", "area_km2")
def mask_build(t: Tables) -> DataFrame:
    cells = spatial.thresholds(coarse(t), "fraction").withColumn("lat", (F.col("grid_row") + F.lit(0.5)) * 5)
    area = F.sum(F.col("fraction") * S.cell_area_km2(F.col("lat"), 5.0, 5.0))
    return cells.agg(F.count_if("t005").alias("n005"), F.count_if("t010").alias("n010"), F.count_if("t020").alias("n020"), area.alias("area_km2"))


FLAGGED = f"SELECT fraction >= 5e-2 AS t005, fraction >= 1e-1 AS t010, fraction >= 2e-1 AS t020 FROM ({COARSE}) c"
FINE_KM2 = "(SELECT count(*) * 25e-4 FROM cells WHERE cell_id % 3 = 0)"
COARSE_KM2 = f"(SELECT sum(fraction * n) * 25e-4 FROM ({COARSE}) c JOIN (SELECT floor(lat / 5e0)::BIGINT AS grid_row, floor(lon / 5e0)::BIGINT AS grid_col, count(*) AS n FROM cells GROUP BY ALL) k USING (grid_row, grid_col))"


@query(
    "val_08",
    f"SELECT b || '_subset_of_' || a AS \"check\", v AS figure, v = 0 AS ok FROM (SELECT 't005' AS a, 't010' AS b, count(*) FILTER (t010 AND NOT t005)::DOUBLE AS v FROM ({FLAGGED}) f UNION ALL SELECT 't010', 't020', count(*) FILTER (t020 AND NOT t010) FROM ({FLAGGED}) f) m"
    f" UNION ALL SELECT 'area_conserved', 100 * abs({COARSE_KM2} - {FINE_KM2}) / {FINE_KM2}, abs({COARSE_KM2} - {FINE_KM2}) <= 5e-2 * {FINE_KM2}"
    f" UNION ALL SELECT 'cells_in_' || code, count(q.cell_id), count(q.cell_id) >= 50 FROM (VALUES ('101'), ('202')) r(code) LEFT JOIN ({IN_POLYGON}) q ON q.aagis_code = code GROUP BY code",
    "figure",
)
def mask_gates(t: Tables) -> DataFrame:
    """Masks of rising thresholds nest, pixels of 50 m keep their area when they become fractions of coarse cells, and regions hold enough cells."""
    own = coarse(t)
    nested = validate.monotone_thresholds(spatial.thresholds(own, "fraction"), ["t005", "t010", "t020"]).select("check", F.col("violations").cast("double").alias("figure"), "ok")
    size = t.cells.groupBy(F.floor(F.col("lat") / 5).alias("grid_row"), F.floor(F.col("lon") / 5).alias("grid_col")).agg((F.count("*") * 0.0025).alias("km2"))
    areas = own.join(size, ["grid_row", "grid_col"]).select((F.col("fraction") * F.col("km2")).alias("area_km2"))
    kept = validate.conservation(areas, t.cells.filter("cell_id % 3 = 0"), 0.0025).select(F.lit("area_conserved").alias("check"), F.col("relative_diff_pct").alias("figure"), "ok")
    regions = validate.cells_by_region(shifted(t), rings(t)).select(F.concat(F.lit("cells_in_"), "aagis_code").alias("check"), F.col("cells").cast("double").alias("figure"), "ok")
    return nested.unionByName(kept).unionByName(regions)


@query("flt_09", "SELECT o.cell_id, date, daily_rain FROM obs o WHERE cell_id IN (SELECT cell_id FROM cells WHERE cell_id % 10 >= 5)", "daily_rain")
def masked(t: Tables) -> DataFrame:
    return t.obs.join(t.cells.filter("cell_id % 10 >= 5").select("cell_id"), "cell_id", "left_semi").select("cell_id", "date", "daily_rain")


HALF = "(SELECT * FROM cells WHERE cell_id % 10 >= 5)"
LAID = "SELECT 'same' AS grid, cell_id, lat FROM {half} UNION ALL SELECT 'turned', cell_id, -54 - lat FROM {half} UNION ALL SELECT 'short', cell_id, lat FROM {half} WHERE cell_id % 10 >= 6".format(half=HALF)


@query("val_06", f"SELECT grid, unnest(['count_ok', 'latitude_ok']) AS \"check\", unnest([abs(n - m) <= 1e-2 * m, abs(lat - mask_lat) <= 1]) AS ok FROM (SELECT grid, count(*) AS n, avg(lat) AS lat FROM ({LAID}) l GROUP BY grid) a CROSS JOIN (SELECT count(*) AS m, avg(lat) AS mask_lat FROM {HALF} h) b")
def alignment(t: Tables) -> DataFrame:
    """Masked cells as they should be, on a grid turned upside down, and with cells lost; tests hold the failure."""
    mask = t.cells.filter("cell_id % 10 >= 5")
    turned = mask.withColumn("lat", F.lit(-54) - F.col("lat"))
    checks = [validate.alignment(kept, mask).withColumn("grid", F.lit(name)) for name, kept in (("same", validate.aligned(mask, mask)), ("turned", turned), ("short", mask.filter("cell_id % 10 >= 6")))]
    return checks[0].unionByName(checks[1]).unionByName(checks[2])


@query("val_07", "SELECT cell_id, lat, lon FROM cells", "lat lon")
def shape_guard(t: Tables) -> DataFrame:
    shape = t.cells.agg(F.countDistinct("lat").alias("a"), F.countDistinct("lon").alias("b")).first()
    return validate.grid_shape(t.cells, shape["a"], shape["b"]).select("cell_id", "lat", "lon")


@query("val_10", "SELECT n_name AS value, 'left' AS side FROM nation WHERE n_nationkey NOT IN (SELECT c_nationkey FROM customer WHERE c_acctbal > 9990)")
def names_without_customers(t: Tables) -> DataFrame:
    from veldt.operators.sets import orphans

    rich = t.raw("customer").filter("c_acctbal > 9990").join(t.raw("nation"), F.col("c_nationkey") == F.col("n_nationkey")).select("n_name")
    return orphans(t.raw("nation").select("n_name"), rich, "n_name")


@query("val_13", "SELECT coalesce(r_name, zone) AS zone, coalesce(n, 0) AS n_regions, zone IS NOT NULL AS expected FROM (SELECT r_name, count(*) AS n FROM nation JOIN region ON n_regionkey = r_regionkey GROUP BY r_name) r FULL JOIN (VALUES ('AFRICA'), ('AMERICA'), ('ASIA'), ('OCEANIA')) z(zone) ON zone = r_name")
def zones(t: Tables) -> DataFrame:
    """Zones found and expected; the number of regions is a gate, and tests hold its failure."""
    return validate.region_boundaries(t.regions, ("AFRICA", "AMERICA", "ASIA", "OCEANIA"), (20, 30))


@query(
    "val_14",
    f"SELECT unnest(['beta_share', 'mean', 'spread']) AS \"check\", unnest([(SELECT count(*) FILTER (beta > 1) / count(*)::DOUBLE >= 0.8 FROM ({SPEI_FIT}) f), (SELECT abs(avg(spei)) <= 0.5 FROM ({SPEI_VALUES}) v), (SELECT stddev_pop(spei) > 0.5 AND stddev_pop(spei) < 1.5 FROM ({SPEI_VALUES}) v)]) AS ok",
)
def spei_gates(t: Tables) -> DataFrame:
    """Months are made once, for the fits and for the values."""
    months = made_once(I.water_balance(t.whole), "balance-months")
    params = written(I.fit_spei(months, "balance", 3, 1995, 2001), "balance-fits")
    return validate.spei_gates(params, I.spei(months, params, "balance", 3))


@query("val_15", "SELECT 't90_plausible' AS \"check\", bool_and(t90 > -1e1 AND t90 < 4.5e1) AS ok FROM t90")
def heat_gate(t: Tables) -> DataFrame:
    return validate.in_range(I.t90(t.dense, 1995, 1997), "t90", -10.0, 45.0, "t90_plausible")


@query("val_16", "SELECT 'counts_not_negative' AS \"check\", count(*) FILTER (n <= -1 OR n >= 367) = 0 AND count(*) FILTER (n > 0) > 0 AS ok FROM (SELECT cell_id, season_year, count(*) FILTER (min_temp < 2) AS n FROM southern GROUP BY ALL) f")
def frost_gate(t: Tables) -> DataFrame:
    """Counts of frost days that no season could have fail, and so does a table without any frost."""
    frost = I.frost_days(t.dense, I.GROWING_WINDOWS["southern_winter"])
    some = F.count_if(F.col("frost_days") > 0) > 0
    return validate.report(frost, {"counts_not_negative": (F.count_if((F.col("frost_days") <= -1) | (F.col("frost_days") >= 367)) == 0) & some})


PICK = ", ".join(f"max(value) FILTER (event_type = '{k}') AS {k}" for k in KINDS)


@query("agg_20", f"SELECT user_id, {PICK} FROM events GROUP BY user_id", " ".join(KINDS))
def pivoted_largest(t: Tables) -> DataFrame:
    one = t.events.groupBy("user_id", "event_type").agg(F.max("value").alias("value"))
    return survey.wide(one, ["user_id"], "event_type", "value", KINDS)


@query("agg_21", f"SELECT user_id, {PICK.replace('max(', 'avg(')} FROM events GROUP BY user_id", " ".join(KINDS))
def pivoted_mean(t: Tables) -> DataFrame:
    return t.events.groupBy("user_id").pivot("event_type", KINDS).agg(F.avg("value"))


@query("join_21", "SELECT user_id, sum(value) FILTER (event_type = 'click') AS click_value, count(*) FILTER (event_type = 'click') AS click_n, sum(value) FILTER (event_type = 'view') AS view_value, count(*) FILTER (event_type = 'view') AS view_n FROM events GROUP BY user_id", "click_value view_value")
def several_in_one_pivot(t: Tables) -> DataFrame:
    wide = t.events.groupBy("user_id").pivot("event_type", ["click", "view"]).agg(F.sum("value").alias("value"), F.count(F.lit(1)).alias("n"))
    return wide.withColumns({c: F.coalesce(c, F.lit(0)) for c in ("click_n", "view_n")})


@query("agg_23", "SELECT user_id, max(a) AS small, max(b) AS large FROM (SELECT user_id, min(value) AS a, NULL::DOUBLE AS b FROM events GROUP BY user_id UNION ALL SELECT user_id, NULL, max(value) FROM events GROUP BY user_id) u GROUP BY user_id", "small large")
def merged_scales(t: Tables) -> DataFrame:
    by = t.events.groupBy("user_id")
    none = F.lit(None).cast("double")
    both = by.agg(F.min("value").alias("small")).withColumn("large", none).unionByName(by.agg(F.max("value").alias("large")).withColumn("small", none))
    return both.groupBy("user_id").agg(F.first("small", True).alias("small"), F.first("large", True).alias("large"))


@query("agg_24", "SELECT event_type, count(DISTINCT user_id) AS n_users, min(value) AS least, max(value) AS most, count(value) AS n_values, count(*) FILTER (value > 50) AS n_large FROM events GROUP BY event_type", "least most")
def counts_and_ranges(t: Tables) -> DataFrame:
    return t.events.groupBy("event_type").agg(F.countDistinct("user_id").alias("n_users"), F.min("value").alias("least"), F.max("value").alias("most"), F.count("value").alias("n_values"), F.count_if(F.col("value") > 50).alias("n_large"))


@query("agg_25", "SELECT event_type, count(*) AS n FROM events GROUP BY event_type")
def value_counts(t: Tables) -> DataFrame:
    return t.events.groupBy("event_type").agg(F.count("*").alias("n"))


@query("agg_26", "SELECT user_id, ts::DATE AS day, count(*) AS n FROM events GROUP BY ALL")
def rows_per_key(t: Tables) -> DataFrame:
    return t.events.groupBy("user_id", F.col("ts").cast("date").alias("day")).agg(F.count("*").alias("n"))


@query("win_10", "SELECT user_id, event_type, arg_max(value, (ts, event_id)) AS value FROM events GROUP BY ALL", "value")
def last_of_each(t: Tables) -> DataFrame:
    return timeseries.keep_last(t.events, ["user_id", "event_type"], [F.desc("ts"), F.desc("event_id")]).select("user_id", "event_type", "value")


@query("jsn_01", "SELECT event_id, (props::JSON ->> '$.k')::INT AS k, coalesce((props::JSON ->> '$.none')::INT, -1) AS absent FROM events")
def json_paths(t: Tables) -> DataFrame:
    p = F.from_json("props", "k int, none int")
    return t.events.select("event_id", p["k"].alias("k"), F.coalesce(p["none"], F.lit(-1)).alias("absent"))


@query("arr_01", "SELECT DISTINCT p_size AS code, p_type AS name FROM part")
def inverted_map(t: Tables) -> DataFrame:
    """Labels with their codes, turned into codes with their labels."""
    labels = t.raw("part").groupBy(F.col("p_type").alias("name")).agg(F.collect_set("p_size").alias("codes"))  # codes of a label are bounded
    return labels.select(F.explode("codes").alias("code"), "name")


@query("arr_02", "SELECT cell_id, coalesce(max(n), 0)::INT AS longest FROM (SELECT DISTINCT cell_id FROM obs) c LEFT JOIN (SELECT cell_id, count(*) AS n FROM (SELECT cell_id, row_number() OVER (PARTITION BY cell_id ORDER BY date) - row_number() OVER (PARTITION BY cell_id, daily_rain < 30 ORDER BY date) AS g, daily_rain < 30 AS dry FROM obs) q WHERE dry GROUP BY cell_id, g) r USING (cell_id) GROUP BY cell_id")
def run_lengths(t: Tables) -> DataFrame:
    """The run length of WIN-04 as a fold over a cell's ordered days."""
    flags = t.obs.groupBy("cell_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("date", (F.col("daily_rain") < 30).alias("dry")))), lambda x: x["dry"]).alias("dry"))
    folded = F.aggregate("dry", F.struct(F.lit(0).alias("now"), F.lit(0).alias("best")), lambda s, d: F.struct(F.when(d, s["now"] + 1).otherwise(0).alias("now"), F.greatest(s["best"], F.when(d, s["now"] + 1).otherwise(0)).alias("best")), lambda s: s["best"])
    return flags.select("cell_id", folded.alias("longest"))


@query("arr_03", "SELECT cell_id, year, month, CASE WHEN count(rain) OVER w = 12 THEN sum(rain) OVER w END AS rain_12 FROM full_months WINDOW w AS (PARTITION BY cell_id ORDER BY month_index RANGE BETWEEN 11 PRECEDING AND CURRENT ROW)", "rain_12")
def sliding_sums(t: Tables) -> DataFrame:
    months = I.monthly_totals(t.whole, "daily_rain", "rain")
    return timeseries.rolling_sum(months, ["cell_id"], "month_index", "rain", 12, "rain_12").select("cell_id", "year", "month", "rain_12")


@query("hsh_01", "SELECT n_nationkey, length(n_name) + 1 AS length, sha256(n_name || chr(10)) AS digest FROM nation")
def digests(t: Tables) -> DataFrame:
    """Digests of files, one landed for each nation."""
    files = scratch(t.spark, "digests")
    t.raw("nation").select(F.col("n_nationkey").alias("key"), F.col("n_name").alias("value")).write.partitionBy("key").text(files)
    key = F.regexp_extract("path", "key=([0-9]+)/", 1).cast("int").alias("n_nationkey")
    return sources.file_digests(t.spark, f"{files}/*/*.txt").select(key, "length", F.col("sha256").alias("digest"))


@query("str_01", "SELECT n_nationkey, trim('  ' || n_name || ' ') AS name FROM nation")
def trimmed(t: Tables) -> DataFrame:
    return t.raw("nation").select("n_nationkey", F.trim(F.concat(F.lit("  "), "n_name", F.lit(" "))).alias("name"))


@query("str_02", "SELECT s_suppkey, lpad(s_suppkey::VARCHAR, 6, '0') AS station_id FROM supplier")
def padded(t: Tables) -> DataFrame:
    return t.raw("supplier").select("s_suppkey", S.zero_padded(F.col("s_suppkey")).alias("station_id"))


CODES = "(SELECT n_nationkey, (100 + n_nationkey * 30)::VARCHAR AS code FROM nation)"


def codes(t: Tables) -> DataFrame:
    return t.raw("nation").select("n_nationkey", (F.lit(100) + F.col("n_nationkey") * 30).cast("string").alias("code"))


@query("str_03", f"SELECT n_nationkey, CASE code[1] WHEN '1' THEN 'NSW' WHEN '2' THEN 'VIC' WHEN '3' THEN 'QLD' WHEN '4' THEN 'SA' WHEN '5' THEN 'WA' WHEN '6' THEN 'TAS' WHEN '7' THEN 'NT' END AS state FROM {CODES} c")
def states(t: Tables) -> DataFrame:
    return codes(t).select("n_nationkey", S.state_of(F.col("code")).alias("state"))


@query("str_04", "SELECT n_nationkey, starts_with(n_name, r_name[1]) AS same_letter FROM nation JOIN region ON n_regionkey = r_regionkey")
def prefixes(t: Tables) -> DataFrame:
    return t.regions.select(F.col("region").alias("n_nationkey"), F.col("region_name").startswith(F.substring("zone", 1, 1)).alias("same_letter"))


@query("str_05", f"SELECT n_nationkey, regexp_full_match(code, '[0-9]{{3}}') AS well_formed FROM {CODES} c")
def well_formed(t: Tables) -> DataFrame:
    return codes(t).select("n_nationkey", F.col("code").rlike("^[0-9]{3}$").alias("well_formed"))


@query("str_06", "SELECT event_id, regexp_matches(strftime(ts, '%Y-%m-%d'), '^[0-9]{4}-[0-9]{2}-[0-9]{2}$') AS iso FROM events")
def iso_dates(t: Tables) -> DataFrame:
    return t.events.select("event_id", F.date_format("ts", "yyyy-MM-dd").rlike("^[0-9]{4}-[0-9]{2}-[0-9]{2}$").alias("iso"))


LEVELS = "(SELECT s_suppkey, CASE s_suppkey % 7 WHEN 0 THEN '0' WHEN 1 THEN '1' WHEN 2 THEN '102.0' WHEN 3 THEN '10203' WHEN 4 THEN '102031234' WHEN 5 THEN '1020' ELSE 'x1' END AS code FROM supplier)"


@query("str_07", f"SELECT s_suppkey, CASE WHEN code = '0' THEN 'national' WHEN NOT regexp_full_match(replace(code, '.0', ''), '[0-9]+') THEN 'unknown' ELSE CASE length(replace(code, '.0', '')) WHEN 1 THEN 'state' WHEN 3 THEN 'sa4' WHEN 5 THEN 'sa3' WHEN 9 THEN 'sa2' ELSE 'unknown' END END AS level FROM {LEVELS} l")
def levels(t: Tables) -> DataFrame:
    made = F.get(F.array(*[F.lit(x) for x in ("0", "1", "102.0", "10203", "102031234", "1020", "x1")]), (F.col("s_suppkey") % 7).cast("int"))
    return t.raw("supplier").select("s_suppkey", S.region_level(made).alias("level"))


@query("str_08", "SELECT s_suppkey, 'c' || s_nationkey AS code, 1990 + s_suppkey::INT % 30 AS year FROM supplier")
def stems(t: Tables) -> DataFrame:
    stem = F.split(F.concat_ws("_", F.concat(F.lit("c"), "s_nationkey"), (F.lit(1990) + F.col("s_suppkey").cast("int") % 30).cast("string")), "_")
    return t.raw("supplier").select("s_suppkey", stem[0].alias("code"), stem[1].try_cast("int").alias("year"))


@query("str_09", "SELECT n_nationkey, n_name AS label FROM nation")
def labels(t: Tables) -> DataFrame:
    return t.raw("nation").select("n_nationkey", F.substring_index(F.concat("n_name", F.lit(" (code "), "n_nationkey", F.lit(")")), " (", 1).alias("label"))


@query("str_10", "SELECT DISTINCT p_size / 1e2 AS t, format('cropping_mask_t{:03d}', p_size::INT) AS name FROM part", "t")
def threshold_names(t: Tables) -> DataFrame:
    return t.raw("part").select((F.col("p_size") / 100).alias("t")).distinct().select("t", S.threshold_name(F.col("t")).alias("name"))


@query("str_11", "SELECT r_name AS zone, string_agg(n_name, ';' ORDER BY n_name) AS regions FROM nation JOIN region ON n_regionkey = r_regionkey GROUP BY r_name")
def joined_lists(t: Tables) -> DataFrame:
    return t.regions.groupBy("zone").agg(F.array_join(F.sort_array(F.collect_set("region_name")), ";").alias("regions"))


@query("dat_01", "SELECT o_orderkey, year(o_orderdate)::INT AS year, month(o_orderdate)::INT AS month FROM orders")
def year_and_month(t: Tables) -> DataFrame:
    return t.raw("orders").select("o_orderkey", F.year("o_orderdate").alias("year"), F.month("o_orderdate").alias("month"))


@query("dat_02", "SELECT date_trunc('month', o_orderdate)::DATE AS month, count(*) AS n FROM orders GROUP BY ALL")
def monthly_bins(t: Tables) -> DataFrame:
    return t.raw("orders").groupBy(F.trunc("o_orderdate", "MM").alias("month")).agg(F.count("*").alias("n"))


@query("dat_03", "SELECT event_id, ts::DATE AS day FROM events")
def to_dates(t: Tables) -> DataFrame:
    return t.events.select("event_id", F.to_date("ts").alias("day"))


@query("dat_04", "SELECT o_orderpriority AS unit, unnest(generate_series(min(o_orderdate)::DATE, max(o_orderdate)::DATE, INTERVAL 1 DAY))::DATE AS day FROM orders GROUP BY 1")
def inclusive_dates(t: Tables) -> DataFrame:
    """Every day from a unit's first to its last."""
    day = F.col("o_orderdate").cast("date")
    spans = t.raw("orders").groupBy(F.col("o_orderpriority").alias("unit")).agg(F.min(day).alias("first"), F.max(day).alias("last"))
    return spans.select("unit", F.explode(F.sequence("first", "last")).alias("day"))


@query("dat_05", "SELECT c_nationkey AS region, unnest(generate_series(min(year(o_orderdate)), max(year(o_orderdate))))::INT AS year FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1")
def inclusive_years(t: Tables) -> DataFrame:
    """Every year from a region's first to its last."""
    spans = t.population.groupBy("region").agg(F.min("year").alias("first"), F.max("year").alias("last"))
    return spans.select("region", F.explode(F.sequence("first", "last")).alias("year"))


@query("mth_01", "SELECT cell_id, cos(radians(lat)) AS weight FROM cells", "weight")
def latitude_weights(t: Tables) -> DataFrame:
    return t.cells.select("cell_id", S.area_weight(F.col("lat")).alias("weight"))


@query("mth_03", "SELECT cell_id, date, 6.108e0 * exp(17.27e0 * max_temp / (max_temp + 237.3e0)) AS es FROM obs", "es")
def vapour_pressure(t: Tables) -> DataFrame:
    return t.obs.select("cell_id", "date", S.saturation_vapour_pressure_hpa(F.col("max_temp")).alias("es"))


@query("mth_04", "SELECT cell_id, date, 1e2 * evap_pan / (6.108e0 * exp(17.27e0 * max_temp / (max_temp + 237.3e0))) AS rh FROM obs", "rh")
def humidity(t: Tables) -> DataFrame:
    return t.obs.select("cell_id", "date", S.relative_humidity(F.col("evap_pan"), F.col("max_temp")).alias("rh"))


@query("mth_06", "SELECT cell_id, date, CASE WHEN max_temp > 2e1 THEN greatest(1e0, max_temp - min_temp) * (max_temp - 2e1) ELSE 0e0 END AS ehf FROM obs", "ehf")
def heat_expression(t: Tables) -> DataFrame:
    return t.obs.select("cell_id", "date", S.excess_heat(F.col("max_temp"), F.col("min_temp"), F.lit(20.0)).alias("ehf"))


@query("mth_07", "SELECT event_id, least(greatest(value, 1e1), 9e1) AS clipped FROM events", "clipped")
def clipped(t: Tables) -> DataFrame:
    return t.events.select("event_id", S.clip(F.col("value"), 10.0, 90.0).alias("clipped"))


@query("mth_08", "SELECT s_suppkey, round_even(s_suppkey * 5e-1, 0) AS half_even FROM supplier", "half_even")
def half_even(t: Tables) -> DataFrame:
    return t.raw("supplier").select("s_suppkey", F.bround(F.col("s_suppkey") * F.lit(0.5), 0).alias("half_even"))


@query("mth_10", "SELECT cell_id, 6371e0 * 6371e0 * radians(5e-2) * radians(5e-2) * cos(radians(lat)) AS km2 FROM cells", "km2")
def cell_areas(t: Tables) -> DataFrame:
    return t.cells.select("cell_id", S.cell_area_km2(F.col("lat"), 0.05, 0.05).alias("km2"))


@query("mth_11", "SELECT p_partkey, CASE WHEN p_size % 5 <> 0 THEN p_retailprice / (p_size % 5) END AS ratio FROM part", "ratio")
def safe_ratio(t: Tables) -> DataFrame:
    return t.raw("part").select("p_partkey", F.try_divide("p_retailprice", F.col("p_size") % 5).alias("ratio"))


@query("src_16", "SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderpriority = '1-URGENT')")
def still_to_fetch(t: Tables) -> DataFrame:
    landed = t.raw("orders").filter("o_orderpriority = '1-URGENT'").select(F.col("o_custkey").alias("c_custkey"))
    return sources.not_landed(t.raw("customer").select("c_custkey"), landed, ["c_custkey"])


@query("src_09", "SELECT l_suppkey, l_shipdate::DATE AS date FROM lineitem WHERE l_shipdate >= TIMESTAMP '1999-01-01' AND l_shipdate < TIMESTAMP '1999-02-01'")
def projected_scan(t: Tables) -> DataFrame:
    day = F.col("l_shipdate")
    return t.raw("lineitem").filter((day >= F.lit("1999-01-01").cast("timestamp_ntz")) & (day < F.lit("1999-02-01").cast("timestamp_ntz"))).select("l_suppkey", day.cast("date").alias("date"))


@query("prj_01", "SELECT c_custkey AS id, c_mktsegment AS segment, c_acctbal / 1e3 AS thousands, 'customer' AS kind FROM customer WHERE c_acctbal BETWEEN 0 AND 5000 AND c_mktsegment <> 'BUILDING'", "thousands")
def projected(t: Tables) -> DataFrame:
    """PRJ-01 to 04 and FLT-01 to 04: project, rename, derive, tag and filter."""
    kept = t.raw("customer").filter(F.col("c_acctbal").between(0, 5000) & ~F.col("c_mktsegment").isin("BUILDING")).dropna(subset=["c_mktsegment"])
    return kept.withColumnsRenamed({"c_custkey": "id", "c_mktsegment": "segment"}).withColumns({"thousands": F.col("c_acctbal") / 1e3, "kind": F.lit("customer")}).select("id", "segment", "thousands", "kind")


def drawn_regions(t: Tables) -> DataFrame:
    """A region for each nation, moved east by its key: a U for even keys, and with a hole in its western arm for odd ones."""
    n = F.col("n_nationkey")
    moved = lambda corners: F.array(*[F.struct((n + F.lit(112.0 + x)).alias("x"), F.lit(y - 40.0).alias("y")) for x, y in corners])
    shell = moved([(0, 0), (9, 0), (9, 6), (6, 6), (6, 2), (3, 2), (3, 6), (0, 6), (0, 0)])
    hole = moved([(0.5, 2.5), (1, 2.5), (1, 5.5), (0.5, 5.5), (0.5, 2.5)])
    return t.raw("nation").select(n.cast("string").alias("aagis_code"), F.posexplode(F.when(n % 2 == 1, F.array(shell, hole)).otherwise(F.array(shell))).alias("ring_id", "verts"))


U_CENTRE = "CASE WHEN n_nationkey % 2 = 0 THEN {even} ELSE {odd} END"
DRAWN = f"SELECT n_nationkey::VARCHAR AS aagis_code, -36e0 AS lat, 112 + n_nationkey + {U_CENTRE.format(even='1.5e0', odd='7.5e0')} AS lon, -40 + {U_CENTRE.format(even='114e0 / 42', odd='108e0 / 405 * 10')} AS centroid_lat, 112 + n_nationkey + {U_CENTRE.format(even='4.5e0', odd='187.875e0 / 40.5')} AS centroid_lon FROM nation"


@query("dom_12", f"SELECT *, km > 150 AS far FROM (SELECT d.*, {HAVERSINE.format(a='d', b='c')} AS km FROM ({DRAWN}) d JOIN (SELECT aagis_code, centroid_lat AS lat, centroid_lon AS lon FROM ({DRAWN}) e) c USING (aagis_code)) q", "lat lon centroid_lat centroid_lon km")
def representative_points(t: Tables) -> DataFrame:
    """Points inside concave regions, some with a hole: by hand, the middle of the widest interval at half height."""
    return geometry.representative_points(drawn_regions(t), far_km=150.0)


#: Broken rings by key modulo 4: corners, and what is right: shells, holes, corners of all rings and area.
BROKEN = (
    ([[(0, 0), (2, 2), (2, 0), (0, 2), (0, 0)]], (2, 0, 8, 2)),  # crosses itself
    ([[(0, 0), (4, 0), (4, 4), (6, 6), (4, 4), (0, 4), (0, 4), (0, 0)]], (1, 0, 5, 16)),  # a spike and a repeated point
    ([[(0, 0), (0, 3), (3, 3), (3, 0)]], (1, 0, 5, 9)),  # not closed, clockwise
    ([[(0, 0), (9, 0), (9, 9), (0, 9), (0, 0)], [(1, 1), (8, 1), (8, 8), (1, 8), (1, 1)], [(2, 2), (5, 2), (5, 5), (2, 5), (2, 2)]], (2, 1, 15, 41)),  # nested rings that turn alike
)


def broken_regions(t: Tables) -> DataFrame:
    n = F.col("c_custkey")
    ring = lambda corners: F.array(*[F.struct((n % 60 + F.lit(float(x))).alias("x"), F.lit(float(y)).alias("y")) for x, y in corners])
    rings = F.get(F.array(*[F.array(*map(ring, case)) for case, _ in BROKEN]), (n % 4).cast("int"))
    return t.raw("customer").select(n.alias("aagis_code"), F.posexplode(rings).alias("ring_id", "verts"))


@query("dom_13", "SELECT c_custkey AS aagis_code, " + ", ".join(f"[{', '.join(str(right[i]) for _, right in BROKEN)}][c_custkey % 4 + 1] AS {name}" for i, name in enumerate(("shells", "holes", "corners"))) + f", [{', '.join(f'{right[3]}e0' for _, right in BROKEN)}][c_custkey % 4 + 1] AS area, c_custkey % 4 = 3 AS sound_before, true AS sound FROM customer", "area")
def repaired_regions(t: Tables) -> DataFrame:
    """Broken rings repaired once: valid afterwards, their even-odd area kept."""
    broken = broken_regions(t)
    whole = written(geometry.repair(broken), "repaired")
    counts = whole.groupBy("aagis_code").agg(F.count_if(~F.col("hole")).cast("int").alias("shells"), F.count_if("hole").cast("int").alias("holes"), F.sum(F.size("verts")).cast("int").alias("corners"), F.sum(geometry.ring_area(F.col("verts"))).alias("area"))
    before = geometry.soundness(broken).withColumnRenamed("sound", "sound_before")
    return counts.join(before, "aagis_code").join(geometry.soundness(whole), "aagis_code")


@query("snk_05", "SELECT c_custkey AS aagis_code, ring_id::INT AS ring_id, ring_id > 0 AND c_custkey % 4 = 3 AND ring_id = 1 AS hole FROM customer, (SELECT unnest([0, 1, 2]) AS ring_id) r WHERE ring_id < [2, 1, 1, 3][c_custkey % 4 + 1]")
def repaired_rings_kept(t: Tables) -> DataFrame:
    """Repaired rings as a sorted table, read again."""
    path = scratch(t.spark, "repaired")
    sinks.write_parquet(geometry.repair(broken_regions(t)), path, sort_by=("aagis_code", "ring_id"))
    return t.spark.read.parquet(path).select("aagis_code", "ring_id", "hole")
