"""Spatial joins in expressions: point in polygon, nearest cell, grid keys."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from veldt.functions.scalars import cell_area_km2, grid_key, haversine_km


def in_ring(x: Column, y: Column, verts: Column) -> Column:
    """Even-odd ray casting over a closed ring of (x, y) structs."""

    def crosses(a: Column, b: Column) -> Column:
        return ((a["y"] > y) != (b["y"] > y)) & (x < F.try_divide((b["x"] - a["x"]) * (y - a["y"]), b["y"] - a["y"]) + a["x"])

    edges = F.sequence(F.lit(0), F.size(verts) - 1)
    hits = F.filter(edges, lambda i: F.coalesce(crosses(F.get(verts, i), F.get(verts, (i + 1) % F.size(verts))), F.lit(False)))
    return F.size(hits) % 2 == 1


def ring_tiles(rings: DataFrame, step: float) -> DataFrame:
    """rings with the tiles of `step` degrees that each ring's bounding box touches: the equi-join key of assign_regions."""
    xs, ys = F.transform("verts", lambda v: v["x"]), F.transform("verts", lambda v: v["y"])
    span = lambda c: F.sequence(F.floor(F.array_min(c) / step), F.floor(F.array_max(c) / step))
    return rings.withColumn("tile_x", F.explode(span(xs))).withColumn("tile_y", F.explode(span(ys)))


def assign_regions(points: DataFrame, rings: DataFrame, how: str = "left", step: float = 2.0, code: str = "aagis_code") -> DataFrame:
    """points (lat, lon) with the code of the region whose rings hold them.

    Points and rings meet on tiles, then ray casting decides; a region's
    rings count by the even-odd rule, so a ring may be a hole. A point on
    several regions takes the smallest code. Points are known by their
    coordinates, so a stage that is run again finds the same regions. `left`
    keeps points without a region, `inner` drops them.
    """
    places = points.select("lat", "lon").distinct().withColumns({"tile_x": F.floor(F.col("lon") / step), "tile_y": F.floor(F.col("lat") / step)})
    near = places.join(ring_tiles(rings, step), ["tile_x", "tile_y"])
    hits = near.filter(in_ring(F.col("lon"), F.col("lat"), F.col("verts"))).groupBy("lat", "lon", code).count().filter("count % 2 = 1")
    return points.join(hits.groupBy("lat", "lon").agg(F.min(code).alias(code)), ["lat", "lon"], how)


def _nearest_in_tiles(points: DataFrame, cells: DataFrame, key: str, size: float, reach: int) -> DataFrame:
    """points with their best cell in the tiles around them, and whether no cell elsewhere can be nearer."""
    tile = lambda c: F.floor(F.col(c) / size)
    tiled = cells.select("cell_id", F.col("lat").alias("cell_lat"), F.col("lon").alias("cell_lon"), tile("lon").alias("tile_x"), tile("lat").alias("tile_y"))
    around = F.sequence(F.lit(-reach), F.lit(reach))
    asked = points.select("*", F.explode(around).alias("dx")).select("*", F.explode(around).alias("dy"))
    asked = asked.withColumns({"tile_x": tile("lon") + F.col("dx"), "tile_y": tile("lat") + F.col("dy")})
    distance = haversine_km(F.col("lat"), F.col("lon"), F.col("cell_lat"), F.col("cell_lon"))
    near = asked.join(tiled, ["tile_x", "tile_y"]).groupBy(key).agg(F.min(F.struct(distance.alias("km"), "cell_id")).alias("best"))
    # a tile's width at the farthest latitude searched; beyond the date line tiles have other numbers
    width = F.cos(F.radians(F.least(F.abs(F.col("lat")) + (reach + 1) * size, F.lit(90.0)))) * (reach * size * math.pi / 180 * 6371.0)
    on_map = F.abs(F.col("lon")) + reach * size < 180
    return points.join(near, key, "left").withColumn("settled", F.coalesce(on_map & (F.col("best.km") <= width), F.lit(False)))


#: Degrees of a tile in each level of the pyramid; a level has as many tiles as the sphere, whatever the cells.
LEVELS = (45.0, 11.25, 2.8125, 0.703125)


def _pyramid(cells: DataFrame, size: float) -> DataFrame:
    """The tiles of one level that hold cells: their box, and the cell of the smallest id to stand for them."""
    tile = lambda c, low: F.floor((F.col(c) - low) / size)
    lon = F.pmod(F.col("lon") + 180.0, F.lit(360.0)) - 180.0
    own = cells.select("cell_id", "lat", lon.alias("lon")).withColumns({"tile_x": tile("lon", -180.0), "tile_y": tile("lat", -90.0)})
    box = own.groupBy("tile_x", "tile_y").agg(F.min("lat").alias("south"), F.max("lat").alias("north"), F.min("lon").alias("west"), F.max("lon").alias("east"), F.min(F.struct("cell_id", "lat", "lon")).alias("one"))
    parent = lambda c: F.floor(F.col(c) * size / (size * 4))
    return box.withColumns({"above_x": parent("tile_x"), "above_y": parent("tile_y")})


def _box_km(lat: Column, lon: Column, south: Column, north: Column, west: Column, east: Column) -> Column:
    """No point of a box is nearer than this."""
    turn = lambda d: F.pmod(d, F.lit(360.0))
    dlat = F.greatest(south - lat, lat - north, F.lit(0.0))
    beside = turn(lon - west) > east - west
    dlon = F.when(beside, F.least(turn(west - lon), turn(lon - east), F.lit(180.0))).otherwise(0.0)
    narrow = F.least(F.cos(F.radians(south)), F.cos(F.radians(north)))
    half = F.pow(F.sin(F.radians(dlat) / 2), 2) + F.cos(F.radians(lat)) * narrow * F.pow(F.sin(F.radians(dlon) / 2), 2)
    return 2 * 6371.0 * F.asin(F.sqrt(F.least(half, F.lit(1.0))))


def _tiles_left(points: DataFrame, cells: DataFrame, key: str) -> DataFrame:
    """points with the tiles of the last level that may hold their nearest cell, found by going down a pyramid.

    At each level a point keeps the tiles whose boxes may be as near as the
    nearest cell that stands for a tile, and goes on to their parts. What is
    left are the tiles around the best distance. Distances go over the date
    line.
    """
    point = [key, "lat", "lon"]
    top = int(360 / LEVELS[0]), int(180 / LEVELS[0])
    every = F.explode(F.array(*[F.struct(F.lit(x).cast("long").alias("tile_x"), F.lit(y).cast("long").alias("tile_y")) for x in range(top[0]) for y in range(-1, top[1] + 1)])).alias("t")
    asked = points.select(*point, every).select(*point, "t.*")
    for depth, size in enumerate(LEVELS):
        tiles = _pyramid(cells, size)
        if depth == 0:
            met = asked.join(F.broadcast(tiles.drop("above_x", "above_y")), ["tile_x", "tile_y"])  # at most 48 tiles
        else:
            above = asked.withColumnsRenamed({"tile_x": "above_x", "tile_y": "above_y"})
            met = above.join(F.broadcast(tiles) if size >= 2 else tiles, ["above_x", "above_y"])  # 2.8 degrees: at most 8,192 tiles
        bound = _box_km(F.col("lat"), F.col("lon"), F.col("south"), F.col("north"), F.col("west"), F.col("east"))
        reach = haversine_km(F.col("lat"), F.col("lon"), F.col("one.lat"), F.col("one.lon"))
        best = F.min(reach).over(Window.partitionBy(key))
        asked = met.select(*point, "tile_x", "tile_y", bound.alias("bound"), best.alias("best")).filter("bound <= best * (1 + 1e-9) + 1e-6").select(*point, "tile_x", "tile_y")
    return asked


def _nearest_by_descent(points: DataFrame, cells: DataFrame, key: str) -> DataFrame:
    """points with their best cell among those in the tiles that are left to them."""
    point, asked = [key, "lat", "lon"], _tiles_left(points, cells, key)
    tile = lambda c, low: F.floor((c - low) / LEVELS[-1])
    lon = F.pmod(F.col("lon") + 180.0, F.lit(360.0)) - 180.0
    placed = cells.select("cell_id", F.col("lat").alias("cell_lat"), F.col("lon").alias("cell_lon"), tile(lon, -180.0).alias("tile_x"), tile(F.col("lat"), -90.0).alias("tile_y"))
    km = haversine_km(F.col("lat"), F.col("lon"), F.col("cell_lat"), F.col("cell_lon"))
    return asked.join(placed, ["tile_x", "tile_y"]).groupBy(*point).agg(F.min(F.struct(km.alias("km"), "cell_id")).alias("best"))


def nearest(points: DataFrame, cells: DataFrame, key: str, step: float = 1.0, reach: int = 3) -> DataFrame:
    """For each point the nearest cell by great-circle distance, ties to the smaller cell_id.

    Cells are looked up in the tiles around a point, `reach` tiles each way.
    Points whose best is farther than these tiles guarantee, or that find
    none, go down a pyramid of tiles instead. Points and cells without
    coordinates have no part; without cells there are no rows. A key names
    one point.
    """
    cells = cells.select("cell_id", "lat", "lon").dropna()
    judged = _nearest_in_tiles(points.select(key, "lat", "lon").dropna(subset=["lat", "lon"]), cells, key, step, reach)
    open_points = judged.filter(~F.col("settled")).select(key, "lat", "lon")
    both = judged.filter("settled").select(key, "best").unionByName(_nearest_by_descent(open_points, cells, key).select(key, "best"))
    return both.select(key, F.col("best.cell_id").alias("cell_id"), F.col("best.km").alias("km"))


def aligned(a: DataFrame, b: DataFrame, step: float, how: str = "inner") -> DataFrame:
    """Rows of two grids whose coordinates agree within half a step, by an equi-join on whole keys."""
    keys = lambda d: d.withColumns({"key_lat": grid_key(F.col("lat"), step), "key_lon": grid_key(F.col("lon"), step)})
    return keys(a).join(keys(b).drop("lat", "lon"), ["key_lat", "key_lon"], how).drop("key_lat", "key_lon")


def resolve_grid(cells: DataFrame, grid: DataFrame, places: int = 4) -> DataFrame:
    """cells with the grid's row and col of equal coordinates to `places` decimals; fails on a cell that has none."""
    exact = lambda d: d.withColumns({"key_lat": F.round("lat", places), "key_lon": F.round("lon", places)})
    found = exact(cells).join(exact(grid).select("key_lat", "key_lon", "row", "col"), ["key_lat", "key_lon"], "left")
    there = F.col("row").isNotNull()
    return found.withColumn("row", F.when(there, F.col("row")).otherwise(F.raise_error(F.lit("cell off the grid")).cast("int"))).drop("key_lat", "key_lon")


def grid_coordinates(spark, lat0: float, lon0: float, step: float, rows: int, cols: int) -> DataFrame:
    """row, col, lat, lon of a regular grid's centres."""
    return spark.range(rows * cols).select(F.floor(F.col("id") / cols).cast("int").alias("row"), (F.col("id") % cols).cast("int").alias("col")).withColumns({"lat": F.lit(lat0) + F.col("row") * step, "lon": F.lit(lon0) + F.col("col") * step})


def resample_mean(pixels: DataFrame, flag: Column, step: float) -> DataFrame:
    """The mean of a pixel value in each coarse cell."""
    return pixels.withColumns({"grid_row": F.floor(F.col("lat") / step), "grid_col": F.floor(F.col("lon") / step)}).groupBy("grid_row", "grid_col").agg(F.avg(flag).alias("fraction"))


def thresholds(cells: DataFrame, fraction: str, levels: tuple[float, ...] = (0.05, 0.10, 0.20)) -> DataFrame:
    """cells with one boolean for each level: t005 for 0.05 and so on."""
    return cells.withColumns({f"t{round(t * 100):03d}": F.col(fraction) >= F.lit(t) for t in levels})


def area_integral(cells: DataFrame, fraction: str, dlat: float, dlon: float) -> DataFrame:
    """area_km2: the fraction integrated over the sphere."""
    return cells.agg(F.sum(F.col(fraction) * cell_area_km2(F.col("lat"), dlat, dlon)).alias("area_km2"))
