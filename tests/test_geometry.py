"""Repair of rings, points inside regions, and nearest cells, by hand and against plain versions."""

import math
import random

import pytest
from pyspark.sql import functions as F

from veldt.operators import geometry as G
from veldt.operators import spatial
from veldt.plans import catalogue

SQUARE = lambda x, y, s: [(x, y), (x + s, y), (x + s, y + s), (x, y + s)]
#: Rings, and what is right: areas of the repaired rings, holes negative.
CASES = [
    ([[(0, 0), (2, 2), (2, 0), (0, 2)]], [1, 1]),
    ([[(0, 0), (4, 0), (4, 4), (6, 6), (4, 4), (0, 4)]], [16]),
    ([[(0, 0), (4, 0), (4, 2), (8, 2), (4, 2), (4, 4), (0, 4)]], [16]),
    ([SQUARE(0, 0, 9), SQUARE(1, 1, 7), SQUARE(2, 2, 3)], [81, -49, 9]),
    ([SQUARE(0, 0, 9), [(0, 0), (2, 1), (1, 2)]], [81, -1.5]),
    ([SQUARE(0, 0, 9), [(4, 0), (5, 2), (3, 2)]], [81, -2]),
    ([SQUARE(0, 0, 4), SQUARE(2, 2, 4)], [12, 12]),
    ([SQUARE(0, 0, 2), SQUARE(2, 0, 2)], [8]),
    ([SQUARE(0, 0, 9), [(0, 4), (9, 4), (9, 5), (0, 5)]], [36, 36]),
    ([[(0, 0), (1, 1), (2, 2)], [(5, 5), (6, 6)], []], []),
    ([SQUARE(0, 0, 3), SQUARE(0, 0, 3)], []),
    ([[(0, 0), (float("nan"), 1), (3, 0), (3, 3), (float("inf"), 0), (0, 3)]], [9]),
]


@pytest.mark.parametrize("rings,areas", CASES)
def test_repair_by_hand(rings, areas):
    out = G.repaired(rings)
    assert [round(G.area(r[:-1]), 9) for *_, r in out] == areas
    assert [hole for _, _, hole, _ in out] == [a < 0 for a in areas]
    assert all(out[shell][3] != r or not hole for _, shell, hole, r in out) and G.is_sound([r for *_, r in out])


def test_repair_keeps_what_is_inside():
    """Random rings of crossing, touching and repeated sides: an odd number of them holds a point, or of the repaired ones."""
    r = random.Random(11)
    for _ in range(150):
        rings = [[(r.randint(0, 9), r.randint(0, 9)) for _ in range(r.randint(3, 9))] for _ in range(r.randint(1, 4))]
        out = G.repaired(rings)
        assert G.is_sound([ring for *_, ring in out])
        assert all((G.area(ring[:-1]) < 0) == hole for *_, hole, ring in out)
        for p in [(r.uniform(0, 9), r.uniform(0, 9)) for _ in range(60)]:
            assert sum(G.holds(x, p) for x in rings) % 2 == sum(G.holds(ring[:-1], p) for *_, ring in out) % 2


def frame(spark, regions):
    rows = [(code, i, None if ring is None else [None if p is None else {"x": p[0], "y": p[1]} for p in ring], "other") for code, rings in regions for i, ring in enumerate(rings)]
    return spark.createDataFrame(rows, "aagis_code string, ring_id int, verts array<struct<x: double, y: double>>, hole_note string")


def test_repair_of_tables(spark):
    floats = lambda rings: [[(float(x), float(y)) for x, y in ring] for ring in rings]
    regions = [(str(i), floats(rings)) for i, (rings, _) in enumerate(CASES)] + [(None, floats([SQUARE(0, 0, 1)])), ("nulls", [None, [None, (0.0, None), (1.0, 1.0)]])]
    whole = G.repair(frame(spark, regions))
    got = {r["aagis_code"]: (round(r["a"], 6), r["n"]) for r in whole.groupBy("aagis_code").agg(F.sum(G.ring_area(F.col("verts"))).alias("a"), F.count("*").alias("n")).collect()}
    assert got == {None: (1.0, 1), **{str(i): (round(sum(areas), 6), len(areas)) for i, (_, areas) in enumerate(CASES) if areas}}
    assert {r["sound"] for r in G.soundness(whole).collect()} == {True}
    assert not any(r["sound"] for r in G.soundness(frame(spark, regions)).collect())  # none of them is closed
    assert G.repair(frame(spark, [])).count() == 0


def test_points_lie_inside(spark):
    r = random.Random(5)
    u = [(0, 0), (9, 0), (9, 6), (6, 6), (6, 2), (3, 2), (3, 6), (0, 6)]
    regions = [("u", [u]), ("ring", [SQUARE(0, 0, 10), SQUARE(1, 1, 8)]), ("parts", [SQUARE(0, 0, 1), SQUARE(50, 50, 3)]), ("flat", [[(0, 0), (1, 1), (2, 2)]])]
    for i in range(30):
        n = r.randint(5, 40)
        regions.append((f"star{i}", [[((a := r.uniform(1, 10)) * math.cos(2 * math.pi * k / n), a * math.sin(2 * math.pi * k / n)) for k in range(n)], SQUARE(-0.2, -0.2, 0.4)]))
    regions = [(c, [[(float(x), float(y)) for x, y in ring] for ring in rings]) for c, rings in regions]
    got = {p["aagis_code"]: p for p in G.representative_points(frame(spark, regions)).collect()}
    assert set(got) == {c for c, _ in regions} - {"flat"}
    for c, rings in regions:
        if c in got:
            p = got[c]
            assert sum(G.holds(ring, (p["lon"], p["lat"])) for ring in rings) % 2 == 1
    assert (got["u"]["lat"], got["u"]["lon"]) == (4.0, 1.5) and got["ring"]["lon"] == pytest.approx(0.5)
    assert got["u"]["centroid_lat"] == pytest.approx(114 / 42) and got["ring"]["centroid_lon"] == pytest.approx(5.0)
    assert got["parts"]["far"] and not got["star0"]["km"] > 1200
    marked = G.repair(frame(spark, regions))
    assert sorted(map(tuple, G.representative_points(marked).collect())) == sorted(map(tuple, got.values()))


def km(a, b):
    h = math.sin(math.radians(b[0] - a[0]) / 2) ** 2 + math.cos(math.radians(a[0])) * math.cos(math.radians(b[0])) * math.sin(math.radians(b[1] - a[1]) / 2) ** 2
    return 2 * 6371.0 * math.asin(math.sqrt(min(h, 1.0)))


def test_nearest_anywhere_on_the_sphere(spark):
    """Points amid the cells, far from all, at the poles and across the date line; some coordinates are missing."""
    r = random.Random(9)
    cells = [(i, -10.0 - r.random() * 34, 112.0 + r.random() * 42) for i in range(600)] + [(900 + i, r.uniform(-60, 60), r.choice([179.9, -179.8, 180.0, -180.0])) for i in range(8)] + [(2000, -20.0, 130.0), (1999, -20.0, 130.0)]
    points = [(i, r.uniform(-90, 90), r.uniform(-180, 180)) for i in range(150)] + [(200, 90.0, 0.0), (201, -90.0, 77.0), (202, 0.0, 180.0), (203, 10.0, -180.0), (204, -20.0, 130.0), (205, -20.0, 130.001), (206, 0.0, -179.0), (207, 45.0, 359.5)]
    p = spark.createDataFrame(points + [(300, None, 1.0), (301, 1.0, None)], "id int, lat double, lon double")
    c = spark.createDataFrame(cells + [(5000, None, 130.0), (5001, 0.0, None)], "cell_id int, lat double, lon double")
    got = {x["id"]: x for x in spatial.nearest(p, c, "id").collect()}
    assert set(got) == {i for i, *_ in points}
    for i, *at in points:
        best = min((km(at, cell[1:]), cell[0]) for cell in cells)
        assert got[i]["km"] == pytest.approx(best[0], abs=1e-6)
        assert km(at, next(x[1:] for x in cells if x[0] == got[i]["cell_id"])) == pytest.approx(best[0], abs=1e-6)
    assert got[204]["cell_id"] == 1999
    assert spatial.nearest(p, c.limit(0), "id").count() == 0 and spatial.nearest(p.limit(0), c, "id").count() == 0


def test_far_points_look_at_few_cells(spark):
    """A point at the other end of the world goes down to the tiles around the best distance, not through all cells."""
    cells = spark.range(40_000).select(F.col("id").alias("cell_id"), (F.lit(-44.0) + (F.col("id") / 200).cast("int") * 0.15).alias("lat"), (F.lit(112.0) + F.col("id") % 200 * 0.2).alias("lon"))
    points = spark.createDataFrame([(1, 50.0, 10.0), (2, 40.0, -100.0)], "id int, lat double, lon double")
    plan = spatial._nearest_by_descent(points, cells, "id")
    met = spatial._tiles_left(points, cells, "id").join(cells.select(*[F.floor((F.col(c) - low) / spatial.LEVELS[-1]).alias(n) for c, low, n in (("lon", -180.0, "tile_x"), ("lat", -90.0, "tile_y"))]), ["tile_x", "tile_y"]).count()
    assert plan.count() == 2 and met < 2000


def test_few_sides_as_many(monkeypatch):
    """Plain loops and arrays give the same rings, bit by bit."""
    r = random.Random(5)
    point = lambda: (float(r.randrange(9)), float(r.randrange(9))) if r.random() < 0.7 else (r.random() * 9, r.random() * 9)
    drawn = [[[point() for _ in range(r.randrange(3, 9))] for _ in range(r.randrange(1, 4))] for _ in range(200)]
    few = [(G.repaired(rings), G.is_sound([[*ring, ring[0]] for ring in rings])) for rings in drawn]
    monkeypatch.setattr(G, "FEW", 0)
    assert [(G.repaired(rings), G.is_sound([[*ring, ring[0]] for ring in rings])) for rings in drawn] == few


def test_repair_is_dealt_over_tasks_and_done_once(spark):
    square = "array(struct(0d AS x, 0d AS y), struct(id + 1d AS x, 0d AS y), struct(id + 1d AS x, 1d AS y), struct(0d AS x, 1d AS y))"
    rings = spark.range(40).selectExpr("id AS aagis_code", "0 AS ring_id", f"{square} AS verts").coalesce(1)
    for found in (G.repair(rings), G.soundness(rings)):
        assert found.rdd.getNumPartitions() == int(spark.conf.get("spark.sql.shuffle.partitions")) and found.count() == 40
    plan = catalogue.queries()["dom_13"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("MapInArrow") == 2
