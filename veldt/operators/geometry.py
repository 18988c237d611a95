"""Polygons: repair of rings, and points that surely lie inside.

A region is its rings by the even-odd rule: what an odd number of rings hold
is inside. Repair keeps that area and describes it by simple rings.
"""

from __future__ import annotations

import math
from collections import defaultdict
from collections.abc import Callable, Iterator, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import _parse_datatype_string

from veldt.functions.scalars import haversine_km
from veldt.sources.stores import ship

Point = tuple[float, float]
#: Places after the point that crossings are rounded to: a tenth of a millimetre in degrees.
PLACES = 9
#: Up to so many sides of a region are compared by plain loops, which are faster there than arrays.
FEW = 64

REPAIRED = "ring_id int, shell_id int, hole boolean, verts array<struct<x: double, y: double>>"


def _edges(rings: Sequence[Sequence[Point]]) -> list[tuple[Point, Point]]:
    """Sides of closed or unclosed rings, without those of no length."""
    out = []
    for ring in rings:
        points = [p for p in ring if math.isfinite(p[0]) and math.isfinite(p[1])]
        out += [(a, b) for a, b in zip(points, points[1:] + points[:1]) if a != b]
    return out


def _side(a: Point, b: Point, p: Point) -> float:
    return (b[0] - a[0]) * (p[1] - a[1]) - (b[1] - a[1]) * (p[0] - a[0])


def _meetings(a: Point, b: Point, c: Point, d: Point) -> list[Point]:
    """Where two sides meet: at ends that lie on the other, or in a crossing, rounded."""
    sides = _side(a, b, c), _side(a, b, d), _side(c, d, a), _side(c, d, b)
    within = lambda p, q, r: min(p[0], q[0]) <= r[0] <= max(p[0], q[0]) and min(p[1], q[1]) <= r[1] <= max(p[1], q[1])
    found = [p for p, s, (q, r) in ((c, sides[0], (a, b)), (d, sides[1], (a, b)), (a, sides[2], (c, d)), (b, sides[3], (c, d))) if s == 0 and within(q, r, p)]
    if not found and (sides[0] > 0) != (sides[1] > 0) and (sides[2] > 0) != (sides[3] > 0) and 0 not in sides:
        t = sides[2] / (sides[2] - sides[3])
        found.append((round(a[0] + t * (b[0] - a[0]), PLACES), round(a[1] + t * (b[1] - a[1]), PLACES)))
    return found


def _overlapping(edges: list[tuple[Point, Point]]) -> Iterator[tuple[int, int]]:
    """Places of sides, sorted by x, whose boxes overlap: a sweep by x."""
    boxes = [(min(a[0], b[0]), max(a[0], b[0]), min(a[1], b[1]), max(a[1], b[1])) for a, b in edges]
    if len(edges) <= FEW:
        for i, (_, right, low, high) in enumerate(boxes):
            for j in range(i + 1, len(boxes)):
                if boxes[j][0] > right:
                    break
                if boxes[j][2] <= high and boxes[j][3] >= low:
                    yield i, j
        return
    import numpy as np

    held = np.array(boxes)
    ends = np.searchsorted(held[:, 0], held[:, 1], side="right")
    for i in range(len(boxes)):
        behind = held[i + 1 : ends[i]]
        for j in np.flatnonzero((behind[:, 2] <= held[i, 3]) & (behind[:, 3] >= held[i, 2])).tolist():
            yield i, i + 1 + j


def _cut(edges: list[tuple[Point, Point]]) -> tuple[list[tuple[Point, Point]], bool]:
    """The sides cut where they meet others, and whether any was."""
    edges = sorted(edges, key=lambda e: min(e[0][0], e[1][0]))
    cuts: dict[int, set[Point]] = defaultdict(set)
    for i, j in _overlapping(edges):
        (a, b), (c, d) = edges[i], edges[j]
        for p in _meetings(a, b, c, d):
            if p not in (a, b):
                cuts[i].add(p)
            if p not in (c, d):
                cuts[j].add(p)
    out = []
    for i, (a, b) in enumerate(edges):
        chain = [a, *sorted(cuts.get(i, ()), key=lambda p: (p[0] - a[0]) ** 2 + (p[1] - a[1]) ** 2), b]
        out += [(p, q) for p, q in zip(chain, chain[1:]) if p != q]
    return out, bool(cuts)


def boundary(rings: Sequence[Sequence[Point]]) -> list[tuple[Point, Point]]:
    """Sides that part inside from outside: they meet at ends only, and sides that stand an even number of times cancel.

    Cutting rounds a crossing, which may make a new one, so it is repeated.
    """
    edges, more, rounds = _edges(rings), True, 0
    while more and edges:
        if rounds == 20:
            raise ValueError("rings that can't be cut apart")
        edges, more = _cut(edges)
        rounds += 1
    times: dict[tuple[Point, Point], int] = defaultdict(int)
    for a, b in edges:
        times[min(a, b), max(a, b)] += 1
    return [e for e, n in times.items() if n % 2]


def area(ring: Sequence[Point]) -> float:
    """Twice the signed area over two: positive counter-clockwise."""
    x0, y0 = ring[0]
    return sum((a[0] - x0) * (b[1] - y0) - (b[0] - x0) * (a[1] - y0) for a, b in zip(ring, [*ring[1:], ring[0]])) / 2


def _lookup(low, high):
    """A function from a coordinate to the places of the spans low..high that may hold it: spans are dealt to as many bins as their number's root."""
    import numpy as np

    n = max(1, int(len(low) ** 0.5))
    start, step = float(low.min()), max((float(high.max()) - float(low.min())) / n, 1e-300)
    place = lambda v: np.clip(((v - start) / step).astype(int), 0, n - 1)
    bins: list[list[int]] = [[] for _ in range(n)]
    for i, (first, last) in enumerate(zip(place(low).tolist(), place(high).tolist())):
        for k in range(first, last + 1):
            bins[k].append(i)
    held = [np.array(x, int) for x in bins]
    return lambda v: held[int(place(np.float64(v)))]


def _counts_before(edges: list[tuple[Point, Point]]) -> Callable[[int, int, float, float], int]:
    """A function from a side, an axis and a point's coordinates on it and on the other one to the number of other sides met before the point."""
    if len(edges) <= FEW:

        def few(i: int, along: int, at: float, level: float) -> int:
            across, n = 1 - along, 0
            for j, (a, b) in enumerate(edges):
                if j != i and (a[along] <= at) != (b[along] <= at):
                    n += a[across] + (at - a[along]) * (b[across] - a[across]) / (b[along] - a[along]) < level
            return n

        return few
    import numpy as np

    a, b = np.array([e[0] for e in edges]), np.array([e[1] for e in edges])
    spans = [(np.minimum(a[:, i], b[:, i]), np.maximum(a[:, i], b[:, i])) for i in (0, 1)]
    near = [_lookup(*s) for s in spans]

    def many(i: int, along: int, at: float, level: float) -> int:
        across, others = 1 - along, near[along](at)
        low, high = spans[along]
        others = others[(low[others] <= at) & (high[others] > at) & (others != i)]
        met = a[others, across] + (at - a[others, along]) * (b[others, across] - a[others, across]) / (b[others, along] - a[others, along])
        return np.count_nonzero(met < level)

    return many


def _left_inside(edges: list[tuple[Point, Point]]) -> list[tuple[Point, Point]]:
    """The sides turned so that the inside is on their left: an odd number of sides stands below a side's middle, or not; west of it where the side is upright."""
    before = _counts_before(edges)
    out = []
    for i, (p, q) in enumerate(edges):
        upright = p[0] == q[0]
        along, across = (1, 0) if upright else (0, 1)  # the axis whose middle is fixed, and that on which sides are counted
        inside_before = before(i, along, (p[along] + q[along]) / 2, (p[across] + q[across]) / 2) % 2 == 1
        forward = (p, q) if q[along] > p[along] else (q, p)
        # going up, west is on the left; going east, below is on the right
        out.append(forward if inside_before == upright else (forward[1], forward[0]))
    return out


def _simple(edges: list[tuple[Point, Point]]) -> list[list[Point]]:
    """Rings without repeated points, each with the inside on its left: at a point of several sides the walk turns left as far as it can, and a ring is cut off where it comes back to a point."""
    out: dict[Point, list[Point]] = defaultdict(list)
    for a, b in edges:
        out[a].append(b)
    rings = []
    for start in sorted(out):
        while out[start]:
            path, places = [start], {start: 0}
            now, came = start, None
            while True:
                choices = out[now]
                if came is None or len(choices) == 1:
                    after = choices.pop()
                else:
                    back = math.atan2(came[1] - now[1], came[0] - now[0])
                    turn = lambda p: (back - math.atan2(p[1] - now[1], p[0] - now[0])) % (2 * math.pi) or 2 * math.pi  # noqa: B023, E731
                    after = min(choices, key=turn)
                    choices.remove(after)
                came, now = now, after
                if now in places:
                    ring = path[places[now] :]
                    rings.append(ring)
                    for p in ring[1:]:
                        del places[p]
                    path = path[: places[now] + 1]
                    if len(path) == 1:
                        break
                else:
                    places[now] = len(path)
                    path.append(now)
    return rings


def _straightened(ring: list[Point], shared: set[Point]) -> list[Point]:
    """A ring without the points on a straight way that no other ring shares; it begins at its smallest point."""
    kept = [p for before, p, after in zip([ring[-1], *ring[:-1]], ring, [*ring[1:], ring[0]]) if p in shared or _side(before, p, after) != 0]
    ring = kept if len(kept) >= 3 else ring
    at = ring.index(min(ring))
    return ring[at:] + ring[:at]


def holds(ring: Sequence[Point], p: Point) -> bool:
    x, y = p
    inside = False
    for a, b in zip(ring, [*ring[1:], ring[0]]):
        if (a[1] > y) != (b[1] > y) and x < (b[0] - a[0]) * (y - a[1]) / (b[1] - a[1]) + a[0]:
            inside = not inside
    return inside


def _within(ring: Sequence[Point], shell: Sequence[Point]) -> bool:
    """Whether a ring lies in a shell that it may touch at points: told by the middles of its sides."""
    middles = [((a[0] + b[0]) / 2, (a[1] + b[1]) / 2) for a, b in zip(ring, [*ring[1:], ring[0]])]
    return sum(holds(shell, m) for m in middles) * 2 > len(middles)


def repaired(rings: Sequence[Sequence[Point]]) -> list[tuple[int, int, bool, list[Point]]]:
    """(ring_id, shell_id, hole, closed ring) of the area that the rings hold: shells counter-clockwise, their holes clockwise behind them."""
    edges = boundary(rings)
    if not edges:
        return []
    degree: dict[Point, int] = defaultdict(int)
    for p in (p for e in edges for p in e):
        degree[p] += 1
    shared = {p for p, n in degree.items() if n > 2}
    simple = [_straightened(r, shared) for r in _simple(_left_inside(edges))]
    shells = sorted((r for r in simple if area(r) > 0), key=lambda r: (r[0], -area(r)))
    held: dict[int, list[list[Point]]] = defaultdict(list)
    for hole in (r for r in simple if area(r) < 0):
        of = min((i for i, s in enumerate(shells) if _within(hole, s)), key=lambda i: area(shells[i]), default=None)
        if of is None:
            raise ValueError("a hole outside of every shell")
        held[of].append(hole)
    out: list[tuple[int, int, bool, list[Point]]] = []
    for i, shell in enumerate(shells):
        first = len(out)
        out += [(first + n, first, n > 0, [*r, r[0]]) for n, r in enumerate([shell, *sorted(held[i])])]
    return out


def _regions(rings: DataFrame, code: str):
    """Rings by region. The number of partitions is fixed: Spark would merge them by the size of their rows, which are few beside the work on them."""
    return rings.repartition(int(rings.sparkSession.conf.get("spark.sql.shuffle.partitions")), code).groupBy(code)


def repair(rings: DataFrame, code: str = "aagis_code") -> DataFrame:
    """code, ring_id, shell_id, hole, verts: the area of each region's rings as valid polygons.

    Rings are closed; repeated points and spikes go; rings are cut apart where
    they cross or touch along a side; shells turn counter-clockwise, holes
    clockwise, and a hole names its shell. The area is that of the even-odd
    rule, also where rings overlap. Points with a missing or infinite
    coordinate are passed over; a region whose rings hold no area has no
    rows. NULL codes are one region. A region is repaired by one task: its
    rings are one geometry.
    """
    ship(rings.sparkSession)
    fields = f"`{code}` {rings.schema[code].dataType.simpleString()}, {REPAIRED}"
    kinds = to_arrow_schema(_parse_datatype_string(fields))

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            rows = []
            for row in batch.to_pylist():
                for ring_id, shell_id, hole, ring in repaired([_points(part) for part in row["parts"]]):
                    rows.append({code: row[code], "ring_id": ring_id, "shell_id": shell_id, "hole": hole, "verts": [{"x": x, "y": y} for x, y in ring]})
            yield pa.RecordBatch.from_pylist(rows, kinds)

    ordered = F.transform(F.array_sort(F.collect_list(F.struct("ring_id", "verts"))), lambda r: r["verts"])
    return _regions(rings, code).agg(ordered.alias("parts")).mapInArrow(run, fields)


def _points(part: list[dict] | None) -> list[Point]:
    """The corners of a ring as it was read; what is missing is no number."""
    number = lambda v, c: math.nan if v is None or v[c] is None else v[c]
    return [(number(v, "x"), number(v, "y")) for v in part or ()]


def is_sound(rings: Sequence[Sequence[Point]]) -> bool:
    """Whether rings are closed and simple, and meet each other at corners only."""
    for ring in rings:
        if len(ring) < 4 or ring[0] != ring[-1] or len(set(ring)) != len(ring) - 1 or not all(math.isfinite(c) for p in ring for c in p):
            return False
    edges = _edges([r[:-1] for r in rings])
    return len({(min(e), max(e)) for e in edges}) == len(edges) and not _cut(edges)[1]


def soundness(rings: DataFrame, code: str = "aagis_code") -> DataFrame:
    """code, sound: whether a region's rings are valid as they stand; missing coordinates are unsound."""
    ship(rings.sparkSession)
    fields = f"`{code}` {rings.schema[code].dataType.simpleString()}, sound boolean"
    kinds = to_arrow_schema(_parse_datatype_string(fields))

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            yield pa.RecordBatch.from_pylist([{code: row[code], "sound": is_sound([_points(p) for p in row["parts"]])} for row in batch.to_pylist()], kinds)

    return _regions(rings, code).agg(F.collect_list("verts").alias("parts")).mapInArrow(run, fields)


def ring_area(verts: Column) -> Column:
    """The signed area of a ring in square units of its coordinates: positive counter-clockwise."""
    first = F.get(verts, 0)
    at = lambda i, c: F.get(verts, i % F.size(verts))[c] - first[c]
    return F.aggregate(F.sequence(F.lit(0), F.size(verts) - 1), F.lit(0.0), lambda s, i: s + at(i, "x") * at(i + 1, "y") - at(i + 1, "x") * at(i, "y")) / 2


def sides(rings: DataFrame, keys: Sequence[str] = ("aagis_code",)) -> DataFrame:
    """A row for each side of the rings, closed if they are not: keys, x1, y1, x2, y2."""
    at = lambda i, c, name: F.get("verts", i)[c].alias(name)
    after = lambda i: (i + 1) % F.size("verts")
    ends = F.transform(F.sequence(F.lit(0), F.size("verts") - 1), lambda i: F.struct(at(i, "x", "x1"), at(i, "y", "y1"), at(after(i), "x", "x2"), at(after(i), "y", "y2")))
    found = rings.filter(F.size("verts") >= 3).select(*keys, F.explode(ends).alias("s")).select(*keys, "s.*")
    return found.filter("x1 <> x2 OR y1 <> y2")


def representative_points(rings: DataFrame, code: str = "aagis_code", far_km: float = 100.0) -> DataFrame:
    """code, lat, lon, centroid_lat, centroid_lon, km, far: a point inside each region.

    Each part of a region is cut along one level, between the two corner
    levels around the middle of its box, so the level meets no corner; where
    it enters and leaves the part or its holes bounds intervals, and the
    middle of the region's widest one is the point (of equals the
    southernmost, then the westernmost). km is the distance to the region's
    centroid, far whether it is more than far_km. Regions without area, and
    those without a code, have no row. Rings that repair() made (they have a
    column hole) are taken as they are, others are repaired first.
    """
    part = [code, "shell_id"]
    all_sides = sides(rings if "hole" in rings.columns else repair(rings, code), part)
    middle = all_sides.groupBy(*part).agg(((F.min("y1") + F.max("y1")) / 2).alias("middle"))
    level = (F.max(F.when(F.col("y1") <= F.col("middle"), F.col("y1"))) + F.min(F.when(F.col("y1") > F.col("middle"), F.col("y1")))) / 2
    levels = all_sides.join(middle, part).groupBy(*part).agg(level.alias("lat"))
    cuts = all_sides.join(levels, part).filter((F.col("y1") > F.col("lat")) != (F.col("y2") > F.col("lat")))
    x = F.col("x1") + (F.col("lat") - F.col("y1")) * (F.col("x2") - F.col("x1")) / (F.col("y2") - F.col("y1"))
    along = Window.partitionBy(*part).orderBy("x")
    spans = cuts.select(*part, "lat", x.alias("x")).withColumns({"place": F.row_number().over(along), "until": F.lead("x").over(along)}).filter("place % 2 = 1 AND until > x")
    widest = spans.groupBy(code).agg(F.max(F.struct((F.col("until") - F.col("x")).alias("width"), (-F.col("lat")).alias("south"), (-F.col("x")).alias("west"))).alias("w"))
    points = widest.select(code, (-F.col("w.south")).alias("lat"), (-F.col("w.west") + F.col("w.width") / 2).alias("lon"))
    # moments about a corner of the region, whose sides turn left around its area
    corner = all_sides.groupBy(code).agg(F.min("x1").alias("x0"), F.min("y1").alias("y0"))
    turned = (F.col("x1") - F.col("x0")) * (F.col("y2") - F.col("y0")) - (F.col("x2") - F.col("x0")) * (F.col("y1") - F.col("y0"))
    moment = lambda c: F.first(f"{c}0") + F.sum((F.col(f"{c}1") + F.col(f"{c}2") - 2 * F.col(f"{c}0")) * F.col("turned")) / (3 * F.sum("turned"))
    centroids = all_sides.join(corner, code).withColumn("turned", turned).groupBy(code).agg(moment("y").alias("centroid_lat"), moment("x").alias("centroid_lon"))
    km = haversine_km(F.col("lat"), F.col("lon"), F.col("centroid_lat"), F.col("centroid_lon"))
    return points.join(centroids, code).withColumn("km", km).withColumn("far", F.col("km") > far_km)
