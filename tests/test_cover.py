"""Places in polygons with parts and holes, and nearest segments, against plain tests; skewed tables and bounded tasks."""

import math
import random

import pytest
from pyspark.sql import functions as F

from basinsift.functions import geo
from basinsift.operators import cover, shared, spatial

SHAPE = "sid int, geometry struct<type:string,parts:array<array<struct<x:double,y:double>>>>"
POINT = "id int, x double, y double"


def inside(x, y, parts):
    """Even-odd over all rings, not on a border."""
    count = 0
    for ring in parts:
        for (ax, ay), (bx, by) in zip(ring, ring[1:], strict=False):
            if (bx - ax) * (y - ay) == (by - ay) * (x - ax) and min(ax, bx) <= x <= max(ax, bx) and min(ay, by) <= y <= max(ay, by):
                return False
            if (ay > y) != (by > y) and x < (bx - ax) * (y - ay) / (by - ay) + ax:
                count += 1
    return count % 2 == 1


def random_shapes(rng):
    shapes = []
    for k in range(12):
        place = (lambda: float(rng.randint(-20, 20))) if k % 2 else (lambda: rng.uniform(-20, 20))
        parts = []
        for _ in range(rng.randint(1, 3)):
            ring = [(place(), place()) for _ in range(rng.randint(3, 9))]
            parts.append([*ring, ring[0]])
        shapes.append((k, ("Polygon", parts)))
    block = lambda r, turn: [(-r, -r), (r, -r), (r, r), (-r, r), (-r, -r)][::turn]
    shapes.append((100, ("MultiPolygon", [block(200.0, 1), block(50.0, -1), [(300.0, 0.0), (310.0, 0.0), (310.0, 10.0), (300.0, 0.0)]])))
    shapes += [(101, None), (102, ("LineString", [[(0.0, 0.0), (9.0, 9.0)]])), (103, ("Polygon", []))]
    return shapes


@pytest.mark.parametrize(("seed", "cell", "most"), [(1, 10.0, 4096), (2, 3.0, 4096), (3, 40.0, 20)])
def test_points_in_shapes(spark, monkeypatch, seed, cell, most):
    monkeypatch.setattr(cover, "CELL_PLACES", most)
    monkeypatch.setattr(cover, "CELLS_PER_PARTITION", 30)
    rng = random.Random(seed)
    shapes = random_shapes(rng)
    points = [(k, float(rng.randint(-22, 22)), float(rng.randint(-22, 22))) if k % 2 else (k, rng.uniform(-22, 22), rng.uniform(-22, 22)) for k in range(1200)]
    points += [(3000 + k, rng.uniform(-320, 320), rng.uniform(-220, 220)) for k in range(300)] + [(9000, None, 1.0), (9001, float("nan"), 2.0), (9002, 1.0, 1.0), (9002, 1.0, 1.0)]
    got = spatial.point_in_polygon(spark.createDataFrame(points, POINT), spark.createDataFrame(shapes, SHAPE), "id", "sid", cell).collect()
    want = []
    for k, x, y in points:
        held = [s for s, g in shapes if g and "Polygon" in g[0] and x is not None and x == x and inside(x, y, g[1])]
        want += [(k, s) for s in held or [None]]
    assert sorted(map(str, want)) == sorted(str((r["id"], r["sid"])) for r in got)


def test_empty_sides(spark):
    shapes, points = spark.createDataFrame(random_shapes(random.Random(5)), SHAPE), spark.createDataFrame([(1, 0.5, 0.5)], POINT)
    assert [tuple(r) for r in spatial.point_in_polygon(points, shapes.limit(0), "id", "sid", 5.0).collect()] == [(1, None)]
    assert spatial.point_in_polygon(points.limit(0), shapes, "id", "sid", 5.0).count() == 0


def test_large_polygon_without_copies_of_its_ring(spark):
    """A ring of 5000 edges over more than 10^6 cells: border cells carry their own edges only, inner cells none."""
    n, radius = 5000, 600.0
    ring = [(radius * math.cos(2 * math.pi * k / n), radius * math.sin(2 * math.pi * k / n)) for k in range(n)]
    shapes = spark.createDataFrame([(1, ("Polygon", [[*ring, ring[0]]]))], SHAPE)
    cells = cover.cover(shapes, "sid", 1.0)
    row = cells.agg(F.count("*").alias("n"), F.count_if(F.col("edges").isNull()).alias("inner"), F.sum(F.size("edges")).alias("edges"), F.max(F.size("edges")).alias("most")).first()
    assert row["n"] > 10**6 and row["inner"] > 10**6 and row["edges"] < 6 * n and row["most"] < 20
    assert math.isclose(row["inner"], math.pi * radius**2, rel_tol=0.01)
    rng = random.Random(1)
    points = [(k, rng.uniform(-620, 620), rng.uniform(-620, 620)) for k in range(3000)]
    got = {r["id"] for r in spatial.point_in_polygon(spark.createDataFrame(points, POINT), shapes, "id", "sid", 1.0).collect() if r["sid"]}
    assert got == {k for k, x, y in points if inside(x, y, [[*ring, ring[0]]])}


def test_most_places_in_one_cell(spark, monkeypatch):
    """90 % of places in one cell: the quadtree's largest cell stays near the median, results the same."""
    monkeypatch.setattr(cover, "CELL_PLACES", 64)
    rng = random.Random(2)
    points = [(k, rng.uniform(0, 10), rng.uniform(0, 10)) if k % 10 else (k, rng.uniform(-1000, 1000), rng.uniform(-1000, 1000)) for k in range(9000)]
    places = spark.createDataFrame(points, POINT).select("x", "y")
    split = cover.splits(places, 100.0)
    assert len(split) > 2
    hot = cover.leaves(places, 100.0, split).filter("level > 0").groupBy("level", "i", "j").count().collect()
    counts = sorted(r["count"] for r in hot)
    assert counts[-1] <= max(64, -(-9000 // (cover.CELLS_PER_PARTITION * 4))) and counts[-1] < 4 * counts[len(counts) // 2]
    by_task = cover.leaves(places, 100.0, split).repartition(16, "level", "i", "j").groupBy(F.spark_partition_id()).count().collect()
    loads = sorted(r["count"] for r in by_task)
    assert loads[-1] < 4 * loads[len(loads) // 2]
    segments = [(rng.uniform(-1000, 1000), rng.uniform(-1000, 1000), rng.uniform(-1000, 1000), rng.uniform(-1000, 1000)) for _ in range(20)] + [(2.0, 1.0, 3.0, 9.0), (5.0, 5.0, 5.0, 5.0)]
    got = spatial.nearest_distance(spark.createDataFrame(points, POINT), spark.createDataFrame(segments, "x1 double, y1 double, x2 double, y2 double"), "id", 100.0, 4000.0).collect()

    def plain(x, y):
        best = math.inf
        for x1, y1, x2, y2 in segments:
            dx, dy = x2 - x1, y2 - y1
            t = max(0.0, min(1.0, ((x - x1) * dx + (y - y1) * dy) / (dx * dx + dy * dy))) if dx or dy else 0.0
            best = min(best, math.hypot(x - x1 - t * dx, y - y1 - t * dy))
        return best

    at = {k: (x, y) for k, x, y in points}
    assert len(got) == 9000 and all(math.isclose(r["distance"], plain(*at[r["id"]]), abs_tol=1e-9) for r in got)


def test_far_places_are_dealt_out(spark, monkeypatch):
    """All places far from the only segment share each cell of the descent."""
    monkeypatch.setattr(spatial, "SPREAD_ROWS", 50)
    monkeypatch.setattr(shared, "SPREAD_ROWS", 50)
    points = [(k, 5000.0 + k, 5000.0) for k in range(400)]
    segment = spark.createDataFrame([(0.0, 0.0, 0.0, 10.0)], "x1 double, y1 double, x2 double, y2 double")
    got = spatial.nearest_distance(spark.createDataFrame(points, POINT), segment, "id", 100.0, 20000.0).collect()
    assert sorted((r["id"], round(r["distance"], 6)) for r in got) == [(k, round(math.hypot(x, y - 10), 6)) for k, x, y in points]


def test_join_of_one_very_common_key(spark):
    left = spark.createDataFrame([(k, 7 if k % 3 else k) for k in range(900)] + [(1000, None)], "id int, key int")
    right = spark.createDataFrame([(7, "seven"), (9, "nine"), (None, "none")], "key int, name string")
    joined = shared.join_spread(left, right, ["key"], rows=100)
    assert sorted(map(str, joined.select("id", "name").collect())) == sorted(map(str, left.join(right, "key", "left").select("id", "name").collect()))
    parts = shared.join_spread(left, right, ["key"], rows=100).filter("key = 7").count()
    assert parts == 600 and shared.join_spread(left, right, ["key"], "inner", 100).count() == left.join(right, "key").count()


def test_nested_polygons_and_features(spark):
    block = lambda x, r, turn: [(x - r, -r), (x + r, -r), (x + r, r), (x - r, r), (x - r, -r)][::turn]
    parts = [block(0.0, 9.0, 1), block(0.0, 5.0, -1), block(0.0, 1.0, 1), block(50.0, 3.0, 1), block(50.0, 1.0, -1), block(52.0, 0.5, -1)]
    rows = [(1, ("MultiPolygon", parts)), (2, ("Polygon", parts[:2])), (3, ("LineString", [[(0.0, 0.0), (1.0, 1.0)]])), (4, None), (5, ("MultiPolygon", [p[::-1] for p in parts])), (6, ("MultiPolygon", []))]
    df = spark.createDataFrame(rows, SHAPE).withColumn("n", F.transform(geo.polygons(F.col("geometry")), lambda p: F.size(p)))
    assert {r["sid"]: r["n"] for r in df.collect()} == {1: [2, 1, 3], 2: [2], 3: None, 4: None, 5: [2, 1, 3], 6: []}
    areas = df.select("sid", F.transform("geometry.parts", geo.ring_area).alias("a")).filter("sid = 1").first()["a"]
    assert areas == [324.0, -100.0, 4.0, 36.0, -4.0, -1.0]
