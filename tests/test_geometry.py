"""Distances, repair, cropping and simplification against plain versions, and their odd cases."""

import json
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from basinsift.functions import geo
from basinsift.operators import frames, spatial

SHAPE = "id int, geometry struct<type:string,parts:array<array<struct<x:double,y:double>>>>"
SEGMENT = "x1 double, y1 double, x2 double, y2 double"


def plain_distance(x, y, segments):
    best = None
    for x1, y1, x2, y2 in segments:
        dx, dy = x2 - x1, y2 - y1
        t = max(0.0, min(1.0, ((x - x1) * dx + (y - y1) * dy) / (dx * dx + dy * dy))) if dx or dy else 0.0
        d = math.hypot(x - x1 - t * dx, y - y1 - t * dy)
        best = d if best is None else min(best, d)
    return best


@pytest.mark.parametrize("extent", [50.0, 5000.0])
def test_nearest_distance_is_exact(spark, extent):
    rng = random.Random(3)
    segments = [tuple(rng.uniform(-2000, 2000) for _ in range(4)) for _ in range(15)]
    segments += [(x, y, x + rng.uniform(-30, 30), y + rng.uniform(-30, 30)) for x, y in ((rng.uniform(-2000, 2000), rng.uniform(-2000, 2000)) for _ in range(40))]
    segments += [(500.0, -900.0, 500.0, 900.0), (-800.0, 100.0, 900.0, 100.0), (7.0, 7.0, 7.0, 7.0), (100.0, 100.0, 200.0, 200.0)]
    points = [(k, rng.uniform(-2500, 2500), rng.uniform(-2500, 2500)) for k in range(150)]
    points += [(200, 100.0, 100.0), (201, 0.0, 0.0), (202, 60_000.0, -45_000.0), (203, 100.0, 100.0), (203, 100.0, 100.0)]
    got = spatial.nearest_distance(spark.createDataFrame(points, "id int, x double, y double"), spark.createDataFrame(segments, SEGMENT), "id", 100.0, extent).collect()
    assert len(got) == len(points)
    at = {k: (x, y) for k, x, y in points}
    assert all(math.isclose(r["distance"], plain_distance(*at[r["id"]], segments), abs_tol=1e-9) for r in got)


def test_points_without_place_stay(spark):
    points = spark.createDataFrame([(1, 0.0, 0.0), (2, None, 1.0), (3, 1.0, None), (4, float("nan"), 1.0), (None, 3.0, 4.0)], "id int, x double, y double")
    segments = spark.createDataFrame([(0.0, 0.0, 0.0, 0.0), (None, 0.0, 1.0, 1.0)], SEGMENT)
    got = {r["id"]: r["distance"] for r in spatial.nearest_distance(points, segments, "id", 10.0, 100.0).collect()}
    assert got == {1: 0.0, 2: None, 3: None, 4: None, None: 5.0}
    none = spatial.nearest_distance(points, segments.filter("x1 > 5"), "id", 10.0, 100.0).collect()
    assert len(none) == 5 and all(r["distance"] is None for r in none)
    assert spatial.nearest_distance(points.limit(0), segments, "id", 10.0, 100.0).count() == 0


def shape(kind, *parts):
    return kind, [None if p is None else [None if v is None else v for v in p] for p in parts]


def test_repair_of_odd_shapes(spark):
    rows = [
        (1, None), (2, shape("Point")), (3, shape("Point", [])), (4, shape("LineString", [(0.0, 0.0), (0.0, 0.0)])), (5, shape("Polygon", [(0.0, 0.0), (1.0, 0.0), (0.0, 0.0)])),
        (6, shape("Polygon", [(0.0, 0.0), (1.0, 0.0), (1.0, 1.0), (0.0, 0.0)], None, [(5.0, 5.0)])), (7, shape("LineString", [(0.0, 0.0), (float("nan"), 1.0), None, (2.0, 2.0)])),
        (8, shape("Polygon", [(0.0, 0.0), (1.0, 0.0), (1.0, 1.0)])),
    ]
    got = {r["id"]: [[(v["x"], v["y"]) for v in p] for p in r["geometry"]["parts"]] for r in spatial.repair(spark.createDataFrame(rows, SHAPE)).collect()}
    ring = [(0.0, 0.0), (1.0, 0.0), (1.0, 1.0), (0.0, 0.0)]
    assert got == {6: [ring], 7: [[(0.0, 0.0), (2.0, 2.0)]], 8: [ring]}
    assert spatial.repair(spark.createDataFrame([], SHAPE)).count() == 0


def test_borders_and_features(spark):
    rows = [(1, shape("Polygon", [(0.0, 0.0), (2.0, 0.0), (2.0, 2.0), (0.0, 0.0)])), (2, shape("MultiPolygon", [(0.0, 0.0), (1.0, 0.0), (1.0, 1.0), (0.0, 0.0)], [(5.0, 5.0), (6.0, 5.0), (6.0, 6.0), (5.0, 5.0)])), (3, shape("Point", [(1.0, 2.0)])), (4, None)]
    df = spark.createDataFrame(rows, SHAPE)
    edges = sorted((r["id"], r["x1"], r["y1"], r["x2"], r["y2"]) for r in spatial.boundary_segments(df).collect())
    assert edges[:3] == [(1, 0.0, 0.0, 2.0, 0.0), (1, 2.0, 0.0, 2.0, 2.0), (1, 2.0, 2.0, 0.0, 0.0)] and len(edges) == 9
    found = {r["id"]: r["f"] for r in df.select("id", geo.geojson(F.col("geometry"), F.col("id")).alias("f")).collect()}
    assert json.loads(found[2])["geometry"] == {"type": "MultiPolygon", "coordinates": [[[[0, 0], [1, 0], [1, 1], [0, 0]]], [[[5, 5], [6, 5], [6, 6], [5, 5]]]]}
    assert json.loads(found[3])["geometry"]["coordinates"] == [1, 2] and found[4] is None
    assert sorted(r["id"] for r in spatial.crop_geometries(df, "geometry", (4.0, 4.0, 5.0, 5.0)).collect()) == [2]
    assert spatial.crop_geometries(df, "geometry", (90.0, 90.0, 91.0, 91.0)).count() == 4


def test_simplified_lines_stay_within_the_tolerance(spark):
    rng = np.random.default_rng(5)
    for n, closed in ((2, False), (50, False), (200, True), (5, True)):
        line = np.cumsum(rng.normal(0, 5, (n, 2)), axis=0)
        if closed:
            line = np.concatenate([line, line[:1]])
        keep = spatial.simplified(line, 12.0)
        left = line[keep]
        assert keep[0] and keep[-1] and (not closed or keep.sum() >= 4)
        edges = [(*a, *b) for a, b in zip(left.tolist(), left[1:].tolist(), strict=False)]
        assert all(plain_distance(x, y, edges) <= 12.0 + 1e-9 for x, y in line.tolist())
    df = spark.createDataFrame([(1, None), (2, shape("Point", [(1.0, 1.0)])), (3, shape("LineString", [(0.0, 0.0), (5.0, 0.1), (10.0, 0.0)]))], SHAPE)
    got = {r["id"]: r["geometry"] for r in spatial.simplify(df, "geometry", 1.0).collect()}
    assert got[1] is None and len(got[2]["parts"][0]) == 1 and [v["x"] for v in got[3]["parts"][0]] == [0.0, 10.0]


def test_projection_and_back(spark):
    rows = [(-102.0, 12.0), (-98.4, 19.05), (-117.1, 32.5), (-86.7, 21.2)]
    df = spark.createDataFrame(rows, "lon double, lat double").withColumn("p", geo.project_lcc(F.col("lon"), F.col("lat")))
    for r in df.withColumn("q", geo.unproject_lcc(F.col("p.x"), F.col("p.y"))).collect():
        assert math.isclose(r["q"]["lon"], r["lon"], abs_tol=1e-9) and math.isclose(r["q"]["lat"], r["lat"], abs_tol=1e-9)


def test_transverse_mercator_and_choice(spark):
    """On the zone's meridian the northing is the scaled arc, here summed numerically; eastings are symmetric."""
    a, e2 = geo.LCC["a"], 2 * geo.LCC["f"] - geo.LCC["f"] ** 2
    steps = 20_000
    arc = sum(a * (1 - e2) / (1 - e2 * math.sin((k + 0.5) * math.radians(19.1) / steps) ** 2) ** 1.5 for k in range(steps)) * math.radians(19.1) / steps
    rows = spark.createDataFrame([(-99.0, 19.1), (-98.2, 19.1), (-99.8, 19.1)], "lon double, lat double")
    middle, east, west = (r["p"] for r in rows.select(geo.project_utm(F.col("lon"), F.col("lat")).alias("p")).collect())
    assert math.isclose(middle["x"], 500_000, abs_tol=1e-6) and math.isclose(middle["y"], 0.9996 * arc, abs_tol=1e-3)
    assert math.isclose(east["x"] - 500_000, 500_000 - west["x"], abs_tol=1e-6) and 84_000 < east["x"] - 500_000 < 84_300 and east["y"] > middle["y"]
    assert geo.choose_projection(spark) == "EPSG:6372"
    nowhere = lambda lon, lat: F.struct((lon * float("nan")).alias("x"), lat.alias("y"))
    assert geo.choose_projection(spark, candidates={"bad": nowhere, "EPSG:32614": geo.project_utm}) == "EPSG:32614"
    with pytest.raises(ValueError, match="none of bad"):
        geo.choose_projection(spark, candidates={"bad": nowhere})


def test_row_numbers_are_whole(spark):
    df = spark.range(0, 5000, 1, 7).select((F.col("id") * 7919 % 5000).alias("k"))
    got = {r["k"]: r["row_id"] for r in frames.with_row_number(df, ["k"]).collect()}
    assert got == {k: k + 1 for k in range(5000)}


def test_nearest_distance_among_dense_and_repeated_segments(spark, monkeypatch):
    laid, keep = [], spatial.materialize

    def counted(df, name):
        out = keep(df, name)
        if name == "laid":
            laid.append(out.count())
        return out

    rng = np.random.default_rng(5)
    lines = [tuple(map(float, r)) for r in rng.uniform(0, 1000, (300, 4))] + [(2000.0, 2000.0, 2000.0, 2000.0)]
    spots = [(k, *map(float, rng.uniform(-200, 1400, 2))) for k in range(150)] + [(150, 2000.5, 2000.0), (151, None, 3.0)]
    x1, y1, x2, y2 = np.array(lines).T
    want = {}
    for k, x, y in spots[:-1]:
        dx, dy = x2 - x1, y2 - y1
        t = np.clip(((x - x1) * dx + (y - y1) * dy) / np.where(dx * dx + dy * dy == 0, 1, dx * dx + dy * dy), 0, 1)
        want[k] = float(np.hypot(x - x1 - t * dx, y - y1 - t * dy).min())
    monkeypatch.setattr(spatial, "materialize", counted)
    points = spark.createDataFrame(spots, "id int, x double, y double")
    for copies, few in ((1, 2**24), (20, 2**24), (20, 0)):
        monkeypatch.setattr(spatial, "FEW_PAIRS", few)
        df = spark.createDataFrame(lines * copies, "x1 double, y1 double, x2 double, y2 double")
        got = dict(spatial.nearest_distance(points, df, "id", 512.0, 4000.0).collect())
        assert got.pop(151) is None and got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-6 for k in want)
    assert laid[0] == laid[1]  # copies are laid once


def test_cells_are_halved_where_segments_are_dense(spark):
    places = spark.range(20_000).selectExpr("CAST(id % 200 AS double) * 5 AS x", "CAST(id div 200 AS double) * 10 AS y")
    lines = spark.range(2000).selectExpr("CAST(id % 50 AS double) * 20 AS x1", "CAST(id div 50 AS double) * 25 AS y1").selectExpr("x1", "y1", "x1 + 3 AS x2", "y1 AS y2")
    assert spatial._halved(places, lines, 1000.0) < 500.0
    assert spatial._halved(places.limit(10), lines, 1000.0) == 1000.0


def test_features_of_one_file_are_repaired_by_all_tasks(spark):
    bow = "named_struct('type', 'Polygon', 'parts', array(array(struct(0D AS x, 0D AS y), struct(2D AS x, 2D AS y), struct(2D AS x, 0D AS y), struct(0D AS x, 2D AS y), struct(0D AS x, 0D AS y))))"
    df = spark.range(400).coalesce(1).selectExpr("id", f"{bow} AS geometry")
    fixed = spatial.repair(df).select("id", F.size("geometry.parts").alias("n"), F.spark_partition_id().alias("task")).collect()
    assert sorted((r["id"], r["n"]) for r in fixed) == [(k, 2) for k in range(400)]
    per_task = [sum(r["task"] == t for r in fixed) for t in range(4)]
    assert sum(per_task) == 400 and min(per_task) > 50
