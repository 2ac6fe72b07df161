"""Simplification that keeps topology: crossings, shared borders, distances, odd shapes."""

import math
import random

import numpy as np
import pytest

from basinsift.functions import rings
from basinsift.operators import borders

SHAPE = "id int, name string, geometry struct<type:string,parts:array<array<struct<x:double,y:double>>>>"


def star(rng, n, x=0.0, y=0.0, size=100.0):
    """A random ring that doesn't cross itself."""
    angles = sorted(rng.uniform(0, 2 * math.pi) for _ in range(n))
    ring = [(x + r * math.cos(a), y + r * math.sin(a)) for a in angles for r in [rng.uniform(0.2, 1) * size]]
    return [*ring, ring[0]]


def ribbon(rng, n=150):
    """A narrow ring along a wave: there on one side, back on the other, with vertices at other places."""
    at = lambda: sorted(rng.uniform(0, 600) for _ in range(n))
    wave = lambda x, off: (x, 30 * math.sin(x / 25) + off)
    ring = [*(wave(x, -4.0) for x in at()), *(wave(x, 4.0) for x in at()[::-1])]
    return [*ring, ring[0]]


def crossings(parts):
    edges = [(a, b) for part in parts for a, b in zip(part, part[1:], strict=False)]
    return [1 for i, j, points in rings.meetings(edges) if len(points) > 1 or any(p not in edges[i] or p not in edges[j] for p in points)]


def places(geometry):
    return [[(v["x"], v["y"]) for v in part] for part in geometry["parts"]]


def test_random_rings_do_not_cross(spark):
    rng = random.Random(4)
    rows = []
    for k in range(40):
        ring = ribbon(rng) if k % 2 else star(rng, 60)
        while crossings([ring]):
            ring = ribbon(rng) if k % 2 else star(rng, 60)
        rows.append((k, "n", ("Polygon", [ring])))
    by_plain = [np.array(r[2][1][0])[borders.thinned(np.array(r[2][1][0]), 50.0)].tolist() for r in rows]
    assert any(crossings([[tuple(p) for p in line]]) for line in by_plain)  # the tolerance alone does make rings cross
    got = {r["id"]: places(r["geometry"]) for r in borders.simplify(spark.createDataFrame(rows, SHAPE), "id", 50.0).collect()}
    assert not any(crossings(parts) for parts in got.values())
    assert sum(len(p[0]) for p in got.values()) < 0.8 * sum(len(r[2][1][0]) for r in rows)
    for k, _, (_, (ring,)) in rows:
        assert set(got[k][0]) <= set(ring) and got[k][0][0] == got[k][0][-1] and len(got[k][0]) >= 4


def wall(rng, a, b, n=40):
    """Vertices from a to b, off the straight line."""
    xs = [(a[0] + (b[0] - a[0]) * t / n + rng.uniform(-8, 8) * (0 < t < n), a[1] + (b[1] - a[1]) * t / n + rng.uniform(-8, 8) * (0 < t < n)) for t in range(n + 1)]
    return xs


@pytest.mark.parametrize("tolerance", [3.0, 10.0, 60.0])
def test_shared_borders_stay_shared(spark, tolerance):
    rng = random.Random(7)
    side = {}

    def along(a, b):
        if (b, a) in side:
            return side[b, a][::-1]
        return side.setdefault((a, b), wall(rng, a, b))

    rows = []
    for i in range(3):
        for j in range(3):
            c = [(1000.0 * (i + x), 1000.0 * (j + y)) for x, y in ((0, 0), (1, 0), (1, 1), (0, 1))]
            ring = [p for a, b in zip(c, [*c[1:], c[0]], strict=True) for p in along(a, b)[:-1]]
            k = rng.randrange(len(ring))  # rings begin anywhere, and turn both ways
            ring = [*ring[k:], *ring[:k], ring[k]]
            rows.append((3 * i + j, "n", ("Polygon", [ring[::-1] if (i + j) % 2 else ring])))
    island = star(rng, 30, 500.0, 500.0)
    while crossings([island]):
        island = star(rng, 30, 500.0, 500.0)
    rows[0] = (0, "n", ("Polygon", [*rows[0][2][1], island[::-1]]))  # a hole, and what fills it
    rows.append((50, "island", ("Polygon", [island])))
    got = {r["id"]: places(r["geometry"]) for r in borders.simplify(spark.createDataFrame(rows, SHAPE), "id", tolerance).collect()}
    count = {}
    for parts in got.values():
        for part in parts:
            for a, b in zip(part, part[1:], strict=False):
                count[min((a, b), (b, a))] = count.get(min((a, b), (b, a)), 0) + 1
    outer = sum(n == 1 for n in count.values())
    assert set(count.values()) == {1, 2}
    assert all(n == 2 or any(min(a[k], b[k]) < 20 or max(a[k], b[k]) > 2980 for k in (0, 1)) for (a, b), n in count.items()) and outer
    assert math.isclose(sum(abs(rings.area(p[0])) - sum(abs(rings.area(h)) for h in p[1:]) for p in got.values()), 9e6, rel_tol=0.03)
    assert set(got[50][0]) == set(got[0][1]) and not any(crossings(p) for p in got.values())


def test_odd_shapes(spark):
    rows = [
        (1, "null", None), (2, "point", ("Point", [[(1.0, 1.0)]])), (3, "line", ("LineString", [[(0.0, 0.0), (5.0, 0.1), (10.0, 0.0)]])), (4, "none", ("LineString", [])),
        (5, "two", ("MultiLineString", [[(0.0, 0.0), (1.0, 1.0)], [(20.0, 0.0), (25.0, 0.1), (30.0, 0.0), (35.0, 40.0)]])), (6, "triangle", ("Polygon", [[(100.0, 0.0), (101.0, 0.0), (100.5, 0.1), (100.0, 0.0)]])),
        (7, "single", ("LineString", [[(7.0, 7.0)]])),
    ]
    df = spark.createDataFrame(rows, SHAPE)
    got = {r["id"]: r for r in borders.simplify(df, "id", 1.0).collect()}
    assert got[1]["geometry"] is None and got[1]["name"] == "null" and places(got[2]["geometry"]) == [[(1.0, 1.0)]] and places(got[3]["geometry"]) == [[(0.0, 0.0), (10.0, 0.0)]]
    assert places(got[5]["geometry"]) == [[(0.0, 0.0), (1.0, 1.0)], [(20.0, 0.0), (30.0, 0.0), (35.0, 40.0)]] and len(places(got[6]["geometry"])[0]) == 4 and places(got[4]["geometry"]) == []
    assert places(got[7]["geometry"]) == [[(7.0, 7.0)]] and len(got) == 7
    assert borders.simplify(df.limit(0), "id", 1.0).count() == 0
