"""Planar geometry on structs: a geometry is ``struct<type, parts: array<array<struct<x, y>>>>`` in metres."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

#: Upper edges of the distance bands and their labels; bands are closed on the right.
BANDS = [(100, "0-100 m"), (250, "100-250 m"), (500, "250-500 m"), (1000, "500-1000 m")]
BEYOND, UNKNOWN = ">1000 m", "sin distancia"
BUFFERS = [100, 250, 500, 1000]


def segment_distance(x: Column, y: Column, x1: Column, y1: Column, x2: Column, y2: Column) -> Column:
    """Distance of a point to a segment; a segment of no length is a point."""
    dx, dy = x2 - x1, y2 - y1
    square = dx * dx + dy * dy
    t = F.when(square == 0, F.lit(0.0)).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), ((x - x1) * dx + (y - y1) * dy) / F.nullif(square, F.lit(0.0)))))
    ex, ey = x - (x1 + t * dx), y - (y1 + t * dy)
    return F.sqrt(ex * ex + ey * ey)


def band(distance: Column) -> Column:
    out = F.when(distance.isNull() | F.isnan(distance), UNKNOWN)
    for edge, label in BANDS:
        out = out.when(distance <= edge, label)
    return out.otherwise(BEYOND)


def within(distance: Column, limit: float) -> Column:
    return F.coalesce((distance <= limit) & ~F.isnan(distance), F.lit(False))


def crossings(x: Column, y: Column, ring: Column) -> Column:
    """How many edges of a closed ring (array of points) a ray to the right crosses."""
    edges = F.zip_with(F.slice(ring, F.lit(1), F.size(ring) - 1), F.slice(ring, F.lit(2), F.size(ring) - 1), lambda a, b: F.struct(a.alias("a"), b.alias("b")))
    hit = lambda e: ((e.a.y > y) != (e.b.y > y)) & (x < (e.b.x - e.a.x) * (y - e.a.y) / F.nullif(e.b.y - e.a.y, F.lit(0.0)) + e.a.x)
    return F.size(F.filter(edges, hit))


def on_ring(x: Column, y: Column, ring: Column) -> Column:
    edges = F.zip_with(F.slice(ring, F.lit(1), F.size(ring) - 1), F.slice(ring, F.lit(2), F.size(ring) - 1), lambda a, b: F.struct(a.alias("a"), b.alias("b")))
    flat = lambda e: ((e.b.x - e.a.x) * (y - e.a.y) == (e.b.y - e.a.y) * (x - e.a.x)) & x.between(F.least(e.a.x, e.b.x), F.greatest(e.a.x, e.b.x)) & y.between(F.least(e.a.y, e.b.y), F.greatest(e.a.y, e.b.y))
    return F.exists(edges, flat)


def inside(x: Column, y: Column, ring: Column) -> Column:
    """Strictly inside: odd crossings and not on the border."""
    return (crossings(x, y, ring) % 2 == 1) & ~on_ring(x, y, ring)


def hexagon(x: Column, y: Column, low: tuple[float, float], high: tuple[float, float], size: int) -> Column:
    """``hx, hy``: centre of the hexagon of a grid with ``size`` columns: the nearer centre of two shifted lattices."""
    rows = int(size / math.sqrt(3))
    wide, tall = (high[0] - low[0]) / size or 1.0, (high[1] - low[1]) / rows or 1.0
    u, v = (x - low[0]) / wide, (y - low[1]) / tall
    a = (F.floor(u + 0.5).cast("double"), F.floor(v + 0.5).cast("double"))
    b = (F.floor(u) + 0.5, F.floor(v) + 0.5)
    near = lambda c: (u - c[0]) * (u - c[0]) + 3.0 * (v - c[1]) * (v - c[1])
    first = near(a) < near(b)
    pick = lambda k: F.when(first, a[k]).otherwise(b[k])
    return F.struct((pick(0) * wide + low[0]).alias("hx"), (pick(1) * tall + low[1]).alias("hy"))


# Lambert conformal conic of EPSG:6372 on the GRS 80 ellipsoid (parallels, origin, offset, axis, flattening).
LCC = {"lat1": 17.5, "lat2": 29.5, "lat0": 12.0, "lon0": -102.0, "x0": 2_500_000.0, "y0": 0.0, "a": 6_378_137.0, "f": 1 / 298.257222101}


def project_lcc(lon: Column, lat: Column, p: dict[str, float] = LCC) -> Column:
    """``x, y`` in metres of longitude and latitude in degrees, in closed form."""
    e = math.sqrt(2 * p["f"] - p["f"] ** 2)
    m = lambda a: math.cos(a) / math.sqrt(1 - e * e * math.sin(a) ** 2)
    t = lambda a: math.tan(math.pi / 4 - a / 2) / ((1 - e * math.sin(a)) / (1 + e * math.sin(a))) ** (e / 2)
    a1, a2, a0 = (math.radians(p[k]) for k in ("lat1", "lat2", "lat0"))
    n = (math.log(m(a1)) - math.log(m(a2))) / (math.log(t(a1)) - math.log(t(a2)))
    scale = m(a1) / (n * t(a1) ** n) * p["a"]
    phi = F.radians(lat)
    sin = e * F.sin(phi)
    tt = F.tan(F.lit(math.pi / 4) - phi / 2) / F.pow((1 - sin) / (1 + sin), F.lit(e / 2))
    r, theta = scale * F.pow(tt, F.lit(n)), n * F.radians(lon - p["lon0"])
    return F.struct((p["x0"] + r * F.sin(theta)).alias("x"), (p["y0"] + scale * t(a0) ** n - r * F.cos(theta)).alias("y"))


def project_utm(lon: Column, lat: Column, zone: int = 14, a: float = LCC["a"], f: float = LCC["f"]) -> Column:
    """``x, y`` in metres of a northern transverse Mercator zone, by the series in the third flattening."""
    n = f / (2 - f)
    series = [n / 2 - 2 * n**2 / 3 + 5 * n**3 / 16, 13 * n**2 / 48 - 3 * n**3 / 5, 61 * n**3 / 240]
    scale, c = 0.9996 * a / (1 + n) * (1 + n**2 / 4 + n**4 / 64), 2 * math.sqrt(n) / (1 + n)
    sin, side = F.sin(F.radians(lat)), F.radians(lon - (6 * zone - 183))
    t = F.sinh(F.atanh(sin) - c * F.atanh(c * sin))
    north, east = F.atan2(t, F.cos(side)), F.atanh(F.sin(side) / F.sqrt(1 + t * t))
    x, y = east, north
    for k, alpha in enumerate(series, 1):
        x = x + alpha * F.cos(2 * k * north) * F.sinh(2 * k * east)
        y = y + alpha * F.sin(2 * k * north) * F.cosh(2 * k * east)
    return F.struct((F.lit(500_000.0) + scale * x).alias("x"), (scale * y).alias("y"))


#: Metric projections in the order of preference.
PROJECTIONS = {"EPSG:6372": project_lcc, "EPSG:32614": project_utm}


def choose_projection(spark: SparkSession, lon: float = -98.2, lat: float = 19.1, candidates: dict[str, Callable[[Column, Column], Column]] | None = None) -> str:
    """The first projection that gives a probe point finite coordinates."""
    candidates = candidates or PROJECTIONS
    at = spark.range(1).select(*(p(F.lit(lon), F.lit(lat)).alias(name) for name, p in candidates.items())).first()
    for name, point in zip(candidates, at, strict=True):
        if point is not None and point["x"] is not None and math.isfinite(point["x"]):
            return name
    raise ValueError(f"none of {', '.join(candidates)} gives finite coordinates at {lon}, {lat}")


def unproject_lcc(x: Column, y: Column, p: dict[str, float] = LCC) -> Column:
    """``lon, lat`` in degrees of metres: the inverse of ``project_lcc``; the latitude settles in six rounds."""
    e = math.sqrt(2 * p["f"] - p["f"] ** 2)
    m = lambda a: math.cos(a) / math.sqrt(1 - e * e * math.sin(a) ** 2)
    t = lambda a: math.tan(math.pi / 4 - a / 2) / ((1 - e * math.sin(a)) / (1 + e * math.sin(a))) ** (e / 2)
    a1, a2, a0 = (math.radians(p[k]) for k in ("lat1", "lat2", "lat0"))
    n = (math.log(m(a1)) - math.log(m(a2))) / (math.log(t(a1)) - math.log(t(a2)))
    scale = m(a1) / (n * t(a1) ** n) * p["a"]
    dx, dy = x - p["x0"], F.lit(p["y0"] + scale * t(a0) ** n) - y
    tt = F.pow(F.sqrt(dx * dx + dy * dy) / scale, F.lit(1 / n))
    # Each round needs the one before twice, so the rounds are a fold instead of one ever larger expression.
    step = lambda phi, _: F.lit(math.pi / 2) - 2 * F.atan(tt * F.pow((1 - e * F.sin(phi)) / (1 + e * F.sin(phi)), F.lit(e / 2)))
    phi = F.aggregate(F.sequence(F.lit(1), F.lit(6)), F.lit(math.pi / 2) - 2 * F.atan(tt), step)
    return F.struct((F.degrees(F.atan2(dx, dy) / n) + p["lon0"]).alias("lon"), F.degrees(phi).alias("lat"))


def repaired(geometry: Column) -> Column:
    """A geometry without missing or repeated vertices, with closed rings; null if nothing of it is left.

    A line needs two vertices, a ring four with its last, which is its first.
    """
    area, line = geometry["type"].contains("Polygon"), geometry["type"].contains("Line")
    whole = lambda part: F.filter(part, lambda v: v.isNotNull() & v.x.isNotNull() & v.y.isNotNull() & ~F.isnan(v.x) & ~F.isnan(v.y))
    once = lambda part: F.filter(part, lambda v, k: (k == 0) | (v != F.get(part, k - 1)))
    closed = lambda part: F.when(area & (F.size(part) > 0) & (F.get(part, F.lit(0)) != F.element_at(part, -1)), F.concat(part, F.slice(part, 1, 1))).otherwise(part)
    parts = F.transform(F.transform(F.transform(F.filter(geometry["parts"], lambda p: p.isNotNull()), whole), once), closed)
    parts = F.filter(parts, lambda part: F.size(part) >= F.when(area, 4).when(line, 2).otherwise(1))
    return F.when(F.size(parts) > 0, F.struct(geometry["type"].alias("type"), parts.alias("parts")))


def ring_area(ring: Column) -> Column:
    """Signed area of a closed ring, positive if it runs counter-clockwise; taken from its first vertex, so large coordinates don't blur it."""
    first = F.get(ring, F.lit(0))
    pairs = F.zip_with(F.slice(ring, F.lit(1), F.greatest(F.size(ring) - 1, F.lit(0))), F.slice(ring, F.lit(2), F.greatest(F.size(ring) - 1, F.lit(0))), lambda a, b: (a.x - first.x) * (b.y - first.y) - (b.x - first.x) * (a.y - first.y))
    return F.aggregate(pairs, F.lit(0.0), lambda total, v: total + v) / 2


def polygons(geometry: Column) -> Column:
    """Polygons of a geometry, each an array of rings, its shell first; null for others than polygons.

    The rings of several polygons lie in one array, each shell before its holes; rings that turn the other way than the first one are holes.
    """
    parts = geometry["parts"]
    turned = F.transform(parts, lambda ring: F.struct(ring_area(ring).alias("area"), ring.alias("ring")))
    empty = F.slice(F.array(parts), 1, 0)

    def grouped(rings: Column) -> Column:
        first = F.get(rings, F.lit(0)).area
        add = lambda found, r: F.when(r.area * first >= 0, F.concat(found, F.array(F.array(r.ring)))).otherwise(F.concat(F.slice(found, F.lit(1), F.size(found) - 1), F.array(F.concat(F.element_at(found, -1), F.array(r.ring)))))
        return F.aggregate(rings, empty, add)

    return F.when(geometry["type"] == "Polygon", F.array(parts)).when(geometry["type"] == "MultiPolygon", F.get(F.transform(F.array(turned), grouped), F.lit(0)))


def edges(geometry: Column) -> Column:
    """``x1, y1, x2, y2`` of the edges of all parts."""
    pairs = lambda part: F.transform(F.slice(part, F.lit(2), F.greatest(F.size(part) - 1, F.lit(0))), lambda v, k: F.struct(F.get(part, k).x.alias("x1"), F.get(part, k).y.alias("y1"), v.x.alias("x2"), v.y.alias("y2")))
    return F.flatten(F.transform(geometry["parts"], pairs))


def box(geometry: Column) -> Column:
    """``minx, miny, maxx, maxy``; null without vertices."""
    vertices = F.flatten(geometry["parts"])
    xs, ys = F.transform(vertices, lambda v: v.x), F.transform(vertices, lambda v: v.y)
    return F.struct(F.array_min(xs).alias("minx"), F.array_min(ys).alias("miny"), F.array_max(xs).alias("maxx"), F.array_max(ys).alias("maxy"))


def geojson(geometry: Column, *properties: Column) -> Column:
    """A feature of any geometry; polygons keep their holes."""
    place = lambda part: F.transform(part, lambda v: F.array(v.x, v.y))
    parts = F.transform(geometry["parts"], place)
    shape = (
        F.when(geometry["type"] == "Point", F.to_json(F.get(F.get(parts, F.lit(0)), F.lit(0))))
        .when(geometry["type"].isin("LineString", "MultiPoint"), F.to_json(F.get(parts, F.lit(0))))
        .when(geometry["type"] == "MultiPolygon", F.to_json(F.transform(polygons(geometry), lambda rings: F.transform(rings, place))))
        .otherwise(F.to_json(parts))
    )
    return F.concat(
        F.lit('{"type":"Feature","properties":'), F.to_json(F.struct(*properties), {"ignoreNullFields": "false"}),
        F.lit(',"geometry":{"type":"'), geometry["type"], F.lit('","coordinates":'), shape, F.lit("}}"),
    )


def geojson_point(lon: Column, lat: Column, *properties: Column) -> Column:
    return F.to_json(
        F.struct(F.lit("Feature").alias("type"), F.struct(*properties).alias("properties"), F.struct(F.lit("Point").alias("type"), F.array(lon, lat).alias("coordinates")).alias("geometry")),
        {"ignoreNullFields": "false"},
    )
