"""Maps of any number of features: a pyramid of tiles that tasks clip, simplify and write.

Tiles are those of the web Mercator grid: tile (z, x, y) is a rectangle of longitudes and latitudes.  A tile of at most
``most`` pieces is a leaf and holds them whole; one with more is an overview, in which pieces smaller than a cell (one of 64 x 64)
are merged into points with their number, and larger ones are simplified; its pieces go on, clipped, to its four quarters.
So every feature is in leaves, whatever their depth, and no tile of many small features grows with the table.

Points are never clipped, so they don't descend: they are counted once in cells of the deepest level, the levels are worked
out from these counts, and a point is joined to the level of its leaf.  For lines and areas each level is a Spark job over
the pieces of overviews.  Nothing is collected.
"""

from __future__ import annotations

import json
from collections.abc import Iterable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from basinsift.functions import geo
from basinsift.operators.borders import thinned
from basinsift.operators.shared import join_spread, map_lists, materialize
from basinsift.sources import sinks, vector

#: Pieces of a leaf, cells of an overview along each axis, and the level that is not split any more.
MOST, CELLS, DEEPEST = 2000, 64, 22
#: Tile files are scripts, so that a page opened from a disk may load them.
_FILE = "{z}/{x}/{y}.js"
_LIMIT = 85.0511287798066
#: Share of a tile by which lines and areas reach beyond its sides, so that rounding loses none that runs along one.
_MARGIN = 1e-6
_BROADCAST_TILES = 100_000

Part = list[tuple[float, float]]


def tile_x(lon: str, level: str) -> str:
    """SQL of the place along x, in tiles of a level."""
    return f"(({lon} + 180D) / 360D * pow(2D, {level}))"


def tile_y(lat: str, level: str) -> str:
    return f"((1D - asinh(tan(radians(greatest(-{_LIMIT}D, least({_LIMIT}D, {lat}))))) / pi()) / 2D * pow(2D, {level}))"


def bounds(z: int, x: int, y: int) -> tuple[float, float, float, float]:
    """West, south, east, north of a tile, with a margin; the outer ones reach the poles."""
    n, x0, y0, x1, y1 = 2**z, x - _MARGIN, y - _MARGIN, x + 1 + _MARGIN, y + 1 + _MARGIN
    lat = lambda v: 90.0 if v <= 0 else -90.0 if v >= n else float(np.degrees(np.arctan(np.sinh(np.pi * (1 - 2 * v / n)))))
    return x0 / n * 360 - 180, lat(y1), x1 / n * 360 - 180, lat(y0)


def clip_line(line: Part, box: tuple[float, float, float, float]) -> list[Part]:
    """Pieces of a line inside of a box."""
    out: list[Part] = []
    for (ax, ay), (bx, by) in zip(line, line[1:], strict=False):
        low, high, dx, dy = 0.0, 1.0, bx - ax, by - ay
        for p, q in ((-dx, ax - box[0]), (dx, box[2] - ax), (-dy, ay - box[1]), (dy, box[3] - ay)):
            if p == 0:
                low = 2.0 if q < 0 else low
            elif p < 0:
                low = max(low, q / p)
            else:
                high = min(high, q / p)
        if low > high:
            continue
        a = (ax, ay) if low == 0 else (ax + low * dx, ay + low * dy)
        b = (bx, by) if high == 1 else (ax + high * dx, ay + high * dy)
        if out and out[-1][-1] == a and low == 0:
            out[-1].append(b)
        else:
            out.append([a, b])
    return out


def clip_ring(ring: Part, box: tuple[float, float, float, float]) -> Part:
    """A closed ring cut at the sides of a box, one after the other; empty outside."""
    part = ring[:-1]
    for axis, edge, sign in ((0, box[0], 1), (0, box[2], -1), (1, box[1], 1), (1, box[3], -1)):
        out: Part = []
        for a, b in zip([part[-1], *part[:-1]] if part else [], part, strict=True):
            a_in, b_in = (a[axis] - edge) * sign >= 0, (b[axis] - edge) * sign >= 0
            if a_in != b_in:
                t = (edge - a[axis]) / (b[axis] - a[axis])
                cut = [a[0] + t * (b[0] - a[0]), a[1] + t * (b[1] - a[1])]
                cut[axis] = edge
                out.append((cut[0], cut[1]))
            if b_in:
                out.append(b)
        part = out
    return [*part, part[0]] if len(part) > 2 else []


def _clipped(kind: str, parts: list[Part], box: tuple) -> list[Part]:
    if "Polygon" in kind:
        return [c for c in (clip_ring(p, box) for p in parts) if c]
    if "Line" in kind:
        return [c for p in parts for c in clip_line(p, box)]
    return parts  # a point is in the tile that its place gives


def _read(parts: Iterable) -> list[Part]:
    return [[(v["x"], v["y"]) for v in part] for part in parts]


def _write(parts: list[Part]) -> list[list[dict[str, float]]]:
    return [[{"x": x, "y": y} for x, y in part] for part in parts]


def _clip(rows: dict[str, list]) -> dict[str, list]:
    """Pieces in their tiles; what a box meets and the geometry doesn't is left out."""
    cut = [_clipped(kind, _read(parts), bounds(z, x, y)) for kind, parts, z, x, y in zip(*(rows[c] for c in ("kind", "parts", "z", "x", "y")), strict=True)]
    kept = [k for k, parts in enumerate(cut) if parts]
    return {c: [v[k] for k in kept] for c, v in rows.items()} | {"parts": [_write(cut[k]) for k in kept]}


def _simplify(rows: dict[str, list]) -> dict[str, list]:
    """Lines and rings with the vertices that an overview shows."""
    shapes = []
    for kind, parts, z in zip(rows["kind"], rows["parts"], rows["z"], strict=True):
        if kind != "Point":
            lines = [np.array(p) for p in _read(parts)]
            parts = _write([[tuple(v) for v in line[thinned(line, 360 / 2**z / 1024)].tolist()] for line in lines])
        shapes.append(parts)
    return rows | {"parts": shapes}


def pyramid(features: DataFrame, most: int = MOST, deepest: int = DEEPEST) -> DataFrame:
    """``z, x, y, leaf, n, feature``: the GeoJSON features of each tile and the number of features that each stands for.

    Input: ``geometry`` in degrees and any other columns, which are the properties.  Null and empty geometries are in no tile;
    the points of several are pieces of their own.
    """
    properties = [F.col(c) for c in features.columns if c != "geometry"]
    shape = F.col("geometry")
    rows = features.withColumn("properties", F.to_json(F.struct(*properties), {"ignoreNullFields": "false"}) if properties else F.lit("{}"))
    rows = rows.filter(F.size(F.flatten(shape["parts"])) > 0)
    points = F.transform(shape["parts"], lambda part: F.array(part))  # each point is a piece
    each = F.when(shape["type"].contains("Point"), points).otherwise(F.array(shape["parts"]))
    pieces = rows.select("properties", F.when(shape["type"].contains("Point"), "Point").otherwise(shape["type"]).alias("kind"), F.explode(each).alias("parts"), F.lit(0).alias("z"), F.lit(0).cast("long").alias("x"), F.lit(0).cast("long").alias("y"))
    # Where a point's cell is on the deepest level; coordinates beyond the grid descend like lines.
    fine = deepest + CELLS.bit_length() - 1
    vertex = F.get(F.get("parts", F.lit(0)), F.lit(0))
    single = (F.col("kind") == "Point") & (F.size("parts") == 1) & (F.size(F.get("parts", F.lit(0))) == 1)
    on_grid = single & F.expr(f"{tile_x('spot.x', '0')} >= 0D AND {tile_x('spot.x', '0')} < 1D AND {tile_y('spot.y', '0')} >= 0D AND {tile_y('spot.y', '0')} < 1D")
    placed = {c: F.when(on_grid, F.expr(f"floor({of})")) for c, of in (("cx", tile_x("spot.x", str(fine))), ("cy", tile_y("spot.y", str(fine))))}
    every = materialize(pieces.withColumn("spot", vertex).withColumns(placed), "pieces")
    points, pieces = every.filter("cx IS NOT NULL"), every.filter("cx IS NULL").select(pieces.columns)
    cells = materialize(points.groupBy("cx", "cy").agg(F.count("*").alias("n"), F.min(F.struct("spot.x", "spot.y")).alias("spot")), "cells")
    n_cells, no_pieces = cells.count(), pieces.isEmpty()
    out: list[DataFrame] = []
    settled: list[DataFrame] = []  # cells and the level of their leaf
    for level in range(deepest + 1):
        tile = {"x": F.shiftright("cx", fine - level), "y": F.shiftright("cy", fine - level)}
        if level:
            up = {"x": F.shiftright("cx", fine - level + 1), "y": F.shiftright("cy", fine - level + 1)}
            spots = cells.withColumns(up).join(tiles, ["x", "y"], "left_semi").withColumns(tile)
        else:
            spots = cells.withColumns(tile)
        counts = spots.groupBy("x", "y").agg(F.sum("n").alias("n"))
        if not no_pieces:
            pieces = materialize(map_lists(pieces, _clip, pieces.schema), "pieces")
            counts = counts.unionByName(pieces.groupBy("x", "y").agg(F.count("*").alias("n"))).groupBy("x", "y").agg(F.sum("n").alias("n"))
        crowded = counts.filter(F.col("n") > (most if level < deepest else F.lit(2**62))).select("x", "y")
        crowded = materialize(crowded, "crowded")
        n_crowded = crowded.count()
        tiles = F.broadcast(crowded) if n_crowded <= _BROADCAST_TILES else crowded
        settled.append((spots.join(tiles, ["x", "y"], "left_anti") if n_crowded else spots).select("cx", "cy", F.lit(level).alias("__z")))
        if not no_pieces:
            leaf = pieces.join(tiles, ["x", "y"], "left_anti") if n_crowded else pieces
            out.append(leaf.select("z", "x", "y", F.lit(True).alias("leaf"), F.lit(1).cast("long").alias("n"), "kind", "parts", "properties"))
        if not n_crowded:
            break
        small = spots.join(tiles, ["x", "y"], "left_semi").withColumns({c: F.shiftright(c, deepest - level) for c in ("cx", "cy")})
        small = small.select(F.lit(level).alias("z"), "x", "y", "cx", "cy", "n", "spot")
        if not no_pieces:
            inner = materialize(pieces.join(tiles, ["x", "y"], "left_semi").select(pieces.columns), "inner")
            boxed = inner.withColumn("box", geo.box(F.struct(F.col("kind").alias("type"), F.col("parts").alias("parts"))))
            cell = [F.expr(f"floor({of} * {CELLS})") for of in (tile_x("box.minx", "z"), tile_x("box.maxx", "z"), tile_y("box.maxy", "z"), tile_y("box.miny", "z"))]
            boxed = boxed.withColumns({"cx": cell[0], "cy": cell[2], "small": (cell[0] == cell[1]) & (cell[2] == cell[3])})
            small = small.unionByName(boxed.filter("small").select("z", "x", "y", "cx", "cy", F.lit(1).cast("long").alias("n"), F.struct(vertex["x"].alias("x"), vertex["y"].alias("y")).alias("spot")))
        merged = small.groupBy("z", "x", "y", "cx", "cy").agg(F.sum("n").alias("n"), F.min("spot").alias("spot"))
        merged = merged.select("z", "x", "y", F.lit(False).alias("leaf"), "n", F.lit("Point").alias("kind"), F.array(F.array("spot")).alias("parts"), F.to_json(F.struct("n")).alias("properties"))
        out.append(merged)
        if no_pieces:
            continue
        large = map_lists(boxed.filter("NOT small").select(pieces.columns), _simplify, pieces.schema)
        out.append(large.select("z", "x", "y", F.lit(False).alias("leaf"), F.lit(1).cast("long").alias("n"), "kind", "parts", "properties"))
        # Quarters that the piece's box meets.
        axis = lambda low, high, own: f"sequence(greatest(2 * {own}, floor({low})), least(2 * {own} + 1, floor({high})))"
        xs, ys = axis(tile_x("box.minx", "z + 1"), tile_x("box.maxx", "z + 1"), "x"), axis(tile_y("box.maxy", "z + 1"), tile_y("box.miny", "z + 1"), "y")
        inside = f"greatest(2 * x, floor({tile_x('box.minx', 'z + 1')})) <= 2 * x + 1 AND least(2 * x + 1, floor({tile_x('box.maxx', 'z + 1')})) >= 2 * x AND greatest(2 * y, floor({tile_y('box.maxy', 'z + 1')})) <= 2 * y + 1 AND least(2 * y + 1, floor({tile_y('box.miny', 'z + 1')})) >= 2 * y"
        quarters = F.expr(f"if({inside}, flatten(transform({xs}, i -> transform({ys}, j -> struct(i, j)))), array(struct(2 * x AS i, 2 * y AS j)))")
        pieces = boxed.select("properties", "kind", "parts", (F.col("z") + 1).alias("z"), F.inline(quarters)).select("properties", "kind", "parts", "z", F.col("i").alias("x"), F.col("j").alias("y"))
    level_of = materialize(reduce(DataFrame.unionByName, settled), "levels")
    leaf = points.join(F.broadcast(level_of), ["cx", "cy"]) if n_cells <= _BROADCAST_TILES else join_spread(points, level_of, ["cx", "cy"], "inner")
    leaf = leaf.select(F.col("__z").alias("z"), F.expr(f"shiftright(cx, {fine} - __z)").alias("x"), F.expr(f"shiftright(cy, {fine} - __z)").alias("y"), F.lit(True).alias("leaf"), F.lit(1).cast("long").alias("n"), "kind", "parts", "properties")
    tiles = reduce(DataFrame.unionByName, [leaf, *out])
    # A clipped line or polygon may have come apart.
    kind = F.when(F.col("kind").contains("Polygon"), "MultiPolygon").when(F.col("kind").contains("Line"), "MultiLineString").otherwise("Point")
    whole = F.struct(kind.alias("type"), F.col("parts").alias("parts"))
    places = F.transform("parts", lambda part: F.transform(part, lambda v: F.array(v.x, v.y)))
    spots = F.transform("parts", lambda part: F.array(F.get(part, F.lit(0)).x, F.get(part, F.lit(0)).y))
    coordinates = (
        F.when(kind == "MultiPolygon", F.to_json(F.transform(geo.polygons(whole), lambda rings: F.transform(rings, lambda part: F.transform(part, lambda v: F.array(v.x, v.y))))))
        .when(kind == "MultiLineString", F.to_json(places)).otherwise(F.to_json(F.get(spots, F.lit(0))))
    )
    feature = F.concat(F.lit('{"type":"Feature","properties":'), F.col("properties"), F.lit(',"geometry":{"type":"'), kind, F.lit('","coordinates":'), coordinates, F.lit("}}"))
    return tiles.select("z", "x", "y", "leaf", "n", feature.alias("feature"))


def _open_output(path: str) -> pa.NativeFile:
    if vector.is_local(path):
        system, inner = pafs.LocalFileSystem(), vector._local(path)
    else:
        system, inner = pafs.FileSystem.from_uri(path)
    system.create_dir(inner.rpartition("/")[0], recursive=True)
    return system.open_output_stream(inner)


def write(tiles: DataFrame, path: str) -> DataFrame:
    """Writes a file for each tile, by tasks; returns ``z, x, y, leaf, items, n`` of the tiles."""
    if not vector.reachable(path):
        raise ValueError(f"tasks can't write to {path}")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done: list[tuple] = []
        here, file = None, None

        def close() -> None:
            if file is not None:
                file.write(b"]);\n")
                file.close()
                done.append((*here, items, total))

        for batch in batches:
            for z, x, y, leaf, n, feature in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if here != (z, x, y, leaf):
                    close()
                    here, items, total = (z, x, y, leaf), 0, 0
                    file = _open_output(f"{path}/{_FILE.format(z=z, x=x, y=y)}")
                    file.write(f'tile("{z}/{x}/{y}", {json.dumps(leaf)}, ['.encode())
                file.write(("," if items else "").encode() + feature.replace("</", "<\\/").encode())
                items, total = items + 1, total + n
        close()
        columns = list(zip(*done, strict=True)) or [[]] * 6
        kinds = [pa.int32(), pa.int64(), pa.int64(), pa.bool_(), pa.int64(), pa.int64()]
        yield pa.record_batch([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], ["z", "x", "y", "leaf", "items", "n"])

    dealt = tiles.select("z", "x", "y", "leaf", "n", "feature").repartition("z", "x", "y").sortWithinPartitions("z", "x", "y")
    return materialize(dealt.mapInArrow(run, "z int, x long, y long, leaf boolean, items long, n long"), "tiles")


#: Loads tiles from the first one on, down to leaves or to what the view shows, and draws them.
_VIEW = """
const canvas = document.getElementById('map'), pen = canvas.getContext('2d'), known = {}, waiting = {};
const merc = lat => (1 - Math.asinh(Math.tan(Math.max(-85.05, Math.min(85.05, lat)) * Math.PI / 180)) / Math.PI) / 2;
let view = {x: 0.5, y: 0.5, scale: canvas.width};
const at = c => [((c[0] + 180) / 360 - view.x) * view.scale + canvas.width / 2, (merc(c[1]) - view.y) * view.scale + canvas.height / 2];
function tile(name, leaf, features) { known[name] = {leaf, features}; draw(); }
function load(name) { if (waiting[name]) return; waiting[name] = true; const s = document.createElement('script'); s.src = name + '.js'; s.onerror = () => { known[name] = {leaf: true, features: []}; }; document.head.appendChild(s); }
const lines = {LineString: c => [c], MultiLineString: c => c, Polygon: c => c, MultiPolygon: c => c.flat()};
function put(f) { const g = f.geometry, p = f.properties || {}; pen.fillStyle = pen.strokeStyle = p.color || '#2b8cbe';
  if (g.type === 'Point') { pen.beginPath(); pen.arc(...at(g.coordinates), Math.min(12, 2 + Math.log2(p.n || 1)), 0, 7); pen.fill(); return; }
  pen.beginPath(); lines[g.type](g.coordinates).forEach(l => l.forEach((c, k) => k ? pen.lineTo(...at(c)) : pen.moveTo(...at(c))));
  if (g.type.endsWith('Polygon')) { pen.globalAlpha = 0.3; pen.fill('evenodd'); pen.globalAlpha = 1; } pen.stroke(); }
function show(z, x, y) { const size = view.scale / 2 ** z, left = (x / 2 ** z - view.x) * view.scale + canvas.width / 2, top = (y / 2 ** z - view.y) * view.scale + canvas.height / 2;
  if (left > canvas.width || top > canvas.height || left + size < 0 || top + size < 0) return;
  const name = z + '/' + x + '/' + y, t = known[name]; if (!t) { load(name); return; }
  if (t.leaf || size < 700) { t.features.forEach(put); return; }
  for (const i of [0, 1]) for (const j of [0, 1]) show(z + 1, 2 * x + i, 2 * y + j); }
function draw() { pen.clearRect(0, 0, canvas.width, canvas.height); show(0, 0, 0); }
canvas.onwheel = e => { e.preventDefault(); view.scale *= e.deltaY < 0 ? 1.5 : 1 / 1.5; draw(); };
canvas.onmousemove = e => { if (e.buttons) { view.x -= e.movementX / view.scale; view.y -= e.movementY / view.scale; draw(); } };
draw();
"""


def write_map(spark: SparkSession, features: DataFrame, path: str, title: str, center: tuple[float, float] | None = None, most: int = MOST, deepest: int = DEEPEST) -> DataFrame:
    """A folder with tiles and the page that shows them; a frame without features gives a placeholder page.  Returns the tiles."""
    done = write(pyramid(features, most, deepest), path)
    start = "" if center is None else f"view = {{x: {(center[0] + 180) / 360}, y: merc({center[1]}), scale: 8 * canvas.width}};"
    body = "<p>Sin registros</p>" if done.isEmpty() else f'<canvas id="map" width="940" height="940"></canvas><script>{_VIEW.replace("draw();\n", start + "draw();\n") if start else _VIEW}</script>'
    name = sinks.escape(title)
    sinks.write_text(spark, f"{path}/index.html", f'<!DOCTYPE html><html><head><meta charset="utf-8"><title>{name}</title></head><body><h1>{name}</h1>{body}</body></html>')
    return done
