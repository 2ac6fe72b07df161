"""Spatial joins without a spatial index: grid cells turn them into equi-joins."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterable, Iterator
from functools import reduce
from operator import and_

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from basinsift.functions import geo, rings
from basinsift.operators import borders, cover
from basinsift.operators.shared import SPREAD_ROWS, dealt, fresh, join_spread, materialize


#: Cells of one level that meet in a cell of the next, along each axis, and cells of the top level.
FANOUT, TOP_CELLS = 4, 64
#: Half a diagonal of a unit square, rounded up.
HALF = 0.7072
#: Pairs of places and segments that need no finer cells; work of laying a segment in a cell and of a place's descent, in pairs.
FEW_PAIRS, LAID, DESCENT = 2**24, 20, 500


def _cells(low_x: Column, low_y: Column, high_x: Column, high_y: Column, size: float) -> Column:
    along = lambda a, b: F.sequence(F.floor(a / size), F.floor(b / size))
    return F.flatten(F.transform(along(low_x, high_x), lambda i: F.transform(along(low_y, high_y), lambda j: F.struct(i.alias("i"), j.alias("j")))))


def _cells_along(x1: Column, y1: Column, x2: Column, y2: Column, size: float) -> Column:
    """Cells that a segment runs through: column by column, those between its ends in the column."""
    low, high, slope = F.least(x1, x2), F.greatest(x1, x2), (y2 - y1) / F.nullif(x2 - x1, F.lit(0.0))

    def rows(i: Column) -> Column:
        at = lambda x: F.coalesce(y1 + (x - x1) * slope, y1)
        a, b = at(F.greatest(low, i * size)), at(F.least(high, (i + 1) * size))
        upright = slope.isNull()
        bottom, top = F.when(upright, F.least(y1, y2)).otherwise(F.least(a, b)), F.when(upright, F.greatest(y1, y2)).otherwise(F.greatest(a, b))
        return F.transform(F.sequence(F.floor(bottom / size), F.floor(top / size)), lambda j: F.struct(i.alias("i"), j.alias("j")))

    return F.flatten(F.transform(F.sequence(F.floor(low / size), F.floor(high / size)), rows))


def nearest_distance(points: DataFrame, segments: DataFrame, id_col: str, cell: float, extent: float) -> DataFrame:
    """``id, distance`` of each point (``x, y``) to the nearest segment (``x1, y1, x2, y2``), exact.

    A row for each point; the distance is null for points without coordinates, and without segments.
    Equal segments count once, and the cells are halved where segments are dense.  Places meet the segments of their cell and
    its neighbours, in a quadtree whose cells hold a bounded number of places; a distance up to the cell's size is final.  The
    others descend through levels of occupied cells, keeping those that may hold the nearest segment.
    """
    ends = [F.col(c) for c in ("x1", "y1", "x2", "y2")]
    known = lambda *columns: reduce(and_, (c.isNotNull() & ~F.isnan(c) for c in columns))
    lines = materialize(segments.filter(known(*ends)).select("x1", "y1", "x2", "y2").distinct(), "lines")
    places = points.select(F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y")).filter(known(F.col("x"), F.col("y"))).distinct()
    places = materialize(places, "places")
    cell = _halved(places, lines, cell)
    laid = materialize(lines.select("x1", "y1", "x2", "y2", F.inline(_cells_along(*ends, cell))), "laid")
    split = cover.splits(places, cell)
    distance = F.min(geo.segment_distance(F.col("x"), F.col("y"), *ends)).alias("distance")
    beside = F.expr("flatten(transform(sequence(i - 1, i + 1), i -> transform(sequence(j - 1, j + 1), j -> struct(i, j))))")
    around = cover.leaves(places, cell, split).select("x", "y", "level", F.inline(beside))
    met = around.join(_laid_finer(laid, cell, split), ["level", "i", "j"], "left")
    size = cell / F.pow(F.lit(2.0), F.min("level"))  # a place has one level
    best = materialize(met.groupBy("x", "y").agg(distance, size.alias("size")), "near")
    final = F.col("distance").isNotNull() & (F.col("distance") <= F.col("size"))
    far = best.filter(~final).select("x", "y")
    n_far = far.count()
    found = best.select("x", "y", "distance") if not n_far else best.filter(final).select("x", "y", "distance").unionByName(_descend(far, laid, distance, cell, extent, n_far > SPREAD_ROWS))
    placed = points.select(id_col, F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y"))
    return join_spread(placed, found, ["x", "y"]).select(id_col, "distance")


def _halved(places: DataFrame, lines: DataFrame, cell: float) -> float:
    """The cell size at which the work is least, counted at one size after the other: pairs that meet, laid segments, places to descend."""
    if 9 * places.count() * lines.count() <= FEW_PAIRS:
        return cell
    ends, best = [F.col(c) for c in ("x1", "y1", "x2", "y2")], math.inf
    for halvings in range(cover.DEEPEST):
        size = cell / 2**halvings
        laid = lines.select(F.inline(_cells_along(*ends, size))).groupBy("i", "j").agg(F.count("*").cast("double").alias("s"))
        spots = places.groupBy(F.floor(F.col("x") / size).alias("i"), F.floor(F.col("y") / size).alias("j")).agg(F.count("*").cast("double").alias("p"))
        work = F.coalesce(F.sum(9 * F.col("p") * F.col("s")), F.lit(0.0)) + LAID * F.coalesce(F.sum("s"), F.lit(0.0)) + DESCENT * F.coalesce(F.sum(F.when(F.col("s").isNull(), F.col("p"))), F.lit(0.0))
        now = spots.join(laid, ["i", "j"], "full").agg(work).first()[0]
        if now > 0.8 * best:
            return 2 * size
        best = now
    return size


def _laid_finer(laid: DataFrame, cell: float, split: list[DataFrame]) -> DataFrame:
    """Segments by ``level, i, j``: all of them in the first level's cells, and in the finer cells in and beside split ones."""
    out = last = laid.withColumn("level", F.lit(0))
    for level, hot in enumerate(split, 1):
        size = cell / 2**level
        near = hot.select(F.inline(F.expr("flatten(transform(sequence(i - 1, i + 1), i -> transform(sequence(j - 1, j + 1), j -> struct(i, j))))"))).distinct()
        fine = hot.select(F.inline(F.expr("flatten(transform(sequence(2 * i - 1, 2 * i + 2), i -> transform(sequence(2 * j - 1, 2 * j + 2), j -> struct(i, j))))"))).distinct()
        ends = [F.col(c) for c in ("x1", "y1", "x2", "y2")]
        own = last.join(F.broadcast(near), ["i", "j"], "left_semi").select(*ends).distinct()  # 9 cells for each split one
        last = own.select(*ends, F.inline(_cells_along(*ends, size))).join(F.broadcast(fine), ["i", "j"], "left_semi").withColumn("level", F.lit(level))
        out = out.unionByName(last)
    return out


def _reach(size: float) -> tuple[Callable[[Column], Column], Callable[[Column], Column]]:
    """How far from ``x, y`` a cell's contents are at most, seen from its centre, and at least."""

    def off(c: Column) -> list[Column]:
        return [F.abs(F.col("x") - (c.i + 0.5) * size), F.abs(F.col("y") - (c.j + 0.5) * size)]

    return lambda c: F.hypot(*off(c)) + HALF * size, lambda c: F.hypot(*(F.greatest(x - size / 2, F.lit(0.0)) for x in off(c)))


def _descend(places: DataFrame, laid: DataFrame, distance: Column, cell: float, extent: float, spread: bool = False) -> DataFrame:
    """``x, y, distance``: each level keeps the cells that are no farther than the farthest corner of the best one.

    With ``spread``, for very many places, those that have a cell in common are dealt out to several tasks.
    """
    meet = (lambda left, right: join_spread(materialize(left, "descent"), right, ["i", "j"], "inner")) if spread else (lambda left, right: left.join(right, ["i", "j"]))
    grids, sizes = [laid.select("i", "j").distinct()], [cell]
    top = grids[0].limit(1).collect()
    while top and (sizes[-1] < extent or len(top := grids[-1].limit(TOP_CELLS + 1).collect()) > TOP_CELLS):
        grids.append(grids[-1].select(*(F.floor(F.col(c) / FANOUT).alias(c) for c in ("i", "j"))).distinct())
        sizes.append(sizes[-1] * FANOUT)
    if not top:
        return places.withColumn("distance", F.lit(None).cast("double"))
    slack = HALF * cell  # for rounding at the borders of cells
    rest = places.withColumn("cells", F.array(*(F.struct(F.lit(r["i"]).cast("long").alias("i"), F.lit(r["j"]).cast("long").alias("j")) for r in top)))
    for level in range(len(grids) - 1, -1, -1):
        size = sizes[level]
        inside, outside = _reach(size)
        rest = rest.withColumn("most", F.array_min(F.transform("cells", lambda c: inside(c))) + slack)
        rest = rest.select("x", "y", F.inline(F.filter("cells", lambda c: outside(c) - slack <= F.col("most"))))
        if level:
            up = [F.floor(F.col(c) / FANOUT).alias(n) for c, n in (("i", "pi"), ("j", "pj"))]
            below = grids[level - 1].select(*up, F.struct("i", "j").alias("cell")).groupBy(F.col("pi").alias("i"), F.col("pj").alias("j")).agg(F.collect_list("cell").alias("below"))
            rest = meet(rest, below).groupBy("x", "y").agg(F.flatten(F.collect_list("below")).alias("cells"))
    return meet(rest, laid).groupBy("x", "y").agg(distance)


def point_in_polygon(points: DataFrame, polygons: DataFrame, point_id: str, polygon_id: str, cell: float) -> DataFrame:
    """``point_id, polygon_id`` for every polygon that strictly holds the point; null for points in none.

    A polygon is a ``geometry`` with any number of parts and holes, or a ``ring``, a closed array of points.
    """
    if "geometry" not in polygons.columns:
        polygons = polygons.select(polygon_id, F.struct(F.lit("Polygon").alias("type"), F.array("ring").alias("parts")).alias("geometry"))
    return cover.points_in_shapes(points, polygons, point_id, polygon_id, cell)


def crop(df: DataFrame, x: str, y: str, bounds: tuple[float, float, float, float], pad: float) -> DataFrame:
    """Rows inside padded bounds; all rows if none is."""
    low_x, low_y, high_x, high_y = bounds
    kept = df.filter(F.col(x).between(low_x - pad, high_x + pad) & F.col(y).between(low_y - pad, high_y + pad))
    return df if kept.isEmpty() else kept


def _replaced(shapes: pa.Array, nested: pa.Array) -> pa.Array:
    """The shapes with those whose nested rings are given made valid; a valid one stays, one without any area has no parts."""
    fixed, take = [], list(range(len(shapes)))
    for k, polygons in enumerate(nested.to_pylist()):
        if polygons is not None:
            before = [[[(v["x"], v["y"]) for v in ring] for ring in polygon] for polygon in polygons]
            after = rings.make_valid(before)
            if after != before:
                take[k] = len(shapes) + len(fixed)
                parts = [[{"x": x, "y": y} for x, y in ring] for polygon in after for ring in polygon]
                fixed.append({"type": "Polygon" if len(after) == 1 else "MultiPolygon", "parts": parts})
    return pa.concat_arrays([shapes, pa.array(fixed, shapes.type)]).take(pa.array(take)) if fixed else shapes


def repair(df: DataFrame, column: str = "geometry") -> DataFrame:
    """Rows whose geometry holds something: repeated vertices gone, rings closed, and polygons valid.

    Polygons are made valid by ``rings.make_valid``, one feature at a time; single triangles, which are valid, and others than
    polygons are left to the native steps.  Features are small beside the work on them, so few input files may hold very many:
    they are dealt out to all tasks first.
    """
    shape = F.col(column)
    df = dealt(df).withColumn(column, geo.repaired(shape)).filter(shape.isNotNull())
    one = F.get(shape["parts"], F.lit(0))
    triangle = (F.size(shape["parts"]) == 1) & (F.size(one) <= 4) & (geo.ring_area(one) != 0)
    names, nested = df.columns, fresh(df.columns, "nested")
    at = names.index(column)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = batch.columns[:-1]
            columns[at] = _replaced(columns[at], batch.column(len(names)))
            yield pa.record_batch(columns, names)

    fixed = df.withColumn(nested, F.when(~triangle, geo.polygons(shape))).mapInArrow(run, df.schema)
    return fixed.filter(F.size(shape["parts"]) > 0)


def boundary_segments(df: DataFrame, column: str = "geometry") -> DataFrame:
    """The other columns with ``x1, y1, x2, y2`` of each edge of lines and polygon borders."""
    others = [c for c in df.columns if c != column]
    return df.select(*others, F.inline(geo.edges(F.col(column))))


def crop_geometries(df: DataFrame, column: str, bounds: tuple[float, float, float, float], pad: float = 0.0) -> DataFrame:
    """Whole geometries whose box meets the padded bounds; all of them if none does."""
    low_x, low_y, high_x, high_y = bounds
    box = geo.box(F.col(column))
    kept = df.filter((box["maxx"] >= low_x - pad) & (box["minx"] <= high_x + pad) & (box["maxy"] >= low_y - pad) & (box["miny"] <= high_y + pad))
    return df if kept.isEmpty() else kept


def simplified(part: np.ndarray, tolerance: float) -> np.ndarray:
    """Which vertices of a line stay so that none of the others is farther than the tolerance from what is left; a ring keeps four."""
    keep = borders.thinned(part, tolerance)
    if len(part) > 3 and (part[0] == part[-1]).all() and keep.sum() < 4:
        inner = np.flatnonzero(~keep)
        keep[inner[np.linspace(0, len(inner) - 1, 4 - int(keep.sum())).astype(int)]] = True
    return keep


def simplify(df: DataFrame, column: str, tolerance: float) -> DataFrame:
    """Lines and borders with the vertices that a tolerance (in metres) does not need left out, for display; points stay.

    Each part by itself, in one pass; ``borders.simplify`` also keeps rings from crossing and shared borders shared.
    """

    def run(frames: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            shapes = []
            for shape in frame[column]:
                if shape is not None:
                    parts = []
                    for part in shape["parts"]:
                        xy = np.array([(p["x"], p["y"]) for p in part], float).reshape(-1, 2)
                        parts.append([{"x": x, "y": y} for x, y in (xy[simplified(xy, tolerance)] if len(xy) > 2 else xy).tolist()])
                    shape = {"type": shape["type"], "parts": parts}
                shapes.append(shape)
            yield frame.assign(**{column: shapes})

    return df.mapInPandas(run, df.schema)
