"""Simplification that keeps topology: no ring crosses itself or another of its feature, and shared borders stay shared.

Borders are cut into arcs where three or more of them meet (junctions).  An arc that two features share is one row, simplified
once, in one direction, so both get the same vertices.  After each round every feature is put together and searched for
crossings; arcs that take part in one get half the tolerance, until none crosses that did not before.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from basinsift.functions import geo, rings
from basinsift.operators.shared import map_lists, materialize

_PLACES = "array<struct<x:double,y:double>>"


def thinned(part: np.ndarray, tolerance: float) -> np.ndarray:
    """Which vertices stay so that none of the others is farther than the tolerance from what is left; both ends do, and of a closed line the farthest one."""
    keep = np.zeros(len(part), bool)
    keep[[0, -1]] = True
    if len(part) > 3 and (part[0] == part[-1]).all():
        keep[int(np.argmax(((part - part[0]) ** 2).sum(axis=1)))] = True
    ends = np.flatnonzero(keep).tolist()
    stack = list(zip(ends, ends[1:], strict=False))
    while stack:
        a, b = stack.pop()
        if b - a < 2:
            continue
        along, off = part[b] - part[a], part[a + 1 : b] - part[a]
        square = float(along @ along)
        share = np.clip(off @ along / square, 0, 1) if square else np.zeros(len(off))
        apart = np.sqrt(((off - share[:, None] * along) ** 2).sum(axis=1))
        at = int(np.argmax(apart))
        if apart[at] > tolerance:
            keep[a + 1 + at] = True
            stack += [(a, a + 1 + at), (a + 1 + at, b)]
    return keep


def arcs(part: list[tuple[float, float]], junctions: set[tuple[float, float]]) -> Iterator[tuple[list[tuple[float, float]], bool]]:
    """Pieces of a part between junctions, in order, each in its own direction (from its smaller end on), and whether the part runs against it.

    A ring begins at a junction, or without any at its least vertex.
    """
    closed = len(part) > 3 and part[0] == part[-1]
    if closed:
        on = [k for k in range(len(part) - 1) if part[k] in junctions]
        start = on[0] if on else min(range(len(part) - 1), key=part.__getitem__)
        part = [*part[start:-1], *part[: start + 1]]
    cuts = [0, *(k for k in range(1, len(part) - 1) if part[k] in junctions), len(part) - 1]
    for a, b in zip(cuts, cuts[1:], strict=False):
        arc = part[a : b + 1]
        against = arc[::-1] < arc
        yield (arc[::-1] if against else arc), against


def _key(arc: list[tuple[float, float]]) -> str:
    return hashlib.blake2b(np.array(arc, "<f8").tobytes(), digest_size=16).hexdigest()


def _places(column: Iterable) -> list[tuple[float, float]]:
    return [(v["x"], v["y"]) for v in column]


def junctions(shapes: DataFrame, feature: str, column: str) -> DataFrame:
    """``feature, places``: the vertices of a feature where three or more edges, of any features, meet."""
    edge = shapes.select(F.col(feature), F.inline(geo.edges(F.col(column)))).filter("x1 <> x2 OR y1 <> y2")
    ends = edge.select(feature, F.inline(F.expr("array(struct(x1 AS x, y1 AS y, x2 AS to_x, y2 AS to_y), struct(x2 AS x, y2 AS y, x1 AS to_x, y1 AS to_y))")))
    # Edges are made distinct first, so a vertex of very many features is no large group.
    meeting = ends.select("x", "y", "to_x", "to_y").distinct().groupBy("x", "y").count().filter("count > 2").select("x", "y")
    return ends.select(feature, "x", "y").distinct().join(meeting, ["x", "y"]).groupBy(feature).agg(F.collect_list(F.struct("x", "y")).alias("places"))


def _cut(rows: dict[str, list]) -> dict[str, list]:
    """The arcs of each part."""
    out = []
    for feature, parts, places in zip(rows["feature"], rows["parts"], rows["places"], strict=True):
        met = set(_places(places or []))
        for k, part in enumerate(parts):
            line = _places(part)
            for n, (arc, against) in enumerate(arcs(line, met) if len(line) > 1 else [(line, False)]):
                out.append((feature, k, n, against, _key(arc), [{"x": x, "y": y} for x, y in arc]))
    return dict(zip(("feature", "part", "n", "against", "arc", "places"), map(list, zip(*out, strict=True)) if out else [[]] * 6, strict=True))


def _thin(rows: dict[str, list]) -> dict[str, list]:
    kept, whole = [], []
    for places, tolerance in zip(rows["places"], rows["tolerance"], strict=True):
        line = np.array(_places(places), float).reshape(-1, 2)
        stay = thinned(line, tolerance) if len(line) > 2 else np.ones(len(line), bool)
        kept.append([{"x": x, "y": y} for x, y in line[stay].tolist()])
        whole.append(bool(stay.all()))
    return {"arc": rows["arc"], "kept": kept, "whole": whole}


def _together(pieces: list[tuple[list[tuple[float, float]], bool, str]]) -> tuple[list[tuple[float, float]], list[str]]:
    """A part from its arcs, and the arc of each of its edges."""
    line, owners = [], []
    for places, against, arc in pieces:
        run = places[::-1] if against else places
        line += run[1:] if line else run
        owners += [arc] * (len(run) - 1)
    return line, owners


def _check(rows: dict[str, list]) -> dict[str, list]:
    """Arcs that take part in a crossing of a feature's rings, or leave a ring too few vertices, and are not whole."""
    found: set[str] = set()
    for pieces in rows["pieces"]:
        parts: dict[int, list] = {}
        for p in sorted(pieces, key=lambda p: (p["part"], p["n"])):
            parts.setdefault(p["part"], []).append((_places(p["kept"]), p["against"], p["arc"]))
        edges, owners, short = [], [], set()
        for own in parts.values():
            line, arcs_of = _together(own)
            if len(line) < 2 or line[0] != line[-1]:
                continue
            if len(line) < 4:
                short |= set(arcs_of)
            edges += list(zip(line, line[1:], strict=False))
            owners += arcs_of
        crossing = {owners[e] for i, j, points in rings.meetings(edges) if len(points) > 1 or any(p not in edges[i] or p not in edges[j] for p in points) for e in (i, j)}
        found |= (short | crossing) - {p["arc"] for p in pieces if p["whole"]}
    return {"arc": sorted(found)}


def simplify(shapes: DataFrame, feature: str, tolerance: float, column: str = "geometry") -> DataFrame:
    """``shapes`` with the vertices of lines and borders left out that the tolerance doesn't need; points stay, and null geometries.

    ``feature`` is a unique key.  A vertex that is left out is no farther than the tolerance from the simplified arc.
    """
    lines = F.col(column)["type"].rlike("Line|Polygon")
    chosen = shapes.filter(lines).select(F.col(feature).alias("feature"), F.col(column)["parts"].alias("parts"))
    places = junctions(shapes.filter(lines).select(F.col(feature).alias("feature"), F.col(column).alias("geometry")), "feature", "geometry")
    key = dict(shapes.dtypes)[feature]
    pieces = materialize(map_lists(chosen.join(places, "feature", "left").select("feature", "parts", "places"), _cut, f"feature {key}, part int, n int, against boolean, arc string, places {_PLACES}"), "arcs")
    used = pieces.select("feature", "part", "n", "against", "arc")
    first = Window.partitionBy("arc").orderBy("feature", "part", "n")
    each = materialize(pieces.withColumn("r", F.row_number().over(first)).filter("r = 1").select("arc", "places").withColumn("tolerance", F.lit(float(tolerance))), "arcs")
    while True:
        thin = materialize(map_lists(each, _thin, f"arc string, kept {_PLACES}, whole boolean"), "thin")
        put = used.join(thin, "arc").groupBy("feature").agg(F.collect_list(F.struct("part", "n", "against", "arc", "kept", "whole")).alias("pieces"))
        tangled = materialize(map_lists(put.select("pieces"), _check, "arc string").distinct(), "tangled")
        if tangled.isEmpty():
            break
        half = tangled.withColumn("again", F.lit(True))
        # Below a thousandth of a metre an arc that still crosses keeps all of its vertices.
        finer = F.when(F.col("again"), F.when(F.col("tolerance") < 1e-3, F.lit(-1.0)).otherwise(F.col("tolerance") / 2)).otherwise(F.col("tolerance"))
        each = materialize(each.join(half, "arc", "left").withColumn("tolerance", finer).drop("again"), "arcs")
    run = F.transform(F.array_sort(F.col("pieces")), lambda p: F.struct(p["part"].alias("part"), F.when(p["against"], F.reverse(p["kept"])).otherwise(p["kept"]).alias("run")))
    of_part = lambda runs, k: F.filter(runs, lambda r: r["part"] == k)
    joined = lambda own: F.flatten(F.transform(own, lambda r, n: F.when(n == 0, r["run"]).otherwise(F.slice(r["run"], F.lit(2), F.greatest(F.size(r["run"]) - 1, F.lit(0))))))
    parts = put.select("feature", run.alias("runs")).withColumn("parts", F.transform(F.sequence(F.lit(0), F.element_at("runs", -1)["part"]), lambda k: joined(of_part(F.col("runs"), k))))
    found = parts.select(F.col("feature").alias(feature), F.col("parts").alias("__parts"))
    shape = F.when(F.col("__parts").isNull(), F.col(column)).otherwise(F.struct(F.col(column)["type"].alias("type"), F.col("__parts").alias("parts")))
    return shapes.join(found, feature, "left").withColumn(column, shape).select(shapes.columns)
