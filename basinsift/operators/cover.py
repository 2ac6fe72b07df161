"""Polygons as covers of grid cells, and a quadtree of places, so that points meet polygons by an equi-join on cells.

A cell that no edge runs through is inside or outside as a whole; inner cells are rows without geometry.  A cell at the
border carries only the edges that run through it, and one reference point whose side is known: a place of the cell is
inside if the straight way to it from the reference point crosses an odd number (or for an outer reference point, an
even number) of the cell's own edges.  So no ring is copied to the cells it covers, and no place meets a whole ring.

The sides of reference points follow along each row of cells: the way from one border cell's point to the next one's stays
in the row, where only the edges of these two cells can cross it.

Cells with many places are split into four, again and again, from a histogram of counts (``splits``); the cover's cells
are split likewise.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from basinsift.functions import geo
from basinsift.operators.shared import join_spread, materialize

#: Where a cell's reference point may lie, as shares of the cell: the one farthest from the cell's edges is taken.
CANDIDATES = [(0.4871, 0.5137), (0.2113, 0.2719), (0.7823, 0.2347), (0.2459, 0.7691), (0.7411, 0.7867), (0.0537, 0.4903), (0.9467, 0.5241), (0.5051, 0.0613), (0.4789, 0.9391)]
#: Share of a cell by which edges are laid more widely than they are, against rounding.
PAD = 1e-9
#: Distinct places of a cell that are not split further, unless more would still give every partition eight cells.
CELL_PLACES, CELLS_PER_PARTITION, DEEPEST = 4096, 8, 40

_EDGE = "struct<k:int,x1:double,y1:double,x2:double,y2:double>"


def cells_along(size: float, x1: str = "x1", y1: str = "y1", x2: str = "x2", y2: str = "y2") -> Column:
    """Cells that a segment runs through, and those that it misses by rounding only."""
    pad, slope = size * PAD, f"(({y2} - {y1}) / nullif({x2} - {x1}, 0D))"
    at = lambda x: f"({y1} + ({x} - {x1}) * {slope})"
    a, b = at(f"greatest(least({x1}, {x2}), i * {size}D - {pad}D)"), at(f"least(greatest({x1}, {x2}), (i + 1) * {size}D + {pad}D)")
    steep = f"({slope} IS NULL OR abs({slope}) > 1e6D)"  # its heights can't be told from its places along x
    bottom, top = f"if({steep}, least({y1}, {y2}), least({a}, {b}))", f"if({steep}, greatest({y1}, {y2}), greatest({a}, {b}))"
    rows = f"transform(sequence(floor(({bottom} - {pad}D) / {size}D), floor(({top} + {pad}D) / {size}D)), j -> struct(i, j))"
    return F.expr(f"flatten(transform(sequence(floor((least({x1}, {x2}) - {pad}D) / {size}D), floor((greatest({x1}, {x2}) + {pad}D) / {size}D)), i -> {rows}))")


def crossed(edges: str, x: str, y: str, to_x: str, to_y: str) -> Column:
    """How many edges the straight way between two points that lie on none of them crosses."""
    side = lambda px, py: f"(({to_x} - {x}) * ({py} - {y}) - ({to_y} - {y}) * ({px} - {x}) > 0)"
    of_edge = lambda px, py: f"((e.x2 - e.x1) * (({py} - {y}) - (e.y1 - {y})) - (e.y2 - e.y1) * (({px} - {x}) - (e.x1 - {x})) > 0)"
    return F.expr(f"size(filter({edges}, e -> {side('e.x1', 'e.y1')} <> {side('e.x2', 'e.y2')} AND {of_edge(x, y)} <> {of_edge(to_x, to_y)}))")


def on_edge(edges: str, x: str, y: str) -> Column:
    within = f"{x} BETWEEN least(e.x1, e.x2) AND greatest(e.x1, e.x2) AND {y} BETWEEN least(e.y1, e.y2) AND greatest(e.y1, e.y2)"
    return F.expr(f"exists({edges}, e -> (e.x2 - e.x1) * ({y} - e.y1) = (e.y2 - e.y1) * ({x} - e.x1) AND {within})")


def _reference(edges: str, i: str, j: str, size: float) -> Column:
    """``apart, x, y`` of the candidate that is farthest from the edges; ``apart`` is the square of the distance."""
    spots = ", ".join(f"struct(({i} + {a}D) * {size}D AS x, ({j} + {b}D) * {size}D AS y)" for a, b in CANDIDATES)
    share = "greatest(0D, least(1D, ((c.x - e.x1) * (e.x2 - e.x1) + (c.y - e.y1) * (e.y2 - e.y1)) / ((e.x2 - e.x1) * (e.x2 - e.x1) + (e.y2 - e.y1) * (e.y2 - e.y1))))"
    off = lambda c: f"pow(c.{c} - e.{c}1 - {share} * (e.{c}2 - e.{c}1), 2)"
    return F.expr(f"array_max(transform(array({spots}), c -> struct(array_min(transform({edges}, e -> {off('x')} + {off('y')})) AS apart, c.x AS x, c.y AS y)))")


def cover(shapes: DataFrame, shape_id: str, size: float, column: str = "geometry") -> DataFrame:
    """``shape, level, i, j, edges, rx, ry, inner``: border cells with their edges and reference point, inner cells with null edges."""
    key, ends = "shape", ["x1", "y1", "x2", "y2"]
    edges = shapes.filter(F.col(column)["type"].contains("Polygon")).select(F.col(shape_id).alias(key), F.posexplode(geo.edges(F.col(column))).alias("k", "e")).select(key, "k", "e.*")
    edges = edges.filter("x1 <> x2 OR y1 <> y2")
    laid = edges.select(key, F.struct("k", *ends).alias("e"), F.inline(cells_along(size)))
    border = laid.groupBy(key, "i", "j").agg(F.collect_list("e").alias("edges"))  # a polygon's edges in one cell
    border = border.withColumn("ref", _reference("edges", "i", "j", size))
    row = Window.partitionBy(key, "j").orderBy("i")
    here = F.expr("struct(ref.x AS x, ref.y AS y, edges)")
    border = border.withColumns({"last": F.lag(here).over(row), "next_i": F.lead("i").over(row)})
    begin = crossed("edges", f"((i - 0.5D) * {size}D)", "ref.y", "ref.x", "ref.y")  # from the cell before, which has no edges
    onward = crossed("array_union(last.edges, edges)", "last.x", "last.y", "ref.x", "ref.y")
    border = border.withColumn("step", F.when(F.col("last").isNull(), begin).otherwise(onward))
    border = border.withColumn("inner", F.sum("step").over(row) % 2 == 1)
    border = border.withColumn("beyond", crossed("edges", "ref.x", "ref.y", f"((i + 1.5D) * {size}D)", "ref.y"))
    gap = "if(next_i > i + 1 AND (beyond + int(inner)) % 2 = 1, sequence(i + 1, next_i - 1), array())"
    inside = f"transform({gap}, i -> struct(i, CAST(NULL AS array<{_EDGE}>) AS edges, CAST(NULL AS double) AS rx, CAST(NULL AS double) AS ry, true AS inner))"
    cells = F.expr(f"concat(array(struct(i, edges, ref.x AS rx, ref.y AS ry, inner)), {inside})")
    return border.select(key, F.lit(0).alias("level"), "j", F.inline(cells)).select(key, "level", "i", "j", "edges", "rx", "ry", "inner")


def splits(places: DataFrame, size: float) -> list[DataFrame]:
    """For each level the cells (i, j) that are split: those of more places than a bound that grows with the table, so their number doesn't."""
    spark, found = places.sparkSession, []
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rest, total = places.select("x", "y"), None
    while len(found) < DEEPEST:
        at = [F.floor(F.col(c) / size).alias(n) for c, n in (("x", "i"), ("y", "j"))]
        counts = rest.select("x", "y", *at).groupBy("i", "j").agg(F.count("*").alias("n"))
        if total is None:
            total = places.count()
        most = max(CELL_PLACES, -(-total // (CELLS_PER_PARTITION * tasks)))
        if total <= most:
            break
        hot = counts.filter(F.col("n") > most).select("i", "j").collect()  # at most CELLS_PER_PARTITION cells for each task
        if not hot:
            break
        found.append(spark.createDataFrame([(r["i"], r["j"]) for r in hot], "i long, j long"))
        rest = rest.select("x", "y", *at).join(F.broadcast(found[-1]), ["i", "j"]).select("x", "y")
        size /= 2
    return found


def leaves(places: DataFrame, size: float, split: list[DataFrame]) -> DataFrame:
    """Adds ``level, i, j`` of the cell that holds each place (``x, y``)."""
    out = places.withColumns({"level": F.lit(0), "i": F.floor(F.col("x") / size), "j": F.floor(F.col("y") / size)})
    others = places.columns
    for level, cells in enumerate(split, 1):
        finer = size / 2**level
        hot = F.broadcast(cells.select(F.lit(level - 1).alias("level"), "i", "j", F.lit(True).alias("__split")))
        to = lambda c, n: F.when(F.col("__split"), F.floor(F.col(c) / finer)).otherwise(F.col(n)).alias(n)  # noqa: B023, E731
        out = out.join(hot, ["level", "i", "j"], "left").select(*others, F.when(F.col("__split"), level).otherwise(F.col("level")).alias("level"), to("x", "i"), to("y", "j"))
    return out


def refined(cells: DataFrame, size: float, split: list[DataFrame]) -> DataFrame:
    """The cover with split cells replaced by their quarters."""
    if not split:
        return cells
    done, rest = [], materialize(cells, "cover")
    for level, hot in enumerate(split):
        marked = F.broadcast(hot)
        done.append(rest.join(marked, ["i", "j"], "left_anti"))
        finer = size / 2 ** (level + 1)
        quarter = F.explode(F.expr("array(struct(0 AS a, 0 AS b), struct(0 AS a, 1 AS b), struct(1 AS a, 0 AS b), struct(1 AS a, 1 AS b))"))
        parts = rest.join(marked, ["i", "j"]).select("*", quarter.alias("q")).selectExpr("*", "i * 2 + q.a AS ci", "j * 2 + q.b AS cj")
        west, south, east, north = (f"(({c} + {n}D) * {finer}D)" for c, n in (("ci", -PAD), ("cj", -PAD), ("ci", 1 + PAD), ("cj", 1 + PAD)))
        corners = ", ".join(f"(e.x2 - e.x1) * ({y} - e.y1) - (e.y2 - e.y1) * ({x} - e.x1)" for x in (west, east) for y in (south, north))
        near = f"greatest(e.x1, e.x2) >= {west} AND least(e.x1, e.x2) <= {east} AND greatest(e.y1, e.y2) >= {south} AND least(e.y1, e.y2) <= {north}"
        parts = parts.withColumn("own", F.expr(f"filter(edges, e -> {near} AND least({corners}) <= 0 AND greatest({corners}) >= 0)"))
        middle = F.expr(f"struct(0D AS apart, (ci + 0.5D) * {finer}D AS x, (cj + 0.5D) * {finer}D AS y)")
        parts = parts.withColumn("ref", F.when(F.size("own") > 0, _reference("own", "ci", "cj", finer)).otherwise(middle))
        side = F.when(F.col("edges").isNull(), F.lit(True)).otherwise((crossed("edges", "rx", "ry", "ref.x", "ref.y") + F.col("inner").cast("int")) % 2 == 1)
        parts = parts.withColumn("side", side).filter("size(own) > 0 OR side")
        rest = materialize(parts.selectExpr("shape", f"{level + 1} AS level", "ci AS i", "cj AS j", "if(size(own) > 0, own, NULL) AS edges", "ref.x AS rx", "ref.y AS ry", "side AS inner"), "cover")
    columns = ["shape", "level", "i", "j", "edges", "rx", "ry", "inner"]
    return reduce(DataFrame.unionByName, (d.select(columns) for d in [*done, rest]))


def points_in_shapes(points: DataFrame, shapes: DataFrame, point_id: str, shape_id: str, size: float, column: str = "geometry") -> DataFrame:
    """``point_id, shape_id`` for every polygon geometry that strictly holds the point (even-odd over all rings); null for points in none.

    Points (``x, y``) of one place are looked up once; points without a place are in none.  Shapes that are no polygons hold nothing.
    """
    known = lambda c: F.col(c).isNotNull() & ~F.isnan(c)
    spots = points.select(F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y"))
    places = materialize(spots.filter(known("x") & known("y")).distinct(), "places")
    split = splits(places, size)
    cells = refined(cover(shapes, shape_id, size, column), size, split)
    met = leaves(places, size, split).join(cells, ["level", "i", "j"])
    odd = (crossed("edges", "rx", "ry", "x", "y") + F.col("inner").cast("int")) % 2 == 1
    hits = met.filter(F.col("edges").isNull() | odd & ~on_edge("edges", "x", "y")).groupBy("x", "y").agg(F.collect_set("shape").alias("shapes"))
    placed = points.select(F.col(point_id), F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y"))
    return join_spread(placed, hits, ["x", "y"]).select(point_id, F.explode_outer("shapes").alias(shape_id))
