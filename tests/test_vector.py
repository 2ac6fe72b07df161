"""Vector files read in parts: holes and several polygons, ranges, boxes, columns, errors, large files."""

import sqlite3
import struct

import pytest
from pyspark.sql import functions as F

from basinsift.functions import geo
from basinsift.operators import spatial
from basinsift.sources import formats, readers, vector


def block(x, y, size, clockwise=True):
    ring = [(x, y), (x, y + size), (x + size, y + size), (x + size, y), (x, y)]
    return ring if clockwise else ring[::-1]


def record(kind, parts):
    starts, xy = [], []
    for part in parts:
        starts.append(len(xy))
        xy += part
    xs, ys = [p[0] for p in xy], [p[1] for p in xy]
    return struct.pack("<i4d2i", kind, min(xs), min(ys), max(xs), max(ys), len(parts), len(xy)) + struct.pack(f"<{len(parts)}i", *starts) + b"".join(struct.pack("<2d", *p) for p in xy)


def point(x, y):
    return struct.pack("<i2d", 1, x, y)


def shapefile(folder, name, records, values, index=True, code="UTF-8"):
    """Main file, index, table and code page of records (bodies) and (NOMBRE, CLAVE) values."""
    main, places = b"\0" * 100, b"\0" * 100
    for k, body in enumerate(records, 1):
        places += struct.pack(">2i", len(main) // 2, len(body) // 2)
        main += struct.pack(">2i", k, len(body) // 2) + body
    (folder / f"{name}.shp").write_bytes(main)
    if index:
        (folder / f"{name}.shx").write_bytes(places)
    fields = b"".join(n.ljust(11, b"\0") + b"C" + b"\0" * 4 + bytes([12]) + b"\0" * 15 for n in (b"NOMBRE", b"CLAVE"))
    rows = b"".join(b" " + a.encode(code).ljust(12) + b.encode(code).ljust(12) for a, b in values)
    (folder / f"{name}.dbf").write_bytes(struct.pack("<4BIHH", 3, 0, 0, 0, len(values), 32 + 64 + 1, 25) + b"\0" * 20 + fields + b"\r" + rows)
    (folder / f"{name}.cpg").write_text(code)


def geopackage(path, blobs, rtree=False, layer="zonas"):
    db = sqlite3.connect(path)
    db.execute("CREATE TABLE IF NOT EXISTS gpkg_geometry_columns (table_name TEXT, column_name TEXT)")
    db.execute("INSERT INTO gpkg_geometry_columns VALUES (?, 'geom')", (layer,))
    db.execute(f"CREATE TABLE {layer} (fid INTEGER PRIMARY KEY, geom BLOB, nombre TEXT, clave INTEGER)")
    db.executemany(f"INSERT INTO {layer} VALUES (?, ?, ?, ?)", [(k * 3 + 1, b, f"n{k}", k) for k, b in enumerate(blobs)])
    if rtree:
        db.execute(f"CREATE VIRTUAL TABLE rtree_{layer}_geom USING rtree(id, minx, maxx, miny, maxy)")
        for k, b in enumerate(blobs):
            box = formats.gpkg_geometry(b)[2]
            db.execute(f"INSERT INTO rtree_{layer}_geom VALUES (?, ?, ?, ?, ?)", (k * 3 + 1, box[0], box[2], box[1], box[3]))
    db.commit()
    db.close()


def wkb_polygon(rings):
    return struct.pack("<BII", 1, 3, len(rings)) + b"".join(struct.pack("<I", len(r)) + b"".join(struct.pack("<2d", *p) for p in r) for r in rings)


def gpkg_value(wkb):
    return b"GP\0\1" + struct.pack("<i", 6372) + wkb


SHELL, HOLE, FAR = block(0.0, 0.0, 10.0), block(2.0, 2.0, 3.0, False), block(20.0, 0.0, 5.0)


def check_shapes(rows):
    """A polygon with a hole, and two polygons of which the first has one: types, rings, features, areas."""
    one, two = rows
    assert one["geometry"]["type"] == "Polygon" and len(one["geometry"]["parts"]) == 2
    assert two["geometry"]["type"] == "MultiPolygon" and len(two["geometry"]["parts"]) == 3


def check_features(spark, df):
    areas = {r["feature_id"]: r["a"] for r in df.select("feature_id", F.transform("geometry.parts", geo.ring_area).alias("a")).collect()}
    assert sorted(areas.values()) == [[100.0, -9.0], [100.0, -9.0, 25.0]]
    nested = {r["t"]: r["n"] for r in df.select(F.col("geometry.type").alias("t"), F.transform(geo.polygons(F.col("geometry")), lambda p: F.size(p)).alias("n")).collect()}
    assert nested == {"Polygon": [2], "MultiPolygon": [2, 1]}
    text = {r["t"]: r["f"] for r in df.select(F.col("geometry.type").alias("t"), geo.geojson(F.col("geometry"), F.lit(1).alias("id")).alias("f")).collect()}
    assert text["Polygon"].count("[[") == 2 and '"coordinates":[[[' in text["Polygon"] and '"coordinates":[[[[' in text["MultiPolygon"]
    places = spark.createDataFrame([(1, 1.0, 1.0), (2, 3.0, 3.0), (3, 21.0, 1.0), (4, 2.0, 2.0), (5, 0.0, 5.0), (6, 9.0, 9.0)], "id int, x double, y double")
    shapes = df.filter("geometry.type = 'MultiPolygon'").withColumn("shape_id", F.lit(7))
    held = sorted(r["id"] for r in spatial.point_in_polygon(places, shapes, "id", "shape_id", 4.0).filter("shape_id = 7").collect())
    assert held == [1, 3, 6]
    assert df.count() == spatial.repair(df).count()


@pytest.mark.parametrize("index", [True, False])
def test_shapefile_holes(spark, tmp_path, index):
    shapefile(tmp_path, "z", [record(5, [SHELL, HOLE]), record(5, [HOLE, SHELL, FAR])], [("uno", "1"), ("dos", "2")], index)
    df = readers.read_shapefiles(spark, str(tmp_path))
    check_shapes(df.orderBy("feature_id").collect())
    check_features(spark, df)


def test_geopackage_holes(spark, tmp_path):
    inner = [wkb_polygon([SHELL, HOLE]), wkb_polygon([FAR])]
    geopackage(tmp_path / "z.gpkg", [gpkg_value(inner[0]), gpkg_value(struct.pack("<BII", 1, 6, 2) + b"".join(inner))])
    df = readers.read_geopackages(spark, str(tmp_path))
    check_shapes(df.orderBy("feature_id").collect())
    check_features(spark, df)


def test_ranges_boxes_and_columns(spark, tmp_path):
    (tmp_path / "deep dir").mkdir()
    shapefile(tmp_path, "a", [point(float(k), 0.0) for k in range(1000)], [(f"año {k}", str(k)) for k in range(1000)], code="cp1252")
    shapefile(tmp_path / "deep dir", "b", [point(float(k), 5.0) if k % 2 else struct.pack("<i", 0) for k in range(100)], [(f"b{k}", str(k)) for k in range(100)])
    df = readers.read_shapefiles(spark, str(tmp_path), records=64)
    assert df.rdd.getNumPartitions() == 16 + 2
    rows = df.collect()
    assert len(rows) == 1100 and all(r["error"] is None for r in rows)
    a = sorted((r["feature_id"], r["attributes"]["NOMBRE"], r["geometry"]["parts"][0][0]["x"]) for r in rows if r["source_path"].endswith("a.shp"))
    assert a == [(k, f"año {k}", float(k)) for k in range(1000)]
    near = readers.read_shapefiles(spark, str(tmp_path), bbox=(10.0, -1.0, 20.0, 1.0), columns=["CLAVE"], records=64).collect()
    assert sorted(r["feature_id"] for r in near) == list(range(10, 21)) and {tuple(r["attributes"]) for r in near} == {("CLAVE",)}
    path = next(r["source_path"] for r in rows if r["source_path"].endswith("b.shp"))
    one = df.filter(F.col("source_path") == path)
    assert one.count() == 100 and one.rdd.getNumPartitions() == 2
    assert sum(r["geometry"] is None for r in one.collect()) == 50
    whole = {(r["source_path"], r["feature_id"], str(r["geometry"]), str(r["attributes"])) for r in readers._whole_shapefiles(spark, str(tmp_path)).collect()}
    assert {(r["source_path"], r["feature_id"], str(r["geometry"]), str(r["attributes"])) for r in rows} == whole


@pytest.mark.parametrize("rtree", [True, False])
def test_geopackage_ranges(spark, tmp_path, rtree):
    blobs = [gpkg_value(struct.pack("<BI2d", 1, 1, float(k), 0.0)) for k in range(300)]
    geopackage(tmp_path / "g.gpkg", blobs, rtree)
    df = readers.read_geopackages(spark, str(tmp_path), records=100)
    assert df.rdd.getNumPartitions() == 9
    assert sorted((r["feature_id"], r["attributes"]["nombre"], r["crs"]) for r in df.collect()) == [(3 * k + 1, f"n{k}", "EPSG:6372") for k in range(300)]
    near = readers.read_geopackages(spark, str(tmp_path), bbox=(5.0, -1.0, 7.0, 1.0), columns=["clave"]).collect()
    assert sorted((r["geometry"]["parts"][0][0]["x"], r["attributes"]["clave"]) for r in near) == [(5.0, "5"), (6.0, "6"), (7.0, "7")] and all(set(r["attributes"]) == {"clave"} for r in near)
    assert "no layer" in readers.read_geopackages(spark, str(tmp_path), "otra").first()["error"]


def test_errors_are_rows(spark, tmp_path):
    shapefile(tmp_path, "good", [point(1.0, 2.0)], [("a", "b")])
    shapefile(tmp_path, "short", [point(1.0, 2.0)] * 2, [("a", "b")])
    shapefile(tmp_path, "cut", [point(1.0, 2.0)] * 3, [("a", "b")] * 3)
    (tmp_path / "cut.shp").write_bytes((tmp_path / "cut.shp").read_bytes()[:-10])
    (tmp_path / "bad.gpkg").write_bytes(b"no database")
    rows = readers.read_shapefiles(spark, str(tmp_path)).collect()
    errors = {r["source_path"].rpartition("/")[2]: r["error"] for r in rows if r["error"]}
    assert set(errors) == {"short.shp", "cut.shp"} and "2 shapes and 1 rows" in errors["short.shp"] and "ends after" in errors["cut.shp"]
    assert sum(r["error"] is None for r in rows) == 3
    assert "DatabaseError" in readers.read_geopackages(spark, str(tmp_path)).first()["error"]
    assert readers.read_shapefiles(spark, str(tmp_path / "none")).count() == 0


def test_three_gigabytes_in_bounded_memory(spark, tmp_path):
    """A (sparse) main file of 3 GB: many ranges, and a task's window holds a few MB of it."""
    n, step = 300, 10 << 20
    shapefile(tmp_path, "big", [point(0.0, 0.0)], [(f"n{k}", str(k)) for k in range(n)])
    with open(tmp_path / "big.shp", "r+b") as main, open(tmp_path / "big.shx", "r+b") as index:
        index.seek(100)
        for k in range(n):
            main.seek(100 + k * step)
            main.write(struct.pack(">2i", k + 1, 10) + point(float(k), 1.0))
            index.write(struct.pack(">2i", (100 + k * step) // 2, 10))
    assert (tmp_path / "big.shp").stat().st_size > 2.9 * 2**30
    df = readers.read_shapefiles(spark, str(tmp_path), records=10)
    assert df.rdd.getNumPartitions() == 30
    assert sorted(r["geometry"]["parts"][0][0]["x"] for r in df.collect()) == [float(k) for k in range(n)]
    window = vector._Window(vector._open(str(tmp_path / "big.shp")))
    for k in range(0, n, 7):
        window.read(100 + k * step, 28)
        assert len(window.data) <= vector.WINDOW


def test_each_file_has_its_own_encoding(spark, tmp_path):
    folder = tmp_path / "csv"
    folder.mkdir()
    (folder / "a.csv").write_bytes("﻿id,nombre\n1,año\n".encode())
    (folder / "b.csv").write_bytes("id,nombre\n2,niño\n".encode("latin1"))
    (folder / "c.csv").write_bytes("id,nombre\n3,río\n".encode())
    rows = readers.read_csv(spark, str(folder)).collect()
    assert sorted((r["id"], r["nombre"]) for r in rows) == [("1", "año"), ("2", "niño"), ("3", "río")]
    assert sorted(readers.encodings(spark, str(folder)).values()) == ["latin1", "utf-8-sig", "utf-8-sig"]
    assert readers.read_csv(spark, str(folder / "b.csv")).first()["nombre"] == "niño"
