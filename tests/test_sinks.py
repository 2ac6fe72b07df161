"""Workbooks written by tasks, tiles of a map, and the probe for a join column."""

import io
import json
import random
import re
import zipfile
import zlib

import pytest
from pyspark.sql import functions as F

from basinsift.operators import frames
from basinsift.sources import readers, sinks, tiles

SHAPE = "id int, name string, geometry struct<type:string,parts:array<array<struct<x:double,y:double>>>>"


def test_checksums_of_joined_texts():
    rng = random.Random(1)
    for _ in range(30):
        a, b = (bytes(rng.randrange(256) for _ in range(rng.randint(0, 300))) for _ in range(2))
        assert sinks.joined_crc(zlib.crc32(a), zlib.crc32(b), len(b)) == zlib.crc32(a + b)


def test_workbook_of_tasks(spark, tmp_path):
    rows = [(k, f"<fila> & {k} \x01ñ" if k % 3 else None, "w" * (k % 40)) for k in range(1, 9001)]
    df = spark.createDataFrame(rows, "id int, `un nombre` string, largo string").repartitionByRange(5, "id").sortWithinPartitions("id")
    odd = spark.createDataFrame([(1,)], "a int")
    path = f"{tmp_path}/libro.xlsx"
    sinks.write_workbook(spark, {"uno": df, "una hoja de nombre muy largo, mas de 31": odd, "vacia": df.limit(0)}, path)
    data = (tmp_path / "libro.xlsx").read_bytes()
    with zipfile.ZipFile(io.BytesIO(data)) as book:
        assert book.testzip() is None
        sheet = book.read("xl/worksheets/sheet1.xml").decode()
    assert 'state="frozen"' in sheet and '<autoFilter ref="A1:C9001"/>' in sheet and re.findall(r'width="(\d+)"', sheet) == ["12", "18", "41"]
    found = readers.read_workbook(data, "uno")
    assert found[0] == ["id", "un nombre", "largo"] and len(found) == 9001
    assert [tuple(r) for r in found[1:]] == [(str(k), (n or "").replace("\x01", ""), w) for k, n, w in rows]
    assert readers.read_workbook(data, "una hoja de nombre muy largo, mas de 31"[:31]) == [["a"], ["1"]] and readers.read_workbook(data, "vacia") == [["id", "un nombre", "largo"]]


def test_a_million_rows_in_a_sheet(spark, tmp_path):
    path = f"{tmp_path}/grande.xlsx"
    sinks.write_workbook(spark, {"grande": spark.range(0, 1_000_000, 1, 8).select("id", (F.col("id") * 7).alias("siete"))}, path)
    with zipfile.ZipFile(path) as book, book.open("xl/worksheets/sheet1.xml") as sheet:
        count = tail = 0
        last = b""
        while block := sheet.read(1 << 20):
            text = last + block
            last = text[-6:]
            count += text.count(b"<row>") - last.count(b"<row>")
            tail = text[-80:]
    assert count == 1_000_001 and b'ref="A1:B1000001"' in tail
    with pytest.raises(ValueError, match="a sheet holds"):
        sinks.write_workbook(spark, {"x": spark.range(0, sinks.SHEET_ROWS, 1, 8)}, f"{tmp_path}/zu.xlsx")


def test_join_column_probe(spark):
    left = spark.createDataFrame([(k, f"c{k}", k % 5, [k], None if k % 2 else f"z{k}") for k in range(500)], "a int, `b.c` string, d int, e array<int>, f string")
    probe = lambda keys: frames.join_column(left, spark.createDataFrame([(x,) for x in keys], "k string"), "k")
    assert probe(["c7", "z4"]) == "b.c" and probe(["z4"]) == "f" and probe(["3"]) == "a" and probe(["nothing", None]) is None and probe([]) is None
    others = [f"x{k}" for k in range(3000)]
    assert probe(others) is None and probe([*others, "z498"]) == "f"
    assert frames.join_column(left.select("e"), spark.createDataFrame([("1",)], "k string"), "k") is None


def test_a_full_filter_still_gives_the_right_column(spark, monkeypatch):
    monkeypatch.setattr(frames, "FILTER_BITS", 64)
    left = spark.createDataFrame([(f"a{k}", f"b{k}") for k in range(300)], "one string, two string")
    assert frames.join_column(left, spark.createDataFrame([(f"b{k}",) for k in range(200, 400)], "k string"), "k") == "two"


def inside(box, part):
    slack = 1e-4
    return all(box[0] - slack <= x <= box[2] + slack and box[1] - slack <= y <= box[3] + slack for x, y in part)


def flat(coordinates):
    return [coordinates] if isinstance(coordinates[0], int | float) else [p for c in coordinates for p in flat(c)]


def test_every_feature_is_in_a_leaf(spark):
    rng = random.Random(3)
    rows = [(k, f"n{k}", ("Point", [[(rng.uniform(-100, -99), rng.uniform(19, 20))]])) for k in range(600)]
    rows += [(1000 + k, "line", ("LineString", [[(rng.uniform(-120, -80), rng.uniform(10, 30)) for _ in range(5)]])) for k in range(20)]
    ring = [(-110.0, 10.0), (-90.0, 10.0), (-90.0, 30.0), (-110.0, 30.0), (-110.0, 10.0)]
    hole = [(-105.0, 15.0), (-105.0, 25.0), (-95.0, 25.0), (-95.0, 15.0), (-105.0, 15.0)]
    rows += [(2000, "area", ("Polygon", [ring, hole])), (2001, "none", None), (2002, "empty", ("Point", [])), (2003, "pair", ("MultiPoint", [[(0.0, 0.0)], [(170.0, -89.0)]])), (2004, "edge", ("LineString", [[(-90.0, 5.0), (-90.0, 50.0)]]))]
    made = tiles.pyramid(spark.createDataFrame(rows, SHAPE), most=40, deepest=12).collect()
    leaves, overviews = [r for r in made if r["leaf"]], [r for r in made if not r["leaf"]]
    found = {json.loads(r["feature"])["properties"]["id"] for r in leaves}
    assert found == {r[0] for r in rows} - {2001, 2002} and overviews
    per_tile = {}
    for r in leaves:
        f = json.loads(r["feature"])
        assert inside(tiles.bounds(r["z"], r["x"], r["y"]), flat(f["geometry"]["coordinates"]))
        per_tile.setdefault((r["z"], r["x"], r["y"]), []).append(f)
    assert max(map(len, per_tile.values())) <= 40 and len({k[0] for k in per_tile}) > 2
    spots = sorted(tuple(f["geometry"]["coordinates"]) for t in per_tile.values() for f in t if f["geometry"]["type"] == "Point")
    assert spots == sorted(p[0] for r in rows if r[2] and "Point" in r[2][0] for p in r[2][1])
    first = [r for r in overviews if r["z"] == 0]
    assert sum(r["n"] for r in first) == 600 + 20 + 1 + 2 + 1

    def area(ring):
        return sum(a[0] * b[1] - b[0] * a[1] for a, b in zip(ring, ring[1:], strict=False)) / 2

    whole = sum(abs(area(p[0])) - sum(abs(area(h)) for h in p[1:]) for t in per_tile.values() for f in t if f["geometry"]["type"] == "MultiPolygon" for p in f["geometry"]["coordinates"])
    assert abs(whole - 300.0) < 0.05


def test_clipping():
    box = (0.0, 0.0, 10.0, 10.0)
    assert tiles.clip_line([(-5.0, 5.0), (15.0, 5.0)], box) == [[(0.0, 5.0), (10.0, 5.0)]]
    assert tiles.clip_line([(5.0, 5.0), (15.0, 5.0), (15.0, 8.0), (5.0, 8.0), (4.0, 8.0)], box) == [[(5.0, 5.0), (10.0, 5.0)], [(10.0, 8.0), (5.0, 8.0), (4.0, 8.0)]]
    assert tiles.clip_line([(20.0, 0.0), (30.0, 5.0)], box) == [] and tiles.clip_ring([(20.0, 0.0), (30.0, 0.0), (30.0, 5.0), (20.0, 0.0)], box) == []
    assert tiles.clip_ring([(-5.0, -5.0), (15.0, -5.0), (15.0, 15.0), (-5.0, 15.0), (-5.0, -5.0)], box)[:-1] and len(tiles.clip_ring([(-5.0, -5.0), (15.0, -5.0), (15.0, 15.0), (-5.0, 15.0), (-5.0, -5.0)], box)) == 5


def test_map_folder(spark, tmp_path):
    rows = [(k, f"</script>{k}", ("Point", [[(-100 + k / 100, 19.0)]])) for k in range(50)]
    df = spark.createDataFrame(rows, SHAPE)
    done = tiles.write_map(spark, df, str(tmp_path / "mapa"), "Puntos & más", (-99.0, 19.0), most=10, deepest=9).collect()
    assert sum(r["n"] for r in done if r["leaf"]) == 50
    for r in done:
        text = (tmp_path / "mapa" / str(r["z"]) / str(r["x"]) / f"{r['y']}.js").read_text()
        assert text.startswith(f'tile("{r["z"]}/{r["x"]}/{r["y"]}", ') and "</script>" not in text
        assert len(json.loads(text[text.index("[") : text.rindex("]") + 1].replace("<\\/", "</"))) == r["items"]
    page = (tmp_path / "mapa" / "index.html").read_text()
    assert "Puntos &amp; más" in page and "function tile" in page
    assert tiles.write_map(spark, df.limit(0), str(tmp_path / "nada"), "Nada").count() == 0 and "Sin registros" in (tmp_path / "nada" / "index.html").read_text()


def test_points_of_one_place_are_written_once_however_deep_their_tile(spark, monkeypatch):
    written, keep = [], tiles.materialize

    def counted(df, name):
        out = keep(df, name)
        written.append(out.count())
        return out

    monkeypatch.setattr(tiles, "materialize", counted)
    rows = [(k, "p", ("Point", [[(-99.2, 19.1)]])) for k in range(300)] + [(300, "short", ("LineString", [[(-99.2, 19.1), (-99.2, 19.1000001)]]))]
    made = tiles.pyramid(spark.createDataFrame(rows, SHAPE), most=10, deepest=12).collect()
    assert sum(written) < 2 * len(rows)
    leaves = [r for r in made if r["leaf"]]
    assert {r["z"] for r in leaves} == {12} and {json.loads(r["feature"])["properties"]["id"] for r in leaves} == {r[0] for r in rows}
    assert sorted((r["z"], r["n"]) for r in made if not r["leaf"]) == [(z, 301) for z in range(12)]
