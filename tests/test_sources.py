import sqlite3
import struct

import pytest
from pyspark.sql import functions as F

from basinsift.operators import frames
from basinsift.queries import PROSE
from basinsift.sources import readers, sinks
from basinsift.streaming import rules


def shapefile(folder, name, points, latin=False):
    body = b""
    for k, (x, y) in enumerate(points, 1):
        body += struct.pack(">2i", k, 10) + struct.pack("<i2d", 1, x, y)
    (folder / f"{name}.shp").write_bytes(b"\0" * 100 + body)
    field = b"NOMBRE".ljust(11, b"\0") + b"C" + b"\0" * 4 + bytes([10]) + b"\0" * 15
    rows = b"".join(b" " + ("año" if latin else "río").encode("latin1" if latin else "utf-8").ljust(10) for _ in points)
    (folder / f"{name}.dbf").write_bytes(struct.pack("<4BIHH", 3, 0, 0, 0, len(points), 32 + 32 + 1, 11) + b"\0" * 20 + field + b"\r" + rows)


def test_shapefiles(spark, tmp_path):
    (tmp_path / "deep").mkdir()
    shapefile(tmp_path, "a", [(1.0, 2.0), (3.0, 4.0)])
    shapefile(tmp_path / "deep", "b", [(5.0, 6.0)], latin=True)
    (tmp_path / "broken.shp").write_bytes(b"\0" * 100 + struct.pack(">2i", 1, 99) + b"\1")
    rows = readers.read_shapefiles(spark, str(tmp_path)).collect()
    good = [r for r in rows if r["error"] is None]
    assert len(good) == 3 and sum(r["error"] is not None for r in rows) == 1
    assert {r["attributes"]["NOMBRE"] for r in good} == {"río", "año"}
    assert good[0]["geometry"]["type"] == "Point"
    assert len(readers.discover(spark, str(tmp_path), "*.shp")) == 3


def test_geopackage(spark, tmp_path):
    db = sqlite3.connect(tmp_path / "x.gpkg")
    db.execute("CREATE TABLE gpkg_geometry_columns (table_name TEXT, column_name TEXT)")
    db.execute("INSERT INTO gpkg_geometry_columns VALUES ('lines', 'geom')")
    db.execute("CREATE TABLE lines (id INTEGER, geom BLOB, nombre TEXT)")
    wkb = b"\1" + struct.pack("<II4d", 2, 2, 0.0, 0.0, 3.0, 4.0)
    db.execute("INSERT INTO lines VALUES (7, ?, 'Atoyac')", (b"GP\0\1" + struct.pack("<i", 6372) + wkb,))
    db.commit()
    db.close()
    row = readers.read_geopackages(spark, str(tmp_path)).first()
    assert row["geometry"]["type"] == "LineString" and row["attributes"]["nombre"] == "Atoyac" and len(row["geometry"]["parts"][0]) == 2


def poly_record(kind, parts):
    starts, xy = [], []
    for part in parts:
        starts.append(len(xy))
        xy += part
    return struct.pack("<i4d2i", kind, 0, 0, 9, 9, len(parts), len(xy)) + struct.pack(f"<{len(parts)}i", *starts) + b"".join(struct.pack("<2d", *p) for p in xy)


def test_lines_and_polygons_with_code_page_and_reference_system(spark, tmp_path):
    ring, line = [(0.0, 0.0), (1.0, 0.0), (1.0, 1.0), (0.0, 0.0)], [(0.0, 0.0), (2.0, 3.0)]
    records = [poly_record(3, [line]), poly_record(5, [ring]), poly_record(3, [line, line]), struct.pack("<i", 0)]
    body = b"".join(struct.pack(">2i", k, len(r) // 2) + r for k, r in enumerate(records, 1))
    shapefile(tmp_path, "l", [(0.0, 0.0)] * 4)
    (tmp_path / "l.shp").write_bytes(b"\0" * 100 + body)
    data = (tmp_path / "l.dbf").read_bytes().replace("río".encode().ljust(10), "año".encode("cp1252").ljust(10))
    (tmp_path / "l.dbf").write_bytes(data)
    (tmp_path / "l.cpg").write_text("1252")
    (tmp_path / "l.prj").write_text('GEOGCS["WGS 84"]')
    rows = readers.read_shapefiles(spark, str(tmp_path)).orderBy("feature_id").collect()
    assert [r["geometry"] and r["geometry"]["type"] for r in rows] == ["LineString", "Polygon", "MultiLineString", None]
    assert [(p["x"], p["y"]) for p in rows[1]["geometry"]["parts"][0]] == ring
    assert {r["attributes"]["NOMBRE"] for r in rows} == {"año"} and {r["crs"] for r in rows} == {'GEOGCS["WGS 84"]'}
    assert [readers.code_page(x) for x in (None, b"UTF-8", b"1252", b"ANSI 1252", b"nonsense", b"ISO-8859-1\r\n")] == ["utf-8", "utf-8", "cp1252", "cp1252", "utf-8", "iso8859-1"]


def test_first_optional_and_template_sources(spark, tmp_path):
    (tmp_path / "b").mkdir()
    for name in ("b/two.csv", "one.csv"):
        (tmp_path / name).write_text("x,y\n1,2\n")
    assert readers.first_of(spark, str(tmp_path), "*.CSV").endswith("b/two.csv")
    with pytest.raises(FileNotFoundError):
        readers.first_of(spark, str(tmp_path / "none"), "*.csv")
    assert readers.optional(spark, str(tmp_path / "layer")) is None
    spark.range(3).write.parquet(str(tmp_path / "layer"))
    assert readers.optional(spark, str(tmp_path / "layer/")).count() == 3
    found = readers.read_templates(spark, {"a": str(tmp_path / "one.csv"), "c": str(tmp_path / "three.csv")})
    assert list(found) == ["a"] and found["a"].first().asDict() == {"x": "1", "y": "2"}
    assert readers.union_by_name([spark.createDataFrame([(1,)], "a int"), spark.createDataFrame([("q",)], "b string")]).collect() == [(1, None), (None, "q")]


def test_provenance_and_missing_columns(spark):
    paths = [("file:/data/raw/Agebs/x.shp",), ("agebs\\huejotzingo\\y.shp",), ("z.shp",), (None,)]
    rows = readers.with_provenance(spark.createDataFrame(paths, "source_path string"), "agebs").collect()
    assert [(r["source_file"], r["source_folder"], r["layer_type"]) for r in rows] == [("x.shp", "Agebs", "agebs"), ("y.shp", "huejotzingo", "agebs"), ("z.shp", "", "agebs"), (None, None, "agebs")]
    filled = frames.ensure(spark.createDataFrame([("n",)], "notas_auditoria string"), ["notas_auditoria", "fecha_auditoria"]).first()
    assert filled.asDict() == {"notas_auditoria": "n", "fecha_auditoria": ""}


def test_windowed_counts_of_a_stream(spark, tmp_path):
    rows = spark.sql("SELECT timestamp'2026-01-01 00:10:00' AS ts, 'alta' AS prioridad_campo UNION ALL SELECT timestamp'2026-01-01 00:50:00', 'alta' UNION ALL SELECT timestamp'2026-01-01 01:10:00', 'baja'")
    rows.write.parquet(str(tmp_path / "in"))
    run = rules.priority_counts(rules.read_registry(spark, str(tmp_path / "in"), rows.schema), "ts").writeStream.format("memory").queryName("counted").outputMode("complete").option("checkpointLocation", str(tmp_path / "ck")).start()
    run.processAllAvailable()
    run.stop()
    assert sorted((r["window"]["start"].hour, r["prioridad_campo"], r["n"]) for r in spark.table("counted").collect()) == [(0, "alta", 2), (1, "baja", 1)]


@pytest.mark.parametrize("encoding", ["utf-8-sig", "latin1"])
def test_csv_encodings(spark, tmp_path, encoding):
    (tmp_path / "t.csv").write_bytes("año,b\nñandú,1\n".encode(encoding))
    df = readers.read_csv(spark, str(tmp_path / "t.csv"))
    assert df.columns == ["año", "b"] and df.first()["año"] == "ñandú"
    assert readers.sidecar_csv(spark, str(tmp_path / "t.shp")).count() == 1
    assert readers.sidecar_csv(spark, str(tmp_path / "u.shp")) is None


def test_census(spark, tmp_path):
    text = "a\nb\nc\nd\nAño Censal,Municipio,UE,\n2023,074 Huejotzingo,5,\nNota,,,\n2018,,,\n,,,\n"
    (tmp_path / "s.csv").write_bytes(text.encode("latin1"))
    rows = readers.read_census(spark, str(tmp_path / "s.csv")).orderBy("ano_censal").collect()
    assert [r["ano_censal"] for r in rows] == ["2018", "2023"] and rows[1].asDict().keys() == {"ano_censal", "municipio", "ue"}


def test_workbook_round_trip(spark):
    data = sinks.workbook({"uno": spark.createDataFrame([(1, "a<b"), (2, None)], "x int, y string"), "dos": spark.createDataFrame([("z",)], "w string")})
    assert readers.read_workbook(data, "uno") == [["x", "y"], ["1", "a<b"], ["2"]]
    assert readers.read_workbook(data, "dos") == [["w"], ["z"]]
    assert readers.read_workbook(data, "no such sheet")[0] == ["x", "y"]


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([("Santa Ana", True, False, None), ("San Martín", True, True, "q")], "place string, a boolean, b boolean, t string")
    sinks.write_layer(df, str(tmp_path / "layer"))
    assert spark.read.parquet(str(tmp_path / "layer")).filter("t = ''").count() == 1
    sinks.write_partitioned(df, str(tmp_path / "parts"), "place", ["a", "b"])
    assert spark.read.csv(str(tmp_path / "parts"), header=True).groupBy("slug", "label").count().count() == 3
    assert not sinks.write_errors(df.filter("false"), str(tmp_path / "none"))
    sinks.write_csv(df, str(tmp_path / "csv"))
    assert next(p for p in (tmp_path / "csv").glob("*.csv")).read_bytes().startswith(b"\xef\xbb\xbf")
    page = sinks.map_page("t", spark.createDataFrame([], "feature string"), (0.0, 0.0))
    assert "Sin registros" in page
    shapes = spark.createDataFrame([('{"type":"Feature","properties":{"n":"</script>"},"geometry":{"type":"Polygon","coordinates":[[[0,0],[1,0],[1,1],[0,0]]]}}',)], "feature string")
    page = sinks.map_page("a & b", shapes, (0.0, 0.0), legend={"alta <": "#b2182b"})
    assert page.count("</script>") == 1 and "a &amp; b" in page and '"Polygon"' in page and '<li style="color:#b2182b">alta &lt;</li>' in page
    assert "## x" in sinks.report("r", {"x": df}) and sinks.run_metadata(df, "s", "f", "c").first()["registros"] == 2
    sinks.write_text(spark, str(tmp_path / "i.html"), sinks.index_page("i", [("a", "a.html", 3)]))
    assert "(3)" in (tmp_path / "i.html").read_text()


def test_stream_equals_batch(spark, tmp_path, small):
    rows = spark.read.parquet(f"{small}/documents.parquet").select(F.col("doc_id").alias("id"), F.col("source").alias("nombre"), F.col("text").alias("texto_busqueda"), F.lit("").alias("codigo"), F.lit("").alias("palabras_clave"), F.lit(10.0).alias("distancia"), F.lit("x").alias("source_folder"))
    rows.repartition(3).write.parquet(str(tmp_path / "in"))
    stream = rules.classify(rules.read_registry(spark, str(tmp_path / "in"), rows.schema, 1), PROSE).select("id", "branch")
    run = stream.writeStream.format("memory").queryName("classified").option("checkpointLocation", str(tmp_path / "ck")).start()
    run.processAllAvailable()
    run.stop()
    batch = rules.classify(rows, PROSE).select("id", "branch")
    assert sorted(map(tuple, spark.table("classified").collect())) == sorted(map(tuple, batch.collect()))
