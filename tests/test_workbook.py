"""Workbook sheets, rule catalogue, legend and the review export."""

from basinsift.operators import frames, workbook
from basinsift.plans import catalogue
from basinsift.queries import classified, reviewed
from basinsift.sources import readers


def test_seventeen_sheets(spark, small):
    df = classified(spark, small).withColumnRenamed("nombre", "nombre_de_la_unidad_economica").withColumnRenamed("distancia", "distancia_hidrografia_m")
    quality = spark.createDataFrame([("a", True, "")], "validacion string, ok boolean, detalle string")
    universes = spark.createDataFrame([("A", 3)], "universe string, n long")
    sheets = workbook.sheets(df, quality, universes)
    assert len(sheets) == 17 and list(sheets)[:3] == ["todos_clasificados", "resumen_control_calidad", "universo_alcance_proyecto"]
    assert sheets["todos_clasificados"].count() == df.count() and set(sheets["todos_clasificados"].columns) <= set(catalogue.SHEET_COLUMNS)
    control = sheets["resumen_control_calidad"].collect()
    assert [tuple(r) for r in control] == [("a", True, "", None, None), (None,) * 5, (None, None, None, "A", 3)]
    assert sheets["catalogo_reglas"].count() == 13 and sheets["instrucciones_auditoria"].count() == 7


def test_review_export(spark, small, tmp_path):
    rows = reviewed(spark, small)
    parts = {region: rows.filter(rows.region_auditoria == region) for region in catalogue.REGION_FILES}
    paths = workbook.export_review(parts, str(tmp_path), "distancia")
    total = sum(df.count() for df in parts.values())
    assert readers.read_csv(spark, paths["todos_csv"]).count() == total
    book = open(paths["todos_xlsx"], "rb").read()
    assert len(readers.read_workbook(book, "Todos")) == total + 1
    summary = {tuple(r[:2]): r[2] for r in readers.read_workbook(book, "Resumen")[1:]}
    assert summary["indicadores", "total_registros"] == str(total)


def test_legend_of_many_and_no_groups(spark):
    df = spark.createDataFrame([(None,), ("",), *((f"v{k:02d}",) for k in range(30))], "v string")
    got = [tuple(r) for r in frames.legend(df, "v").collect()]
    assert len(got) == 16 and got[0] == ("", "sin dato (1)", 1) and got[15][0] == "v14"
    assert frames.legend(df.limit(0), "v").count() == 0


def test_columns(spark):
    df = spark.createDataFrame([], "a int, geometry struct<type:string,parts:array<array<struct<x:double,y:double>>>>")
    assert frames.missing_columns(df, ["b", "a", "c"]) == ["b", "c"] and frames.tabular(df).columns == ["a"]
    assert [tuple(r) for r in frames.column_catalogue(spark, {"t": df.select("a")}).collect()] == [("t", 1, "a", "int")]
