"""Sheets of the review workbook, the rule catalogue and the bundle of the review export."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from basinsift.operators import frames
from basinsift.plans import catalogue
from basinsift.sources import sinks


def rule_catalogue(spark: SparkSession, families: dict[str, list[str]] = catalogue.FAMILIES) -> DataFrame:
    """``familia_regla, descripcion, terminos`` of each family, in the order of the cascade."""
    return spark.createDataFrame([(f, catalogue.FAMILY_NOTES.get(f, ""), "; ".join(t)) for f, t in families.items()], "familia_regla string, descripcion string, terminos string")


def instructions(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(catalogue.INSTRUCTIONS.items()), "campo string, como_llenar string")


def color(column: str, value: Column) -> Column:
    """Colour of a class on a map."""
    known = catalogue.COLORS.get(column)
    if known is None:
        return F.lit(catalogue.OTHER_COLUMN)
    out = F.when(F.lit(False), "")
    for name, code in known.items():
        out = out.when(value == name, code)
    return out.otherwise(catalogue.OTHER_VALUE)


def filters(name: str, distance: str, denim: str = "mezclilla|jeans|denim") -> dict[str, Column]:
    """Rows of the sheets that hold classified establishments; ``name`` and the locality tell possible duplicates."""
    c = F.col
    scope, (first, second, third) = c("flag_universo_alcance_proyecto"), catalogue.LOCALITIES
    return {
        "todos_clasificados": F.lit(True),
        "universo_alcance_proyecto": scope,
        "alcance_huejotzingo": scope & (c("localidad") == first),
        "alcance_xalmimilulco": scope & (c("localidad") == second),
        "alcance_san_martin": scope & (c("localidad") == third),
        "universo_prioritario": c("flag_estudio_prioritario"),
        "procesos_humedos": c("presion_ambiental_potencial") == "alta",
        "mezclilla_jeans": F.coalesce(c("palabras_clave_etapa"), F.lit("")).rlike(f"(?i){denim}"),
        "auditoria_obligatoria": c("prioridad_auditoria").isin("alta", "media"),
        "pendientes": c("decision_estudio_sugerida").isin("mantener_pendiente", "validar_documentalmente"),
        "excluidos_comercio": c("etapa_productiva_sugerida") == "comercio_simple",
        "excluidos_confeccion_especializada": c("etapa_productiva_sugerida") == "confeccion_especializada_baja_relevancia",
        "cercanos_hidrografia_250m": c(distance) <= 250,
        "posibles_duplicados": F.count("*").over(Window.partitionBy(name, "localidad")) > 1,
    }


def sheets(classified: DataFrame, quality: DataFrame, universes: DataFrame, name: str = "nombre_de_la_unidad_economica", distance: str = "distancia_hidrografia_m") -> dict[str, DataFrame]:
    """The seventeen sheets; the window of possible duplicates is computed for its own sheet alone."""
    spark, out = classified.sparkSession, {}
    for sheet, kept in filters(name, distance).items():
        rows = classified.withColumn("__kept", kept).filter("__kept").drop("__kept")
        out[sheet] = frames.project(frames.tabular(rows), catalogue.SHEET_COLUMNS)
        if len(out) == 1:
            out["resumen_control_calidad"] = frames.stacked(quality, universes).orderBy("__part").drop("__part")
    return out | {"catalogo_reglas": rule_catalogue(spark), "instrucciones_auditoria": instructions(spark)}


def review_summary(prepared: DataFrame, distance: str, near: float = 250.0) -> DataFrame:
    """``seccion, clave, valor``: the indicators and the counts by place, suggested category and priority, in one pass."""
    c = F.col
    kpis = {
        "total_registros": F.lit(True), "posible_alta_relevancia": c("categoria_sugerida") == "alta", "cercanos_hidrografia": c(distance) <= near,
        "requieren_revision_manual": c("categoria_sugerida") == "revisar", "probablemente_excluibles": c("categoria_sugerida") == "excluir",
    }
    groups = {"por_localidad": "localidad_auditoria", "por_categoria_sugerida": "categoria_sugerida", "por_prioridad_revision": "prioridad_revision"}
    entry = lambda section, key, counts: F.struct(F.lit(section).alias("seccion"), key.cast("string").alias("clave"), counts.alias("counts"))
    rows = [entry("indicadores", F.lit(k), F.coalesce(v, F.lit(False))) for k, v in kpis.items()] + [entry(s, c(g), F.lit(True)) for s, g in groups.items()]
    return prepared.select(F.inline(F.array(*rows))).groupBy("seccion", "clave").agg(F.count_if("counts").alias("valor"))


def export_review(enriched: dict[str, DataFrame], folder: str, distance: str) -> dict[str, str]:
    """Writes a CSV set for each region, one for all and the workbook of five sheets; gives their paths."""
    paths, session = {}, next(iter(enriched.values())).sparkSession
    rows = sinks.union_frames(enriched.values())
    for region, df in enriched.items():
        paths[region] = f"{folder}/{catalogue.REGION_FILES[region][0]}"
        sinks.write_csv(df, paths[region])
    paths["todos_csv"], paths["todos_xlsx"] = f"{folder}/{catalogue.REVIEW_FILE}.csv", f"{folder}/{catalogue.REVIEW_FILE}.xlsx"
    sinks.write_csv(rows, paths["todos_csv"])
    book = {catalogue.REGION_FILES[region][1]: df for region, df in enriched.items()}
    book |= {"Todos": rows, "Resumen": review_summary(rows, distance).orderBy("seccion", "clave")}
    sinks.write_workbook(session, book, paths["todos_xlsx"])
    return paths
