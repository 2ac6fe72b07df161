"""Data-quality checks as one aggregate, reported as rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

CRITICAL = ["etapa_productiva_sugerida", "presion_ambiental_potencial", "confianza_clasificacion", "decision_estudio_sugerida"]
GONE = ["excluir_por_comercio", "excluir_por_renta", "excluir_del_universo_prioritario"]


def quality_checks(classified: DataFrame, expected_rows: int) -> DataFrame:
    """``validacion, ok, detalle`` of the ten checks over classified rows."""
    blank = lambda c: F.trim(F.coalesce(F.col(c), F.lit(""))) == ""
    c = F.col
    wanted = {
        "n": F.count("*"), "ids": F.count_distinct("id"), **{x: F.count_if(blank(x)) for x in CRITICAL},
        "reason": F.count_if(c("flag_estudio_prioritario") & blank("motivo_flag_estudio_prioritario")),
        "wet": F.count_if(c("flag_proceso_humedo_relevante") & c("decision_estudio_sugerida").isin(GONE)),
        "trade": F.count_if(c("flag_comercio_o_renta") & c("flag_senal_industrial")),
        "near": F.count_if(c("flag_cercania_hidrografia_250m") & ~c("requiere_auditoria_manual") & ~c("flag_estudio_prioritario")),
    }
    got = classified.agg(*(v.alias(k) for k, v in wanted.items()))
    text = lambda label, x: F.concat(F.lit(label), F.col(x).cast("string"))
    rows = [
        ("sin_perdida_registros", c("n") == expected_rows, F.concat(c("n").cast("string"), F.lit(f" de {expected_rows}"))),
        ("ids_duplicados", c("n") == c("ids"), F.lit("")),
        *((f"campo_critico_{x}", c(x) == 0, text("vacios=", x)) for x in CRITICAL),
        ("prioritarios_con_motivo", c("reason") == 0, text("sin_motivo=", "reason")),
        ("excluidos_con_senal_humeda", c("wet") == 0, text("casos=", "wet")),
        ("comercio_con_senal_industrial_identificado", F.lit(True), text("casos_para_revision=", "trade")),
        ("cercanos_no_prioritarios_sin_auditoria", c("near") == 0, text("casos=", "near")),
    ]
    return got.select(F.inline(F.array(*(F.struct(F.lit(a).alias("validacion"), b.alias("ok"), d.alias("detalle")) for a, b, d in rows))))


def invalid_values(df: DataFrame, column: str, valid: list[str]) -> DataFrame:
    """Distinct values outside the allowed domain."""
    return df.filter(~F.coalesce(F.col(column), F.lit("")).isin(valid)).select(column).distinct()


def quarantine(df: DataFrame, condition, reason: str) -> tuple[DataFrame, DataFrame]:
    """Rows that are fine, and the others with the reason."""
    bad = F.coalesce(condition, F.lit(False))
    return df.filter(~bad), df.filter(bad).withColumn("error", F.lit(reason))
