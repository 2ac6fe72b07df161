"""Overlay of manual decisions: the last decision of a key wins, precedence decides what it changes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from basinsift.functions import codes
from basinsift.operators.frames import keep_last

# Categories that the final table keeps.
FINAL_CATEGORIES = ["alta_relevancia_ambiental", "media_relevancia_ambiental"]


def _last(decisions: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    text_keys = decisions.withColumns({k: F.coalesce(F.col(k).cast("string"), F.lit("nan")) for k in keys})
    return keep_last(text_keys, keys, order).drop(*order)


def _with_text_keys(rows: DataFrame, keys: list[str]) -> DataFrame:
    return rows.withColumns({k: F.coalesce(F.col(k).cast("string"), F.lit("nan")) for k in keys})


def audit_overlay(rows: DataFrame, decisions: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """``categoria_final`` and ``estado_auditoria``: a manual category counts only where the automatic one is ``revisar``."""
    manual = _last(decisions, keys, order).select(*keys, codes.canonical_category(F.col("categoria_auditada")).alias("__c"), F.col("notas_auditoria").alias("__n"))
    out = _with_text_keys(rows, keys).join(manual, keys, "left")
    open_, given = F.col("categoria") == "revisar", F.coalesce(F.col("__c"), F.lit("")) != ""
    return out.withColumns({
        "categoria_final": F.when(open_ & given, F.col("__c")).when(open_, "pendiente_auditoria").otherwise(F.col("categoria")),
        "estado_auditoria": F.when(open_ & given, "auditado_manual").when(open_, "pendiente_auditoria").otherwise("clasificacion_automatica"),
        "notas_auditoria": F.coalesce("__n", F.lit("")),
    }).drop("__c", "__n")


def audit_final(overlaid: DataFrame) -> DataFrame:
    return overlaid.filter(F.col("categoria_final").isin(FINAL_CATEGORIES)).withColumn("categoria", F.col("categoria_final"))


def productive_overlay(rows: DataFrame, decisions: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Final decision, stage and category with manual values where given; any non-blank value marks the row as audited."""
    blank = lambda c: F.trim(F.coalesce(F.col(c), F.lit("")))
    manual = _last(decisions, keys, order).select(*keys, "decision_estudio", "etapa_productiva_auditada", codes.canonical_category(F.col("categoria_auditada")).alias("__c"))
    stale = [c for c in ("decision_estudio", "etapa_productiva_auditada") if c in rows.columns]
    out = _with_text_keys(rows.drop(*stale), keys).join(manual, keys, "left")
    decided = codes.decision(F.col("decision_estudio"))
    any_given = (blank("decision_estudio") != "") | (blank("etapa_productiva_auditada") != "") | (F.coalesce(F.col("__c"), F.lit("")) != "")
    return out.withColumns({
        "decision_estudio_final": F.when((blank("decision_estudio") != "") & (decided != ""), decided).otherwise(F.col("decision_estudio_sugerida")),
        "etapa_productiva_final": F.when(blank("etapa_productiva_auditada") != "", F.col("etapa_productiva_auditada")).otherwise(F.col("etapa_productiva_sugerida")),
        "categoria_ambiental_final": F.when(F.coalesce(F.col("__c"), F.lit("")) != "", F.col("__c")).otherwise(F.col("categoria")),
        "estado_auditoria_productiva": F.when(any_given, "auditado_manual").otherwise("sin_decision_manual"),
    }).drop("__c")
