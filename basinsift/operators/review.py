"""Preparation of the manual review: keywords, suggestions, priorities and their order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from basinsift.functions import codes, text
from basinsift.plans.catalogue import REGIONS, REVIEW_QUERIES

# Labels and ranks; the reasons below are fixed too.
LABELS = {"alta": "alta", "media": "media", "baja": "baja_comercio"}
RANKS = {"priority": {"alta": 0, "manual": 1, "media": 2, "baja": 3}, "category": {"alta": 0, "revisar": 1, "media": 2, "excluir": 3}}


def found(match: Column, keywords: dict[str, list[str]]) -> dict[str, Column]:
    return {family: text.terms_found(match, terms, ordered=False) for family, terms in keywords.items()}


def flatten(arrays: dict[str, Column]) -> Column:
    return F.concat_ws(" | ", *(F.when(F.size(a) > 0, F.concat(F.lit(f"{LABELS[f]}: "), F.array_join(a, ", "))) for f, a in arrays.items()))


def category(match: Column, keywords: dict[str, list[str]]) -> Column:
    return F.when(text.has_any(match, keywords["alta"]), "alta").when(text.has_any(match, keywords["media"]), "media").when(text.has_any(match, keywords["baja"]), "excluir").otherwise("revisar")


def criterion(category: Column) -> Column:
    """Reason for a suggested category."""
    return (
        F.when(category == "alta", "posible proceso humedo/textil: contiene keywords de lavado, tenido, tintoreria, acabado o insumos quimicos")
        .when(category == "media", "posible proceso productivo textil sin evidencia humeda/quimica")
        .when(category == "excluir", "parece comercio simple de prendas o telas")
        .otherwise("sin evidencia suficiente; requiere revision manual")
    )


def priority(category: Column, distance: Column, limit: float) -> Column:
    near = F.coalesce(distance <= limit, F.lit(False))
    return F.when((category == "alta") | near, "alta").when(category == "media", "media").when(category == "excluir", "baja").otherwise("manual")


def rank(col: Column, kind: str) -> Column:
    return codes.first_match([(col == k, F.lit(v)) for k, v in RANKS[kind].items()], 4)


def query(name: Column, locality: Column, municipality: Column, ending: Column) -> Column:
    return text.joined_once([F.coalesce(c, F.lit("")) for c in (name, locality, municipality)] + [F.lit("Puebla")], ending)


def prepare(df: DataFrame, name: str, columns: list[str], source: str, distance: str, keywords: dict[str, list[str]], limit: float) -> DataFrame:
    """Adds the review columns to a template; ``order_by_priority`` sorts it."""
    match = text.relevant_text(*(F.col(c) for c in columns if c in df.columns))
    df = df.select("*", F.inline(F.array(F.struct(match.alias("texto_auditoria_normalizado")))))
    region = codes.region(F.col(source))
    place = lambda k: codes.first_match([(region == r, F.lit(v[k])) for r, v in REGIONS.items()], "")
    arrays = found(F.col("texto_auditoria_normalizado"), keywords)
    df = df.withColumns({"keywords_detectadas": flatten(arrays), "categoria_sugerida": category(F.col("texto_auditoria_normalizado"), keywords), "region_auditoria": region, "localidad_auditoria": place(0), "municipio_auditoria": place(1)})
    cat = F.col("categoria_sugerida")
    ending = codes.first_match([(cat == k, F.lit(v)) for k, v in REVIEW_QUERIES.items()], REVIEW_QUERIES["revisar"])
    parts = [F.col(name), F.col("localidad_auditoria"), F.col("municipio_auditoria")]
    return df.withColumns({
        "criterio_auditoria_sugerido": criterion(cat), "prioridad_revision": priority(cat, F.col(distance), limit),
        "query_maps": query(*parts, F.lit("Google Maps")), "query_web": query(*parts, ending),
    })


def order_by_priority(df: DataFrame, distance: str, tie: str) -> DataFrame:
    return df.orderBy(rank(F.col("prioridad_revision"), "priority"), F.col(distance).asc_nulls_last(), rank(F.col("categoria_sugerida"), "category"), tie)


def status(df: DataFrame) -> DataFrame:
    """``estado, registros``: all, without and with a manual category, with notes."""
    has = text.normalize(F.col("categoria_auditada")) != ""
    notes = F.trim(F.coalesce(F.col("notas_auditoria"), F.lit(""))) != ""
    counts = df.agg(F.count("*").alias("a"), F.count_if(~has).alias("b"), F.count_if(has).alias("c"), F.count_if(notes).alias("d"))
    names = dict(a="total", b="pendientes_categoria", c="auditados_categoria", d="con_notas")
    return counts.select(F.inline(F.array(*(F.struct(F.lit(v).alias("estado"), F.col(k).alias("registros")) for k, v in names.items()))))
