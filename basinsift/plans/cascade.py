"""First-match rule cascade as native columns: one boolean signal per family, one CASE per output."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from basinsift.functions import codes, text
from basinsift.plans.catalogue import STAGE_QUERIES, STAGE_QUERY_DEFAULT, Catalogue

# Outputs of the cascade that are flags, and columns that a reviewer fills in.  The stages, decisions and reasons below are fixed too.
FLAGS = [
    "flag_universo_alcance_proyecto", "flag_fuera_alcance_productivo_textil", "flag_estudio_prioritario", "flag_proceso_humedo_relevante",
    "flag_mezclilla_jeans", "flag_lavado_deslavado", "flag_tenido_tintoreria", "flag_acabado_tratamiento", "flag_maquila_productiva",
    "flag_confeccion_especializada_baja_relevancia", "flag_comercio_o_renta", "flag_requiere_auditoria_manual", "flag_prioridad_campo",
    "flag_cercania_hidrografia_250m", "flag_senal_industrial", "flag_texto_ambiguo", "flag_posible_falso_positivo", "flag_posible_falso_negativo",
    "tiene_senal_proceso_humedo", "tiene_senal_mezclilla_jeans", "tiene_senal_lavado_deslavado", "tiene_senal_tenido_tintoreria",
    "tiene_senal_acabado_tratamiento", "tiene_senal_industrial", "tiene_senal_maquila", "es_confeccion_especializada", "es_comercio_o_renta",
    "requiere_auditoria_manual",
]
MANUAL = ["categoria_auditada", "etapa_productiva_auditada", "notas_auditoria", "fuente_auditoria", "decision_estudio", "fecha_auditoria", "auditor_responsable"]
NEAR = 250.0
KEYWORD_FAMILIES = ["lavado_deslavado", "lavanderia_industrial", "tenido_tintoreria", "acabado_tratamiento", "mezclilla_jeans", "industrial", "maquila", "confeccion_especializada", "comercio", "renta"]


def _joined(parts: list[Column], separator: str = "; ") -> Column:
    """Distinct sorted non-null parts."""
    return F.array_join(F.array_sort(F.array_distinct(F.array_compact(F.array(*parts)))), separator)


def with_signals(df: DataFrame, catalogue: Catalogue) -> DataFrame:
    """Adds the match text ``m``, an array of found terms for each family (``t_<family>``) and the code's stage and rule.

    Input columns: ``nombre, texto_busqueda, codigo, palabras_clave, distancia``.
    """
    blank = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    stage, rule = codes.code_stage(blank("codigo"), catalogue.stages)
    df = df.withColumns({"m": text.tokens(F.concat_ws(" ", *map(blank, ("nombre", "texto_busqueda", "codigo", "palabras_clave")))), "s_code": stage, "r_code": rule})
    # A struct in a one-row array is a barrier: the folded text is computed once, not once for each term; so are
    # the terms of one word that it holds, which one intersection finds.
    df = df.select("*", F.inline(F.array(F.struct(F.col("m").alias("texto_busqueda_normalizado"), text.padded(F.col("m")).alias("_m"))))).drop("m")
    single = sorted({w for terms in catalogue.families.values() for t in terms if " " not in (w := text.tokens_py(t))})
    df = df.select("*", F.inline(F.array(F.struct(F.array_intersect(F.lit(single), F.split("texto_busqueda_normalizado", " ")).alias("_w")))))
    return df.withColumns({f"t_{f}": text.terms_found(F.col("_m"), terms, F.col("_w")) for f, terms in catalogue.families.items()})


def classify(df: DataFrame, catalogue: Catalogue) -> DataFrame:
    """Adds every output of the cascade to rows with ``nombre, texto_busqueda, codigo, palabras_clave, distancia, source_folder``."""
    df = with_signals(df, catalogue)
    place = codes.location(F.col("source_folder"))
    df = df.withColumns({"localidad": place["locality"], "municipio": place["municipality"]})
    has = {f: F.size(f"t_{f}") > 0 for f in catalogue.families}
    lavado = has["lavado_deslavado"] | has["lavanderia_industrial"]
    df = df.withColumns({
        "_lav": lavado, "_ten": has["tenido_tintoreria"], "_aca": has["acabado_tratamiento"], "_mez": has["mezclilla_jeans"], "_ind": has["industrial"],
        "_maq": has["maquila"], "_con": has["confeccion"], "_esp": has["confeccion_especializada"], "_com": has["comercio"], "_ren": has["renta"],
        "_non": has["no_textil"], "_bor": has["bordado_estampado"],
        "_wet": lavado | has["tenido_tintoreria"] | has["acabado_tratamiento"] | (F.col("s_code") == "lavanderia_industrial"),
        "_near": F.coalesce(F.col("distancia") <= NEAR, F.lit(False)),
    })
    c = F.col
    sewing, mill = c("s_code") == "confeccion_maquila", c("s_code") == "fabricacion_textil"
    made = c("_ind") | c("_maq") | c("_mez")
    printed = F.arrays_overlap("t_bordado_estampado", F.lit(catalogue.print_terms))
    branch = codes.first_match([
        (c("_non") & ~(c("_wet") | c("_mez") | c("_maq")), F.lit(1)),
        (c("_wet"), F.lit(2)),
        (c("_mez") & (c("_maq") | c("_ind") | c("_con") | sewing), F.lit(3)),
        (c("_maq") | (sewing & (c("_ind") | c("_con"))), F.lit(4)),
        (c("_bor"), F.lit(5)),
        (c("_esp") & ~made, F.lit(6)),
        (c("_ren") & ~made, F.lit(7)),
        (c("_com") & ~made, F.lit(8)),
        (mill, F.lit(9)),
        (sewing | c("_con"), F.lit(10)),
    ], F.lit(11))
    df = df.withColumns({"branch": branch, "_print": printed})
    b, loud = c("branch"), c("_ind")

    def by_branch(default: str, **values) -> Column:
        return codes.first_match([(b == int(k[1:]), v if isinstance(v, Column) else F.lit(v)) for k, v in values.items()], default)

    wet_stage = F.when(has["lavado_deslavado"], "lavado_deslavado").when(has["lavanderia_industrial"] | (c("s_code") == "lavanderia_industrial"), "lavanderia_industrial").when(c("_ten"), "tenido_tintoreria").otherwise("acabado_textil")
    sure_wet = has["lavado_deslavado"] | c("_ten") | c("_aca")
    df = df.withColumns({
        "etapa_productiva_sugerida": by_branch(
            "revisar", b1="no_pertinente", b2=wet_stage, b3="fabricacion_mezclilla", b4="confeccion_maquila", b5=F.when(c("_print"), "estampado_serigrafia").otherwise("bordado"),
            b6="confeccion_especializada_baja_relevancia", b7="renta_prendas", b8="comercio_simple", b9="fabricacion_textil", b10=F.when(loud, "confeccion_maquila").otherwise("revisar"),
        ),
        "presion_ambiental_potencial": by_branch(
            "pendiente", b1="baja", b2="alta", b3="media", b4="media", b5=F.when(c("_print"), "media").otherwise("baja"), b6="baja", b7="baja", b8="baja", b9="media",
            b10=F.when(loud, "media").otherwise("pendiente"),
        ),
        "decision_estudio_sugerida": by_branch(
            "mantener_pendiente", b1="excluir_del_universo_prioritario", b2="incluir_prioritario", b3="validar_documentalmente", b4="incluir_contexto_productivo",
            b5=F.when(c("_print"), "validar_documentalmente").otherwise("incluir_contexto_productivo"), b6="excluir_del_universo_prioritario", b7="excluir_por_renta",
            b8="excluir_por_comercio", b9="incluir_contexto_productivo", b10=F.when(loud, "validar_documentalmente").otherwise("mantener_pendiente"),
        ),
        "confianza_clasificacion": by_branch(
            "baja", b1="media", b2=F.when(sure_wet, "alta").otherwise("media"), b3="media", b4="media", b5="media", b6="alta", b7="alta", b8="alta", b9="media",
            b10=F.when(loud, "media").otherwise("baja"),
        ),
        "motivo_exclusion_prioritaria": by_branch(
            "", b1="senal no textil sin senales productivas relevantes", b6="confeccion especializada o sobre medida sin senales industriales ni humedas",
            b7="renta o alquiler de prendas sin senales productivas", b8="comercio de prendas o accesorios sin senales productivas",
        ),
    })
    stage, scode = c("etapa_productiva_sugerida"), c("s_code")
    second = [F.when((b == 2) & c("_mez"), F.lit("fabricacion_mezclilla")), F.when((b == 2) & c("_maq") | (b == 3) & (c("_maq") | sewing), F.lit("confeccion_maquila")), F.when((scode != "") & (scode != stage), scode)]
    wet, near, mez = c("_wet"), c("_near"), c("_mez")
    flagged = wet | (mez & (c("_lav") | c("_ten") | c("_aca") | c("_ind") | c("_maq")))
    productive = stage.isin("fabricacion_mezclilla", "confeccion_maquila", "estampado_serigrafia")
    field = codes.first_match([
        (wet & near, F.lit("muy_alta")), (wet, F.lit("alta")), ((productive | mez) & near, F.lit("media")), (productive | (stage == "fabricacion_textil"), F.lit("media")),
        (near & ~stage.isin("comercio_simple", "renta_prendas", "confeccion_especializada_baja_relevancia"), F.lit("documental")),
    ], "baja")
    why_field = codes.first_match([
        (wet & near, F.lit("proceso humedo o tratamiento y distancia <= 250 m a hidrografia")), (wet, F.lit("proceso humedo o tratamiento")),
        ((productive | mez) & near, F.lit("actividad productiva o ambigua cerca de hidrografia")), (productive | (stage == "fabricacion_textil"), F.lit("contexto productivo textil")),
        (near & ~stage.isin("comercio_simple", "renta_prendas", "confeccion_especializada_baja_relevancia"), F.lit("registro ambiguo cerca de hidrografia")),
    ], F.lit(None).cast("string"))
    why_wet = F.when(b == 2, F.lit("senal compatible con proceso humedo o tratamiento de prendas"))
    vague = (stage == "revisar") | (c("confianza_clasificacion") == "baja")
    missed = (c("_com") | c("_esp")) & (wet | mez | c("_maq") | c("_ind"))
    audit = vague | missed | (near & ~stage.isin("comercio_simple", "renta_prendas")) | c("decision_estudio_sugerida").isin("validar_documentalmente", "mantener_pendiente")
    scope = wet | c("_lav") | mez
    why_audit = [
        by_branch(None, b3="mezclilla/jeans sin evidencia directa de proceso humedo", b4="maquila o confeccion productiva sin senal humeda", b10="confeccion generica sin suficiente detalle operativo", b11="texto insuficiente o ambiguo"),
        F.when(c("_com") & (c("_ind") | c("_maq") | wet), F.lit("senal comercial mezclada con senal productiva")),
        F.when(near & ~flagged, F.lit("cercania a hidrografia requiere cautela documental")),
    ]
    evidence = [F.when(c("r_code") != "", F.concat(F.lit("SCIAN "), c("codigo")))] + [F.when(has[f], F.concat(F.lit(f"{f}: "), F.array_join(f"t_{f}", ", "))) for f in catalogue.families]
    rules = [F.when(c("r_code") != "", c("r_code"))] + [F.when(has[f], F.lit(f"texto_{f}")) for f in catalogue.families]
    parts = [F.coalesce(c(k), F.lit("")) for k in ("nombre", "localidad", "municipio")] + [F.lit("Puebla")]
    ending = codes.first_match([(stage == k, F.lit(v)) for k, v in STAGE_QUERIES.items()], STAGE_QUERY_DEFAULT)
    out = {
        "etapa_productiva_secundaria": _joined(second), "subtipo_confeccion": F.when(c("_esp"), "especializada_baja_relevancia").when(c("_maq"), "maquila_productiva").when(c("_con"), "generica").otherwise(""),
        "evidencia_clasificacion": F.concat_ws(" | ", *evidence), "reglas_activadas": _joined(rules),
        "palabras_clave_etapa": F.array_join(F.array_sort(F.array_distinct(F.concat(*(c(f"t_{f}") for f in KEYWORD_FAMILIES)))), "; "),
        "flag_estudio_prioritario": flagged, "prioridad_campo": field, "motivo_prioridad_campo": _joined([why_wet, why_field]),
        "motivo_flag_estudio_prioritario": F.when(flagged, F.coalesce(F.nullif(F.concat_ws("; ", why_wet, why_field), F.lit("")), F.concat_ws("; ", *evidence))).otherwise("sin senales suficientes de proceso humedo, tratamiento, mezclilla prioritaria o maquila relevante"),
        "flag_texto_ambiguo": vague, "flag_posible_falso_positivo": stage.isin("comercio_simple", "renta_prendas", "confeccion_especializada_baja_relevancia", "no_pertinente"),
        "flag_posible_falso_negativo": missed, "requiere_auditoria_manual": audit, "flag_requiere_auditoria_manual": audit,
        "motivo_auditoria": F.when(audit, _joined(why_audit)).otherwise(""), "prioridad_auditoria": F.when(flagged | near | missed, "alta").when(audit, "media").otherwise("baja"),
        "flag_universo_alcance_proyecto": scope, "flag_fuera_alcance_productivo_textil": ~scope, "decision_alcance_proyecto": F.when(scope, "dentro_alcance_proyecto").otherwise("fuera_alcance_contexto_textil"),
        "motivo_universo_alcance_proyecto": F.coalesce(F.nullif(F.concat_ws("; ", F.when(wet, "senal de proceso humedo o tratamiento"), F.when(c("_lav"), "senal especifica de lavado/deslavado/lavanderia"), F.when(mez, "senal de mezclilla/jeans")), F.lit("")), F.lit("textil fuera del alcance operativo definido para este proyecto")),
        "flag_proceso_humedo_relevante": wet, "tiene_senal_proceso_humedo": wet, "flag_mezclilla_jeans": mez, "tiene_senal_mezclilla_jeans": mez,
        "flag_lavado_deslavado": c("_lav"), "tiene_senal_lavado_deslavado": c("_lav"), "flag_tenido_tintoreria": c("_ten"), "tiene_senal_tenido_tintoreria": c("_ten"),
        "flag_acabado_tratamiento": c("_aca"), "tiene_senal_acabado_tratamiento": c("_aca"), "flag_senal_industrial": c("_ind"), "tiene_senal_industrial": c("_ind"), "tiene_senal_maquila": c("_maq"),
        "flag_maquila_productiva": c("_maq") | (stage == "confeccion_maquila"), "es_confeccion_especializada": c("_esp"),
        "flag_confeccion_especializada_baja_relevancia": stage == "confeccion_especializada_baja_relevancia", "es_comercio_o_renta": c("_com") | c("_ren"), "flag_comercio_o_renta": c("_com") | c("_ren"),
        "flag_prioridad_campo": field != "baja", "flag_cercania_hidrografia_250m": near,
        "query_maps": text.joined_once(parts, F.lit("Google Maps")), "query_web": text.joined_once(parts, ending),
    }
    df = df.withColumns(out).withColumns({k: F.lit("") for k in MANUAL})
    return df.drop(*[x for x in df.columns if x.startswith("_") or x.startswith("t_")])


def universes() -> dict[str, Column]:
    """The five nested study universes as predicates over classified rows."""
    gone = ["excluir_del_universo_prioritario", "excluir_por_comercio", "excluir_por_renta"]
    return {
        "A": F.lit(True),
        "B": ~F.col("decision_estudio_sugerida").isin(gone),
        "C": F.col("flag_universo_alcance_proyecto"),
        "D": F.col("flag_estudio_prioritario"),
        "E": F.col("requiere_auditoria_manual"),
    }
