"""DuckDB SQL for the registered queries, written from the operators' definitions and run on the same tables."""

from __future__ import annotations

from basinsift.functions import codes
from basinsift.functions.text import tokens_py
from basinsift.plans import cascade
from basinsift.plans.catalogue import COLORS, FAMILIES, FAMILY_NOTES, INSTRUCTIONS, LOCALITIES, OTHER_COLUMN, OTHER_VALUE, REGIONS, REVIEW_QUERIES, STAGE_QUERIES, STAGE_QUERY_DEFAULT
from basinsift.queries import DIMENSIONS, HIGH, KEYWORDS, MAKING, MEDIUM, OTHER, PREFIXES, PROSE, SELECTED, TRADE, TRADE_PREFIXES, WORDS


def q(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


def fold(x: str) -> str:
    return f"strip_accents(lower(coalesce({x}, '')))"


def norm(x: str) -> str:
    return f"trim(regexp_replace({fold(x)}, '\\s+', ' ', 'g'))"


def toks(x: str) -> str:
    return f"trim(regexp_replace({fold(x)}, '[^a-z0-9]+', ' ', 'g'))"


def slug(x: str) -> str:
    return f"trim(regexp_replace({fold(x)}, '[^a-z0-9]+', '_', 'g'), '_')"


def term(m: str, t: str) -> str:
    return f"contains(' ' || {m} || ' ', {q(f' {tokens_py(t)} ')})"


def anyterm(m: str, ts) -> str:
    return "(" + " OR ".join(term(m, t) for t in ts) + ")"


def anysub(m: str, ts) -> str:
    return "(" + " OR ".join(f"contains({m}, {q(t)})" for t in ts) + ")"


def found(m: str, ts, ordered: bool = True) -> str:
    ts = sorted(set(ts), key=lambda t: (len(t), t)) if ordered else ts
    return "concat_ws(', ', " + ", ".join(f"CASE WHEN {term(m, t)} THEN {q(t)} END" for t in ts) + ")"


def starts(x: str, prefixes) -> str:
    return "(" + " OR ".join(f"starts_with({x}, {q(p)})" for p in prefixes) + ")"


def rnd(x: str) -> str:
    return f"round({x}, 6)"


REG = r"""reg AS (
  SELECT doc_id AS id, concat_ws(' ', source, lang) AS nombre, text AS texto, lang, source,
    CASE doc_id % 9 WHEN 0 THEN '812210' WHEN 1 THEN '313110' WHEN 2 THEN '314120' WHEN 3 THEN '315225' WHEN 4 THEN '461122' WHEN 5 THEN '323119' WHEN 6 THEN '' WHEN 8 THEN 'x 541' END AS codigo,
    CASE lang WHEN 'en' THEN 'agebs\huejotzingo' WHEN 'fr' THEN 'Xalmimilulco' WHEN 'de' THEN 'san_martin' ELSE 'otra zona' END AS source_folder,
    CASE WHEN doc_id % 13 <> 0 THEN (doc_id * 7919 % 14000) / 10 END AS distancia
  FROM documents)"""
_pattern = "|".join(sorted(SELECTED, key=len, reverse=True))
SEA = f"""{REG}, sea0 AS MATERIALIZED (SELECT *, {norm("concat_ws(' ', nombre, texto)")} AS t, regexp_extract(coalesce(codigo, ''), '[0-9]+') AS code FROM reg),
sea AS MATERIALIZED (SELECT *, array_to_string(list_sort(list_distinct(regexp_extract_all(t, {q(_pattern)}))), '; ') AS palabras_clave,
  CASE WHEN {anysub("t", HIGH)} THEN 'alta_relevancia_ambiental' WHEN {anysub("t", MEDIUM)} THEN 'media_relevancia_ambiental' ELSE 'revisar' END AS categoria FROM sea0)"""

FAM = PROSE.families
_sig = ",\n  ".join(f"{found('m', ts)} AS f_{f}" for f, ts in FAM.items())
_exact = " ".join(f"WHEN cd = {q(k)} THEN {q(v)}" for k, v in codes.CODE_STAGES.items())
_pref = " ".join(f"WHEN starts_with(cd, {q(k)}) THEN {q(v)}" for k, v in codes.CODE_STAGES.items())
_exact_rule = " ".join(f"WHEN cd = {q(k)} THEN {q('scian_' + k)}" for k in codes.CODE_STAGES)
_pref_rule = " ".join(f"WHEN starts_with(cd, {q(k)}) THEN {q('scian_prefijo_' + k)}" for k in codes.CODE_STAGES)


def sorted_list(*parts: str) -> str:
    return f"array_to_string(list_sort(list_distinct(list_filter([{', '.join(parts)}], lambda x: x IS NOT NULL))), '; ')"


def once(parts: list[str], ending: str) -> str:
    kept = []
    for k, p in enumerate(parts):
        dup = "".join(f" AND ({toks(parts[j])} <> {toks(p)} OR trim({parts[j]}) = '')" for j in range(k))
        kept.append(f"CASE WHEN trim({p}) <> ''{dup} THEN trim({p}) END")
    return f"trim(concat_ws(' ', {', '.join(kept)}, {ending}))"


LOCATION = "CASE WHEN contains({0}, 'xalmimilulco') THEN 'Santa Ana Xalmimilulco' WHEN contains({0}, 'san martin') THEN 'San Martin Texmelucan' WHEN contains({0}, 'huejotzingo') THEN 'Huejotzingo' ELSE source_folder END"
TOWN = "CASE WHEN contains({0}, 'xalmimilulco') THEN 'Huejotzingo' WHEN contains({0}, 'san martin') THEN 'San Martin Texmelucan' WHEN contains({0}, 'huejotzingo') THEN 'Huejotzingo' ELSE '' END"
_folder = toks("source_folder")
_kw = ["lavado_deslavado", "lavanderia_industrial", "tenido_tintoreria", "acabado_tratamiento", "mezclilla_jeans", "industrial", "maquila", "confeccion_especializada", "comercio", "renta"]
_kw_terms = [t for f in _kw for t in FAM[f]]

CLS = f"""{SEA},
c1 AS MATERIALIZED (SELECT *, {toks("concat_ws(' ', nombre, t, coalesce(codigo, ''), palabras_clave)")} AS m, regexp_replace(coalesce(codigo, ''), '[^0-9]+', '', 'g') AS cd,
  {LOCATION.format(_folder)} AS localidad, {TOWN.format(_folder)} AS municipio FROM sea),
c2 AS MATERIALIZED (SELECT *, CASE {_exact} {_pref} ELSE '' END AS sc, CASE {_exact_rule} {_pref_rule} ELSE '' END AS rc,
  {_sig} FROM c1),
c3 AS MATERIALIZED (SELECT *, f_lavado_deslavado <> '' OR f_lavanderia_industrial <> '' AS lav, f_tenido_tintoreria <> '' AS ten, f_acabado_tratamiento <> '' AS aca, f_mezclilla_jeans <> '' AS mez,
  f_industrial <> '' AS ind, f_maquila <> '' AS maq, f_confeccion <> '' AS con, f_confeccion_especializada <> '' AS esp, f_comercio <> '' AS com, f_renta <> '' AS ren, f_no_textil <> '' AS non, f_bordado_estampado <> '' AS bor,
  coalesce(distancia <= 250, FALSE) AS near, {anyterm("m", PROSE.print_terms)} AS prn FROM c2),
c4 AS (SELECT *, lav OR ten OR aca OR sc = 'lavanderia_industrial' AS wet, ind OR maq OR mez AS made FROM c3),
c5 AS MATERIALIZED (SELECT *, CASE WHEN non AND NOT (wet OR mez OR maq) THEN 1 WHEN wet THEN 2 WHEN mez AND (maq OR ind OR con OR sc = 'confeccion_maquila') THEN 3
  WHEN maq OR (sc = 'confeccion_maquila' AND (ind OR con)) THEN 4 WHEN bor THEN 5 WHEN esp AND NOT made THEN 6 WHEN ren AND NOT made THEN 7 WHEN com AND NOT made THEN 8
  WHEN sc = 'fabricacion_textil' THEN 9 WHEN sc = 'confeccion_maquila' OR con THEN 10 ELSE 11 END AS b FROM c4),
c6 AS MATERIALIZED (SELECT *, CASE b WHEN 1 THEN 'no_pertinente'
    WHEN 2 THEN CASE WHEN f_lavado_deslavado <> '' THEN 'lavado_deslavado' WHEN f_lavanderia_industrial <> '' OR sc = 'lavanderia_industrial' THEN 'lavanderia_industrial' WHEN ten THEN 'tenido_tintoreria' ELSE 'acabado_textil' END
    WHEN 3 THEN 'fabricacion_mezclilla' WHEN 4 THEN 'confeccion_maquila' WHEN 5 THEN if(prn, 'estampado_serigrafia', 'bordado') WHEN 6 THEN 'confeccion_especializada_baja_relevancia'
    WHEN 7 THEN 'renta_prendas' WHEN 8 THEN 'comercio_simple' WHEN 9 THEN 'fabricacion_textil' WHEN 10 THEN if(ind, 'confeccion_maquila', 'revisar') ELSE 'revisar' END AS st,
  CASE WHEN b = 2 THEN 'alta' WHEN b IN (3, 4, 9) OR (b = 5 AND prn) OR (b = 10 AND ind) THEN 'media' WHEN b IN (1, 5, 6, 7, 8) THEN 'baja' ELSE 'pendiente' END AS pr,
  CASE WHEN b IN (1, 6) THEN 'excluir_del_universo_prioritario' WHEN b = 2 THEN 'incluir_prioritario' WHEN b = 3 OR (b = 5 AND prn) OR (b = 10 AND ind) THEN 'validar_documentalmente'
    WHEN b IN (4, 5, 9) THEN 'incluir_contexto_productivo' WHEN b = 7 THEN 'excluir_por_renta' WHEN b = 8 THEN 'excluir_por_comercio' ELSE 'mantener_pendiente' END AS de,
  CASE WHEN b IN (6, 7, 8) OR (b = 2 AND (f_lavado_deslavado <> '' OR ten OR aca)) THEN 'alta' WHEN b = 11 OR (b = 10 AND NOT ind) THEN 'baja' ELSE 'media' END AS cf,
  CASE b WHEN 1 THEN 'senal no textil sin senales productivas relevantes' WHEN 6 THEN 'confeccion especializada o sobre medida sin senales industriales ni humedas'
    WHEN 7 THEN 'renta o alquiler de prendas sin senales productivas' WHEN 8 THEN 'comercio de prendas o accesorios sin senales productivas' ELSE '' END AS ex,
  wet OR (mez AND (lav OR ten OR aca OR ind OR maq)) AS pri, (com OR esp) AND (wet OR mez OR maq OR ind) AS fneg, wet OR lav OR mez AS scope FROM c5),
c7 AS (SELECT *, st = 'revisar' OR cf = 'baja' AS amb, st IN ('fabricacion_mezclilla', 'confeccion_maquila', 'estampado_serigrafia') AS prod FROM c6),
c8 AS MATERIALIZED (SELECT *, amb OR fneg OR (near AND st NOT IN ('comercio_simple', 'renta_prendas')) OR de IN ('validar_documentalmente', 'mantener_pendiente') AS aud,
  CASE WHEN wet AND near THEN 'muy_alta' WHEN wet THEN 'alta' WHEN (prod OR mez) AND near THEN 'media' WHEN prod OR st = 'fabricacion_textil' THEN 'media'
    WHEN near AND st NOT IN ('comercio_simple', 'renta_prendas', 'confeccion_especializada_baja_relevancia') THEN 'documental' ELSE 'baja' END AS fp,
  CASE WHEN wet AND near THEN 'proceso humedo o tratamiento y distancia <= 250 m a hidrografia' WHEN wet THEN 'proceso humedo o tratamiento' WHEN (prod OR mez) AND near THEN 'actividad productiva o ambigua cerca de hidrografia'
    WHEN prod OR st = 'fabricacion_textil' THEN 'contexto productivo textil' WHEN near AND st NOT IN ('comercio_simple', 'renta_prendas', 'confeccion_especializada_baja_relevancia') THEN 'registro ambiguo cerca de hidrografia' END AS why,
  CASE WHEN b = 2 THEN 'senal compatible con proceso humedo o tratamiento de prendas' END AS wwet,
  concat_ws(' | ', CASE WHEN rc <> '' THEN 'SCIAN ' || codigo END, {", ".join(f"CASE WHEN f_{f} <> '' THEN '{f}: ' || f_{f} END" for f in FAM)}) AS evi FROM c7),
cls AS MATERIALIZED (SELECT *, CASE WHEN pri OR near OR fneg THEN 'alta' WHEN aud THEN 'media' ELSE 'baja' END AS pa,
  {sorted_list(*(f"CASE WHEN {term('m', t)} THEN {q(t)} END" for t in _kw_terms))} AS kws FROM c8)"""

FLAG_SQL = dict(
    flag_universo_alcance_proyecto="scope", flag_fuera_alcance_productivo_textil="NOT scope", flag_estudio_prioritario="pri", flag_proceso_humedo_relevante="wet", flag_mezclilla_jeans="mez",
    flag_lavado_deslavado="lav", flag_tenido_tintoreria="ten", flag_acabado_tratamiento="aca", flag_maquila_productiva="(maq OR st = 'confeccion_maquila')",
    flag_confeccion_especializada_baja_relevancia="st = 'confeccion_especializada_baja_relevancia'", flag_comercio_o_renta="(com OR ren)", flag_requiere_auditoria_manual="aud", flag_prioridad_campo="fp <> 'baja'",
    flag_cercania_hidrografia_250m="near", flag_senal_industrial="ind", flag_texto_ambiguo="amb",
    flag_posible_falso_positivo="st IN ('comercio_simple', 'renta_prendas', 'confeccion_especializada_baja_relevancia', 'no_pertinente')", flag_posible_falso_negativo="fneg",
    tiene_senal_proceso_humedo="wet", tiene_senal_mezclilla_jeans="mez", tiene_senal_lavado_deslavado="lav", tiene_senal_tenido_tintoreria="ten", tiene_senal_acabado_tratamiento="aca", tiene_senal_industrial="ind",
    tiene_senal_maquila="maq", es_confeccion_especializada="esp", es_comercio_o_renta="(com OR ren)", requiere_auditoria_manual="aud",
)
GONE = "de IN ('excluir_por_comercio', 'excluir_por_renta', 'excluir_del_universo_prioritario')"
_stage_query = "CASE st " + " ".join(f"WHEN {q(k)} THEN {q(v)}" for k, v in STAGE_QUERIES.items()) + f" ELSE {q(STAGE_QUERY_DEFAULT)} END"

_last = "DEC AS (SELECT doc_id AS id, CASE WHEN toxic = 1 THEN 'Alto' WHEN quality = 0 THEN 'MEDIA relevancia' WHEN doc_id % 3 = 0 THEN 'baja' ELSE '' END AS cat, CASE WHEN quality = 0 THEN 'bordado' ELSE ' ' END AS etapa, CASE WHEN toxic = 1 THEN 'nota ' || doc_id END AS nota, CASE doc_id % 4 WHEN 0 THEN 'Excluir por comercio' WHEN 1 THEN 'no valida' ELSE '' END AS deci FROM labels)"
_canon = "CASE WHEN cat = 'Alto' THEN 'alta_relevancia_ambiental' WHEN cat = 'MEDIA relevancia' THEN 'media_relevancia_ambiental' ELSE '' END"
OVER = f"""WITH {SEA}, {_last}, o AS (SELECT CAST(sea.id AS VARCHAR) AS id, source_folder, categoria, coalesce({_canon}, '') AS cc, coalesce(nota, '') AS notas_auditoria FROM sea LEFT JOIN DEC ON sea.id = DEC.id),
 ov AS (SELECT id, source_folder, CASE WHEN categoria = 'revisar' THEN if(cc <> '', cc, 'pendiente_auditoria') ELSE categoria END AS categoria_final,
  CASE WHEN categoria = 'revisar' THEN if(cc <> '', 'auditado_manual', 'pendiente_auditoria') ELSE 'clasificacion_automatica' END AS estado_auditoria, notas_auditoria FROM o)"""

PTS = "pts AS (SELECT c_custkey AS id, CAST(c_custkey * 7919 % 20000 AS DOUBLE) AS x, CAST(c_custkey * 10473 % 20000 AS DOUBLE) AS y, c_mktsegment FROM customer)"
SEG = "v AS (SELECT s_suppkey AS k, CAST(s_suppkey * 3571 % 20000 AS DOUBLE) AS x, CAST(s_suppkey * 9173 % 20000 AS DOUBLE) AS y FROM supplier), seg AS (SELECT a.x AS x1, a.y AS y1, b.x AS x2, b.y AS y2 FROM v a JOIN v b ON b.k = a.k + 1)"
DIST = f"""{PTS}, {SEG}, pair AS (SELECT id, c_mktsegment, x, y, x1, y1, x2 - x1 AS dx, y2 - y1 AS dy FROM pts, seg),
 tt AS (SELECT *, greatest(0.0, least(1.0, coalesce(((x - x1) * dx + (y - y1) * dy) / nullif(dx * dx + dy * dy, 0), 0.0))) AS t FROM pair),
 dist AS (SELECT id, any_value(c_mktsegment) AS c_mktsegment, min(sqrt((x - x1 - t * dx) * (x - x1 - t * dx) + (y - y1 - t * dy) * (y - y1 - t * dy))) AS d FROM tt GROUP BY id)"""
BAND = "CASE WHEN {0} IS NULL THEN 'sin distancia' WHEN {0} <= 100 THEN '0-100 m' WHEN {0} <= 250 THEN '100-250 m' WHEN {0} <= 500 THEN '250-500 m' WHEN {0} <= 1000 THEN '500-1000 m' ELSE '>1000 m' END"
CEN = """cen AS (SELECT l_orderkey, l_linenumber, lpad(CAST(n_nationkey AS VARCHAR), 3, '0') AS cve, n_name AS mun, lpad(CAST(n_nationkey AS VARCHAR), 3, '0') || ' ' || n_name AS municipio, 'Subsector 313 ' || p_type AS actividad,
  p_size % 3 AS s3, l_quantity AS ue, l_extendedprice AS valor, l_discount AS pago, l_tax AS insumo
  FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey JOIN part ON l_partkey = p_partkey)"""

_region = "CASE WHEN contains({0}, 'xalmimilulco') THEN 'xalmimilulco' WHEN contains({0}, 'san martin') THEN 'san_martin' WHEN contains({0}, 'huejotzingo') THEN 'huejotzingo' ELSE '' END".format(_folder)
_place = lambda k: "CASE region_auditoria " + " ".join(f"WHEN {q(r)} THEN {q(v[k])}" for r, v in REGIONS.items()) + " ELSE '' END"
REV = f"""{REG}, r1 AS MATERIALIZED (SELECT *, {toks("concat_ws(' ', nombre, coalesce(codigo, 'nan'), texto, source_folder)")} AS m, {_region} AS region_auditoria FROM reg),
r2 AS MATERIALIZED (SELECT *, {found("m", KEYWORDS["alta"], False)} AS ka, {found("m", KEYWORDS["media"], False)} AS km, {found("m", KEYWORDS["baja"], False)} AS kb, {_place(0)} AS localidad_auditoria, {_place(1)} AS municipio_auditoria FROM r1),
r3 AS MATERIALIZED (SELECT *, CASE WHEN ka <> '' THEN 'alta' WHEN km <> '' THEN 'media' WHEN kb <> '' THEN 'excluir' ELSE 'revisar' END AS categoria_sugerida,
  concat_ws(' | ', CASE WHEN ka <> '' THEN 'alta: ' || ka END, CASE WHEN km <> '' THEN 'media: ' || km END, CASE WHEN kb <> '' THEN 'baja_comercio: ' || kb END) AS keywords_detectadas FROM r2),
rev AS (SELECT *, CASE WHEN categoria_sugerida = 'alta' OR coalesce(distancia <= 250, FALSE) THEN 'alta' WHEN categoria_sugerida = 'media' THEN 'media' WHEN categoria_sugerida = 'excluir' THEN 'baja' ELSE 'manual' END AS prioridad_revision,
  CASE categoria_sugerida WHEN 'alta' THEN 'posible proceso humedo/textil: contiene keywords de lavado, tenido, tintoreria, acabado o insumos quimicos' WHEN 'media' THEN 'posible proceso productivo textil sin evidencia humeda/quimica'
    WHEN 'excluir' THEN 'parece comercio simple de prendas o telas' ELSE 'sin evidencia suficiente; requiere revision manual' END AS criterio_auditoria_sugerido FROM r3)"""
_order = "CASE prioridad_revision WHEN 'alta' THEN 0 WHEN 'manual' THEN 1 WHEN 'media' THEN 2 WHEN 'baja' THEN 3 ELSE 4 END, distancia ASC NULLS LAST, CASE categoria_sugerida WHEN 'alta' THEN 0 WHEN 'revisar' THEN 1 WHEN 'media' THEN 2 WHEN 'excluir' THEN 3 ELSE 4 END, id"
_review_query = "CASE categoria_sugerida " + " ".join(f"WHEN {q(k)} THEN {q(v)}" for k, v in REVIEW_QUERIES.items()) + " END"
_rev_parts = ["nombre", "localidad_auditoria", "municipio_auditoria", "'Puebla'"]

_words = "[" + ", ".join(map(q, WORDS)) + "]"
_word = f"({_words})[CAST(o_orderkey % {len(WORDS)} AS INTEGER) + 1]"


def tall(name: str, rows: dict[str, str], source: str) -> str:
    return " UNION ALL ".join(f"SELECT {q(k)} AS {name}, coalesce(count(*) FILTER (WHERE {v}), 0) AS n FROM {source}" for k, v in rows.items())


def _ratio(a: str, b: str, name: str) -> str:
    return f"{rnd(f'sum({a}) / nullif(sum({b}), 0)')} AS {name}"


_ratios = ", ".join([_ratio("valor", "ue", "valor_por_ue"), _ratio("pago", "ue", "pago_por_ue"), _ratio("insumo", "pago", "insumo_por_pago")])
_inventory = {
    "region": "r_regionkey, r_name", "nation": "n_nationkey, n_name, n_regionkey", "customer": "c_custkey, c_name, c_nationkey, c_acctbal, c_mktsegment", "supplier": "s_suppkey, s_name, s_nationkey, s_acctbal",
    "part": "p_partkey, p_name, p_brand, p_type, p_size, p_retailprice", "orders": "o_orderkey, o_custkey, o_orderstatus, o_totalprice, o_orderdate, o_orderpriority",
    "lineitem": "l_orderkey, l_partkey, l_suppkey, l_linenumber, l_quantity, l_extendedprice, l_discount, l_tax, l_returnflag, l_linestatus, l_shipdate", "documents": "doc_id, text, lang, source, n_chars",
}
_dim = {"municipio": "municipio", "localidad": "localidad", "codigo": "codigo", "etapa_productiva_sugerida": "st", "presion_ambiental_potencial": "pr", "confianza_clasificacion": "cf", "prioridad_auditoria": "pa", "prioridad_campo": "fp", "rango": BAND.format("distancia"), "flag_estudio_prioritario": "pri", "flag_universo_alcance_proyecto": "scope", "flag_proceso_humedo_relevante": "wet", "flag_mezclilla_jeans": "mez", "decision_alcance_proyecto": "if(scope, 'dentro_alcance_proyecto', 'fuera_alcance_contexto_textil')", "motivo_exclusion_prioritaria": "ex"}
assert list(_dim) == DIMENSIONS
_specs = {"prioritarios": "pri", "humedos": "wet", "mezclilla": "mez", "alta": "pr = 'alta'", "muy_alta": "fp = 'muy_alta'", "cerca": "near", "comercio": "(com OR ren)"}
_local = {f"{k}_{p}": f"({v}) AND localidad = {q(p)}" for p in LOCALITIES for k, v in _specs.items()}
_check = {"etapa_productiva_sugerida": "st", "presion_ambiental_potencial": "pr", "confianza_clasificacion": "cf", "decision_estudio_sugerida": "de"}
_sheets = {
    "todos_clasificados": "TRUE", "universo_alcance_proyecto": "scope", "alcance_huejotzingo": f"scope AND localidad = {q(LOCALITIES[0])}", "alcance_xalmimilulco": f"scope AND localidad = {q(LOCALITIES[1])}", "alcance_san_martin": f"scope AND localidad = {q(LOCALITIES[2])}",
    "universo_prioritario": "pri", "procesos_humedos": "pr = 'alta'", "mezclilla_jeans": "regexp_matches(kws, 'with the|avec', 'i')", "auditoria_obligatoria": "pa IN ('alta', 'media')", "pendientes": "de IN ('mantener_pendiente', 'validar_documentalmente')",
    "excluidos_comercio": "st = 'comercio_simple'", "excluidos_confeccion_especializada": "st = 'confeccion_especializada_baja_relevancia'", "cercanos_hidrografia_250m": "distancia <= 250", "posibles_duplicados": "same > 1",
}
_marks = {"prioritarios": "pri", "universo_alcance_proyecto": "scope", "excluidos_comercio": "de = 'excluir_por_comercio'", "excluidos_renta": "de = 'excluir_por_renta'", "confeccion_especializada": "st = 'confeccion_especializada_baja_relevancia'", "ambiguos_auditar": "aud", "procesos_humedos": "wet"}
_scope_marks = {"universo_alcance_proyecto": "scope", "procesos_humedos": "wet", "lavado_deslavado": "lav", "mezclilla_jeans": "mez", "fuera_alcance_contexto_textil": "NOT scope"}
# Clean headers written out: the tables' own names are clean already, the same four odd headers follow each table.
_odd = [[("Año Censal", "ano_censal"), ("", "columna"), ("% total", "total"), ("Año  censal", "ano_censal_2")], [("Año Censal", "ano_censal_3"), ("", "columna_2"), ("% total", "total_2"), ("Año  censal", "ano_censal_4")], [("Año Censal", "ano_censal_5"), ("", "columna_3"), ("% total", "total_3"), ("Año  censal", "ano_censal_6")]]
_heads = [h for t, odd in zip(("customer", "supplier", "part"), _odd, strict=True) for h in [*((c, c) for c in _inventory[t].split(", ")), *odd]]
_split0 = f"cand AS (SELECT *, {starts('code', PREFIXES)} OR {anysub('t', SELECTED)} AS candidate, {starts('code', TRADE_PREFIXES)} OR ({anysub('t', TRADE)} AND NOT {anysub('t', MAKING)}) AS ex_trade, {anysub('t', OTHER)} AND NOT {starts('code', PREFIXES)} AS ex_other FROM sea0)"
_hex_rows = int(34 / 3**0.5)

BORDER = """ring AS (SELECT n_nationkey AS id, (n_nationkey % 5) * 4000.0::DOUBLE + 2000 AS cx, (n_nationkey // 5) * 4000.0::DOUBLE + 2000 AS cy FROM nation),
 border AS (SELECT id, cx + a * 2200 AS x1, cy + b * 2200 AS y1, cx - b * 2200 AS x2, cy + a * 2200 AS y2 FROM ring, (VALUES (1, 0), (0, 1), (-1, 0), (0, -1)) v(a, b))"""


def _color(column: str, x: str) -> str:
    return f"CASE {x} " + " ".join(f"WHEN {q(k)} THEN {q(v)}" for k, v in COLORS[column].items()) + f" ELSE {q(OTHER_VALUE)} END"


ORACLES: dict[str, str] = {
    "scan_project": "SELECT 'lineitem' AS layer, l_orderkey, CAST(l_linenumber AS VARCHAR) AS line_text, l_quantity AS quantity, CASE l_returnflag WHEN 'N' THEN 'none' ELSE l_returnflag END AS flag FROM lineitem",
    "numeric_row_filter": "SELECT CAST(y AS DOUBLE) AS year, count(*) AS n FROM (SELECT CASE WHEN doc_id % 7 = 0 THEN NULL WHEN doc_id % 5 = 0 THEN doc_id % 30 + 2000 WHEN doc_id % 11 = 0 THEN NULL ELSE doc_id % 30 + 1990 END AS y FROM documents) WHERE y IS NOT NULL GROUP BY y",
    "union_tagged": "SELECT 'customer' AS region_auditoria, count(*) AS n, count(c_acctbal) AS n_balance, CAST(0 AS BIGINT) AS n_size, count(DISTINCT c_name) AS n_names FROM customer UNION ALL SELECT 'supplier', count(*), 0, 0, count(DISTINCT s_name) FROM supplier UNION ALL SELECT 'part', count(*), 0, count(p_size), count(DISTINCT p_name) FROM part",
    "table_inventory": " UNION ALL ".join(f"SELECT {q(t)} AS name, count(*) AS n_rows, CAST({len(c.split(', '))} AS BIGINT) AS n_columns, {q(c)} AS columns FROM {t}" for t, c in _inventory.items()),
    "null_to_empty": "SELECT d.doc_id, CASE WHEN toxic = 1 THEN 'toxic' ELSE '' END AS mark, CASE WHEN quality = 1 THEN source ELSE '' END AS good_source, quality FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id",
    "error_quarantine": "SELECT conv_id, turn, role, CAST(length(text) AS INTEGER) AS n, 'short or unknown role' AS error FROM conversations WHERE length(text) < 40 OR role NOT IN ('user', 'assistant')",
    "code_prefix_filter": f"WITH {REG} SELECT id, codigo FROM reg WHERE {starts("regexp_extract(coalesce(codigo, ''), '[0-9]+')", PREFIXES)}",
    "keyword_candidates": f"WITH {SEA} SELECT id, palabras_clave FROM sea WHERE {anysub('t', SELECTED)}",
    "exclusion_rules": f"WITH {SEA}, {_split0} SELECT id, ex_trade, ex_other FROM cand",
    "candidate_split": f"WITH {SEA}, {_split0} SELECT id, CASE WHEN candidate AND NOT ex_trade AND NOT ex_other THEN 'included' WHEN candidate THEN 'excluded' ELSE 'none' END AS part FROM cand",
    "universe_depurado": f"WITH {CLS} SELECT id, de AS decision_estudio_sugerida FROM cls WHERE NOT {GONE}",
    "layer_classifier": "SELECT page_id, (['denue', 'agebs', 'hidrografia', NULL, 'manzanas', 'localidades', 'vialidades', 'caminos_carreteras', 'cuencas', NULL])[CAST(page_id % 10 AS INTEGER) + 1] AS layer FROM pages",
    "source_filter": f"WITH {REG} SELECT id, source_folder FROM reg WHERE lang IN ('de', 'fr')",
    "geometry_family": "SELECT p_brand, family, count(*) AS n, string_agg(DISTINCT kind, ', ' ORDER BY kind) AS kinds FROM (SELECT p_brand, (['Point', 'LineString', 'MultiLineString', 'Polygon', 'MultiPolygon', ''])[CAST(p_partkey % 6 AS INTEGER) + 1] AS kind, (['point', 'line', 'line', 'polygon', 'polygon', NULL])[CAST(p_partkey % 6 AS INTEGER) + 1] AS family FROM part) WHERE family IS NOT NULL GROUP BY ALL",
    "bbox_crop": f"WITH {PTS} SELECT id, 'cropped' AS kind FROM pts WHERE x BETWEEN 4500 AND 9500 AND y BETWEEN 4500 AND 9500 UNION ALL SELECT id, 'fallback' FROM pts",
    "safe_numeric": "SELECT p_partkey, CASE WHEN p_size % 5 = 0 OR p_size % 7 = 0 OR p_size % 11 = 0 THEN NULL ELSE p_size + 0.5::DOUBLE END AS value, CAST(NULL AS DOUBLE) AS absent FROM part",
    "map_spec_counts": f"WITH {CLS} " + tall("spec", _specs | _local, "cls"),
    "left_enrich": "SELECT d.doc_id, source, quality, toxic FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id",
    "positional_zip": "SELECT position, c_custkey, s_suppkey FROM (SELECT row_number() OVER (ORDER BY c_custkey DESC) AS position, c_custkey FROM customer) JOIN (SELECT row_number() OVER (ORDER BY s_suppkey) AS position, s_suppkey FROM supplier) USING (position)",
    "audit_overlay": f"{OVER} SELECT id, categoria_final, estado_auditoria, notas_auditoria FROM ov",
    "audit_final": f"{OVER} SELECT source_folder, categoria_final AS categoria, count(*) AS n FROM ov WHERE categoria_final IN ('alta_relevancia_ambiental', 'media_relevancia_ambiental') GROUP BY ALL",
    "productive_overlay": f"""WITH {CLS}, {_last} SELECT CAST(cls.id AS VARCHAR) AS id, CASE WHEN deci = 'Excluir por comercio' THEN 'excluir_por_comercio' ELSE de END AS decision_estudio_final, CASE WHEN trim(coalesce(etapa, '')) <> '' THEN etapa ELSE st END AS etapa_productiva_final,
      CASE WHEN coalesce({_canon}, '') <> '' THEN {_canon} ELSE categoria END AS categoria_ambiental_final,
      CASE WHEN coalesce(deci, '') <> '' OR trim(coalesce(etapa, '')) <> '' OR coalesce({_canon}, '') <> '' THEN 'auditado_manual' ELSE 'sin_decision_manual' END AS estado_auditoria_productiva FROM cls LEFT JOIN DEC ON cls.id = DEC.id""",
    "nearest_distance": f"WITH {DIST} SELECT id, {rnd('d')} AS distance FROM dist",
    "point_in_polygon": f"""WITH {PTS}, dia AS (SELECT n_nationkey AS poly_id, (n_nationkey % 5) * 4000.0 + 2000.0 AS cx, (n_nationkey // 5) * 4000.0 + 2000.0 AS cy FROM nation)
      SELECT poly_id, count(*) AS n FROM pts LEFT JOIN dia ON abs(x - cx) + abs(y - cy) < 2200 GROUP BY poly_id""",
    "choropleth_join": "SELECT n_name AS nombre, n_nationkey AS clave, coalesce(n, 0) AS n FROM nation LEFT JOIN (SELECT s_nationkey AS k, count(*) AS n FROM supplier WHERE s_acctbal > 2000 GROUP BY 1) ON n_nationkey = k",
    "source_to_location": f"WITH {REG} SELECT id, {LOCATION.format(_folder)} AS localidad, {TOWN.format(_folder)} AS municipio, {_region} AS region FROM reg",
    "membership_probe": "SELECT 'part' AS side, count(*) AS n FROM part WHERE p_partkey IN (SELECT l_partkey FROM lineitem) UNION ALL SELECT 'customer', count(*) FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders) UNION ALL SELECT 'nation', count(*) FROM nation WHERE n_nationkey IN (SELECT r_regionkey FROM region)",
    "group_count": "SELECT source, toxic, count(*) AS n FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id GROUP BY ALL",
    "count_by_dimension": f"WITH {CLS} " + " UNION ALL ".join(f"SELECT {q(k)} AS dimension, CAST({v} AS VARCHAR) AS value, count(*) AS n FROM cls GROUP BY 2" for k, v in _dim.items()),
    "transition_matrix": f"WITH {CLS} SELECT categoria, st AS etapa_productiva_sugerida, de AS decision_estudio_sugerida, count(*) AS n FROM cls GROUP BY ALL",
    "census_rollup": f"WITH {CEN} SELECT cve, mun, actividad, {rnd("sum(CASE WHEN NOT contains(actividad, 'BRASS') THEN ue END)")} AS ue, {rnd('sum(valor)')} AS valor, {rnd('sum(pago)')} AS pago, {rnd('sum(insumo)')} AS insumo FROM cen GROUP BY ALL",
    "ratio_of_sums": f"WITH {CEN} SELECT municipio, {_ratios} FROM cen GROUP BY ALL",
    "row_ratios": "SELECT l_orderkey, l_linenumber, l_tax / nullif(l_discount, 0) AS tax_per_discount, l_extendedprice / nullif(l_quantity, 0) AS price_each FROM lineitem",
    "micro_stratum": f"WITH {CEN} SELECT actividad, {', '.join(f'{rnd(f'sum({c})')} AS {c}' for c in ('ue', 'valor', 'pago', 'insumo'))}, {_ratios} FROM cen WHERE s3 = 0 GROUP BY ALL",
    "municipal_summary": f"WITH {CEN} SELECT municipio, 'estrato ' || s3 * 10 || ' a ' || s3 * 10 + 10 AS estrato, {rnd('coalesce(sum(ue) FILTER (WHERE pago > 0.09 AND l_linenumber > 1), 0)')} AS ue, {rnd('coalesce(sum(valor), 0)')} AS valor, {rnd('sum(valor) / nullif(coalesce(sum(ue) FILTER (WHERE pago > 0.09 AND l_linenumber > 1), 0), 0)')} AS valor_por_ue FROM cen GROUP BY ALL",
    "total_bounds": f"""WITH {PTS}, {SEG}, e AS (SELECT x, y FROM pts UNION ALL SELECT x1, y1 FROM seg UNION ALL SELECT x2, y2 FROM seg), b AS (SELECT min(x) AS minx, min(y) AS miny, max(x) AS maxx, max(y) AS maxy FROM e)
      SELECT *, '{{"minx":' || CAST(minx AS BIGINT) || ',"miny":' || CAST(miny AS BIGINT) || ',"maxx":' || CAST(maxx AS BIGINT) || ',"maxy":' || CAST(maxy AS BIGINT) || '}}' AS bounds_json FROM b""",
    "flag_tally": f"WITH {CLS} " + " UNION ALL ".join(f"SELECT {q(f)} AS flag, count(*) FILTER (WHERE {FLAG_SQL[f]}) AS n_true, count(*) FILTER (WHERE NOT ({FLAG_SQL[f]})) AS n_false FROM cls" for f in cascade.FLAGS),
    "locality_flag_matrix": f"WITH {CLS} " + " UNION ALL ".join(f"SELECT {q(p)} AS localidad, {q(k)} AS categoria_alcance, count(*) FILTER (WHERE ({v}) AND localidad = {q(p)}) AS n FROM cls" for p in [*LOCALITIES, "Ninguna"] for k, v in _scope_marks.items()),
    "buffer_counts": f"WITH {DIST} SELECT buffer_m, c_mktsegment, count(*) AS n FROM dist JOIN (VALUES (100), (250), (500), (1000)) AS t(buffer_m) ON d <= buffer_m GROUP BY ALL",
    "pivot_counts": "SELECT source, " + ", ".join(f"count(*) FILTER (WHERE lang = '{x}') AS {x}" for x in ("de", "en", "es", "fr")) + " FROM documents d JOIN labels l ON d.doc_id = l.doc_id WHERE quality IS NOT NULL GROUP BY source",
    "audit_kpis": f"WITH {REV} " + tall("kpi", {"total_registros": "TRUE", "posible_alta_relevancia": "categoria_sugerida = 'alta'", "cercanos_hidrografia": "distancia <= 250", "requieren_revision_manual": "categoria_sugerida = 'revisar'", "probablemente_excluibles": "categoria_sugerida = 'excluir'"}, "rev"),
    "audit_status": f"WITH {_last}, u AS (SELECT 'revisar' AS cat, '' AS nota FROM labels UNION ALL SELECT cat, nota FROM DEC) SELECT 'total' AS estado, count(*) AS registros FROM u UNION ALL SELECT 'pendientes_categoria', count(*) FILTER (WHERE cat = '') FROM u UNION ALL SELECT 'auditados_categoria', count(*) FILTER (WHERE cat <> '') FROM u UNION ALL SELECT 'con_notas', count(*) FILTER (WHERE nota <> '') FROM u",
    "universe_counts": f"WITH {CLS} " + tall("universe", {"A": "TRUE", "B": f"NOT {GONE}", "C": "scope", "D": "pri", "E": "aud"}, "cls"),
    "map_center": f"WITH {PTS} SELECT 'all' AS layer, {rnd('avg(x)')} AS cx, {rnd('avg(y)')} AS cy FROM pts UNION ALL SELECT 'empty', 10000.0::DOUBLE, 10000.0::DOUBLE",
    "histogram_quartiles": f"""WITH s AS (SELECT min(c_acctbal) AS lo, max(c_acctbal) AS hi, {rnd('quantile_cont(c_acctbal, 0.25)')} AS q1, {rnd('quantile_cont(c_acctbal, 0.5)')} AS q2, {rnd('quantile_cont(c_acctbal, 0.75)')} AS q3 FROM customer)
      SELECT CAST(least(19, floor((c_acctbal - lo) / ((hi - lo) / 20))) AS BIGINT) AS bin, count(*) AS n, q1, q2, q3 FROM customer, s GROUP BY ALL""",
    "hexbin": f"""WITH {PTS}, s AS (SELECT min(x) AS x0, min(y) AS y0, (max(x) - min(x)) / 34 AS w, (max(y) - min(y)) / {_hex_rows} AS h FROM pts), u AS (SELECT *, (x - x0) / w AS a, (y - y0) / h AS b FROM pts, s),
      e AS (SELECT *, (a - floor(a + 0.5)) * (a - floor(a + 0.5)) + 3 * (b - floor(b + 0.5)) * (b - floor(b + 0.5)) < (a - floor(a) - 0.5) * (a - floor(a) - 0.5) + 3 * (b - floor(b) - 0.5) * (b - floor(b) - 0.5) AS one FROM u)
      SELECT {rnd("if(one, floor(a + 0.5), floor(a) + 0.5) * w + x0")} AS hx, {rnd("if(one, floor(b + 0.5), floor(b) + 0.5) * h + y0")} AS hy, count(*) AS n FROM e GROUP BY 1, 2""",
    "possible_duplicates": "SELECT p_partkey, p_name, p_brand, n FROM part JOIN (SELECT p_name, p_brand, count(*) AS n FROM part GROUP BY ALL HAVING count(*) > 1) USING (p_name, p_brand)",
    "quality_checks": f"""WITH {CLS} SELECT 'sin_perdida_registros' AS validacion, count(*) = (SELECT count(*) FROM documents) AS ok, count(*) || ' de ' || (SELECT count(*) FROM documents) AS detalle FROM cls
      UNION ALL SELECT 'ids_duplicados', count(*) = count(DISTINCT id), '' FROM cls """
    + " ".join(f"UNION ALL SELECT 'campo_critico_{k}', count(*) FILTER (WHERE {v} = '') = 0, 'vacios=' || count(*) FILTER (WHERE {v} = '') FROM cls" for k, v in _check.items())
    + f""" UNION ALL SELECT 'prioritarios_con_motivo', TRUE, 'sin_motivo=0' UNION ALL SELECT 'excluidos_con_senal_humeda', count(*) FILTER (WHERE wet AND {GONE}) = 0, 'casos=' || count(*) FILTER (WHERE wet AND {GONE}) FROM cls
      UNION ALL SELECT 'comercio_con_senal_industrial_identificado', TRUE, 'casos_para_revision=' || count(*) FILTER (WHERE (com OR ren) AND ind) FROM cls
      UNION ALL SELECT 'cercanos_no_prioritarios_sin_auditoria', count(*) FILTER (WHERE near AND NOT aud AND NOT pri) = 0, 'casos=' || count(*) FILTER (WHERE near AND NOT aud AND NOT pri) FROM cls""",
    "dedup_keep_last": "SELECT o_custkey, max(o_orderkey) AS o_orderkey, max_by(o_orderpriority, o_orderkey) AS o_orderpriority FROM orders GROUP BY o_custkey",
    "representative_sample": f"WITH {CLS}, lab AS (" + " UNION ALL ".join(f"SELECT {q(k)} AS tipo_ejemplo, id FROM cls WHERE {v}" for k, v in _marks.items()) + ") SELECT tipo_ejemplo, id, n FROM (SELECT *, row_number() OVER (PARTITION BY tipo_ejemplo ORDER BY id) AS n FROM lab) WHERE n <= 15",
    "surrogate_id": "SELECT row_number() OVER (ORDER BY p_name, p_partkey) AS row_id, p_partkey FROM part",
    "unique_headers": "SELECT CAST(p AS BIGINT) AS position, raw, clean FROM (VALUES " + ", ".join(f"({k}, {q(a)}, {q(b)})" for k, (a, b) in enumerate(_heads)) + ") AS t(p, raw, clean)",
    "column_roles": "SELECT * FROM (VALUES ('customer', 'name', 'c_name'), ('customer', 'key', 'c_custkey'), ('customer', 'place', 'c_nationkey'), ('customer', 'date', 'c_mktsegment'), ('part', 'name', 'p_name'), ('part', 'price', 'p_retailprice'), ('part', 'key', 'p_partkey'), ('part', 'type', 'p_type'), ('orders', 'price', 'o_totalprice'), ('orders', 'key', 'o_orderkey'), ('orders', 'date', 'o_orderdate'), ('events', 'key', 'event_id'), ('events', 'type', 'event_type'), ('events', 'date', 'ts')) AS t(table_name, role, column_name)",
    "audit_priority_sort": f"WITH {REV} SELECT row_number() OVER (ORDER BY {_order}) AS position, id FROM rev",
    "top_k_priority": f"WITH {REV} SELECT id, prioridad_revision, distancia FROM rev ORDER BY {_order} LIMIT 30",
    "detect_terms": f"WITH {REG}, mm AS MATERIALIZED (SELECT id, {toks('texto')} AS m FROM reg) SELECT * FROM (" + " UNION ALL ".join(f"SELECT id, {q(f)} AS family, {found('m', ts)} AS terms FROM mm" for f, ts in FAM.items()) + ") WHERE terms <> ''",
    "invalid_values": f"WITH {_last} SELECT DISTINCT {norm('cat')} AS value FROM DEC WHERE {norm('cat')} NOT IN ('', 'alta', 'media', 'excluir', 'revisar')",
    "normalize_text": f"SELECT doc_id, md5({norm('text')}) AS normalized_md5, length({norm('text')}) AS n FROM documents",
    "normalize_tokens": f"SELECT doc_id, md5({toks('text')}) AS tokens_md5 FROM documents",
    "slugify": f"SELECT p_partkey, {slug("concat_ws(' - ', p_name, p_brand, p_type)")} AS slug, 'columna' AS empty_slug FROM part",
    "build_search_text": f"SELECT conv_id, turn, md5({norm("concat_ws(' ', coalesce(role, ''), coalesce(text, ''), coalesce(CAST(nullif(turn, 1) AS VARCHAR), ''))")}) AS search_md5 FROM conversations",
    "extract_code": "SELECT p_partkey, regexp_extract(p_brand, '[0-9]+') AS code, '' AS no_code, CASE WHEN p_size % 2 = 0 THEN 'RH' || p_size || 'Ad' ELSE 'RH18A' END AS area FROM part",
    "code_stage": f"WITH {REG}, k AS (SELECT id, regexp_replace(coalesce(codigo, ''), '[^0-9]+', '', 'g') AS cd FROM reg) SELECT id, CASE {_exact} {_pref} ELSE '' END AS stage, CASE {_exact_rule} {_pref_rule} ELSE '' END AS rule FROM k",
    "split_code_name": """SELECT n_nationkey, CAST(form AS BIGINT) AS form, CASE form WHEN 0 THEN lpad(CAST(n_nationkey AS VARCHAR), 3, '0') WHEN 1 THEN '313' WHEN 4 THEN '074' WHEN 5 THEN '4521' ELSE '' END AS code,
      CASE form WHEN 3 THEN '' WHEN 4 THEN '' WHEN 5 THEN n_name || ' 4521' ELSE n_name END AS name FROM nation, range(6) AS t(form)""",
    "default_label": "SELECT c_custkey, CASE WHEN c_custkey % 3 = 2 THEN c_mktsegment ELSE 'Puebla total' END AS label FROM customer",
    "keyword_list": f"WITH {SEA} SELECT id, palabras_clave FROM sea",
    "classify_relevance": f"WITH {SEA} SELECT source, categoria, count(*) AS n FROM sea GROUP BY ALL",
    "suggest_keywords": f"WITH {REV} SELECT id, keywords_detectadas FROM rev",
    "distance_bands": f"WITH {REG}, {DIST} SELECT {BAND.format('distancia')} AS rango, count(*) AS n, 'documents' AS layer FROM reg GROUP BY ALL UNION ALL SELECT {BAND.format('d')}, count(*), 'points' FROM dist GROUP BY ALL",
    "buffer_flags": f"WITH {REG} SELECT id, " + ", ".join(f"coalesce(distancia <= {b}, FALSE) AS en_buffer_{b}m" for b in (100, 250, 500, 1000)) + " FROM reg",
    "search_query": f"WITH {CLS} SELECT id, {once(['nombre', 'localidad', 'municipio', "'Puebla'"], "'Google Maps'")} AS query_maps, {once(['nombre', 'localidad', 'municipio', "'Puebla'"], _stage_query)} AS query_web FROM cls",
    "first_nonempty": "SELECT c_custkey, CASE WHEN c_custkey % 4 > 1 THEN c_name WHEN c_custkey % 8 < 6 THEN c_mktsegment ELSE '' END AS value FROM customer",
    "canonical_category": f"SELECT o_orderkey, CASE WHEN {slug(_word)} IN ('alta', 'alto', 'alta_relevancia', 'alta_relevancia_ambiental') THEN 'alta_relevancia_ambiental' WHEN {slug(_word)} IN ('media', 'medio', 'mediana', 'media_relevancia', 'media_relevancia_ambiental') THEN 'media_relevancia_ambiental' WHEN {slug(_word)} IN ('excluir', 'no', 'no_pertinente', 'descartar', 'fuera') THEN 'excluir' WHEN {slug(_word)} IN ('revisar', 'mantener_revisar', 'duda', 'pendiente') THEN 'mantener_revisar' ELSE '' END AS category FROM orders",
    "normalize_decision": f"SELECT o_orderkey, CASE WHEN {slug(_word)} IN ('incluir_prioritario', 'excluir_por_renta', 'validar_en_campo') THEN {slug(_word)} ELSE '' END AS decision FROM orders",
    "suggest_category": f"WITH {REV} SELECT id, categoria_sugerida, criterio_auditoria_sugerido FROM rev",
    "suggest_priority": f"WITH {REV} SELECT id, prioridad_revision FROM rev",
    "relevant_text": f"SELECT d.doc_id, {toks("concat_ws(' ', source, coalesce(CAST(quality AS VARCHAR), 'nan'), lang, coalesce(CAST(toxic AS VARCHAR), 'nan'))")} AS relevant FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id",
    "html_escape": "SELECT page_id, md5(replace(replace(replace(replace(html, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;')) AS escaped_md5 FROM pages",
    "geojson_points": f"""WITH {REG} SELECT id, '{{"type":"Feature","properties":{{"nombre":"' || nombre || '","distancia":"' || coalesce(CAST(distancia AS VARCHAR), '') || '","codigo":' || coalesce('"' || codigo || '"', 'null') || '}},"geometry":{{"type":"Point","coordinates":[' || (id % 360 - 180) || ',' || (id % 180 - 90) || ']}}}}' AS feature FROM reg""",
    "rule_cascade": f"WITH {CLS} SELECT id, CAST(b AS BIGINT) AS branch, st AS etapa_productiva_sugerida, {sorted_list("CASE WHEN b = 2 AND mez THEN 'fabricacion_mezclilla' END", "CASE WHEN (b = 2 AND maq) OR (b = 3 AND (maq OR sc = 'confeccion_maquila')) THEN 'confeccion_maquila' END", "CASE WHEN sc <> '' AND sc <> st THEN sc END")} AS etapa_productiva_secundaria, pr AS presion_ambiental_potencial, de AS decision_estudio_sugerida, cf AS confianza_clasificacion, ex AS motivo_exclusion_prioritaria, CASE WHEN esp THEN 'especializada_baja_relevancia' WHEN maq THEN 'maquila_productiva' WHEN con THEN 'generica' ELSE '' END AS subtipo_confeccion FROM cls",
    "rule_evidence": f"WITH {CLS} SELECT id, evi AS evidencia_clasificacion, {sorted_list("CASE WHEN rc <> '' THEN rc END", *(f"CASE WHEN f_{f} <> '' THEN 'texto_{f}' END" for f in FAM))} AS reglas_activadas, kws AS palabras_clave_etapa FROM cls",
    "field_priority": f"WITH {CLS} SELECT id, fp AS prioridad_campo, {sorted_list('wwet', 'why')} AS motivo_prioridad_campo, pri AS flag_estudio_prioritario, CASE WHEN NOT pri THEN 'sin senales suficientes de proceso humedo, tratamiento, mezclilla prioritaria o maquila relevante' WHEN wwet IS NOT NULL OR why IS NOT NULL THEN concat_ws('; ', wwet, why) ELSE evi END AS motivo_flag_estudio_prioritario FROM cls",
    "audit_need": f"WITH {CLS} SELECT id, aud AS requiere_auditoria_manual, pa AS prioridad_auditoria, CASE WHEN aud THEN {sorted_list("CASE b WHEN 3 THEN 'mezclilla/jeans sin evidencia directa de proceso humedo' WHEN 4 THEN 'maquila o confeccion productiva sin senal humeda' WHEN 10 THEN 'confeccion generica sin suficiente detalle operativo' WHEN 11 THEN 'texto insuficiente o ambiguo' END", "CASE WHEN com AND (ind OR maq OR wet) THEN 'senal comercial mezclada con senal productiva' END", "CASE WHEN near AND NOT pri THEN 'cercania a hidrografia requiere cautela documental' END")} ELSE '' END AS motivo_auditoria, fneg AS flag_posible_falso_negativo, amb AS flag_texto_ambiguo FROM cls",
    "scope_universe": f"WITH {CLS} SELECT id, scope AS flag_universo_alcance_proyecto, if(scope, 'dentro_alcance_proyecto', 'fuera_alcance_contexto_textil') AS decision_alcance_proyecto, CASE WHEN scope THEN concat_ws('; ', CASE WHEN wet THEN 'senal de proceso humedo o tratamiento' END, CASE WHEN lav THEN 'senal especifica de lavado/deslavado/lavanderia' END, CASE WHEN mez THEN 'senal de mezclilla/jeans' END) ELSE 'textil fuera del alcance operativo definido para este proyecto' END AS motivo_universo_alcance_proyecto FROM cls",
    "sheet_counts": f"WITH {CLS}, sh AS (SELECT *, count(*) OVER (PARTITION BY nombre, localidad) AS same FROM cls) " + tall("sheet", _sheets, "sh"),
    "audit_prepare": f"WITH {REV} SELECT id, keywords_detectadas, categoria_sugerida, criterio_auditoria_sugerido, prioridad_revision, {once(_rev_parts, "'Google Maps'")} AS query_maps, {once(_rev_parts, _review_query)} AS query_web, region_auditoria, localidad_auditoria, municipio_auditoria, md5(m) AS text_md5 FROM rev",
    "repair_geometry": """WITH s AS (SELECT s_suppkey AS id, s_suppkey * 3571 % 20000 AS x, s_suppkey * 9173 % 20000 AS y FROM supplier)
      SELECT id, ['Polygon', 'LineString', 'Point', 'MultiLineString'][CAST(id % 6 AS INTEGER) + 1] AS type,
        CASE id % 6 WHEN 0 THEN concat(x, ' ', y, ',', x + 100, ' ', y, ',', x + 100, ' ', y + 50, ',', x, ' ', y) WHEN 1 THEN concat(x, ' ', y, ',', x + 30, ' ', y + 40)
          WHEN 2 THEN concat(x, ' ', y) ELSE concat(x, ' ', y, ',', x + 60, ' ', y + 80) END AS vertices FROM s WHERE id % 6 < 4""",
    "polygon_segments": f"WITH {BORDER} SELECT id, CAST(x1 AS BIGINT) AS x1, CAST(y1 AS BIGINT) AS y1, CAST(x2 AS BIGINT) AS x2, CAST(y2 AS BIGINT) AS y2 FROM border",
    "nearest_border": f"""WITH {PTS}, {BORDER}, pair AS (SELECT p.id, x, y, x1, y1, x2 - x1 AS dx, y2 - y1 AS dy FROM pts p, border),
      tt AS (SELECT *, greatest(0.0, least(1.0, ((x - x1) * dx + (y - y1) * dy) / (dx * dx + dy * dy))) AS t FROM pair)
      SELECT id, {rnd('min(sqrt((x - x1 - t * dx) * (x - x1 - t * dx) + (y - y1 - t * dy) * (y - y1 - t * dy)))')} AS distance FROM tt GROUP BY id""",
    "crop_lines": """WITH s AS (SELECT s_suppkey AS id, s_suppkey * 3571 % 20000 AS x, s_suppkey * 9173 % 20000 AS y, s_suppkey % 24 AS up FROM supplier), box AS (SELECT id FROM s WHERE x + 400 >= 3500 AND x <= 9500 AND y + up >= 3500 AND y <= 8500)
      SELECT 'near' AS crop, id FROM s WHERE id IN (SELECT id FROM box) OR NOT EXISTS (SELECT 1 FROM box) UNION ALL SELECT 'none', id FROM s""",
    "geojson_shapes": """WITH s AS (SELECT s_suppkey AS id, CAST(s_suppkey * 3571 % 20000 AS DOUBLE) AS x, CAST(s_suppkey * 9173 % 20000 AS DOUBLE) AS y FROM supplier),
      f AS (SELECT id, ['Polygon', 'LineString', 'Point'][CAST(id % 6 AS INTEGER) + 1] AS kind, CASE id % 6 WHEN 0 THEN concat('[[[', x, ',', y, '],[', x + 100, ',', y, '],[', x + 100, ',', y + 50, '],[', x, ',', y, ']]]')
        WHEN 1 THEN concat('[[', x, ',', y, '],[', x + 30, ',', y + 40, ']]') ELSE concat('[', x, ',', y, ']') END AS place FROM s WHERE id % 6 < 3)
      SELECT id, concat('{"type":"Feature","properties":{"id":', id, ',"tipo":null},"geometry":{"type":"', kind, '","coordinates":', place, '}}') AS feature FROM f""",
    "simplify_lines": "SELECT s_suppkey AS id, CAST(if(s_suppkey % 24 > 12, if(s_suppkey % 24 / 2 * cos(atan2(s_suppkey % 24, 200)) > 12, 5, 3), 2) AS BIGINT) AS n_vertices FROM supplier",
    "display_projection": f"SELECT c_custkey, {rnd('-110.0::DOUBLE + c_custkey % 200 / 10')} AS lon, {rnd('15.0::DOUBLE + c_custkey % 170 / 10')} AS lat FROM customer",
    "column_catalogue": "SELECT * FROM (VALUES ('documents', 1::BIGINT, 'doc_id', 'bigint'), ('documents', 2, 'text', 'string'), ('documents', 3, 'lang', 'string'), ('documents', 4, 'source', 'string'), ('documents', 5, 'n_chars', 'bigint'), ('labels', 1, 'doc_id', 'bigint'), ('labels', 2, 'quality', 'int'), ('labels', 3, 'toxic', 'int'), ('nation', 1, 'n_nationkey', 'int'), ('nation', 2, 'n_name', 'string'), ('nation', 3, 'n_regionkey', 'int')) v(name, place, \"column\", dtype)",
    "missing_columns": "SELECT * FROM (VALUES ('documents', FALSE, 'quality, n_name'), ('labels', FALSE, 'text, n_name'), ('nation', FALSE, 'doc_id, text, quality')) v(name, ok, detalle)",
    "rule_catalogue": " UNION ALL ".join(f"SELECT {q(f)} AS familia_regla, {q(FAMILY_NOTES.get(f, ''))} AS descripcion, {q('; '.join(t))} AS terminos" for f, t in FAMILIES.items()),
    "fill_instructions": " UNION ALL ".join(f"SELECT {q(k)} AS campo, {q(v)} AS como_llenar" for k, v in INSTRUCTIONS.items()),
    "review_summary": f"""WITH {REV} SELECT 'por_localidad' AS seccion, localidad_auditoria AS clave, count(*) AS valor FROM rev GROUP BY 2 UNION ALL SELECT 'por_categoria_sugerida', categoria_sugerida, count(*) FROM rev GROUP BY 2
      UNION ALL SELECT 'por_prioridad_revision', prioridad_revision, count(*) FROM rev GROUP BY 2 UNION ALL SELECT 'indicadores', k, n FROM (SELECT count(*) AS total_registros, count_if(categoria_sugerida = 'alta') AS posible_alta_relevancia,
      count_if(distancia <= 250) AS cercanos_hidrografia, count_if(categoria_sugerida = 'revisar') AS requieren_revision_manual, count_if(categoria_sugerida = 'excluir') AS probablemente_excluibles FROM rev) UNPIVOT (n FOR k IN (total_registros, posible_alta_relevancia, cercanos_hidrografia, requieren_revision_manual, probablemente_excluibles))""",
    "map_colors": f"WITH {CLS} SELECT id, " + ", ".join(f"{_color(c, x)} AS {c}" for c, x in (("etapa_productiva_sugerida", "st"), ("presion_ambiental_potencial", "pr"), ("confianza_clasificacion", "cf"), ("prioridad_auditoria", "pa"))) + f", {q(OTHER_COLUMN)} AS municipio FROM cls",
    "legend_groups": """SELECT value, if(value = '', 'sin dato', value) || ' (' || n || ')' AS label, n FROM (SELECT CASE WHEN doc_id % 11 = 0 THEN '' ELSE source END AS value, count(*) AS n FROM documents GROUP BY 1) ORDER BY value LIMIT 16""",
    "provenance": """SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN 'raw/' || source WHEN 1 THEN 'raw/' || lang || '/' || source WHEN 2 THEN 'raw/' || lang || '/' || source || '/' || source ELSE 'elsewhere/' || lang || '/' || source END || '.shp' AS relpath,
      CASE doc_id % 4 WHEN 0 THEN '.' WHEN 1 THEN lang WHEN 2 THEN lang || '/' || source ELSE lang END AS origin, source || '.shp' AS file FROM documents""",
}


def _diamond(cx: str, size: int, turn: int) -> str:
    """Coordinates of a closed diamond as JSON."""
    corners = [(f"{cx} + {size}", "cy"), (cx, f"cy + {size * turn}"), (f"{cx} - {size}", "cy"), (cx, f"cy - {size * turn}"), (f"{cx} + {size}", "cy")]
    return "concat('[', " + ", ',', ".join(f"'[', {x}, ',', {y}, ']'" for x, y in corners) + ", ']')"


_LATTICE = "dia AS (SELECT n_nationkey AS poly_id, (n_nationkey % 5) * 4000.0::DOUBLE + 2000 AS cx, (n_nationkey // 5) * 4000.0::DOUBLE + 2000 AS cy FROM nation)"
ORACLES |= {
    "point_in_rings": f"""WITH {PTS}, {_LATTICE} SELECT poly_id, count(*) AS n, CAST(sum(id) AS BIGINT) AS ids FROM pts LEFT JOIN dia
      ON (abs(x - cx) + abs(y - cy) < 1700 AND abs(x - cx) + abs(y - cy) > 900) OR abs(x - cx - 2000) + abs(y - cy) < 200 GROUP BY poly_id""",
    "polygon_holes": f"""WITH {_LATTICE} SELECT CAST(poly_id AS BIGINT) AS id, 2::BIGINT AS n_polygons, 2::BIGINT AS n_rings, concat('{{"type":"Feature","properties":{{"id":', poly_id, '}},"geometry":{{"type":"MultiPolygon","coordinates":[[',
      {_diamond("cx", 1700, 1)}, ',', {_diamond("cx", 900, -1)}, '],[', {_diamond("cx + 2000", 200, 1)}, ']]}}}}') AS feature FROM dia""",
    # Areas in squares of w: two triangles; a square; two squares without their overlap; a square without its part of the hole, and the rest of that; a square with a hole.
    "make_valid": """SELECT s_suppkey AS id, if(s_suppkey % 5 IN (0, 2, 3), 'MultiPolygon', 'Polygon') AS type, [2, 1, 2, 2, 1][CAST(s_suppkey % 5 AS INTEGER) + 1]::BIGINT AS n_polygons,
      [2, 1, 2, 2, 2][CAST(s_suppkey % 5 AS INTEGER) + 1]::BIGINT AS n_rings, [2, 16, 24, 14, 15][CAST(s_suppkey % 5 AS INTEGER) + 1]::DOUBLE * (s_suppkey % 50 + 2) * (s_suppkey % 50 + 2) AS area FROM supplier""",
    "fold_decomposed": f"SELECT doc_id, md5({toks('text')}) AS tokens_md5 FROM documents",
    "quantile_ranks": "WITH s AS (SELECT count(*) AS rows, quantile_cont(l_extendedprice, [" + ", ".join(f"{k / 20}" for k in range(21)) + "]) AS qs FROM lineitem) SELECT rows, CAST(k AS BIGINT) AS twentieth, round(qs[CAST(k AS INTEGER) + 1], 4) AS price FROM s, range(21) t(k)",
    "layer_profile": """WITH f AS (SELECT s_suppkey AS k, s_nationkey AS nk, s_nationkey % 9 = 0 AS broken, CAST(s_suppkey * 3571 % 20000 AS DOUBLE) AS x, CAST(s_suppkey * 9173 % 20000 AS DOUBLE) AS y FROM supplier),
      g AS (SELECT *, ['Polygon', 'LineString', 'Point', 'MultiLineString', 'LineString'][CAST(k % 6 AS INTEGER) + 1] AS kind, [100, 30, 0, 60][CAST(k % 6 AS INTEGER) + 1] AS wide, [50, 40, 0, 80][CAST(k % 6 AS INTEGER) + 1] AS tall FROM f)
      SELECT concat('raw/', nk, '.shp') AS source_path, count(*) FILTER (WHERE NOT broken) AS n_features, coalesce(string_agg(DISTINCT kind, ',' ORDER BY kind) FILTER (WHERE NOT broken), '') AS geometry_types,
        if(NOT bool_or(broken) AND nk % 2 = 0, 'EPSG:6372', '') AS crs, count(*) FILTER (WHERE NOT broken AND k % 6 = 5) AS n_null_geometry,
        if(bool_or(broken), '', concat('clave:int64:0,nombre:object:', count(*) FILTER (WHERE k % 3 = 0), ',saldo:', if(count(*) FILTER (WHERE k % 4 <> 0) = 0, 'object', 'float64'), ':', count(*) FILTER (WHERE k % 4 = 0))) AS columns,
        min(x) FILTER (WHERE NOT broken AND k % 6 < 4) AS minx, min(y) FILTER (WHERE NOT broken AND k % 6 < 4) AS miny, max(x + wide) FILTER (WHERE NOT broken) AS maxx, max(y + tall) FILTER (WHERE NOT broken) AS maxy,
        if(bool_or(broken), 'error', 'ok') AS status, if(bool_or(broken), 'UnicodeDecodeError: bytes', '') AS error FROM g GROUP BY nk""",
    # A side's middle vertex stays if it is more than 12 m off; it adds or takes a triangle of half the side's length.
    "simplify_borders": """WITH s AS (SELECT CAST(n_nationkey AS BIGINT) AS id, n_nationkey % 5 AS i, n_nationkey // 5 AS j FROM nation),
      b AS (SELECT id, (i * 7 + j * 11) % 24 AS south, (i * 7 + (j + 1) * 11) % 24 AS north, (i * 7 + j * 11 + 5) % 24 AS west, ((i + 1) * 7 + j * 11 + 5) % 24 AS east FROM s)
      SELECT id, 5::BIGINT + (south > 12)::INT + (north > 12)::INT + (west > 12)::INT + (east > 12)::INT AS n_vertices,
        1000000.0::DOUBLE + 500 * (if(north > 12, north, 0) + if(east > 12, east, 0) - if(south > 12, south, 0) - if(west > 12, west, 0)) AS area FROM b""",
    "tile_pyramid": """WITH p AS (SELECT -117.03::DOUBLE + c_custkey * 7919 % 300 / 10 AS lon, 14.07::DOUBLE + c_custkey * 10473 % 180 / 10 AS lat FROM customer),
      u AS (SELECT (lon + 180) / 360 AS u, (1 - asinh(tan(radians(lat))) / pi()) / 2 AS v FROM p),
      t AS (SELECT z, CAST(floor(u * 2 ** z) AS BIGINT) AS x, CAST(floor(v * 2 ** z) AS BIGINT) AS y, count(*) AS n, count(DISTINCT (floor(u * 2 ** z * 64), floor(v * 2 ** z * 64))) AS cells FROM u, range(10) r(z) GROUP BY ALL)
      SELECT t.z, t.x, t.y, t.n <= 40 OR t.z = 9 AS leaf, if(t.n <= 40 OR t.z = 9, t.n, t.cells) AS items, t.n FROM t LEFT JOIN t up ON up.z = t.z - 1 AND up.x = t.x // 2 AND up.y = t.y // 2 WHERE t.z = 0 OR up.n > 40""",
    "rule_usage": f"WITH {CLS} " + " UNION ALL ".join(f"SELECT {q(f)} AS familia_regla, {q('; '.join(ts))} AS terminos, count(*) FILTER (WHERE f_{f} <> '') AS n FROM cls" for f, ts in FAM.items()),
}
_one, _two = (f"SELECT {p}::BIGINT AS part, {columns} FROM ({ORACLES[k]})" for p, columns, k in ((0, "validacion, ok, NULL AS universe, NULL::BIGINT AS n", "quality_checks"), (2, "NULL, NULL, universe, n", "universe_counts")))
ORACLES["control_sheet"] = f"{_one} UNION ALL SELECT 1, NULL, NULL, NULL, NULL UNION ALL {_two}"
