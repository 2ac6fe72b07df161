"""Registered queries: each operator applied to the supplied tables (mappings from tables to domain columns are here)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from basinsift.functions import codes, geo, paths, text
from basinsift.operators import checks, frames, overlay, profiles, quantiles, review, spatial, workbook
from basinsift.operators.borders import simplify as simplify_shared
from basinsift.plans import cascade
from basinsift.plans.catalogue import LOCALITIES, Catalogue
from basinsift.sources import tiles

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
HIGH, MEDIUM, TRADE, MAKING, OTHER = ["idiot", "stupid", "tation", "scum"], ["with the", "nicht", "para", "pour"], ["venta", "que", "les"], ["idiot", "with", "this"], ["loser", "von"]
SELECTED = ["idiot", "stupid", "that", "tha", "nicht", "pour", "para", "schön"]
PREFIXES, TRADE_PREFIXES = ["313", "314", "315", "8122"], ["46"]
KEYWORDS = {"alta": ["idiot", "stupid", "scum"], "media": ["with the", "nicht", "para", "pour"], "baja": ["that", "les", "und", "que"]}
ROLES = {"name": ["name", "title"], "price": ["price", "amount"], "key": ["key", "id"], "type": ["type", "class"], "place": ["region", "nation"], "date": ["date", "ts"]}
POINTS_CELL, EXTENT = 1000.0, 40000.0
#: The same thirteen families over frequent words of mixed prose, so that each branch has rows in a text corpus.
PROSE = Catalogue(
    families={
        "lavado_deslavado": ["idiot", "moron"],
        "lavanderia_industrial": ["clown"],
        "tenido_tintoreria": ["stupid", "scum"],
        "acabado_tratamiento": ["trash", "loser"],
        "mezclilla_jeans": ["with the", "avec"],
        "industrial": ["this", "nicht"],
        "maquila": ["worthless", "is for", "sur la"],
        "confeccion": ["para", "und"],
        "confeccion_especializada": ["mit", "una", "with"],
        "bordado_estampado": ["auch", "pour la", "was the"],
        "comercio": ["que", "les", "was"],
        "renta": ["esta", "durch", "est"],
        "no_textil": ["disgusting", "von", "elle la"],
    },
    print_terms=["pour la"],
)


def query(function: Callable[[SparkSession, str], DataFrame]):
    QUERIES[function.__name__] = function
    return function


def load(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def registry(spark: SparkSession, d: str) -> DataFrame:
    """Documents as establishments."""
    c = F.col
    code = codes.first_match([(c("doc_id") % 9 == k, F.lit(v)) for k, v in enumerate(["812210", "313110", "314120", "315225", "461122", "323119", ""])], F.when(c("doc_id") % 9 == 8, "x 541"))
    folder = codes.first_match([(c("lang") == k, F.lit(v)) for k, v in (("en", "agebs\\huejotzingo"), ("fr", "Xalmimilulco"), ("de", "san_martin"))], "otra zona")
    df = load(spark, d, "documents").select(
        c("doc_id").alias("id"), F.concat_ws(" ", "source", "lang").alias("nombre"), c("text").alias("texto"), code.alias("codigo"), folder.alias("source_folder"), c("lang"), c("source"),
        F.when(c("doc_id") % 13 != 0, (c("doc_id") * 7919 % 14000) / 10).alias("distancia"),
    )
    return df


def searched(spark: SparkSession, d: str) -> DataFrame:
    """The registry with its search text and first relevance."""
    df = registry(spark, d).withColumn("texto_busqueda", text.search_text(F.col("nombre"), F.col("texto")))
    t = F.col("texto_busqueda")
    relevance = F.when(text.contains_any(t, HIGH), "alta_relevancia_ambiental").when(text.contains_any(t, MEDIUM), "media_relevancia_ambiental").otherwise("revisar")
    return df.withColumns({"palabras_clave": text.substring_list(t, SELECTED), "categoria": relevance})


def classified(spark: SparkSession, d: str) -> DataFrame:
    return cascade.classify(searched(spark, d), PROSE)


def decisions(spark: SparkSession, d: str) -> DataFrame:
    """Labels as manual decisions, each twice: the second file's row counts."""
    c = F.col
    base = load(spark, d, "labels").select(c("doc_id").alias("id"), "quality", "toxic")
    first = base.select("id", F.lit("revisar").alias("categoria_auditada"), F.lit("x").alias("etapa_productiva_auditada"), F.lit("").alias("notas_auditoria"), F.lit("no valida").alias("decision_estudio"), F.lit(1).alias("file_order"), c("id").alias("row_order"))
    second = base.select(
        "id", codes.first_match([(c("toxic") == 1, F.lit("Alto")), (c("quality") == 0, F.lit("MEDIA relevancia")), (c("id") % 3 == 0, F.lit("baja"))], "").alias("categoria_auditada"),
        F.when(c("quality") == 0, "bordado").otherwise(" ").alias("etapa_productiva_auditada"), F.when(c("toxic") == 1, F.concat(F.lit("nota "), c("id").cast("string"))).alias("notas_auditoria"),
        codes.first_match([(c("id") % 4 == 0, F.lit("Excluir por comercio")), (c("id") % 4 == 1, F.lit("no valida"))], "").alias("decision_estudio"), F.lit(2).alias("file_order"), c("id").alias("row_order"),
    )
    return first.unionByName(second)


def points(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("c_custkey")
    return load(spark, d, "customer").select(k.alias("id"), (k * 7919 % 20000).cast("double").alias("x"), (k * 10473 % 20000).cast("double").alias("y"), "c_mktsegment")


def segments(spark: SparkSession, d: str) -> DataFrame:
    """A polyline through the suppliers, in key order; the join with the next key needs no global window."""
    k = F.col("s_suppkey")
    ends = load(spark, d, "supplier").select(k.alias("k"), (k * 3571 % 20000).cast("double").alias("x1"), (k * 9173 % 20000).cast("double").alias("y1"))
    following = ends.select((F.col("k") - 1).alias("k"), F.col("x1").alias("x2"), F.col("y1").alias("y2"))
    return ends.join(following, "k")


def distances(spark: SparkSession, d: str) -> DataFrame:
    return spatial.nearest_distance(points(spark, d), segments(spark, d), "id", POINTS_CELL, EXTENT)


def polygons(spark: SparkSession, d: str) -> DataFrame:
    """Diamonds around a lattice of nations."""
    k = F.col("n_nationkey")
    x, y = (k % 5) * 4000.0 + 2000.0, F.floor(k / 5) * 4000.0 + 2000.0
    at = lambda a, b: F.struct((x + a).alias("x"), (y + b).alias("y"))
    return load(spark, d, "nation").select(k.alias("poly_id"), F.array(at(2200.0, 0.0), at(0.0, 2200.0), at(-2200.0, 0.0), at(0.0, -2200.0), at(2200.0, 0.0)).alias("ring"))


def census(spark: SparkSession, d: str) -> DataFrame:
    """Line items as census rows by nation and part type."""
    li, s, n, p = (load(spark, d, t) for t in ("lineitem", "supplier", "nation", "part"))
    j = li.join(s, li.l_suppkey == s.s_suppkey).join(n, F.col("s_nationkey") == F.col("n_nationkey")).join(p, li.l_partkey == p.p_partkey)
    return j.select("l_orderkey", "l_linenumber", F.concat_ws(" ", F.lpad(F.col("n_nationkey").cast("string"), 3, "0"), "n_name").alias("municipio"), F.concat(F.lit("Subsector 313 "), F.col("p_type")).alias("actividad"), F.concat(F.lit("estrato "), (F.col("p_size") % 3 * 10).cast("string"), F.lit(" a "), (F.col("p_size") % 3 * 10 + 10).cast("string")).alias("estrato"), F.col("l_quantity").alias("ue"), F.col("l_extendedprice").alias("valor"), F.col("l_discount").alias("pago"), F.col("l_tax").alias("insumo"))


def r6(col: Column) -> Column:
    return F.round(col, 6)


# -- projections, filters, sources ---------------------------------------------------------------------------------------------------------


@query
def scan_project(spark, d):
    df = frames.project(load(spark, d, "lineitem"), ["l_orderkey", "l_linenumber", "no_such_column", "l_quantity", "l_returnflag"])
    return df.withColumnRenamed("l_quantity", "quantity").select(F.lit("lineitem").alias("layer"), "l_orderkey", F.col("l_linenumber").cast("string").alias("line_text"), "quantity", F.when(F.col("l_returnflag") == "N", "none").otherwise(F.col("l_returnflag")).alias("flag"))


@query
def numeric_row_filter(spark, d):
    c = F.col("doc_id")
    year = F.when(c % 7 == 0, F.lit("nota")).when(c % 5 == 0, F.concat(F.lit("\x00"), (c % 30 + 2000).cast("string"))).when(c % 11 == 0, F.lit(None)).otherwise((c % 30 + 1990).cast("string"))
    df = load(spark, d, "documents").select("doc_id", F.regexp_replace(year, "\x00", "").alias("year"))
    return df.withColumn("year", codes.safe_number(F.col("year"))).filter("year IS NOT NULL").groupBy("year").agg(F.count("*").alias("n"))


@query
def union_tagged(spark, d):
    by = lambda *c: load(spark, d, c[0]).select(*c[1:])
    tagged = frames.union_tagged({"customer": by("customer", F.col("c_name").alias("name"), F.col("c_acctbal").alias("balance")), "supplier": by("supplier", F.col("s_name").alias("name")), "part": by("part", F.col("p_name").alias("name"), F.col("p_size").alias("size"))}, "region_auditoria")
    return tagged.groupBy("region_auditoria").agg(F.count("*").alias("n"), F.count("balance").alias("n_balance"), F.count("size").alias("n_size"), F.count_distinct("name").alias("n_names"))


@query
def table_inventory(spark, d):
    return frames.profile({t: load(spark, d, t) for t in ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "documents")})


@query
def null_to_empty(spark, d):
    df = load(spark, d, "documents").join(load(spark, d, "labels"), "doc_id", "left").select("doc_id", F.when(F.col("toxic") == 1, "toxic").alias("mark"), F.when(F.col("quality") == 1, F.col("source")).alias("good_source"), "quality")
    return frames.nulls_to_empty(df)


@query
def error_quarantine(spark, d):
    df = load(spark, d, "conversations").select("conv_id", "turn", "role", F.length("text").alias("n"))
    _, bad = checks.quarantine(df, (F.col("n") < 40) | ~F.col("role").isin("user", "assistant"), "short or unknown role")
    return bad


@query
def code_prefix_filter(spark, d):
    return registry(spark, d).filter(codes.has_prefix(codes.first_digits(F.col("codigo")), PREFIXES)).select("id", "codigo")


@query
def keyword_candidates(spark, d):
    return searched(spark, d).filter(text.contains_any(F.col("texto_busqueda"), SELECTED)).select("id", "palabras_clave")


def _split(spark, d):
    df = searched(spark, d).withColumn("code", codes.first_digits(F.col("codigo")))
    t = F.col("texto_busqueda")
    cand = codes.has_prefix(F.col("code"), PREFIXES) | text.contains_any(t, SELECTED)
    trade = codes.has_prefix(F.col("code"), TRADE_PREFIXES) | (text.contains_any(t, TRADE) & ~text.contains_any(t, MAKING))
    other = text.contains_any(t, OTHER) & ~codes.has_prefix(F.col("code"), PREFIXES)
    return df.withColumns({"candidate": cand, "ex_trade": trade, "ex_other": other})


@query
def exclusion_rules(spark, d):
    return _split(spark, d).select("id", "ex_trade", "ex_other")


@query
def candidate_split(spark, d):
    part = F.when(F.col("candidate") & ~F.col("ex_trade") & ~F.col("ex_other"), "included").when(F.col("candidate"), "excluded").otherwise("none")
    return _split(spark, d).select("id", part.alias("part"))


@query
def universe_depurado(spark, d):
    return classified(spark, d).filter(cascade.universes()["B"]).select("id", "decision_estudio_sugerida")


@query
def layer_classifier(spark, d):
    names = ["raw/DENUE_2024.shp", "raw/agebs/AGEB_urb.shp", "raw/hidrografia_atoyac/rios.shp", "raw/arearuralesnoamanzanadas_ageb.shp", "raw/Manzanas.shp", "raw/localidades.shp", "raw/Vialidad.shp", "raw/caminos.shp", "raw/subcuenca.shp", "raw/otro.shp"]
    path = F.element_at(F.array(*map(F.lit, names)), (F.col("page_id") % len(names) + 1).cast("int"))
    return load(spark, d, "pages").select("page_id", codes.layer_type(path).alias("layer"))


@query
def source_filter(spark, d):
    df = registry(spark, d)
    hit = lambda key: text.normalize(F.col("source_folder")).contains(key)
    return df.filter(hit("san_martin") | hit("xalmi")).select("id", "source_folder")


@query
def geometry_family(spark, d):
    kind = F.element_at(F.array(*map(F.lit, ["Point", "LineString", "MultiLineString", "Polygon", "MultiPolygon", ""])), (F.col("p_partkey") % 6 + 1).cast("int"))
    df = load(spark, d, "part").select("p_brand", kind.alias("kind"))
    family = F.when(F.col("kind").contains("Line"), "line").when(F.col("kind").contains("Polygon"), "polygon").when(F.col("kind").contains("Point"), "point")
    return df.withColumn("family", family).filter("family IS NOT NULL").groupBy("p_brand", "family").agg(F.count("*").alias("n"), F.array_join(F.array_sort(F.collect_set("kind")), ", ").alias("kinds"))


@query
def bbox_crop(spark, d):
    inside = spatial.crop(points(spark, d), "x", "y", (5000.0, 5000.0, 9000.0, 9000.0), 500.0).select("id", F.lit("cropped").alias("kind"))
    fallback = spatial.crop(points(spark, d), "x", "y", (90000.0, 90000.0, 90001.0, 90001.0), 10.0).select("id", F.lit("fallback").alias("kind"))
    return inside.unionByName(fallback)


@query
def safe_numeric(spark, d):
    raw = F.when(F.col("p_size") % 5 == 0, "n/d").when(F.col("p_size") % 7 == 0, " ").when(F.col("p_size") % 11 == 0, "NaN").otherwise(F.concat(F.lit(" "), F.col("p_size").cast("string"), F.lit(".5")))
    return load(spark, d, "part").select("p_partkey", codes.safe_number(raw).alias("value"), codes.safe_number(F.lit(None)).alias("absent"))


@query
def map_spec_counts(spark, d):
    c = F.col
    specs = {"prioritarios": c("flag_estudio_prioritario"), "humedos": c("flag_proceso_humedo_relevante"), "mezclilla": c("flag_mezclilla_jeans"), "alta": c("presion_ambiental_potencial") == "alta", "muy_alta": c("prioridad_campo") == "muy_alta", "cerca": c("flag_cercania_hidrografia_250m"), "comercio": c("flag_comercio_o_renta")}
    every = dict(specs) | {f"{k}_{place}": v & (c("localidad") == place) for place in LOCALITIES for k, v in specs.items()}
    return frames.conditional_counts(classified(spark, d), every, "spec")


# -- joins ---------------------------------------------------------------------------------------------------------------------------------


@query
def left_enrich(spark, d):
    extra = load(spark, d, "labels").select(F.col("doc_id").alias("__id"), "quality", "toxic")
    df = load(spark, d, "documents")
    return df.join(extra, df.doc_id == F.col("__id"), "left").drop("__id").select("doc_id", "source", "quality", "toxic")


@query
def positional_zip(spark, d):
    return frames.zip_positional(load(spark, d, "customer").select("c_custkey"), load(spark, d, "supplier").select("s_suppkey"), [F.desc("c_custkey")], ["s_suppkey"])


@query
def audit_overlay(spark, d):
    return overlay.audit_overlay(searched(spark, d).select("id", "categoria"), decisions(spark, d), ["id"], ["file_order", "row_order"]).select("id", "categoria_final", "estado_auditoria", "notas_auditoria")


@query
def audit_final(spark, d):
    df = overlay.audit_overlay(searched(spark, d).select("id", "categoria", "source_folder"), decisions(spark, d), ["id"], ["file_order", "row_order"])
    return overlay.audit_final(df).groupBy("source_folder", "categoria").agg(F.count("*").alias("n"))


@query
def productive_overlay(spark, d):
    rows = classified(spark, d).select("id", "categoria", "decision_estudio_sugerida", "etapa_productiva_sugerida", "decision_estudio", "etapa_productiva_auditada")
    out = overlay.productive_overlay(rows, decisions(spark, d), ["id"], ["file_order", "row_order"])
    return out.select("id", "decision_estudio_final", "etapa_productiva_final", "categoria_ambiental_final", "estado_auditoria_productiva")


@query
def nearest_distance(spark, d):
    return distances(spark, d).select("id", r6(F.col("distance")).alias("distance"))


@query
def point_in_polygon(spark, d):
    hits = spatial.point_in_polygon(points(spark, d), polygons(spark, d), "id", "poly_id", 2000.0)
    return hits.groupBy("poly_id").agg(F.count("*").alias("n"))


def holed(spark: SparkSession, d: str) -> DataFrame:
    """Diamonds around a lattice of nations: one with a hole, and a second one beside it."""
    k = F.col("n_nationkey")
    x, y = (k % 5) * 4000.0 + 2000.0, F.floor(k / 5) * 4000.0 + 2000.0

    def diamond(cx: Column, size: float, turn: int) -> Column:
        at = lambda a, b: F.struct((cx + a).alias("x"), (y + b).alias("y"))
        corners = [at(size, 0.0), at(0.0, size * turn), at(-size, 0.0), at(0.0, -size * turn), at(size, 0.0)]
        return F.array(*corners)

    parts = F.array(diamond(x, 1700.0, 1), diamond(x, 900.0, -1), diamond(x + 2000.0, 200.0, 1))
    return load(spark, d, "nation").select(k.alias("poly_id"), F.struct(F.lit("MultiPolygon").alias("type"), parts.alias("parts")).alias("geometry"))


@query
def point_in_rings(spark, d):
    """Places per polygon of several parts and holes."""
    hits = spatial.point_in_polygon(points(spark, d), holed(spark, d), "id", "poly_id", 1000.0)
    return hits.groupBy("poly_id").agg(F.count("*").alias("n"), F.sum("id").alias("ids"))


@query
def choropleth_join(spark, d):
    areas = load(spark, d, "nation").select(F.col("n_name").alias("nombre"), F.col("n_nationkey").alias("clave"))
    counts = load(spark, d, "supplier").filter("s_acctbal > 2000").groupBy(F.col("s_nationkey").alias("k")).agg(F.count("*").alias("n"))
    key = frames.join_column(areas, counts, "k")
    return areas.join(counts, areas[key].cast("string") == counts.k.cast("string"), "left").select("nombre", "clave", F.coalesce("n", F.lit(0)).alias("n"))


@query
def source_to_location(spark, d):
    place = codes.location(F.col("source_folder"))
    return registry(spark, d).select("id", place["locality"].alias("localidad"), place["municipality"].alias("municipio"), codes.region(F.col("source_folder")).alias("region"))


@query
def membership_probe(spark, d):
    parts = [("part", "p_partkey", "lineitem", "l_partkey"), ("customer", "c_custkey", "orders", "o_custkey"), ("nation", "n_nationkey", "region", "r_regionkey")]
    out = [load(spark, d, a).select(F.col(b).cast("long").alias("k")).join(load(spark, d, t).select(F.col(x).cast("long").alias("k")), "k", "left_semi").agg(F.lit(a).alias("side"), F.count("*").alias("n")) for a, b, t, x in parts]
    return out[0].unionByName(out[1]).unionByName(out[2])


# -- aggregates ----------------------------------------------------------------------------------------------------------------------------


@query
def group_count(spark, d):
    df = load(spark, d, "documents").join(load(spark, d, "labels"), "doc_id", "left")
    return df.groupBy("source", "toxic").agg(F.count("*").alias("n"))


DIMENSIONS = ["municipio", "localidad", "codigo", "etapa_productiva_sugerida", "presion_ambiental_potencial", "confianza_clasificacion", "prioridad_auditoria", "prioridad_campo", "rango", "flag_estudio_prioritario", "flag_universo_alcance_proyecto", "flag_proceso_humedo_relevante", "flag_mezclilla_jeans", "decision_alcance_proyecto", "motivo_exclusion_prioritaria"]


@query
def count_by_dimension(spark, d):
    return frames.count_each(classified(spark, d).withColumn("rango", geo.band(F.col("distancia"))), DIMENSIONS)


@query
def transition_matrix(spark, d):
    return classified(spark, d).groupBy("categoria", "etapa_productiva_sugerida", "decision_estudio_sugerida").agg(F.count("*").alias("n"))


def _rollup(df: DataFrame, *keys: str) -> DataFrame:
    sums = df.groupBy(*keys).agg(*(F.sum(c).alias(c) for c in ("ue", "valor", "pago", "insumo")))
    return sums.withColumns({"valor_por_ue": codes.ratio(F.col("valor"), F.col("ue")), "pago_por_ue": codes.ratio(F.col("pago"), F.col("ue")), "insumo_por_pago": codes.ratio(F.col("insumo"), F.col("pago"))})


def _rounded(df: DataFrame) -> DataFrame:
    return df.select(*(r6(F.col(c)).alias(c) if kind == "double" else F.col(c) for c, kind in df.dtypes))


@query
def census_rollup(spark, d):
    df = census(spark, d).withColumns({"ue": F.when(F.col("actividad").contains("BRASS"), None).otherwise(F.col("ue"))})
    parts = codes.split_code_name(F.col("municipio"))
    return _rounded(_rollup(df.withColumns({"cve": parts["code"], "mun": parts["name"]}), "cve", "mun", "actividad").select("cve", "mun", "actividad", "ue", "valor", "pago", "insumo"))


@query
def ratio_of_sums(spark, d):
    return _rounded(_rollup(census(spark, d), "municipio").select("municipio", "valor_por_ue", "pago_por_ue", "insumo_por_pago"))


@query
def row_ratios(spark, d):
    return load(spark, d, "lineitem").select("l_orderkey", "l_linenumber", codes.ratio(F.col("l_tax"), F.col("l_discount")).alias("tax_per_discount"), codes.ratio(F.col("l_extendedprice"), F.col("l_quantity")).alias("price_each"))


@query
def micro_stratum(spark, d):
    df = census(spark, d).filter(F.col("estrato").rlike(r"(?i)0\s*a\s*10"))
    return _rounded(_rollup(df, "actividad"))


@query
def municipal_summary(spark, d):
    df = census(spark, d).withColumn("ue", F.when(F.col("l_linenumber") > 1, F.col("ue")))
    out = df.groupBy("municipio", "estrato").agg(F.coalesce(F.sum(F.when(F.col("pago") > 0.09, F.col("ue"))), F.lit(0.0)).alias("ue"), F.coalesce(F.sum("valor"), F.lit(0.0)).alias("valor"))
    return _rounded(out.withColumn("valor_por_ue", codes.ratio(F.col("valor"), F.col("ue"))))


@query
def total_bounds(spark, d):
    b = points(spark, d).agg(F.min("x").alias("minx"), F.min("y").alias("miny"), F.max("x").alias("maxx"), F.max("y").alias("maxy"))
    s = segments(spark, d).agg(F.min(F.least("x1", "x2")).alias("a"), F.min(F.least("y1", "y2")).alias("b"), F.max(F.greatest("x1", "x2")).alias("c"), F.max(F.greatest("y1", "y2")).alias("e"))
    both = b.join(s).select(F.least("minx", "a").alias("minx"), F.least("miny", "b").alias("miny"), F.greatest("maxx", "c").alias("maxx"), F.greatest("maxy", "e").alias("maxy"))
    return both.withColumn("bounds_json", F.to_json(F.struct(*(F.col(c).cast("long").alias(c) for c in ("minx", "miny", "maxx", "maxy")))))


@query
def flag_tally(spark, d):
    return frames.tally(classified(spark, d), cascade.FLAGS)


@query
def locality_flag_matrix(spark, d):
    marks = {"universo_alcance_proyecto": "flag_universo_alcance_proyecto", "procesos_humedos": "flag_proceso_humedo_relevante", "lavado_deslavado": "flag_lavado_deslavado", "mezclilla_jeans": "flag_mezclilla_jeans", "fuera_alcance_contexto_textil": "flag_fuera_alcance_productivo_textil"}
    places = spark.createDataFrame([(p,) for p in [*LOCALITIES, "Ninguna"]], "localidad string")
    sums = classified(spark, d).groupBy("localidad").agg(*(F.count_if(F.col(v)).alias(k) for k, v in marks.items()))
    full = places.join(sums, "localidad", "left")
    return full.select("localidad", F.inline(F.array(*(F.struct(F.lit(k).alias("categoria_alcance"), F.coalesce(F.col(k), F.lit(0)).alias("n")) for k in marks))))


@query
def buffer_counts(spark, d):
    df = distances(spark, d).join(points(spark, d).select("id", "c_mktsegment"), "id")
    each = df.select("c_mktsegment", F.explode(F.array_compact(F.array(*(F.when(geo.within(F.col("distance"), b), F.lit(b)) for b in geo.BUFFERS)))).alias("buffer_m"))
    return each.groupBy("buffer_m", "c_mktsegment").agg(F.count("*").alias("n"))


@query
def pivot_counts(spark, d):
    df = load(spark, d, "documents").join(load(spark, d, "labels").filter("quality IS NOT NULL"), "doc_id")
    return df.groupBy("source").pivot("lang", ["de", "en", "es", "fr"]).agg(F.count("doc_id")).na.fill(0)


def reviewed(spark: SparkSession, d: str) -> DataFrame:
    return review.prepare(registry(spark, d), "nombre", ["nombre", "codigo", "texto", "source_folder"], "source_folder", "distancia", KEYWORDS, 250.0)


@query
def audit_kpis(spark, d):
    c = F.col
    kpis = {"total_registros": F.lit(True), "posible_alta_relevancia": c("categoria_sugerida") == "alta", "cercanos_hidrografia": c("distancia") <= 250, "requieren_revision_manual": c("categoria_sugerida") == "revisar", "probablemente_excluibles": c("categoria_sugerida") == "excluir"}
    return frames.conditional_counts(reviewed(spark, d), kpis, "kpi")


@query
def audit_status(spark, d):
    return review.status(decisions(spark, d))


@query
def universe_counts(spark, d):
    return frames.conditional_counts(classified(spark, d), cascade.universes(), "universe")


@query
def map_center(spark, d):
    found = points(spark, d).agg(r6(F.coalesce(F.avg("x"), F.lit(0.0))).alias("cx"), r6(F.coalesce(F.avg("y"), F.lit(0.0))).alias("cy")).select(F.lit("all").alias("layer"), "cx", "cy")
    none = points(spark, d).filter("x < 0").agg(r6(F.coalesce(F.avg("x"), F.lit(10000.0))).alias("cx"), r6(F.coalesce(F.avg("y"), F.lit(10000.0))).alias("cy")).select(F.lit("empty").alias("layer"), "cx", "cy")
    return found.unionByName(none)


@query
def histogram_quartiles(spark, d):
    v = load(spark, d, "customer").select("c_acctbal")
    lo, q1, q2, q3, hi = quantiles.exact(v, "c_acctbal", [0.0, 0.25, 0.5, 0.75, 1.0])
    binned = v.select(F.least(F.lit(19), F.floor((F.col("c_acctbal") - lo) / ((hi - lo) / 20))).cast("long").alias("bin")).groupBy("bin").agg(F.count("*").alias("n"))
    return binned.select("bin", "n", *(r6(F.lit(q)).alias(name) for name, q in (("q1", q1), ("q2", q2), ("q3", q3))))


@query
def quantile_ranks(spark, d):
    """Order statistics of prices at many ranks, from histograms alone."""
    shares = [k / 20 for k in range(21)]
    found = quantiles.exact(load(spark, d, "lineitem"), "l_extendedprice", shares)
    table = F.array(*(F.struct(F.lit(k).cast("long").alias("twentieth"), F.round(F.lit(v), 4).alias("price")) for k, v in enumerate(found)))
    return load(spark, d, "lineitem").agg(F.count("*").alias("rows")).select("rows", F.inline(table))


@query
def hexbin(spark, d):
    p = points(spark, d)
    b = p.agg(F.min("x"), F.min("y"), F.max("x"), F.max("y")).first()
    cell = geo.hexagon(F.col("x"), F.col("y"), (b[0], b[1]), (b[2], b[3]), 34)
    return p.select(cell.alias("h")).groupBy(r6(F.col("h.hx")).alias("hx"), r6(F.col("h.hy")).alias("hy")).agg(F.count("*").alias("n"))


@query
def possible_duplicates(spark, d):
    p = load(spark, d, "part")
    return p.withColumn("n", F.count("*").over(Window.partitionBy("p_name", "p_brand"))).filter("n > 1").select("p_partkey", "p_name", "p_brand", "n")


@query
def quality_checks(spark, d):
    return checks.quality_checks(classified(spark, d), load(spark, d, "documents").count())


# -- order ---------------------------------------------------------------------------------------------------------------------------------


@query
def dedup_keep_last(spark, d):
    o = load(spark, d, "orders").select("o_custkey", "o_orderkey", "o_orderpriority")
    return frames.keep_last(o, ["o_custkey"], ["o_orderkey"])


@query
def representative_sample(spark, d):
    c, df = F.col, classified(spark, d)
    marks = {"prioritarios": c("flag_estudio_prioritario"), "universo_alcance_proyecto": c("flag_universo_alcance_proyecto"), "excluidos_comercio": c("decision_estudio_sugerida") == "excluir_por_comercio", "excluidos_renta": c("decision_estudio_sugerida") == "excluir_por_renta", "confeccion_especializada": c("flag_confeccion_especializada_baja_relevancia"), "ambiguos_auditar": c("requiere_auditoria_manual"), "procesos_humedos": c("flag_proceso_humedo_relevante")}
    labelled = df.select("id", F.explode(F.array_compact(F.array(*(F.when(v, F.lit(k)) for k, v in marks.items())))).alias("tipo_ejemplo"))
    return labelled.withColumn("n", F.row_number().over(Window.partitionBy("tipo_ejemplo").orderBy("id"))).filter("n <= 15").select("tipo_ejemplo", "id", F.col("n").cast("long").alias("n"))


@query
def surrogate_id(spark, d):
    return frames.with_row_number(load(spark, d, "part").select("p_name", "p_partkey"), ["p_name", "p_partkey"], "row_id").select("row_id", "p_partkey")


@query
def unique_headers(spark, d):
    names = [c for t in ("customer", "supplier", "part") for c in [*load(spark, d, t).columns, "Año Censal", "", "% total", "Año  censal"]]
    return spark.createDataFrame(list(zip(range(len(names)), names, frames.unique_names(names), strict=True)), "position long, raw string, clean string")


@query
def column_roles(spark, d):
    rows = [(t, role, column) for t in ("customer", "part", "orders", "events") for role, column in frames.detect_roles(load(spark, d, t).columns, ROLES).items()]
    return spark.createDataFrame(rows, "table_name string, role string, column_name string")


@query
def audit_priority_sort(spark, d):
    ranked = review.order_by_priority(reviewed(spark, d), "distancia", "id").select("id", "prioridad_revision", "categoria_sugerida", "distancia")
    ranks = [review.rank(F.col("prioridad_revision"), "priority"), F.col("distancia").asc_nulls_last(), review.rank(F.col("categoria_sugerida"), "category"), F.col("id")]
    return frames.with_row_number(ranked, ranks, "position").select("position", "id")


@query
def top_k_priority(spark, d):
    return review.order_by_priority(reviewed(spark, d), "distancia", "id").select("id", "prioridad_revision", "distancia").limit(30)


# -- scalar functions ----------------------------------------------------------------------------------------------------------------------


@query
def detect_terms(spark, d):
    df = registry(spark, d).select("id", F.inline(F.array(F.struct(text.tokens(F.col("texto")).alias("m")))))
    return df.select("id", F.inline(F.array(*(F.struct(F.lit(f).alias("family"), F.array_join(text.terms_found(F.col("m"), terms), ", ").alias("terms")) for f, terms in PROSE.families.items())))).filter("terms <> ''")


@query
def invalid_values(spark, d):
    df = decisions(spark, d).withColumn("value", text.normalize(F.col("categoria_auditada")))
    return checks.invalid_values(df, "value", ["", "alta", "media", "excluir", "revisar"])


@query
def normalize_text(spark, d):
    return load(spark, d, "documents").select("doc_id", F.md5(text.normalize(F.col("text"))).alias("normalized_md5"), F.length(text.normalize(F.col("text"))).cast("long").alias("n"))


@query
def normalize_tokens(spark, d):
    return load(spark, d, "documents").select("doc_id", F.md5(text.tokens(F.col("text"))).alias("tokens_md5"))


@query
def fold_decomposed(spark, d):
    """Token texts of documents whose accents are combining marks, and with letters in compatibility forms."""
    value = F.col("text")
    for plain, marks in (("é", "e\u0301"), ("è", "e\u0300"), ("ê", "e\u0302"), ("ñ", "n\u0303"), ("ü", "u\u0308"), ("ö", "o\u0308"), ("fi", "\ufb01"), ("T", "\uff34"), ("xa", "\U0001d431a")):
        value = F.replace(value, F.lit(plain), F.lit(marks))
    return load(spark, d, "documents").select("doc_id", F.md5(text.tokens(value)).alias("tokens_md5"))


@query
def slugify(spark, d):
    return load(spark, d, "part").select("p_partkey", text.slug(F.concat_ws(" - ", "p_name", "p_brand", "p_type"), "columna").alias("slug"), text.slug(F.lit("??"), "columna").alias("empty_slug"))


@query
def build_search_text(spark, d):
    return load(spark, d, "conversations").select("conv_id", "turn", F.md5(text.search_text(F.col("role"), F.col("text"), F.nullif(F.col("turn"), F.lit(1)))).alias("search_md5"))


@query
def extract_code(spark, d):
    p = load(spark, d, "part")
    area = F.regexp_extract(F.concat(F.lit("zona RH"), F.col("p_size").cast("string"), F.when(F.col("p_size") % 2 == 0, "Ad").otherwise("")), r"(RH\d+[A-Za-z]+)", 1)
    return p.select("p_partkey", codes.first_digits(F.col("p_brand")).alias("code"), codes.first_digits(F.col("p_name")).alias("no_code"), text.default_label(area, "RH18A").alias("area"))


@query
def code_stage(spark, d):
    stage, rule = codes.code_stage(F.col("codigo"))
    return registry(spark, d).select("id", stage.alias("stage"), rule.alias("rule"))


@query
def split_code_name(spark, d):
    forms = F.array(F.concat_ws(" ", F.lpad(F.col("n_nationkey").cast("string"), 3, "0"), "n_name"), F.concat(F.lit("Subsector 313 - "), F.col("n_name")), F.col("n_name"), F.lit(None).cast("string"), F.lit("074"), F.concat(F.col("n_name"), F.lit(" 4521")))
    df = load(spark, d, "nation").select("n_nationkey", F.posexplode(forms).alias("form", "label"))
    part = codes.split_code_name(F.col("label"))
    return df.select("n_nationkey", F.col("form").cast("long").alias("form"), part["code"].alias("code"), part["name"].alias("name"))


@query
def default_label(spark, d):
    raw = F.when(F.col("c_custkey") % 3 == 0, "").when(F.col("c_custkey") % 3 == 1, F.lit(None)).otherwise(F.col("c_mktsegment"))
    return load(spark, d, "customer").select("c_custkey", text.default_label(raw, "Puebla total").alias("label"))


@query
def keyword_list(spark, d):
    return searched(spark, d).select("id", "palabras_clave")


@query
def classify_relevance(spark, d):
    return searched(spark, d).groupBy("source", "categoria").agg(F.count("*").alias("n"))


@query
def suggest_keywords(spark, d):
    return reviewed(spark, d).select("id", "keywords_detectadas")


@query
def distance_bands(spark, d):
    df = registry(spark, d).withColumn("rango", geo.band(F.col("distancia")))
    near = distances(spark, d).withColumn("rango", geo.band(F.col("distance")))
    return df.groupBy("rango").agg(F.count("*").alias("n")).withColumn("layer", F.lit("documents")).unionByName(near.groupBy("rango").agg(F.count("*").alias("n")).withColumn("layer", F.lit("points")))


@query
def buffer_flags(spark, d):
    return registry(spark, d).select("id", *(geo.within(F.col("distancia"), b).alias(f"en_buffer_{b}m") for b in geo.BUFFERS))


@query
def search_query(spark, d):
    return classified(spark, d).select("id", "query_maps", "query_web")


@query
def first_nonempty(spark, d):
    a = F.when(F.col("c_custkey") % 4 == 0, "  ").when(F.col("c_custkey") % 4 == 1, F.lit(None)).otherwise(F.concat(F.lit(" "), F.col("c_name"), F.lit(" ")))
    b = F.when(F.col("c_custkey") % 8 < 6, F.col("c_mktsegment"))
    return load(spark, d, "customer").select("c_custkey", text.first_nonempty(a, b).alias("value"))


WORDS = ["Alta", " ALTO ", "alta-relevancia", "Mediana", "media", "No", "no pertinente", "Fuera", "Revisar", "duda", "baja", "", "mantener revisar", "Incluir prioritario", "excluir_por_renta", "Validar en campo", "otra"]


def _word(key: str) -> Column:
    return F.element_at(F.array(*map(F.lit, WORDS)), (F.col(key) % len(WORDS) + 1).cast("int"))


@query
def canonical_category(spark, d):
    return load(spark, d, "orders").select("o_orderkey", codes.canonical_category(_word("o_orderkey")).alias("category"))


@query
def normalize_decision(spark, d):
    return load(spark, d, "orders").select("o_orderkey", codes.decision(_word("o_orderkey")).alias("decision"))


@query
def suggest_category(spark, d):
    return reviewed(spark, d).select("id", "categoria_sugerida", "criterio_auditoria_sugerido")


@query
def suggest_priority(spark, d):
    return reviewed(spark, d).select("id", "prioridad_revision")


@query
def relevant_text(spark, d):
    df = load(spark, d, "documents").join(load(spark, d, "labels"), "doc_id", "left")
    return df.select("doc_id", text.relevant_text(F.col("source"), F.col("quality"), F.col("lang"), F.col("toxic")).alias("relevant"))


@query
def html_escape(spark, d):
    return load(spark, d, "pages").select("page_id", F.md5(text.html_escape(F.col("html"))).alias("escaped_md5"))


@query
def geojson_points(spark, d):
    # Python rounds half to even, hence bround.
    df = registry(spark, d).withColumn("d", F.coalesce(F.bround("distancia", 1).cast("string"), F.lit("")))
    lon, lat = (F.col("id") % 360 - 180).cast("long"), (F.col("id") % 180 - 90).cast("long")
    return df.select("id", geo.geojson_point(lon, lat, F.col("nombre").alias("nombre"), F.col("d").alias("distancia"), F.col("codigo").alias("codigo")).alias("feature"))


# -- rule cascade --------------------------------------------------------------------------------------------------------------------------


@query
def rule_cascade(spark, d):
    return classified(spark, d).select("id", F.col("branch").cast("long").alias("branch"), "etapa_productiva_sugerida", "etapa_productiva_secundaria", "presion_ambiental_potencial", "decision_estudio_sugerida", "confianza_clasificacion", "motivo_exclusion_prioritaria", "subtipo_confeccion")


@query
def rule_evidence(spark, d):
    return classified(spark, d).select("id", "evidencia_clasificacion", "reglas_activadas", "palabras_clave_etapa")


@query
def field_priority(spark, d):
    return classified(spark, d).select("id", "prioridad_campo", "motivo_prioridad_campo", "flag_estudio_prioritario", "motivo_flag_estudio_prioritario")


@query
def audit_need(spark, d):
    return classified(spark, d).select("id", "requiere_auditoria_manual", "prioridad_auditoria", "motivo_auditoria", "flag_posible_falso_negativo", "flag_texto_ambiguo")


@query
def scope_universe(spark, d):
    return classified(spark, d).select("id", "flag_universo_alcance_proyecto", "decision_alcance_proyecto", "motivo_universo_alcance_proyecto")


@query
def sheet_counts(spark, d):
    df = classified(spark, d)
    kept = workbook.filters("nombre", "distancia", "with the|avec")
    same = kept.pop("posibles_duplicados")
    return frames.conditional_counts(df.withColumn("same", same), kept | {"posibles_duplicados": F.col("same")}, "sheet")


@query
def audit_prepare(spark, d):
    return reviewed(spark, d).select("id", "keywords_detectadas", "categoria_sugerida", "criterio_auditoria_sugerido", "prioridad_revision", "query_maps", "query_web", "region_auditoria", "localidad_auditoria", "municipio_auditoria", F.md5("texto_auditoria_normalizado").alias("text_md5"))


# -- geometries ----------------------------------------------------------------------------------------------------------------------------


def shapes(spark: SparkSession, d: str) -> DataFrame:
    """Suppliers as geometries that need repair: open rings and lines with repeated vertices, points, and nothing."""
    k = F.col("s_suppkey")
    x, y = (k * 3571 % 20000).cast("double"), (k * 9173 % 20000).cast("double")
    at = lambda a, b: F.struct((x + a).alias("x"), (y + b).alias("y"))
    nowhere = F.struct(F.lit(None).cast("double").alias("x"), y.alias("y"))
    kinds = {
        "Polygon": F.array(F.array(at(0, 0), at(0, 0), at(100, 0), at(100, 50), nowhere, at(100, 50))),
        "LineString": F.array(F.array(at(0, 0), at(0, 0), at(30, 40))),
        "Point": F.array(F.array(at(0, 0))),
        "MultiLineString": F.array(F.array(at(0, 0), at(60, 80)), F.array(at(5, 5), at(5, 5))),
    }
    whole = [(k % 6 == n, F.struct(F.lit(kind).alias("type"), parts.alias("parts"))) for n, (kind, parts) in enumerate(kinds.items())]
    empty = F.struct(F.lit("LineString").alias("type"), F.array().cast("array<array<struct<x:double,y:double>>>").alias("parts"))
    return load(spark, d, "supplier").select(k.alias("id"), codes.first_match([*whole, (k % 6 == 4, empty)], None).alias("geometry"))


def bends(spark: SparkSession, d: str) -> DataFrame:
    """Suppliers as lines of five vertices: the second and fourth are on the way, the third is off it by some metres."""
    k = F.col("s_suppkey")
    x, y = (k * 3571 % 20000).cast("double"), (k * 9173 % 20000).cast("double")
    vertices = [(0.0, F.lit(0.0)), (100.0, F.lit(0.0)), (200.0, (k % 24).cast("double")), (300.0, F.lit(0.0)), (400.0, F.lit(0.0))]
    line = F.array(*(F.struct((x + a).alias("x"), (y + b).alias("y")) for a, b in vertices))
    return load(spark, d, "supplier").select(k.alias("id"), F.struct(F.lit("LineString").alias("type"), F.array(line).alias("parts")).alias("geometry"))


@query
def repair_geometry(spark, d):
    fixed = spatial.repair(shapes(spark, d))
    vertex = lambda v: F.concat_ws(" ", v.x.cast("long").cast("string"), v.y.cast("long").cast("string"))
    parts = F.transform("geometry.parts", lambda part: F.array_join(F.transform(part, vertex), ","))
    return fixed.select("id", F.col("geometry.type").alias("type"), F.array_join(parts, ";").alias("vertices"))


@query
def polygon_holes(spark, d):
    """Features of polygons with holes, and how many polygons and rings they have."""
    shape = F.col("geometry")
    nested = holed(spark, d).withColumn("polygons", geo.polygons(shape))
    feature = geo.geojson(shape, F.col("poly_id").alias("id"))
    return nested.select(F.col("poly_id").cast("long").alias("id"), F.size("polygons").cast("long").alias("n_polygons"), F.size(F.col("polygons")[0]).cast("long").alias("n_rings"), feature.alias("feature"))


def tangled(spark: SparkSession, d: str) -> DataFrame:
    """Suppliers as invalid polygons: bow-ties, squares with a spike, overlapping squares, a hole that sticks out, and valid ones."""
    k = F.col("s_suppkey")
    x, y, w = (k * 3571 % 20000).cast("double"), (k * 9173 % 20000).cast("double"), (k % 50 + 2).cast("double")
    ring = lambda *places: F.array(*(F.struct((x + w * a).alias("x"), (y + w * b).alias("y")) for a, b in places))
    square = lambda a, b, c: ring((a, b), (a + c, b), (a + c, b + c), (a, b + c), (a, b))
    kinds = [
        ("Polygon", F.array(ring((0, 0), (2, 2), (2, 0), (0, 2), (0, 0)))),
        ("Polygon", F.array(ring((0, 0), (4, 0), (4, 4), (6, 4), (4, 4), (0, 4), (0, 0)))),
        ("MultiPolygon", F.array(square(0, 0, 4), square(2, 2, 4))),
        ("Polygon", F.array(square(0, 0, 4), ring((1, 1), (1, 3), (6, 3), (6, 1), (1, 1)))),
        ("Polygon", F.array(square(0, 0, 4), ring((1, 1), (1, 2), (2, 2), (2, 1), (1, 1)))),
    ]
    shape = codes.first_match([(k % 5 == n, F.struct(F.lit(kind).alias("type"), parts.alias("parts"))) for n, (kind, parts) in enumerate(kinds)], None)
    return load(spark, d, "supplier").select(k.alias("id"), w.alias("w"), shape.alias("geometry"))


@query
def make_valid(spark, d):
    """Polygons, rings and even-odd area of repaired features."""
    fixed = spatial.repair(tangled(spark, d))
    nested = geo.polygons(F.col("geometry"))
    area = F.aggregate(F.transform("geometry.parts", geo.ring_area), F.lit(0.0), lambda total, a: total + a)
    return fixed.select("id", F.col("geometry.type").alias("type"), F.size(nested).cast("long").alias("n_polygons"), F.size("geometry.parts").cast("long").alias("n_rings"), r6(area).alias("area"))


@query
def polygon_segments(spark, d):
    return spatial.boundary_segments(borders(spark, d)).select("id", *(F.col(c).cast("long").alias(c) for c in ("x1", "y1", "x2", "y2")))


def borders(spark: SparkSession, d: str) -> DataFrame:
    return polygons(spark, d).select(F.col("poly_id").alias("id"), F.struct(F.lit("Polygon").alias("type"), F.array("ring").alias("parts")).alias("geometry"))


@query
def nearest_border(spark, d):
    """Without lines, borders of polygons stand for them."""
    edges = spatial.boundary_segments(borders(spark, d))
    return spatial.nearest_distance(points(spark, d), edges, "id", POINTS_CELL, EXTENT).select("id", r6(F.col("distance")).alias("distance"))


@query
def tile_pyramid(spark, d):
    """Tiles of a map of customers: leaves of at most 40, and overviews that merge what lies in one cell."""
    k = F.col("c_custkey")
    place = F.struct((F.lit(-117.03) + k * 7919 % 300 / 10).alias("x"), (F.lit(14.07) + k * 10473 % 180 / 10).alias("y"))
    features = load(spark, d, "customer").select(k.alias("id"), F.struct(F.lit("Point").alias("type"), F.array(F.array(place)).alias("parts")).alias("geometry"))
    made = tiles.pyramid(features, most=40, deepest=9)
    return made.groupBy("z", "x", "y", "leaf").agg(F.count("*").alias("items"), F.sum("n").alias("n")).withColumn("z", F.col("z").cast("long"))


@query
def crop_lines(spark, d):
    box = (4000.0, 4000.0, 9000.0, 8000.0)
    near = spatial.crop_geometries(bends(spark, d), "geometry", box, 500.0).select(F.lit("near").alias("crop"), "id")
    return near.unionByName(spatial.crop_geometries(bends(spark, d), "geometry", (-9e6, -9e6, -8e6, -8e6)).select(F.lit("none").alias("crop"), "id"))


@query
def geojson_shapes(spark, d):
    fixed = spatial.repair(shapes(spark, d)).filter(F.col("id") % 6 != 3)
    return fixed.select("id", geo.geojson(F.col("geometry"), F.col("id").alias("id"), F.lit(None).cast("string").alias("tipo")).alias("feature"))


@query
def simplify_lines(spark, d):
    lines = spatial.simplify(bends(spark, d), "geometry", 12.0)
    return lines.select("id", F.size(F.col("geometry.parts")[0]).cast("long").alias("n_vertices"))


def lattice(spark: SparkSession, d: str) -> DataFrame:
    """Nations as squares that share their sides, each with a vertex off its middle by up to 23 metres, the same for both squares."""
    k = F.col("n_nationkey")
    i, j = (k % 5).cast("int"), F.floor(k / 5).cast("int")
    at = lambda x, y: F.struct((x * 1000.0).cast("double").alias("x"), (y * 1000.0).cast("double").alias("y"))
    bump = lambda a, b, turn: ((a * 7 + b * 11 + turn * 5) % 24) / 1000.0
    ring = [at(i, j), at(i + 0.5, j + bump(i, j, 0)), at(i + 1, j), at(i + 1 + bump(i + 1, j, 1), j + 0.5), at(i + 1, j + 1), at(i + 0.5, j + 1 + bump(i, j + 1, 0)), at(i, j + 1), at(i + bump(i, j, 1), j + 0.5), at(i, j)]
    return load(spark, d, "nation").select(k.cast("long").alias("id"), F.struct(F.lit("Polygon").alias("type"), F.array(F.array(*ring)).alias("parts")).alias("geometry"))


@query
def simplify_borders(spark, d):
    """Vertices and areas of squares whose shared sides are simplified once for both."""
    thin = simplify_shared(lattice(spark, d), "id", 12.0)
    return thin.select("id", F.size(F.col("geometry.parts")[0]).cast("long").alias("n_vertices"), r6(geo.ring_area(F.col("geometry.parts")[0])).alias("area"))


@query
def display_projection(spark, d):
    k = F.col("c_custkey")
    there = geo.project_lcc(F.lit(-110.0) + k % 200 / 10, F.lit(15.0) + k % 170 / 10)
    back = load(spark, d, "customer").select("c_custkey", there.alias("p")).select("c_custkey", geo.unproject_lcc(F.col("p.x"), F.col("p.y")).alias("q"))
    return back.select("c_custkey", r6(F.col("q.lon")).alias("lon"), r6(F.col("q.lat")).alias("lat"))


def layers(spark: SparkSession, d: str) -> DataFrame:
    """Suppliers as features of as many layers as there are nations, some of them unreadable."""
    c = F.col
    base = load(spark, d, "supplier").join(shapes(spark, d).withColumnRenamed("id", "s_suppkey"), "s_suppkey")
    values = F.create_map(F.lit("clave"), c("s_suppkey").cast("string"), F.lit("saldo"), F.when(c("s_suppkey") % 4 != 0, c("s_acctbal").cast("string")), F.lit("nombre"), F.when(c("s_suppkey") % 3 != 0, c("s_name")))
    broken = c("s_nationkey") % 9 == 0
    return base.select(
        F.concat(F.lit("raw/"), c("s_nationkey").cast("string"), F.lit(".shp")).alias("source_path"), F.when(~broken, c("s_suppkey")).alias("feature_id"), F.when(~broken, c("geometry")).alias("geometry"),
        F.when(~broken, values).alias("attributes"), F.when(~broken, F.when(c("s_nationkey") % 2 == 0, "EPSG:6372")).alias("crs"), F.when(broken, "UnicodeDecodeError: bytes").alias("error"),
    )


@query
def layer_profile(spark, d):
    found = profiles.layer_profile(layers(spark, d))
    columns = F.array_join(F.transform("columns", lambda x: F.concat_ws(":", x["name"], x["dtype"], x["n_null"].cast("string"))), ",")
    bounds = [F.col(f"bounds.{c}").alias(c) for c in ("minx", "miny", "maxx", "maxy")]
    return found.select("source_path", "n_features", F.array_join("geometry_types", ",").alias("geometry_types"), F.array_join("crs", ",").alias("crs"), "n_null_geometry", columns.alias("columns"), *bounds, "status", "error")


# -- workbook, catalogue, legend -------------------------------------------------------------------------------------------------------------


@query
def column_catalogue(spark, d):
    return frames.column_catalogue(spark, {t: load(spark, d, t) for t in ("documents", "labels", "nation")}).select("name", F.col("place").cast("long").alias("place"), "column", "dtype")


@query
def missing_columns(spark, d):
    gone = {t: frames.missing_columns(load(spark, d, t), ["doc_id", "text", "quality", "n_name"]) for t in ("documents", "labels", "nation")}
    return spark.createDataFrame([(t, not c, ", ".join(c)) for t, c in gone.items()], "name string, ok boolean, detalle string")


@query
def rule_catalogue(spark, d):
    return workbook.rule_catalogue(spark)


@query
def rule_usage(spark, d):
    """The catalogue of families with the number of establishments that hold a term of each."""
    df = cascade.with_signals(searched(spark, d), PROSE)
    used = frames.conditional_counts(df, {f: F.size(f"t_{f}") > 0 for f in PROSE.families}, "familia_regla")
    return workbook.rule_catalogue(spark, PROSE.families).join(used, "familia_regla").select("familia_regla", "terminos", "n")


@query
def fill_instructions(spark, d):
    return workbook.instructions(spark)


@query
def control_sheet(spark, d):
    df = classified(spark, d)
    out = frames.stacked(checks.quality_checks(df, load(spark, d, "documents").count()), frames.conditional_counts(df, cascade.universes(), "universe"))
    return out.select(F.col("__part").cast("long").alias("part"), "validacion", "ok", "universe", "n")


@query
def review_summary(spark, d):
    return workbook.review_summary(reviewed(spark, d), "distancia")


@query
def map_colors(spark, d):
    columns = ["etapa_productiva_sugerida", "presion_ambiental_potencial", "confianza_clasificacion", "prioridad_auditoria", "municipio"]
    return classified(spark, d).select("id", *(workbook.color(c, F.col(c)).alias(c) for c in columns))


@query
def legend_groups(spark, d):
    df = load(spark, d, "documents").select(F.when(F.col("doc_id") % 11 == 0, "").otherwise(F.col("source")).alias("source"))
    return frames.legend(df, "source")


@query
def provenance(spark, d):
    """Paths as a scan of a source folder would give them, some of them from elsewhere."""
    c = F.col
    folder = codes.first_match([(c("doc_id") % 4 == 0, F.lit("data/raw/")), (c("doc_id") % 4 == 1, F.concat(F.lit("data/raw/"), c("lang"), F.lit("/"))), (c("doc_id") % 4 == 2, F.concat(F.lit("data/raw/"), c("lang"), F.lit("/"), c("source"), F.lit("/")))], F.concat(F.lit("elsewhere/"), c("lang"), F.lit("/")))
    df = load(spark, d, "documents").select("doc_id", F.concat(folder, c("source"), F.lit(".shp")).alias("path"))
    return df.select("doc_id", paths.relative(c("path"), "data").alias("relpath"), paths.origin_folder(c("path"), "data/raw").alias("origin"), paths.file_name(c("path")).alias("file"))
