import math
import random

from pyspark.sql import functions as F

from basinsift.functions import codes, geo, text
from basinsift.operators import frames, spatial
from basinsift.plans import cascade
from basinsift.plans.catalogue import Catalogue


def one(spark, column, **values):
    df = spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} {'double' if isinstance(v, float) else 'string'}" for k, v in values.items())) if values else spark.range(1)
    return df.select(column.alias("v")).first()["v"]


def test_two_normalisers(spark):
    raw = "  Téñido, Ropa\t y  más! "
    assert one(spark, text.normalize(F.col("t")), t=raw) == "tenido, ropa y mas!"
    assert one(spark, text.tokens(F.col("t")), t=raw) == "tenido ropa y mas"
    assert one(spark, text.tokens(F.col("t")), t=None) == ""


def test_substring_and_token_terms(spark):
    assert one(spark, text.contains_any(F.lit("contenido"), ["tenido"])) is True
    assert one(spark, text.has_any(F.lit("contenido"), ["tenido"])) is False
    assert one(spark, text.substring_list(F.lit("jeans maquiladora maquila"), ["maquila", "jeans"])) == "jeans; maquila"
    assert one(spark, text.terms_found(F.lit("tenido de ropa"), ["teñido", "tenido", "ropa"])) == ["ropa", "tenido", "teñido"]


def test_token_match_is_border_match(spark):
    import re

    rng = random.Random(1)
    words = ["".join(rng.choice("ab") for _ in range(rng.randint(1, 3))) for _ in range(400)]
    rows = [(" ".join(rng.sample(words, 4)),) for _ in range(200)]
    for term in ("a", "ab", "b a"):
        got = [r["v"] for r in spark.createDataFrame(rows, "t string").select(text.has_term(F.col("t"), term).alias("v")).collect()]
        assert got == [bool(re.search(rf"(?<![a-z0-9]){term}(?![a-z0-9])", t)) for (t,) in rows]


def test_band_edges(spark):
    expected = {0.0: "0-100 m", 100.0: "0-100 m", 100.01: "100-250 m", 250.0: "100-250 m", 500.0: "250-500 m", 1000.0: "500-1000 m", 1000.5: ">1000 m"}
    for d, label in expected.items():
        assert one(spark, geo.band(F.lit(d))) == label
    assert one(spark, geo.band(F.lit(None).cast("double"))) == "sin distancia"
    assert one(spark, geo.band(F.lit(float("nan")))) == "sin distancia"
    assert one(spark, geo.within(F.lit(float("nan")), 100)) is False


def test_codes(spark):
    pair = lambda t: tuple(one(spark, codes.split_code_name(F.col("t")), t=t))
    assert pair("074 Huejotzingo") == ("074", "Huejotzingo")
    assert pair("Subsector 313 - Insumos") == ("313", "Insumos")
    assert pair("Puebla") == ("", "Puebla")
    assert pair(None) == ("", "")
    stage, rule = codes.code_stage(F.col("t"))
    assert one(spark, stage, t="812210") == "lavanderia_industrial" and one(spark, rule, t="812210") == "scian_812210"
    assert one(spark, rule, t="315225") == "scian_prefijo_315" and one(spark, stage, t=None) == ""
    assert one(spark, codes.canonical_category(F.col("t")), t="Alta Relevancia") == "alta_relevancia_ambiental"
    assert one(spark, codes.canonical_category(F.col("t")), t="baja") == ""
    assert one(spark, codes.decision(F.col("t")), t="Validar en campo") == "validar_en_campo"
    assert one(spark, codes.safe_number(F.col("t")), t="NaN") is None
    assert one(spark, codes.ratio(F.lit(1.0), F.lit(0.0))) is None


def test_headers():
    assert frames.unique_names(["Año", "ano", "", "%"]) == ["ano", "ano_2", "columna", "columna_2"]


def test_projection_to_metres(spark):
    x, y = one(spark, geo.project_lcc(F.lit(-102.0), F.lit(12.0)))
    assert math.isclose(x, 2_500_000, abs_tol=1e-6) and math.isclose(y, 0, abs_tol=1e-6)


BRANCHES = [
    (1, "taller mecanico", ""), (2, "lavado de jeans", ""), (2, "sin datos", "812210"), (3, "mezclilla industrial", ""), (4, "maquila", ""), (5, "serigrafia", ""),
    (6, "vestidos de novia", ""), (7, "alquiler", ""), (8, "boutique", ""), (9, "hilos", "313110"), (10, "ropa", ""), (11, "hola", ""),
]


def test_cascade_branches(spark):
    rows = [(k, f"n{k}", t, c, "", 300.0 if k % 2 else 100.0, "agebs\\huejotzingo") for k, (_, t, c) in enumerate(BRANCHES)]
    df = spark.createDataFrame(rows, "id int, nombre string, texto_busqueda string, codigo string, palabras_clave string, distancia double, source_folder string")
    got = {r["id"]: r for r in cascade.classify(df, Catalogue()).collect()}
    assert [got[k]["branch"] for k in range(len(BRANCHES))] == [b for b, _, _ in BRANCHES]
    stages = {r["etapa_productiva_sugerida"] for r in got.values()}
    assert "desconocido" not in stages and "tratamiento_especial_prenda" not in stages
    assert got[1]["prioridad_campo"] == "alta" and got[2]["prioridad_campo"] == "muy_alta"
    assert got[3]["etapa_productiva_secundaria"] == "" and got[3]["decision_estudio_sugerida"] == "validar_documentalmente"
    assert all(r["flag_universo_alcance_proyecto"] != r["flag_fuera_alcance_productivo_textil"] for r in got.values())
    assert got[0]["localidad"] == "Huejotzingo" and got[0]["query_maps"] == "n0 Huejotzingo Puebla Google Maps"


def test_cascade_stays_in_codegen(spark):
    df = spark.createDataFrame([(1, "a", "b", "c", "d", 1.0, "e")], "id int, nombre string, texto_busqueda string, codigo string, palabras_clave string, distancia double, source_folder string")
    plan = cascade.classify(df, Catalogue())._jdf.queryExecution().toString()
    assert "Python" not in plan


def test_nearest_is_exact(spark):
    rng = random.Random(5)
    pts = [(k, rng.uniform(-3000, 3000), rng.uniform(-3000, 3000)) for k in range(60)] + [(99, 90000.0, 0.0)]
    seg = [tuple(rng.uniform(-3000, 3000) for _ in range(4)) for _ in range(12)] + [(5.0, 5.0, 5.0, 5.0)]
    got = {r["id"]: r["distance"] for r in spatial.nearest_distance(spark.createDataFrame(pts, "id int, x double, y double"), spark.createDataFrame(seg, "x1 double, y1 double, x2 double, y2 double"), "id", 200.0, 200000.0).collect()}

    def far(x, y, x1, y1, x2, y2):
        dx, dy = x2 - x1, y2 - y1
        t = max(0, min(1, ((x - x1) * dx + (y - y1) * dy) / (dx * dx + dy * dy))) if dx or dy else 0
        return math.hypot(x - x1 - t * dx, y - y1 - t * dy)

    for k, x, y in pts:
        assert math.isclose(got[k], min(far(x, y, *s) for s in seg), rel_tol=1e-9)
    none = spatial.nearest_distance(spark.createDataFrame(pts[:1], "id int, x double, y double"), spark.createDataFrame([], "x1 double, y1 double, x2 double, y2 double"), "id", 200.0, 800.0).collect()
    assert none[0]["distance"] is None


def test_point_on_border_and_overlap(spark):
    ring = lambda x: [(x, 0.0), (x + 2.0, 0.0), (x + 2.0, 2.0), (x, 2.0), (x, 0.0)]
    polygons = spark.createDataFrame([(1, ring(0.0)), (2, ring(1.0))], "p int, ring array<struct<x:double,y:double>>")
    points = spark.createDataFrame([(1, 1.5, 1.0), (2, 0.0, 1.0), (3, 9.0, 9.0)], "id int, x double, y double")
    got = sorted((r["id"], r["p"] or 0) for r in spatial.point_in_polygon(points, polygons, "id", "p", 1.0).collect())
    assert got == [(1, 1), (1, 2), (2, 0), (3, 0)]


def test_keep_last_with_null_keys(spark):
    df = spark.createDataFrame([("a", 1, 1), ("a", 2, 1), (None, 1, 2), (None, 1, 1)], "k string, f int, r int")
    assert sorted((r["k"] or "", r["f"], r["r"]) for r in frames.keep_last(df, ["k"], ["f", "r"]).collect()) == [("", 1, 2), ("a", 2, 1)]


def test_folding_equals_the_full_decomposition(spark):
    """Every assigned code point, alone and between letters; and decomposed accents in words."""
    import unicodedata

    rows = [(chr(c),) for c in range(1, 0x110000) if not 0xD800 <= c <= 0xDFFF and unicodedata.category(chr(c)) != "Cn"]
    df = spark.createDataFrame(rows, "c string").repartition(4)
    found = df.select("c", text.strip_accents(F.col("c")).alias("one"), text.strip_accents(F.concat(F.lit("é"), F.col("c"), F.lit("Ź"))).alias("three")).collect()
    assert len(found) == len(rows) > 280_000
    assert [r["c"] for r in found if r["one"] != text.strip_py(r["c"]) or r["three"] != text.strip_py("é" + r["c"] + "Ź")] == []
    words = ["café lavandería", "ẽ Ｔ ﬁn", "각 ㎏ ½", "İstanbul ẞ ǆ", None, "plain"]
    tokens = spark.createDataFrame([(w,) for w in words], "w string").select(text.tokens(F.col("w")).alias("t"), text.fold(F.col("w")).alias("f")).collect()
    assert [r["t"] for r in tokens] == [text.tokens_py(w or "") for w in words] and tokens[0]["t"] == "cafe lavanderia"
    assert [r["f"] for r in tokens] == [text.fold_py(w or "") for w in words]


def test_a_long_text_is_folded_in_runs(spark):
    long = "x" * 1000 + "ﬁ" + "е́\n\x01" * 1000 + "각\U0001d431" + "z" * 1000
    odd = [long, "ﬁﬁ", "ﬁ", "\nﬁ\r\nﬁ ", "́각\U0001f600ﷺ[^]&&-\\", ""]
    pieces, value = F.regexp_extract_all("s", F.lit(text._classes()[2]), F.lit(0)), text.strip_accents(F.col("s"))
    rows = spark.createDataFrame([(s,) for s in odd], "s string").select("s", pieces.alias("pieces"), value.alias("plain")).collect()
    assert [len(r["pieces"]) for r in rows if r["s"] == long] == [5]  # each character was one before
    assert all("".join(r["pieces"]) == r["s"] and r["plain"] == text.strip_py(r["s"]) for r in rows)
