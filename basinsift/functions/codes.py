"""Activity codes, labels and the small vocabularies of manual decisions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from basinsift.functions.text import normalize, slug, tokens

# Synonyms of the manual categories and the decisions that may be given.
CATEGORY_SYNONYMS = {
    "alta_relevancia_ambiental": ["alta", "alto", "alta_relevancia", "alta_relevancia_ambiental"],
    "media_relevancia_ambiental": ["media", "medio", "mediana", "media_relevancia", "media_relevancia_ambiental"],
    "excluir": ["excluir", "no", "no_pertinente", "descartar", "fuera"],
    "mantener_revisar": ["revisar", "mantener_revisar", "duda", "pendiente"],
}
DECISIONS = [
    "incluir_prioritario",
    "incluir_contexto_productivo",
    "excluir_del_universo_prioritario",
    "excluir_por_comercio",
    "excluir_por_renta",
    "mantener_pendiente",
    "validar_documentalmente",
    "validar_en_campo",
]
# Stage of an activity code, exact or by prefix.
CODE_STAGES = {
    "812210": "lavanderia_industrial",
    "313": "fabricacion_textil",
    "314": "fabricacion_textil",
    "315": "confeccion_maquila",
    "323": "estampado_serigrafia",
}


def first_digits(col: Column) -> Column:
    return F.regexp_extract(F.coalesce(col, F.lit("")), r"(\d+)", 1)


def has_prefix(col: Column, prefixes: list[str]) -> Column:
    out = F.lit(False)
    for prefix in prefixes:
        out = out | F.coalesce(col, F.lit("")).startswith(prefix)
    return out


def code_stage(col: Column, stages: dict[str, str] = CODE_STAGES) -> tuple[Column, Column]:
    """Stage and rule name: an exact code counts before prefixes, which count in their order."""
    code = F.regexp_replace(F.coalesce(col, F.lit("")), r"\D+", "")
    cases = [(code == k, v, f"scian_{k}") for k, v in stages.items()] + [(code.startswith(k), v, f"scian_prefijo_{k}") for k, v in stages.items()]
    return _cases([(c, F.lit(v)) for c, v, _ in cases], ""), _cases([(c, F.lit(r)) for c, _, r in cases], "")


def _cases(cases: list[tuple[Column, Column]], default) -> Column:
    out = None
    for condition, value in cases:
        out = F.when(condition, value) if out is None else out.when(condition, value)
    default = F.lit(default) if not isinstance(default, Column) else default
    return default if out is None else out.otherwise(default)


first_match = _cases


def split_code_name(col: Column) -> Column:
    """``code, name``: a first word of digits; else the first 3 to 6 digits between word borders and the text behind them; else no code."""
    text = F.coalesce(col, F.lit(""))
    first, rest = F.regexp_extract(text, r"(?s)^([0-9]+)(?: (.*))?$", 1), F.regexp_extract(text, r"(?s)^[0-9]+ (.*)$", 1)
    inner = F.regexp_extract(text, r"\b([0-9]{3,6})\b", 1)
    behind = F.regexp_replace(F.regexp_extract(text, r"(?s)\b[0-9]{3,6}\b(.*)$", 1), "^[ :-]+|[ :-]+$", "")
    code = F.when(first != "", first).otherwise(inner)
    name = F.when(first != "", rest).when((inner != "") & (behind != ""), behind).otherwise(text)
    return F.struct(code.alias("code"), name.alias("name"))


def canonical_category(col: Column) -> Column:
    text = slug(col)
    return _cases([(text.isin(words), F.lit(name)) for name, words in CATEGORY_SYNONYMS.items()], "")


def decision(col: Column) -> Column:
    text = slug(col)
    return F.when(text.isin(DECISIONS), text).otherwise("")


def location(source: Column) -> Column:
    """``locality, municipality`` of a source folder; unknown folders keep their name."""
    text = tokens(source)
    place = lambda a, b: F.struct(F.lit(a).alias("locality"), F.lit(b).alias("municipality"))
    return (
        F.when(text.contains("xalmimilulco"), place("Santa Ana Xalmimilulco", "Huejotzingo"))
        .when(text.contains("san martin"), place("San Martin Texmelucan", "San Martin Texmelucan"))
        .when(text.contains("huejotzingo"), place("Huejotzingo", "Huejotzingo"))
        .otherwise(F.struct(F.coalesce(source, F.lit("")).alias("locality"), F.lit("").alias("municipality")))
    )


def region(source: Column) -> Column:
    text = tokens(source)
    return F.when(text.contains("xalmimilulco"), "xalmimilulco").when(text.contains("san martin"), "san_martin").when(text.contains("huejotzingo"), "huejotzingo").otherwise("")


def layer_type(path: Column) -> Column:
    """Layer of a file from its path and its name without suffix, first match; null if none."""
    text = normalize(path)
    name = F.regexp_replace(F.regexp_extract(text, r"([^/\\]*)$", 1), r"\.[^.]*$", "")
    rural = name.contains("arearuralesnoamanzanadas")
    cases = [
        (text.contains("hidrografia_atoyac") | text.contains("hidrologia_atoyac"), "hidrografia"),
        (name.contains("denue"), "denue"),
        (name.contains("ageb") & ~name.contains("arearurales"), "agebs"),
        (rural, None),
        (name.contains("manzana"), "manzanas"),
        (name.contains("localidad"), "localidades"),
        (name.contains("vialidad"), "vialidades"),
        (name.contains("camino") | name.contains("carretera"), "caminos_carreteras"),
        (name.contains("cuenca"), "cuencas"),
    ]
    return _cases([(c, F.lit(v).cast("string")) for c, v in cases], F.lit(None).cast("string"))


def safe_number(col: Column) -> Column:
    """Number or null; blanks, words and NaN are null."""
    value = F.trim(col.cast("string")).try_cast("double")
    return F.when(F.isnan(value), F.lit(None)).otherwise(value)


def ratio(a: Column, b: Column) -> Column:
    """a / b; null where b is null or zero."""
    return a / F.nullif(b, F.lit(0.0))
