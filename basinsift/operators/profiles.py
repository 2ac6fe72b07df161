"""Profile of layers: one mergeable aggregate over the features of any number of files."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from basinsift.functions import geo

_BOX = ["minx", "miny", "maxx", "maxy"]
#: Kinds of text values, from the narrowest; an attribute has the narrowest that all of its values fit.
_NUMBER, _WHOLE = r"^\s*[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?\s*$", r"^\s*[+-]?\d{1,18}\s*$"


def layer_profile(features: DataFrame) -> DataFrame:
    """One row for each ``source_path``: features, geometry types, reference systems, null geometries, attributes, bounds, status, error.

    ``columns`` is an array of (name, dtype, n_null) by name; the dtype is inferred from the texts (int64, float64, object), and
    null counts include features that lack the attribute.  A layer with any error has the status ``error`` and its least error
    text; files without features but with an error are rows too.  Both steps are aggregates with partial sums: a layer of any
    size is no single group, and the rows of the second are the attributes of each layer.
    """
    shape, box = F.col("geometry"), geo.box(F.col("geometry"))
    is_feature = F.col("error").isNull()
    entry = lambda name, value: F.struct(name.alias("name"), value.alias("value"))
    entries = F.concat(F.array(entry(F.lit(None).cast("string"), F.lit(None).cast("string"))), F.transform(F.coalesce(F.map_entries("attributes"), F.array().cast("array<struct<key:string,value:string>>")), lambda e: entry(e.key, e.value)))
    own = F.col("name").isNull()  # the row of the feature itself
    rows = features.select("source_path", "crs", "error", shape["type"].alias("kind"), (is_feature & shape.isNull()).alias("blank"), is_feature.alias("is_feature"), box.alias("box"), F.inline(entries))
    filled = F.col("value").isNotNull()
    first = rows.groupBy("source_path", "name").agg(
        F.count_if("is_feature").alias("n"), F.count_if(filled).alias("n_filled"), F.bool_and(F.when(filled, F.col("value").rlike(_WHOLE))).alias("whole"), F.bool_and(F.when(filled, F.col("value").rlike(_NUMBER))).alias("number"),
        F.collect_set(F.when(own, F.col("kind"))).alias("kinds"), F.collect_set(F.when(own, F.col("crs"))).alias("systems"), F.count_if(own & F.col("blank")).alias("n_blank"), F.min("error").alias("error"),
        *(f(F.when(own, F.col(f"box.{c}"))).alias(c) for c, f in zip(_BOX, (F.min, F.min, F.max, F.max), strict=True)),
    )
    dtype = F.when(F.col("whole"), "int64").when(F.col("number"), "float64").otherwise("object")
    only = lambda c: F.max(F.when(own, F.col(c)))
    layer = first.groupBy("source_path").agg(
        only("n").alias("n_features"), F.array_sort(only("kinds")).alias("geometry_types"), F.array_sort(only("systems")).alias("crs"), only("n_blank").alias("n_null_geometry"),
        F.array_sort(F.collect_list(F.when(~own, F.struct("name", dtype.alias("dtype"), F.col("n_filled").alias("n_null"))))).alias("columns"),
        F.struct(*(only(c).alias(c) for c in _BOX)).alias("bounds"), F.min("error").alias("error"),
    )
    columns = F.transform("columns", lambda c: F.struct(c["name"].alias("name"), c["dtype"].alias("dtype"), (F.col("n_features") - c["n_null"]).alias("n_null")))
    return layer.withColumn("columns", columns).select("source_path", "n_features", "geometry_types", "crs", "n_null_geometry", "columns", "bounds", F.when(F.col("error").isNull(), "ok").otherwise("error").alias("status"), F.coalesce("error", F.lit("")).alias("error"))
