"""Operators over whole frames: projection, union, joins by position, sequence numbers, tallies."""

from __future__ import annotations

from collections import Counter
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from basinsift.functions.text import clean_name, fold_py
from basinsift.operators.shared import materialize


def project(df: DataFrame, columns: list[str]) -> DataFrame:
    """Those of the listed columns that exist."""
    return df.select(*(c for c in columns if c in df.columns))


def ensure(df: DataFrame, columns: list[str], value="") -> DataFrame:
    return df.withColumns({c: F.lit(value) for c in columns if c not in df.columns})


def union_tagged(frames: dict[str, DataFrame], tag: str) -> DataFrame:
    """Bag union by name with the frame's key as a column; columns absent from one are null."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), (df.withColumn(tag, F.lit(k)) for k, df in frames.items()))


def unique_names(names: list[object]) -> list[str]:
    """Clean headers; repeated ones get ``_2``, ``_3``, ..."""
    seen: Counter[str] = Counter()
    out = []
    for name in map(clean_name, names):
        seen[name] += 1
        out.append(name if seen[name] == 1 else f"{name}_{seen[name]}")
    return out


def detect_roles(columns: list[str], roles: dict[str, list[str]]) -> dict[str, str]:
    """Column of each role: the first whose name holds the role's first two tokens or is one of them, else one that holds any."""
    found = {}
    for role, words in roles.items():
        strict = (c for c in columns if all(w in fold_py(c) for w in words[:2]) or fold_py(c) in words)
        loose = (c for c in columns if any(w in fold_py(c) for w in words))
        column = next(strict, None) or next(loose, None)
        if column:
            found[role] = column
    return found


def with_row_number(df: DataFrame, order: list, name: str = "row_id") -> DataFrame:
    """Numbers rows from 1 in a total order without gathering them: ranges are sorted, counted and offset."""
    ranged = df.repartitionByRange(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *order).sortWithinPartitions(*order)
    ranged = materialize(ranged.withColumn("__m", F.monotonically_increasing_id()), "ranged").withColumn("__p", F.shiftright("__m", 33))
    counts = ranged.groupBy("__p").agg(F.count("*").alias("__n"))
    before = Window.orderBy("__p").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("__p", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__o"))
    numbered = ranged.join(F.broadcast(offsets), "__p")  # one row for each range
    return numbered.withColumn(name, F.col("__o") + F.col("__m").bitwiseAND(F.lit((1 << 33) - 1)) + 1).drop("__m", "__p", "__o")


def zip_positional(left: DataFrame, right: DataFrame, left_order: list, right_order: list) -> DataFrame:
    """Joins the n-th row of one side with the n-th of the other."""
    return with_row_number(left, left_order, "position").join(with_row_number(right, right_order, "position"), "position")


def keep_last(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The last row of each key in the given order; null keys are a key."""
    w = Window.partitionBy(*keys).orderBy(*(F.col(c).desc() for c in order))
    return df.withColumn("__n", F.row_number().over(w)).filter("__n = 1").drop("__n")


def tally(df: DataFrame, flags: list[str], name: str = "flag") -> DataFrame:
    """True and false counts of boolean columns in one pass, as rows."""
    counts = df.agg(*(F.count_if(F.col(f)).alias(f) for f in flags), F.count("*").alias("__n"))
    rows = F.array(*(F.struct(F.lit(f).alias(name), F.col(f).alias("n_true"), (F.col("__n") - F.col(f)).alias("n_false")) for f in flags))
    return counts.select(F.inline(rows))


def conditional_counts(df: DataFrame, conditions: dict[str, Column], name: str) -> DataFrame:
    """``name, n`` for named predicates in one pass."""
    counts = df.agg(*(F.count_if(F.coalesce(c, F.lit(False))).alias(f"c{k}") for k, c in enumerate(conditions.values())))
    return counts.select(F.inline(F.array(*(F.struct(F.lit(n).alias(name), F.col(f"c{k}").alias("n")) for k, n in enumerate(conditions)))))


def count_each(df: DataFrame, columns: list[str]) -> DataFrame:
    """``dimension, value, n`` of several columns in one pass; nulls are a group."""
    pairs = F.array(*(F.struct(F.lit(c).alias("dimension"), F.col(c).cast("string").alias("value")) for c in columns))
    return df.select(F.inline(pairs)).groupBy("dimension", "value").agg(F.count("*").alias("n"))


def nulls_to_empty(df: DataFrame) -> DataFrame:
    return df.na.fill("", [c for c, kind in df.dtypes if kind == "string"])


def profile(frames: dict[str, DataFrame]) -> DataFrame:
    """Rows, number and list of columns of each frame."""
    parts = [df.agg(F.count("*").alias("n_rows")).select(F.lit(k).alias("name"), "n_rows", F.lit(len(df.columns)).cast("long").alias("n_columns"), F.lit(", ".join(df.columns)).alias("columns")) for k, df in frames.items()]
    return reduce(DataFrame.unionByName, parts)


#: Bits of a key filter: one row of 64 bits for each word, so the table that is broadcast has a fixed size.
FILTER_BITS = 1 << 22


def key_filter(keys: DataFrame) -> DataFrame:
    """``word, bits``: a bit for the hash of every value of the column ``v``; others may share a bit."""
    at = F.pmod(F.xxhash64("v"), F.lit(FILTER_BITS))
    return keys.select(F.shiftright(at, 6).alias("word"), F.expr(f"shiftleft(1L, CAST(pmod(xxhash64(v), {FILTER_BITS}L) % 64 AS int))").alias("bit")).groupBy("word").agg(F.bit_or("bit").alias("bits"))


def join_column(left: DataFrame, right: DataFrame, key: str) -> str | None:
    """The first column of the left side that shares a value (as text) with the right side's key.

    One pass over the left side tests the values of all columns against a filter of the keys; what passes is made distinct and
    joined with the keys, which removes values that only share a bit.
    """
    keys = right.select(F.col(key).cast("string").alias("v")).filter("v IS NOT NULL").distinct()
    quoted = [F.col(f"`{c.replace('`', '``')}`") for c in left.columns]
    simple = [k for k, f in enumerate(left.schema) if f.dataType.typeName() not in ("array", "map", "struct")]
    if not simple:
        return None
    values = left.select(F.inline(F.array(*(F.struct(F.lit(k).alias("place"), quoted[k].cast("string").alias("v")) for k in simple)))).filter("v IS NOT NULL")
    possible = values.withColumn("word", F.expr(f"shiftright(pmod(xxhash64(v), {FILTER_BITS}L), 6)")).join(F.broadcast(key_filter(keys)), "word")  # FILTER_BITS / 64 rows at most
    possible = possible.filter(F.expr(f"(shiftright(bits, CAST(pmod(xxhash64(v), {FILTER_BITS}L) % 64 AS int)) & 1) = 1")).select("place", "v").distinct()
    place = possible.join(keys, "v", "left_semi").agg(F.min("place")).first()[0]
    return None if place is None else left.columns[place]


def column_catalogue(spark: SparkSession, frames: dict[str, DataFrame]) -> DataFrame:
    """``name, place, column, dtype`` of every column of each frame, from the schemas alone."""
    rows = [(name, k, column, kind) for name, df in frames.items() for k, (column, kind) in enumerate(df.dtypes, 1)]
    return spark.createDataFrame(rows, "name string, place int, column string, dtype string")


def missing_columns(df: DataFrame, expected: list[str]) -> list[str]:
    """Expected columns that the frame lacks, in their order."""
    return [c for c in expected if c not in df.columns]


def tabular(df: DataFrame) -> DataFrame:
    """The frame without geometries."""
    return df.select(*(f.name for f in df.schema if not f.dataType.simpleString().startswith("struct<type:string,parts:")))


def stacked(first: DataFrame, second: DataFrame) -> DataFrame:
    """One frame above the other with an empty row between; ``__part`` (0, 1, 2) says which a row comes from.  For small tables of a report."""
    blank = first.sparkSession.createDataFrame([(1,)], "__part int")
    parts = (first.withColumn("__part", F.lit(0)), blank, second.withColumn("__part", F.lit(2)))
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


def legend(df: DataFrame, column: str, groups: int = 16, blank: str = "sin dato") -> DataFrame:
    """``value, label, n`` of the first groups in the order of their values; nulls come last."""
    counts = df.groupBy(F.col(column).cast("string").alias("value")).agg(F.count("*").alias("n")).orderBy(F.col("value").asc_nulls_last()).limit(groups)
    name = F.when(F.coalesce("value", F.lit("")) == "", blank).otherwise(F.col("value"))
    return counts.select("value", F.concat(name, F.lit(" ("), F.col("n").cast("string"), F.lit(")")).alias("label"), "n")
