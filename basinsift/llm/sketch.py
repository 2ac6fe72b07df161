"""Document fingerprints: bottom-k sketches of word-shingle hashes, in DataFrame functions only.

A sketch is the ascending array of the ``k`` smallest distinct 64-bit hashes of a text's shingles of five
words.  Sketches of parts merge into the sketch of their union, and two sketches estimate resemblance,
containment and the number of distinct shingles.

Defined results: null text counts as empty and has an empty sketch; a text of fewer words than a shingle
is one shingle; two empty sketches resemble each other fully, an empty and a non-empty one not at all;
a null id sorts before all others; repeated ids are ordered by their text's hash; an empty table gives an
empty result; other columns are ignored.
"""

from __future__ import annotations

import math
from collections import Counter

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from basinsift.llm.common import partitions, table

SKETCH_SIZE = 128
SHINGLE_WORDS = 5
_SPACE = " \t\n\x0b\x0c\r"
_FIRST = -(1 << 63)


def word_hashes(text: Column) -> Column:
    """64-bit hashes of the lower-cased words of a text."""
    trimmed = F.lower(F.btrim(text, F.lit(_SPACE)))
    words = F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, r"[\x20\x09-\x0D]+"))
    return F.transform(words, lambda w: F.xxhash64(w))


def bottom(hashes: Column, k: int = SKETCH_SIZE) -> Column:
    return F.slice(F.sort_array(F.array_distinct(hashes)), 1, k)


def sketch(hashes: Column, k: int = SKETCH_SIZE, width: int = SHINGLE_WORDS) -> Column:
    """Bottom-k sketch from the word hashes of a text.  ``hashes`` must be a stored column, not an expression: it is read once for each shingle."""
    shingles = F.transform(F.sequence(F.lit(0), F.size(hashes) - width), lambda i: F.xxhash64(*(F.get(hashes, i + j) for j in range(width))))
    short = F.array(F.aggregate(hashes, F.lit(0).cast("long"), lambda acc, h: F.xxhash64(acc, h)))
    return F.when(F.size(hashes) == 0, F.array().cast("array<bigint>")).when(F.size(hashes) < width, short).otherwise(bottom(shingles, k))


def with_sketch(df: DataFrame, texts: dict[str, str], k: int = SKETCH_SIZE, width: int = SHINGLE_WORDS) -> DataFrame:
    """Adds a sketch column for each text column named in ``texts`` (text -> sketch)."""
    hashed = [word_hashes(F.coalesce(F.col(t), F.lit(""))).alias(f"__w_{s}") for t, s in texts.items()]
    # inline() of a single struct is a barrier: the optimizer must not copy the hashing into the shingle lambda.
    stored = df.select("*", F.inline(F.array(F.struct(*hashed))))
    return stored.select(*df.columns, *(sketch(F.col(f"__w_{s}"), k, width).alias(s) for s in texts.values()))


def merge(a: Column, b: Column, k: int = SKETCH_SIZE) -> Column:
    return F.slice(F.sort_array(F.array_union(a, b)), 1, k)


def merge_groups(sketches: DataFrame, keys: list[str], column: str, k: int = SKETCH_SIZE) -> DataFrame:
    """Sketch of each group's union.  Only each task's ``k`` least hashes of a group are shuffled."""
    hashes = sketches.select(*keys, F.explode(column).alias("__h")).groupBy(*keys, "__h").agg(F.count("*").alias("__n"))
    least = hashes.withColumn("__r", F.row_number().over(Window.partitionBy(*keys).orderBy("__h"))).filter(F.col("__r") <= k)
    return least.groupBy(*keys).agg(F.sort_array(F.collect_list("__h")).alias(column))


def resemblance(a: Column, b: Column, k: int = SKETCH_SIZE) -> Column:
    """Estimated share of common shingles among all shingles of both."""
    both, union = F.array_intersect(a, b), merge(a, b, k)
    common = F.size(F.filter(both, lambda h: h <= F.element_at(union, -1)))
    return F.when((F.size(a) == 0) & (F.size(b) == 0), F.lit(1.0)).when((F.size(a) == 0) | (F.size(b) == 0), F.lit(0.0)).otherwise(common / F.size(union))


def containment(a: Column, b: Column, k: int = SKETCH_SIZE) -> Column:
    """Estimated share of the first side's shingles that the second has."""
    both, last = F.array_intersect(a, b), F.element_at(merge(a, b, k), -1)
    common, own = F.size(F.filter(both, lambda h: h <= last)), F.size(F.filter(a, lambda h: h <= last))
    return F.when(F.size(a) == 0, F.lit(1.0)).when((F.size(b) == 0) | (own == 0), F.lit(0.0)).otherwise(common / own)


def distinct_shingles(a: Column, k: int = SKETCH_SIZE) -> Column:
    """Number of distinct shingles: exact below ``k``, else estimated from the k-th least hash."""
    return F.when(F.size(a) < k, F.size(a).cast("double")).otherwise(F.lit(float(k - 1)) / (F.element_at(a, -1) / F.lit(2.0**64) + F.lit(0.5)))


def as_text(a: Column) -> Column:
    return F.array_join(F.transform(a, lambda h: F.lpad(F.lower(F.hex(h)), 16, "0")), "")


def _slot(key: Column, bounds: list[int]) -> Column:
    """Index of the last bound not above the key, found in two steps of about sqrt(n) comparisons."""
    step = max(1, math.isqrt(len(bounds)))
    coarse = F.array(*map(F.lit, bounds[::step]))
    fine = F.array(*(F.array(*map(F.lit, bounds[i : i + step])) for i in range(0, len(bounds), step)))
    at = F.size(F.filter(coarse, lambda b: b <= key)) - 1
    return at * step + F.size(F.filter(F.get(fine, at), lambda b: b <= key)) - 1


def with_next(df: DataFrame, key: str, columns: list[str], slots: int) -> DataFrame:
    """Adds ``slot``, ``ghost`` and the next row's ``columns`` (as ``next_<column>``; after the last row: the first).

    The rows are cut into slots at values of the key, and where a key has so many rows that several cuts
    fall on it, at even steps of the tie breaker ``tie`` (a hash); the first row of each slot is added as a
    ghost to the slot before, so that no row needs another slot.
    """
    probs = [k / slots for k in range(1, slots)] or [0.5]
    first = df.agg(F.min(key), F.percentile_approx(key, probs, 20 * slots)).first()
    cuts = Counter(first[1] or [])
    bounds = sorted({first[0], *cuts} - {None}) or [0]
    parts = [max(1, cuts[b]) for b in bounds]
    at, begin = _slot(F.col(key), bounds), [sum(parts[:k]) for k in range(len(parts))]
    if max(parts) == 1:
        slot = at
    else:
        share = F.get(F.array(*map(F.lit, parts)), at)
        step = F.least(share - 1, F.floor((F.col("tie") / F.lit(2.0**64) + 0.5) * share))
        slot = F.get(F.array(*map(F.lit, begin)), at) + F.when(F.get(F.array(*map(F.lit, bounds)), at) == F.col(key), step).otherwise(share - 1)
    own = df.select(*df.columns, slot.cast("int").alias("slot"), F.lit(False).alias("ghost"), F.lit(False).alias("wraps"))
    # One row for each slot, here and in the broadcast.
    begins = sorted((r["slot"], r["f"][0], r["f"][1]) for r in own.groupBy("slot").agg(F.min(F.struct(key, "tie")).alias("f")).collect())
    ghosts = df.sparkSession.createDataFrame([(b, t, begins[k - 1][0], k == 0) for k, (_, b, t) in enumerate(begins)], f"{key} long, tie long, slot int, wraps boolean")
    added = df.join(F.broadcast(ghosts), [key, "tie"]).dropDuplicates([key, "tie"]).select(*df.columns, "slot", F.lit(True).alias("ghost"), "wraps")
    rows = own.unionByName(added)
    return rows.select("*", *(F.lead(c).over(ordered(key)).alias(f"next_{c}") for c in columns))


def ordered(key: str):
    return Window.partitionBy("slot").orderBy("wraps", key, "tie", "ghost")


def op1_fingerprints(spark, sf_dir: str) -> DataFrame:
    """Sketches of every document and of its edited text, and their likeness."""
    docs = table(spark, sf_dir, "documents").select(
        F.coalesce(F.col("doc_id").cast("long"), F.lit(_FIRST)).alias("key"), "doc_id", F.coalesce("text", F.lit("")).alias("text")
    )
    docs = docs.withColumn("tie", F.xxhash64("text"))
    rows = with_next(docs, "key", ["text"], 4 * partitions(spark))
    length = F.length("text")
    cut = F.floor(length / 4).cast("int")
    edited = F.concat(F.substring("text", F.lit(1), length - cut), F.substring(F.coalesce("next_text", F.lit("")), F.lit(1), cut))
    rows = rows.withColumn("n_chars", length.cast("long")).withColumn("edited", edited).drop("next_text")
    rows = with_sketch(rows, {"text": "own", "edited": "changed"}).withColumn("edited_sha256", F.sha2("edited", 256)).drop("text", "edited")
    rows = rows.withColumn("next_own", F.lead("own").over(ordered("key"))).filter(~F.col("ghost"))
    return rows.select(
        "doc_id", "n_chars", "edited_sha256",
        as_text(F.col("own")).alias("fingerprint"), as_text(F.col("changed")).alias("edited_fingerprint"),
        resemblance(F.col("own"), F.col("changed")).alias("near_edited"), resemblance(F.col("own"), F.col("next_own")).alias("near_next"),
        distinct_shingles(F.col("own")).alias("n_shingles"),
    )


def fingerprints_edited(spark, sf_dir: str) -> DataFrame:
    """The columns of ``op1_fingerprints`` that SQL can express: a further check."""
    return op1_fingerprints(spark, sf_dir).select("doc_id", "n_chars", "edited_sha256")


EDITED_SQL = """
WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
n AS (SELECT doc_id, text, length(text) AS n_chars, coalesce(lead(text) OVER (ORDER BY doc_id), first_value(text) OVER (ORDER BY doc_id)) AS following FROM d)
SELECT doc_id, CAST(n_chars AS BIGINT) AS n_chars, sha256(left(text, n_chars - n_chars // 4) || left(following, n_chars // 4)) AS edited_sha256 FROM n
"""
