"""URL filters: a blocked Bloom filter passes possible hits to an exact hash join with the listed entries.

A listed entry is a canonical URL prefix ``host/path``.  It covers its host with all subdomains, and every
path that starts with its own; of several that fit, the longest counts.  For each URL the candidate keys
(host suffix + path prefix of a listed length) are hashed; the filter, a table of 512-bit blocks, removes
nearly all candidates that are not listed; the rest are joined with the list, which removes false positives.

Defined results: a null URL or one without ``://`` has an empty host and path and fits no entry; a URL
that fits none gets the default verdict ``allow``; of entries with one key the last action in the order of
their names counts, so ``block`` wins over ``allow``; an entry without an action gives the default; repeated
pages keep a row each; an empty list or table works; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from basinsift.llm.common import table

BLOCK_BITS = 512
PROBES = 8
BITS_PER_ENTRY = 16
#: Bound of the broadcast filter; a longer list makes it denser (more rows reach the join), never larger.
MAX_FILTER_BYTES = 32 << 20
#: Listed entries that may be broadcast for the exact join.
MAX_BROADCAST_ENTRIES = 50_000

RULES = [("com/", "allow"), ("example.com/en/", "block"), ("www.example.com/en/", "allow"), ("net/es/", "block"), ("net/fr/", "block")]


def _rest(url: Column) -> Column:
    at = F.position(F.lit("://"), url)
    return F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end; A-Z lower-cased."""
    host = F.regexp_extract(_rest(F.coalesce(url, F.lit(""))), r"^([^/?#]*)", 1)
    return F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path_of(url: Column) -> Column:
    return F.regexp_extract(_rest(F.coalesce(url, F.lit(""))), r"^[^/?#]*([^?#]*)", 1)


def candidates(host: Column, path: Column, lengths: list[int]) -> Column:
    """Every host suffix (whole labels) with every prefix of the path that has a listed length."""
    labels = F.split(host, r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    prefixes = F.transform(F.filter(F.array(*map(F.lit, lengths)).cast("array<int>"), lambda n: n <= F.length(path)), lambda n: F.substring(path, F.lit(1), n))
    return F.array_distinct(F.flatten(F.transform(suffixes, lambda s: F.transform(prefixes, lambda p: F.concat(s, p)))))


def _places(hashes: np.ndarray, blocks: int) -> tuple[np.ndarray, np.ndarray]:
    """Block of each hash and its probe bits inside the block."""
    h = hashes.astype(np.int64).view(np.uint64)
    block = (h >> np.uint64(32)) % np.uint64(blocks)
    low = h & np.uint64(0xFFFFFFFF)
    step = (low * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(40) | np.uint64(1)
    probes = (low[:, None] + step[:, None] * np.arange(PROBES, dtype=np.uint64)) % np.uint64(BLOCK_BITS)
    return block.astype(np.int64), probes.astype(np.int64)


class BlockedBloom:
    """Filter whose probes for one key stay inside one 512-bit block (a cache line)."""

    def __init__(self, blocks: int):
        self.blocks = max(1, blocks)
        self.bits = np.zeros((self.blocks, BLOCK_BITS // 8), np.uint8)

    @staticmethod
    def blocks_for(entries: int) -> int:
        return max(1, min(-(-entries * BITS_PER_ENTRY // BLOCK_BITS), MAX_FILTER_BYTES * 8 // BLOCK_BITS))

    def add(self, hashes: np.ndarray) -> BlockedBloom:
        block, probes = _places(hashes, self.blocks)
        np.bitwise_or.at(self.bits, (block[:, None], probes >> 3), (1 << (probes & 7)).astype(np.uint8))
        return self

    def merge(self, other: BlockedBloom) -> BlockedBloom:
        self.bits |= other.bits
        return self

    def may_hold(self, hashes: np.ndarray) -> np.ndarray:
        block, probes = _places(hashes, self.blocks)
        return ((self.bits[block[:, None], probes >> 3] >> (probes & 7).astype(np.uint8)) & 1).all(axis=1)


def build_filter(listed: DataFrame, entries: int) -> BlockedBloom:
    """Filter of the hashes of ``key``: each task sets the bits of its share of blocks; the driver receives at most the filter's size."""
    blocks = BlockedBloom.blocks_for(entries)

    def run(frames: Iterable[pd.DataFrame]):
        for f in frames:
            block, probes = _places(f["h"].to_numpy(), blocks)
            yield pd.DataFrame({"w": np.repeat(block, PROBES) * (BLOCK_BITS // 64) + probes.ravel() // 64, "m": np.uint64(1) << (probes.ravel() % 64).astype(np.uint64)}).astype({"m": "int64"})

    words = listed.select(F.xxhash64("key").alias("h")).mapInPandas(run, "w long, m long").groupBy("w").agg(F.bit_or("m").alias("m"))
    bloom = BlockedBloom(blocks)
    flat = bloom.bits.reshape(-1).view(np.uint64)
    for row in words.toLocalIterator():
        flat[row["w"]] = np.int64(row["m"]).view(np.uint64)
    return bloom


def judge(pages: DataFrame, listed: DataFrame, id_col: str = "page_id", default: str = "allow") -> DataFrame:
    """``id, host, path, rule, verdict`` of each row of ``pages`` against ``listed`` (``key``, ``action``)."""
    spark = pages.sparkSession
    listed = listed.filter("key IS NOT NULL").groupBy("key").agg(F.max("action").alias("action"))
    sizes = listed.agg(F.count("*"), F.collect_set(F.length("key") - F.position(F.lit("/"), F.col("key")) + 1)).first()
    bloom = spark.sparkContext.broadcast(build_filter(listed, sizes[0]))

    @F.pandas_udf("array<boolean>")
    def may_be_listed(hashes: pd.Series) -> pd.Series:
        sizes = hashes.map(len).to_numpy()
        flat = np.concatenate([*hashes, np.zeros(0, np.int64)]).astype(np.int64)
        return pd.Series(np.split(bloom.value.may_hold(flat), np.cumsum(sizes)[:-1])) if len(hashes) else hashes

    urls = pages.select(F.col(id_col).alias("id"), F.col("url"), host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    keyed = urls.withColumn("keys", candidates(F.col("host"), F.col("path"), sorted(sizes[1])))
    keyed = keyed.withColumn("hits", may_be_listed(F.transform("keys", lambda k: F.xxhash64(k))))
    survivors = keyed.select("id", "url", F.explode(F.expr("transform(filter(arrays_zip(keys, hits), x -> x.hits), x -> x.keys)")).alias("key")).distinct()
    entries = F.broadcast(listed) if sizes[0] <= MAX_BROADCAST_ENTRIES else listed
    best = survivors.join(entries, "key").groupBy("id", "url").agg(F.max_by(F.struct("key", "action"), F.length("key")).alias("best"))
    out = urls.alias("u").join(best.alias("b"), F.col("u.id").eqNullSafe(F.col("b.id")) & F.col("u.url").eqNullSafe(F.col("b.url")), "left")
    return out.select(F.col("u.id").alias(id_col), "host", "path", F.col("best.key").alias("rule"), F.coalesce("best.action", F.lit(default)).alias("verdict"))


def op2_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rule and verdict of every page's URL."""
    return judge(table(spark, sf_dir, "pages"), spark.createDataFrame(RULES, "key string, action string"))


OP2_SQL = r"""
WITH u AS (
  SELECT page_id, CASE WHEN strpos(coalesce(url, ''), '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages
), p AS (
  SELECT page_id,
    translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM u
), r(rule, rhost, rpath, verdict) AS (
  VALUES ('com/', 'com', '/', 'allow'), ('example.com/en/', 'example.com', '/en/', 'block'),
    ('www.example.com/en/', 'www.example.com', '/en/', 'allow'), ('net/es/', 'net', '/es/', 'block'), ('net/fr/', 'net', '/fr/', 'block')
), m AS (
  SELECT p.*, r.rule, r.verdict, row_number() OVER (PARTITION BY page_id ORDER BY length(r.rule) DESC NULLS LAST) AS k
  FROM p LEFT JOIN r ON (p.host = r.rhost OR ends_with(p.host, '.' || r.rhost)) AND starts_with(p.path, r.rpath)
)
SELECT page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict FROM m WHERE k = 1
"""
