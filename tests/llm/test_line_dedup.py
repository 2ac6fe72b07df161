"""Line deduplication against a plain version, with groups cut by partition borders, and odd rows."""

import collections
import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from basinsift.llm import line_dedup

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def plain(rows, least=3, chars=20):
    """Kept text, lines and dropped lines of each row (id, text)."""
    key = lambda line: line.strip(" \t\n\x0b\x0c\r").translate(str.maketrans(UPPER, LOWER))
    holders = collections.defaultdict(set)
    for d, t in rows:
        for line in (t or "").split("\n"):
            if len(key(line)) >= chars:
                holders[key(line)].add(-(2**63) if d is None else d)
    gone = lambda d, line: len(holders[key(line)]) >= least and max(holders[key(line)]) != (-(2**63) if d is None else d)
    split = [(d, (t or "").split("\n")) for d, t in rows]
    kept = [[line for line in lines if not gone(d, line)] for d, lines in split]
    return [("\n".join(k), len(lines), len(lines) - len(k)) for k, (_, lines) in zip(kept, split, strict=True)]


def corpus(n, seed):
    rng = random.Random(seed)
    common = [f"this line is common number {k} of all" for k in range(12)]
    out = []
    for d in range(n):
        lines = [rng.choice([rng.choice(common), rng.choice(common[:2]).upper() + " \t", f"a line of document {d} {rng.random()}", "short", "", " \x0b"]) for _ in range(rng.randint(1, 12))]
        out.append((d, "\n".join(lines)))
    return out


def check(spark, rows, **how):
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = sorted((str(r["doc_id"]), r["text"], r["n_lines"], r["n_dropped"]) for r in line_dedup.apply(df, line_dedup.keep_bitmaps(df, **how)).collect())
    assert got == sorted((str(d), *k) for (d, _), k in zip(rows, plain(rows, how.get("min_docs", 3), how.get("min_chars", 20)), strict=True))
    return got


@pytest.mark.parametrize("seed", range(3))
def test_kept_lines(spark, seed):
    check(spark, corpus(60, seed))


def test_other_thresholds(spark):
    check(spark, corpus(25, 9), min_docs=2, min_chars=3)


def test_one_line_in_every_document_over_many_partitions(spark):
    """A group that holds all rows is cut by every border; the largest task sees its share only."""
    rows = [(d, "the same line in every document") for d in range(500)]
    spark.conf.set("spark.sql.shuffle.partitions", "16")
    try:
        got = check(spark, rows)
        lines = line_dedup.hashed_lines(spark.createDataFrame(rows, "doc_id long, text string"))
        ranged = lines.repartitionByRange(16, F.col("h1"), F.col("h2"), F.col("doc").desc(), F.col("version"), F.col("pos"))
        most = max(r["count"] for r in ranged.groupBy(F.spark_partition_id()).count().collect())
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert sum(g[3] for g in got) == 499 and most < 3 * 500 / 16


@pytest.mark.parametrize("parts", [1, 2, 3, 7, 40])
def test_stream_with_borders_anywhere(parts):
    """The stream over pieces of sorted rows, in batches of any size, and the summaries of cut groups decide every line."""
    rng = random.Random(parts)
    rows = sorted({(rng.choice([1, 1, 2, 3, 4, rng.randint(5, 40)]), 0, -rng.randint(0, 5), rng.randint(0, 1), rng.randint(0, 6)) for _ in range(300)})
    rows = sorted(rows * 2)
    columns = lambda part: [np.array([r[0] for r in part]), np.array([r[1] for r in part]), np.array([-r[2] for r in part]), np.array([r[3] for r in part]), np.array([r[4] for r in part], np.int32)]
    cuts = sorted(rng.sample(range(1, len(rows)), parts - 1))
    found, cut, tops = set(), [], collections.defaultdict(list)
    for a, b in zip([0, *cuts], [*cuts, len(rows)], strict=True):
        stream, at, out = line_dedup._Stream(3), a, []
        while at < b:
            to = min(b, at + rng.randint(1, 20))
            out += stream.take(columns(rows[at:to]))
            at = to
        out += stream.end()
        summaries = 0
        for r in (r for batch in out for r in batch.to_pylist()):
            if r["kind"] == 0:
                found.add((r["h1"], r["doc"], r["version"], r["pos"]))
            elif r["kind"] == 1:
                cut.append((r["h1"], r["doc"], r["version"], r["pos"]))
            else:
                tops[r["h1"]] += r["docs"]
                summaries += 1
        assert summaries <= 2
    found |= {c for c in cut if len(set(tops[c[0]])) >= 3 and c[1] != max(tops[c[0]])}
    holders = collections.defaultdict(set)
    for r in rows:
        holders[r[0]].add(-r[2])
    assert found == {(r[0], -r[2], r[3], r[4]) for r in rows if len(holders[r[0]]) >= 3 and -r[2] != max(holders[r[0]])}


def test_bitmaps_without_text(spark):
    rows = [(d, f"own line {d}\nshared line of three documents\nlast") for d in range(3)]
    maps = line_dedup.keep_bitmaps(spark.createDataFrame(rows, "doc_id long, text string"))
    assert "text" not in maps.columns
    got = {r["doc"]: r for r in maps.collect()}
    assert [line_dedup.kept_lines(rows[d][1], bytes(got[d]["keep"])) for d in range(3)] == ["own line 0\nlast", "own line 1\nlast", rows[2][1]]
    assert [got[d]["n_dropped"] for d in range(3)] == [1, 1, 0]


def test_odd_rows(spark, tmp_path):
    long = "\n".join(f"a line of the long document {k % 700}" for k in range(30000))
    rows = [(1, long), (2, long), (3, long), (1, long), (None, long), (4, None), (5, ""), (5, ""), (6, "\n\n"), (2, "a line of the long document 5")]
    df = spark.createDataFrame([(d, t, "k", "v", b"x", 1, 2) for d, t in rows], "doc_id long, text string, doc string, version string, keep binary, n_lines int, n_dropped int")
    out = line_dedup.apply(df, line_dedup.keep_bitmaps(df))
    assert out.columns == ["doc_id", "text", "doc", "version", "keep", "n_lines", "n_dropped"]
    got = sorted((str(r["doc_id"]), r["text"], r["n_lines"], r["n_dropped"]) for r in out.collect())
    assert got == sorted((str(d), *k) for (d, _), k in zip(rows, plain(rows), strict=True))
    df.write.parquet(f"{tmp_path}/documents.parquet")
    digests = {r["doc_id"]: r for r in line_dedup.op13_line_dedup(spark, str(tmp_path)).collect()}
    assert len(digests) == 7 and digests[4]["kept_sha256"] == digests[5]["kept_sha256"] == hashlib.sha256(b"").hexdigest()
    assert digests[3]["n_dropped"] == 0 and digests[1]["n_dropped"] == digests[1]["n_lines"] == 30000
    assert line_dedup.apply(df.limit(0), line_dedup.keep_bitmaps(df.limit(0))).count() == 0
