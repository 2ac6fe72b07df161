"""Hard negatives against all scores, the tree against plain distances, and odd rows."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from basinsift.llm import hard_negatives as hard

VEC = "vec_id long, embedding array<float>, label int"


def plain(rows, every=50, positives=5, negatives=3, low=50, high=95):
    """All results by scoring each anchor against all rows."""
    usable = {}
    for i, v, label in rows:
        if i is None or label is None or v is None or any(x is None or not math.isfinite(x) for x in v):
            continue
        row = ((label + 1) % 10 if i % 7 == 0 else label, [math.floor(256 * float(np.float32(x))) for x in v])
        usable[i] = min(usable.get(i, row), row)
    score = lambda a, b: sum(x * y for x, y in zip(a, b, strict=False))
    out = []
    for a, (label, v) in usable.items():
        if a % every:
            continue
        scored = sorted((-score(v, w), i, other == label) for i, (other, w) in usable.items() if i != a)
        for s, p, _ in [x for x in scored if x[2]][:positives]:
            fits = [x for x in scored if not x[2] and low * -s <= 100 * -x[0] <= high * -s][:negatives]
            out += [(a, p, k + 1, x[1], -s, -x[0]) for k, x in enumerate(fits)]
    return sorted(out)


def clustered(n, seed, dim=8, spread=0.15):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(12, dim))
    return [(k, [float(np.float32(x)) for x in centres[rng.integers(12)] + spread * rng.normal(size=dim)], int(rng.integers(10))) for k in range(n)]


@pytest.fixture
def write(spark, tmp_path):
    def put(rows):
        spark.createDataFrame(rows, VEC).repartition(3).write.mode("overwrite").parquet(f"{tmp_path}/embeddings.parquet")
        return str(tmp_path)

    return put


def result(df):
    return sorted(tuple(r) for r in df.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score").collect())


def test_query(spark, write):
    rows = clustered(1500, 1)
    rows = [(k, rows[7][1] if k % 3 == 0 else v, 4 if k % 3 == 0 else label) for k, v, label in rows]  # one vector and label for a third of all
    random.Random(1).shuffle(rows)
    out = hard.op11_hard_negatives(spark, write(rows))
    assert result(out) == plain(rows)
    assert [f.dataType.simpleString() for f in out.schema] == ["bigint", "bigint", "int", "bigint", "bigint", "bigint"]


def test_many_leaves_and_chunks(spark, monkeypatch):
    """A sample far smaller than the table, leaves above the cap in chunks, and queries asked by ranges of ids."""
    monkeypatch.setattr(hard, "LEAF_CAP", 40)
    monkeypatch.setattr(hard, "ID_BLOCK", 100)
    rows = clustered(900, 2, 6, 0.5) + [(2000 + k, [0.0] * 6, k % 10) for k in range(60)]
    df = spark.createDataFrame(rows, VEC)
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    assert result(hard.mine(df, F.col("id") % 10 == 0, label=moved, sample=60, leaf_rows=120)) == plain(rows, 10)
    assert result(hard.mine(df, F.col("id") % 10 == 0, label=moved, positives=2, negatives=1, low=20, high=80, sample=10_000, leaf_rows=30)) == plain(rows, 10, 2, 1, 20, 80)


def test_odd_rows(spark, write):
    rows = clustered(120, 3, 4)
    rows += [(None, [1.0] * 4, 1), (1000, None, 1), (1050, [1.0] * 4, None), (1100, [1.0, None, 1.0, 1.0], 1), (1150, [float("nan")] * 4, 1), (1200, [float("inf")] * 4, 1)]
    rows += [(1250, [], 2), (1300, [0.5, 0.25], 2), (1350, [0.0] * 4, 2), (50, rows[50][1], rows[50][2]), (100, [9.0] * 4, 9), (100, [9.0] * 4, 3)]
    assert result(hard.op11_hard_negatives(spark, write(rows))) == plain(rows)


def test_empty_and_clashing_names(spark):
    kind = VEC + ", id long, v string, label2 int, leaf int, gid int, windows string"
    assert hard.mine(spark.createDataFrame([], kind), F.col("id") % 50 == 0).count() == 0
    rows = clustered(200, 5, 4)
    df = spark.createDataFrame([(*r, 1, "v", 2, 3, 4, "w") for r in rows], kind)
    assert result(hard.mine(df, F.col("id") % 50 == 0, label=F.col("label"))) == result(hard.mine(spark.createDataFrame(rows, VEC), F.col("id") % 50 == 0))


def test_huge_components(spark):
    rows = [(k, [1e6 * (k + 1), -3e7 * k], k % 2) for k in range(40)]
    got = result(hard.mine(spark.createDataFrame(rows, VEC), F.col("id") % 10 == 0, positives=3))
    ints = {k: ([math.floor(256 * float(np.float32(x))) for x in v], label) for k, v, label in rows}
    score = lambda a, b: sum(x * y for x, y in zip(ints[a][0], ints[b][0], strict=True))
    assert got and all(score(a, p) == s and score(a, n) == t for a, p, _, n, s, t in got)


@pytest.mark.parametrize("seed", range(4))
def test_tree_walk_is_nearest_first_and_prunes(seed):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(30, 5)) * 400
    rows = np.floor(centres[rng.integers(30, size=3000)] + 40 * rng.normal(size=(3000, 5))).astype(np.int64)
    labels = rng.integers(3, size=3000)
    most = float((rows.astype(float) ** 2).sum(axis=1).max())
    chunk = hard.Chunk(rows, labels, [[k] for k in range(3000)], most, 32)
    visited = 0
    for q in rows[:40]:
        scores = rows @ q
        windows = [{"lo": -(2**63), "hi": 2**63 - 1, "same": True, "k": 6}, {"lo": int(scores.max() * 0.3), "hi": int(scores.max() * 0.6), "same": False, "k": 3}]
        for w, got in zip(windows, chunk.search(q, 1, windows), strict=True):
            fits = [(-int(s), k) for k, s in enumerate(scores) if (labels[k] == 1) == w["same"] and w["lo"] <= s <= w["hi"]]
            assert got == [(-s, k) for s, k in sorted(fits)[: w["k"]]]
            tops = [best for _, best in chunk.tree.visits(chunk.tree.distances(q.astype(float)), float(q @ q), w["lo"], w["hi"], w["lo"])]
            assert [min(t, w["hi"]) for t in tops] == sorted((min(t, w["hi"]) for t in tops), reverse=True)
            reached = -sorted(fits)[w["k"] - 1][0] if len(fits) >= w["k"] else w["lo"]
            visited += len(list(chunk.tree.visits(chunk.tree.distances(q.astype(float)), float(q @ q), w["lo"], w["hi"], reached)))
    assert visited < 0.4 * 80 * len(chunk.members)
