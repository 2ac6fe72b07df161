"""Approximate nearest neighbours: a forest of random-projection trees behind one shared priority queue.

The forest's planes are fitted on a bounded sample of distinct vectors (``SAMPLE`` rows, least hashes), but
every vector is routed into a leaf of every tree.  A query walks all trees through one priority queue,
nearest margins first, until the visited leaves hold a number of vectors.  That number is measured, not
assumed: the least one with which ``PROBES`` queries from the sample reach ``RECALL`` against brute force over
all vectors, so it follows the data and their number.
Queries and vectors meet in an equi-join on (tree, leaf), streamed from sorted partitions; distances are
exact, on the original vectors, and a task passes on only the nearest of each query.
Equal vectors are searched and indexed once, with their smallest ids only, so a very common vector costs no
more than any other; a leaf above ``LEAF_CAP`` vectors is split into chunks that each get the leaf's queries.

Defined results: vectors null, zero, of another length than most of the sample, or with null or non-finite
components take no part; repeated rows count once; fewer candidates than asked for are all returned; ties go to the
smaller id; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from basinsift.llm.common import least_within, materialize, table

NEIGHBOURS = 10
TREES = 12
SAMPLE = 20_000
LEAF_ROWS = 96
#: Recall to reach, above the 0.9 that is promised, and queries that measure it by brute force over all vectors.
RECALL = 0.95
PROBES = 200
#: Vectors of a block of that search.
BLOCK = 4096
LEAF_CAP = 20_000
#: Queries whose nearest a task holds before it passes them on.
HELD_QUERIES = 20_000
SEED = 20


class Forest:
    """Random-projection trees as flat arrays: plane, offset and children of each node; leaves are negative children."""

    def __init__(self, sample: np.ndarray, trees: int = TREES, leaf_rows: int = LEAF_ROWS, seed: int = SEED):
        rng = np.random.default_rng(seed)
        self.dim = sample.shape[1]
        planes, offsets, children, self.roots, sizes = [], [], [], [], []

        def split(rows: np.ndarray) -> int:
            if len(rows) > leaf_rows:
                for _ in range(4):
                    a, b = sample[rng.choice(rows, 2, replace=False)]
                    normal = a - b
                    length = np.linalg.norm(normal)
                    if length == 0:
                        continue
                    normal /= length
                    side = sample[rows] @ normal
                    middle = np.median(side)
                    left = side <= middle
                    if left.all():
                        left = side < middle
                    if 0 < left.sum() < len(rows):
                        node = len(planes)
                        planes.append(normal)
                        offsets.append(middle)
                        children.append([0, 0])
                        children[node] = [split(rows[left]), split(rows[~left])]
                        return node
            sizes.append(len(rows))
            return -len(sizes)

        for _ in range(trees):
            self.roots.append(split(np.arange(len(sample))))
        self.planes = np.array(planes).reshape(-1, self.dim)
        self.offsets, self.children = np.array(offsets), np.array(children, np.int64).reshape(-1, 2)
        self.sizes = np.array(sizes, np.float64)

    def route(self, vectors: np.ndarray) -> np.ndarray:
        """Leaf number (from 0, over all trees) of each vector in each tree."""
        out = np.empty((len(self.roots), len(vectors)), np.int64)
        for t, root in enumerate(self.roots):
            at = np.full(len(vectors), root)
            while (inner := np.nonzero(at >= 0)[0]).size:
                node = at[inner]
                margin = np.einsum("ij,ij->i", vectors[inner], self.planes[node]) - self.offsets[node]
                at[inner] = self.children[node, (margin > 0).astype(int)]
            out[t] = -at - 1
        return out

    def search(self, vector: np.ndarray, scale: float, effort: float) -> list[int]:
        """Leaves to visit: all trees share one queue, ordered by the least margin crossed so far."""
        margins = self.planes @ vector - self.offsets
        queue = [(-np.inf, root) for root in self.roots]
        heapq.heapify(queue)
        leaves, held = [], 0.0
        while queue and held < effort:
            crossed, node = heapq.heappop(queue)
            while node >= 0:
                margin = margins[node]
                near, far = self.children[node, 1], self.children[node, 0]
                if margin <= 0:
                    near, far, margin = far, near, -margin
                heapq.heappush(queue, (max(crossed, margin), far))
                node = near
            leaves.append(-int(node) - 1)
            held += self.sizes[-node - 1] * scale
        return leaves

    def effort_for(self, asked: np.ndarray, leaves: np.ndarray, scale: float, recall: float = RECALL) -> float:
        """Least number of vectors to visit for a share ``recall`` of the true neighbours, whose leaves (query, neighbour, tree) are given."""
        needed = []
        for query, near in zip(asked, leaves, strict=True):
            order = self.search(query, scale, np.inf)
            before = np.zeros(len(self.sizes))
            before[order] = np.cumsum(np.r_[0.0, self.sizes[order[:-1]]]) * scale
            needed.append(before[near].min(axis=1))
        needed = np.sort(np.concatenate(needed)) if needed else np.zeros(0)
        return float(np.nextafter(needed[int(np.ceil(recall * len(needed))) - 1], np.inf)) if len(needed) else np.inf


def true_neighbours(groups: DataFrame, forest: Forest, asked: np.ndarray, own: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Queries, and the leaves (query, neighbour, tree) of the ``k`` nearest of each among all vectors, by brute force in blocks.

    ``own`` are the queries' ids, which are no neighbours of theirs.  A task passes on ``k`` rows for each
    query, a number that is fixed; a query of fewer than ``k`` neighbours is left out.
    """
    shared = groups.sparkSession.sparkContext.broadcast((forest, asked, own))
    dim = asked.shape[1]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forest, asked, own = shared.value
        far, leaf = np.full((len(asked), k), np.inf), np.zeros((len(asked), k, len(forest.roots)), np.int64)
        for batch in batches:
            for at in range(0, batch.num_rows, BLOCK):
                part = batch.slice(at, BLOCK)
                vectors = _matrix(part.column(1), dim)
                square = (asked**2).sum(axis=1)[:, None] - 2 * asked @ vectors.T + (vectors**2).sum(axis=1)
                square[own[:, None] == part.column(0).to_numpy()] = np.inf
                near = np.argsort(square, axis=1, kind="stable")[:, :k]
                met, back = np.unique(near, return_inverse=True)
                routed = forest.route(vectors[met]).T[back.reshape(near.shape)]
                both = np.concatenate([far, np.take_along_axis(square, near, axis=1)], axis=1)
                best = np.argsort(both, axis=1, kind="stable")[:, :k]
                far = np.take_along_axis(both, best, axis=1)
                leaf = np.take_along_axis(np.concatenate([leaf, routed], axis=1), best[:, :, None], axis=1)
        query, place = np.nonzero(far < np.inf)
        yield pa.record_batch([pa.array(query), pa.array(far[query, place]), pa.array(leaf[query, place].tolist(), pa.list_(pa.int64()))], ["q", "far", "leaves"])

    found = groups.select("gid", "v").mapInArrow(run, "q long, far double, leaves array<long>")
    first = Window.partitionBy("q").orderBy("far", "leaves")
    rows = found.withColumn("n", F.row_number().over(first)).filter(F.col("n") <= k).select("q", "leaves").collect()  # ``k`` rows for each query
    by_query: dict[int, list] = {}
    for r in rows:
        by_query.setdefault(r["q"], []).append(r["leaves"])
    whole = sorted(q for q, leaves in by_query.items() if len(leaves) == k)
    return asked[whole], np.array([by_query[q] for q in whole], np.int64).reshape(-1, k, len(forest.roots))


def usable(vector: Column) -> Column:
    fine = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return vector.isNotNull() & (F.size(vector) > 0) & fine & F.exists(vector, lambda x: x != 0)


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)


def nearest_in_leaf(queries: np.ndarray, vectors: np.ndarray, ids: np.ndarray, k: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each query: positions and Euclidean distances of the ``k`` nearest, ties to the smaller id."""
    found = []
    for q in queries:
        score = np.sqrt(((vectors - q) ** 2).sum(axis=1))
        if len(score) > k:
            near = np.nonzero(score <= np.partition(score, k - 1)[k - 1])[0]
        else:
            near = np.arange(len(score))
        near = near[np.lexsort((ids[near], score[near]))][:k]
        found.append((near, score[near]))
    return found


def search(
    vectors: DataFrame, queries: Column, id_col: str = "vec_id", vector_col: str = "embedding", k: int = NEIGHBOURS,
    trees: int = TREES, leaf_rows: int = LEAF_ROWS, recall: float = RECALL, sample: int = SAMPLE,
) -> DataFrame:
    """``query_id, rank, vec_id, score`` of the ``k`` nearest other vectors of each row that satisfies ``queries``."""
    spark = vectors.sparkSession
    kind = vectors.schema[vector_col].dataType.simpleString()
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).alias("v")).filter(F.col("id").isNotNull() & usable(F.col("v")))
    asked = rows.filter(queries)
    empty = spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")

    # The k + 1 smallest ids of each distinct vector: one more than needed, for the query's own.
    ranked = rows.distinct().withColumn("n", F.row_number().over(Window.partitionBy("v").orderBy("id"))).filter(F.col("n") <= k + 1)
    groups = materialize(ranked.groupBy("v").agg(F.sort_array(F.collect_list("id")).alias("ids")).select(F.col("ids")[0].alias("gid"), "ids", "v"), "vectors")
    drawn = least_within(groups.select("gid", "v"), F.xxhash64("v"), (F.lit(1), sample)).toArrow().sort_by("gid").combine_chunks()  # bounded by ``sample``
    if not len(drawn):
        return empty
    lengths = pc.list_value_length(drawn["v"]).to_numpy()
    dim = int(np.bincount(lengths).argmax())
    drawn = drawn.filter(pa.array(lengths == dim)).combine_chunks()
    fitted = _matrix(drawn["v"].combine_chunks(), dim)
    forest = Forest(fitted, trees, leaf_rows)
    groups, asked = groups.filter(F.size("v") == dim), asked.filter(F.size("v") == dim)
    total = groups.count()
    scale = total / len(fitted)
    probed = np.random.default_rng(SEED).permutation(len(fitted))[:PROBES]
    if total > k + 1:
        effort = forest.effort_for(*true_neighbours(groups, forest, fitted[probed], drawn["gid"].to_numpy()[probed], k), scale, recall)
    else:
        effort = np.inf
    chunks = max(1, int(-(-leaf_rows * scale // LEAF_CAP)))
    shared = spark.sparkContext.broadcast(forest)
    probes = asked.groupBy("v").agg(F.min("id").alias("gid"))

    def index(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                leaves = shared.value.route(_matrix(batch.column(2), dim))
                at = pa.array(np.tile(np.arange(batch.num_rows), len(leaves)))
                chunk = np.tile(batch.column(0).to_numpy() % chunks, len(leaves)).astype(np.int32)
                yield pa.record_batch([pa.array(leaves.ravel()), pa.array(chunk), pa.array(np.ones(len(at), np.int32)), *(c.take(at) for c in batch.columns)], ["leaf", "chunk", "side", "gid", "ids", "v"])

    def route(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                visits = [shared.value.search(q, scale, effort) for q in _matrix(batch.column(2), dim)]
                at = pa.array(np.repeat(np.arange(batch.num_rows), [len(x) * chunks for x in visits]))
                leaf = np.repeat(np.concatenate(visits).astype(np.int64), chunks)
                chunk = np.tile(np.arange(chunks, dtype=np.int32), len(leaf) // chunks)
                yield pa.record_batch([pa.array(leaf), pa.array(chunk), pa.array(np.zeros(len(leaf), np.int32)), *(c.take(at) for c in batch.columns)], ["leaf", "chunk", "side", "gid", "ids", "v"])

    keyed = f"leaf long, chunk int, side int, gid long, ids array<long>, v {kind}"
    met = groups.select("gid", "ids", "v").mapInArrow(index, keyed).unionByName(probes.select("gid", F.array("gid").alias("ids"), "v").mapInArrow(route, keyed))
    met = met.repartition("leaf", "chunk").sortWithinPartitions("leaf", "chunk", "side")

    def rerank(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        best: dict[int, list[tuple[float, int, list[int]]]] = {}

        def flush() -> None:
            rows = pa.Table.from_batches(held).combine_chunks()
            side, gid, ids = rows["side"].to_numpy(), rows["gid"].to_numpy(), rows["ids"]
            cut = int((side == 0).sum())
            if 0 < cut < len(side):
                v = _matrix(rows["v"].combine_chunks(), dim)
                for query, (at, score) in zip(gid[:cut].tolist(), nearest_in_leaf(v[:cut], v[cut:], gid[cut:], k + 1), strict=True):
                    mine = best.setdefault(query, [])
                    known = {g for _, g, _ in mine}
                    last = mine[k] if len(mine) > k else (np.inf, 0, [])
                    fresh = [(s, g, x) for s, g, x in zip(score.tolist(), gid[cut + at].tolist(), at.tolist(), strict=True) if g not in known and (s, g) < last[:2]]
                    if fresh:
                        best[query] = sorted([*mine, *((s, g, ids[cut + x].as_py()) for s, g, x in fresh)])[: k + 1]

        def found() -> pa.RecordBatch:
            rows = [(q, s, g, ids) for q, mine in best.items() for s, g, ids in mine]
            columns = list(zip(*rows, strict=True)) or [[]] * 4
            kinds = [pa.int64(), pa.float64(), pa.int64(), pa.list_(pa.int64())]
            return pa.record_batch([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], ["query", "score", "gid", "ids"])

        last = None
        for batch in batches:
            if not batch.num_rows:
                continue
            key = np.stack([batch.column(0).to_numpy(), batch.column(1).to_numpy()])
            cuts = [0, *(np.nonzero((key[:, 1:] != key[:, :-1]).any(axis=0))[0] + 1).tolist(), batch.num_rows]
            for a, b in zip(cuts, cuts[1:], strict=False):
                here = (int(key[0, a]), int(key[1, a]))
                if here != last and held:
                    flush()
                    held = []
                    if len(best) >= HELD_QUERIES:
                        yield found()
                        best.clear()
                last = here
                held.append(batch.slice(a, b - a))
        if held:
            flush()
        yield found()

    near = met.mapInArrow(rerank, "query long, score double, gid long, ids array<long>")
    near = near.groupBy("query", "gid", "score").agg(F.min("ids").alias("ids"))
    near = near.withColumn("n", F.row_number().over(Window.partitionBy("query").orderBy("score", "gid"))).filter(F.col("n") <= k + 1)
    found = near.select("query", "score", F.explode("ids").alias("vec_id"))
    members = asked.join(probes.select("v", F.col("gid").alias("query")), "v").select(F.col("id").alias("query_id"), "query").distinct()
    pairs = members.join(found, "query").filter("query_id <> vec_id")
    pairs = pairs.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy("score", "vec_id"))).filter(F.col("rank") <= k)
    return pairs.select("query_id", "rank", "vec_id", "score")


def op4_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten nearest vectors of every hundredth vector."""
    return search(table(spark, sf_dir, "embeddings"), F.col("id") % 100 == 0)
