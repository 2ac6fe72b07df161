"""Hard-negative mining: a vantage-point tree over norm-augmented vectors, walked nearest first inside distance annuli.

With M the greatest norm, a vector x gets one more component sqrt(M^2 - |x|^2) and a query q a zero, so that
|q - x|^2 = |q|^2 + M^2 - 2 q.x: more score is less distance, and a window of scores is an annulus around the query.
A search is a list of windows, each with the ``k`` first rows (greatest score, then smallest id) of the query's label or of
any other label.  Positives are one window without limits; each positive's negatives are one window between
shares of its score.

The upper tree is fitted on a bounded sample (``SAMPLE`` distinct vectors, least hashes) and routes every row into a
leaf; the exact least and greatest distance of all rows below each child to its vantage point are then taken in one
aggregate, so a query skips a subtree only if no row of it can lie in the annulus.  The sample also gives each query
its first bound: the k-th row found there.  Queries and leaves meet in an equi-join on (leaf, chunk); inside, a tree of the
chunk's own rows is walked through a priority queue, nearest to the annulus' inner edge first, until the next
node is farther than the k-th row.  All results are exact: scores are integers, and bounds get a slack for rounding.

Hot groups: rows of equal vector and label are indexed once, with as many smallest ids as any query needs; queries of equal
vector and label are asked once for each range of ``ID_BLOCK`` ids; a leaf above ``LEAF_CAP`` rows is split into
chunks that each get the leaf's queries.  No label is a key of any shuffle.

Defined results: rows with a null id or label, or a null vector or any null or non-finite component take no part; of
several rows with one id the one of the smallest label, then vector, counts; shorter vectors count as padded with zeros;
components and scores beyond 64 bits are cut off there; fewer rows than asked for are all returned; a positive with a negative
score has no window; other columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from basinsift.llm.common import least_within, materialize, partitions, release, small_batches, table

POSITIVES, NEGATIVES = 5, 3
#: A negative's score, in per cent of the positive's.
LOW, HIGH = 50, 95
SAMPLE = 20_000
LEAF_ROWS, LEAF_CAP, BUCKET = 1024, 16_384, 256
#: Queries of equal vector and label are asked once for all ids of a range of this length.
ID_BLOCK = 100_000
SEED = 11
_LONG = 2**63 - 1
_SEARCH = "leaf long, chunk int, side int, gid long, g long, label long, ids array<long>, v array<long>, windows array<struct<lo:long,hi:long,same:boolean,k:int>>"
_NAMES = ["leaf", "chunk", "side", "gid", "g", "label", "ids", "v", "windows"]


def matrix(column: pa.Array, dim: int) -> np.ndarray:
    """Rows of integers, padded with zeros to ``dim``."""
    offsets = column.offsets.to_numpy()
    flat, sizes = column.values.to_numpy(zero_copy_only=False), np.diff(offsets)
    out = np.zeros((len(sizes), dim), np.int64)
    out[np.arange(dim) < sizes[:, None]] = flat[offsets[0] : offsets[-1]]
    return out


def exact_scores(rows: np.ndarray, query: np.ndarray, floats: np.ndarray | None) -> np.ndarray:
    """Integer inner products: in floating point where no sum can pass 2^53, else with whole numbers of any size, cut off at 64 bits."""
    if floats is not None:
        return (floats @ query).astype(np.int64)
    return np.array([max(-_LONG - 1, min(_LONG, sum(a * b for a, b in zip(row, query.tolist(), strict=True)))) for row in rows.tolist()], np.int64)


class VpTree:
    """Vantage-point tree as flat lists: vantage vector and threshold of each inner node, distance ranges of both children; leaves are -1, -2, ..."""

    def __init__(self, vectors: np.ndarray, most: float, bucket: int, seed: int = SEED):
        self.most = most
        points = self.augment(vectors)
        rng = np.random.default_rng(seed)
        self.vantage, self.threshold, self.children, self.ranges, self.members = [], [], [], [], []

        def split(rows: np.ndarray) -> int:
            if len(rows) > bucket:
                point = points[rows[rng.integers(len(rows))]]
                far = np.sqrt(((points[rows] - point) ** 2).sum(axis=1))
                middle = float(np.median(far))
                inner = far <= middle
                if inner.all():
                    inner = far < middle
                    middle = float(far[inner].max(initial=0))
                if 0 < inner.sum() < len(rows):
                    node = len(self.vantage)
                    self.vantage.append(point)
                    self.threshold.append(middle)
                    self.ranges.append([(far[inner].min(), far[inner].max()), (far[~inner].min(), far[~inner].max())])
                    self.children.append([0, 0])
                    self.children[node] = [split(rows[inner]), split(rows[~inner])]
                    return node
            self.members.append(rows)
            return -len(self.members)

        self.root = split(np.arange(len(points)))
        self.vantage = np.array(self.vantage).reshape(-1, points.shape[1])

    def augment(self, vectors: np.ndarray) -> np.ndarray:
        real = vectors.astype(np.float64)
        return np.c_[real, np.sqrt(np.maximum(0, self.most - (real**2).sum(axis=1)))]

    def distances(self, query: np.ndarray) -> list[float]:
        """Distances of a query to all vantage points."""
        square = (query**2).sum() + self.most - 2 * (self.vantage[:, :-1] @ query)
        return np.sqrt(np.maximum(0, square)).tolist()

    def route(self, vectors: np.ndarray) -> tuple[np.ndarray, list[list[float]]]:
        """Leaf number of each row, from 0, and its distances to the vantage points on its way."""
        points, leaf = self.augment(vectors), np.empty(len(vectors), np.int64)
        way: list[list[float]] = [[] for _ in range(len(vectors))]
        queue = [(self.root, np.arange(len(vectors)))]
        while queue:
            node, rows = queue.pop()
            if node < 0:
                leaf[rows] = -node - 1
                continue
            far = np.sqrt(((points[rows] - self.vantage[node]) ** 2).sum(axis=1))
            for r, d in zip(rows.tolist(), far.tolist(), strict=True):
                way[r].append(d)
            inner = far <= self.threshold[node]
            queue += [(self.children[node][0], rows[inner]), (self.children[node][1], rows[~inner])]
        return leaf, way

    def ways(self) -> dict[int, list[tuple[int, int]]]:
        """Inner nodes above each leaf, from the root, with the side that leads to it."""
        found, queue = {}, [(self.root, [])]
        while queue:
            node, way = queue.pop()
            if node < 0:
                found[-node - 1] = way
            else:
                queue += [(child, [*way, (node, side)]) for side, child in enumerate(self.children[node])]
        return found

    def visits(self, far: list[float], square: float, lo: float, hi: float, reached: float) -> Iterator[tuple[int, float]]:
        """Leaves that may hold scores from ``max(lo, reached)`` to ``hi``, greatest possible score first; send a new ``reached`` to tighten it."""
        total = square + self.most
        slack = 1e-9 * total + 1e-6
        heap = [(-hi, 0, self.root, np.inf, 0.0, np.inf)]
        count = 0
        while heap:
            top, _, node, greatest, near, wide = heapq.heappop(heap)
            if -top + slack < max(lo, reached):
                return
            if node < 0:
                said = yield -node - 1, greatest
                reached = max(reached, said) if said is not None else reached
                continue
            d = far[node]
            for child, (least, most) in zip(self.children[node], self.ranges[node], strict=True):
                if least > most:  # no row below
                    continue
                closest, widest = max(near, least - d, d - most), min(wide, d + most)
                best, worst = (total - closest * closest) / 2, (total - widest * widest) / 2
                if worst - slack <= hi and best + slack >= max(lo, reached):
                    count += 1
                    heapq.heappush(heap, (-min(hi, best), count, child, best, closest, widest))


class Chunk:
    """Rows of one chunk, or of the sample, under a tree of their own."""

    def __init__(self, rows: np.ndarray, labels: np.ndarray, ids: list[list[int]], most: float, bucket: int):
        self.tree = VpTree(rows, most, bucket)
        self.labels, self.ids = labels, ids
        self.members = self.tree.members
        self.rows = [rows[m] for m in self.members]
        self.largest = max(1, int(np.abs(rows.astype(np.float64)).max(initial=0)))
        self.floats = [r.astype(np.float64) for r in self.rows] if self.largest < 2**53 else None
        self.same = [labels[m] for m in self.members]

    def search(self, query: np.ndarray, label: int, windows: list[dict]) -> list[list[tuple[int, int]]]:
        """For each window the first (score, id): greatest score, then smallest id."""
        real = query.astype(np.float64)
        small = self.floats is not None and float(np.abs(real).max(initial=0)) * self.largest * max(1, len(real)) < 2**53
        far, square = self.tree.distances(real), float((real**2).sum())
        known: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        return [self._window(real if small else query, small, label, w, far, square, known) for w in windows]

    def _window(self, query: np.ndarray, small: bool, label: int, window: dict, far: list[float], square: float, known: dict) -> list[tuple[int, int]]:
        best: list[tuple[int, int]] = []  # (-score, id), sorted
        k, lo, hi = window["k"], window["lo"], window["hi"]
        reached = lo
        steps = self.tree.visits(far, square, lo, hi, lo)
        step = next(steps, None)
        while step is not None:
            leaf = step[0]
            if leaf not in known:
                known[leaf] = exact_scores(self.rows[leaf], query, self.floats[leaf] if small else None), self.same[leaf] == label
            scores, same = known[leaf]
            fits = np.nonzero((scores >= reached) & (scores <= hi) & (same if window["same"] else ~same))[0]
            if len(fits) > k:
                least = np.partition(scores[fits], -k)[-k]
                fits = fits[scores[fits] >= least]
            if len(fits):
                best += [(-int(scores[f]), i) for f in fits.tolist() for i in self.ids[self.members[leaf][f]]]
                best = sorted(best)[:k]
                if len(best) == k:
                    reached = max(reached, -best[-1][0])
            try:
                step = steps.send(reached)
            except StopIteration:
                step = None
        return [(-s, i) for s, i in best]


class Index:
    """The upper tree with the exact ranges of all rows, the chunks of each leaf, and the sample that gives first bounds."""

    def __init__(self, sample: Chunk, tree: VpTree, dim: int):
        self.sample, self.tree, self.dim, self.chunks = sample, tree, dim, np.ones(len(tree.members), np.int64)

    def measured(self, leaves: Iterable) -> None:
        """Takes the ranges of all rows: leaf, rows, least and greatest distance to each vantage point on its way."""
        ways = self.tree.ways()
        ranges = [[[np.inf, -np.inf], [np.inf, -np.inf]] for _ in self.tree.children]
        for leaf, rows, least, most in leaves:
            self.chunks[leaf] = -(-rows // LEAF_CAP)
            for (node, side), a, b in zip(ways[leaf], least, most, strict=True):
                here = ranges[node][side]
                here[0], here[1] = min(here[0], a), max(here[1], b)
        self.tree.ranges = ranges

    def visits(self, query: np.ndarray, label: int, windows: list[dict]) -> tuple[list[int], list[dict]]:
        """Leaves that may hold a row of any window, and the windows without what is behind the k-th row of the sample."""
        real = query.astype(np.float64)
        far, square = self.tree.distances(real), float((real**2).sum())
        leaves: set[int] = set()
        closer = []
        for window, found in zip(windows, self.sample.search(query, label, windows), strict=True):
            closer.append(window | {"lo": max(window["lo"], found[-1][0])} if len(found) == window["k"] else window)
            leaves.update(leaf for leaf, _ in self.tree.visits(far, square, closer[-1]["lo"], window["hi"], closer[-1]["lo"]))
        return sorted(leaves), closer


def usable(vector: Column) -> Column:
    return vector.isNotNull() & F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))


def clean(vectors: DataFrame, id_col: str, vector_col: str, label: Column) -> DataFrame:
    """``id, label, v`` of the rows that take part, one for each id, with quantized vectors."""
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), label.cast("long").alias("label"), F.col(vector_col).cast("array<double>").alias("v"))
    rows = rows.filter(F.col("id").isNotNull() & F.col("label").isNotNull() & usable(F.col("v")))
    rows = rows.withColumn("v", F.transform("v", lambda x: F.floor(F.lit(256.0) * x).cast("long")))
    return rows.groupBy("id").agg(F.min(F.struct("label", "v")).alias("r")).select("id", "r.label", "r.v")


def build(groups: DataFrame, sample: int = SAMPLE, leaf_rows: int = LEAF_ROWS) -> tuple[Index, DataFrame] | None:
    """The index over rows of distinct (label, v), and the rows with their leaves; None without rows."""
    square = F.aggregate("v", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double"))
    total, dim, most = groups.agg(F.count("*"), F.max(F.size("v")), F.max(square)).first()
    if not total:
        return None
    drawn = least_within(groups, F.xxhash64("v", "label"), (F.lit(1), sample)).toArrow().sort_by([("label", "ascending"), ("ids0", "ascending")]).combine_chunks()  # bounded by ``sample``
    rows = matrix(drawn["v"].combine_chunks(), dim)
    chunk = Chunk(rows, drawn["label"].to_numpy(), drawn["ids"].to_pylist(), float(most), BUCKET)
    index = Index(chunk, VpTree(rows, float(most), max(8, int(leaf_rows * len(rows) / total))), dim)
    shared = groups.sparkSession.sparkContext.broadcast(index.tree)

    def route(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                leaf, way = shared.value.route(matrix(batch.column(2), dim))
                yield pa.record_batch([pa.array(leaf), pa.array(way, pa.list_(pa.float64())), *batch.columns], ["leaf", "way", "label", "ids", "v"])

    routed = materialize(groups.select("label", "ids", "v").mapInArrow(route, "leaf long, way array<double>, label long, ids array<long>, v array<long>"), "routed")
    deep = max((len(w) for w in index.tree.ways().values()), default=0)
    bounds = [f(F.get("way", F.lit(k))).alias(f"{name}{k}") for name, f in (("a", F.min), ("b", F.max)) for k in range(deep)]
    leaves = routed.groupBy("leaf").agg(F.count("*").alias("n"), *bounds).collect()  # one row for each leaf of the upper tree
    ways = index.tree.ways()
    index.measured((r["leaf"], r["n"], [r[f"a{k}"] for k in range(len(ways[r["leaf"]]))], [r[f"b{k}"] for k in range(len(ways[r["leaf"]]))]) for r in leaves)
    return index, routed


def window_search(index: Index, routed: DataFrame, asks: DataFrame) -> DataFrame:
    """``gid, g, w, score, id``: the first rows of each window (number ``w``) of each ask (gid, g, label, v, windows)."""
    spark = routed.sparkSession
    shared = spark.sparkContext.broadcast(index)
    dim, most = index.dim, index.tree.most
    chunks = F.broadcast(spark.createDataFrame([(k, int(n)) for k, n in enumerate(index.chunks)], "leaf long, chunks int"))  # one row for each leaf
    rows = routed.join(chunks, "leaf").select(
        "leaf", F.pmod(F.xxhash64("v", "label"), F.col("chunks")).cast("int").alias("chunk"), F.lit(0).alias("side"), F.lit(0).cast("long").alias("gid"), F.lit(0).cast("long").alias("g"), "label", "ids", "v",
        F.lit(None).cast("array<struct<lo:long,hi:long,same:boolean,k:int>>").alias("windows"),
    )

    def visit(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = shared.value
        for batch in batches:
            if not batch.num_rows:
                continue
            labels, windows = batch.column(2).to_pylist(), batch.column(4).to_pylist()
            at, leaf, chunk = [], [], []
            for k, query in enumerate(matrix(batch.column(3), dim)):
                leaves, windows[k] = index.visits(query, labels[k], windows[k])
                for x in leaves:
                    for c in range(index.chunks[x]):
                        at.append(k)
                        leaf.append(x)
                        chunk.append(c)
            take = pa.array(at, pa.int64())
            gid, g, label, v = (c.take(take) for c in batch.columns[:4])
            w = pa.array(windows, batch.column(4).type).take(take)
            yield pa.record_batch([pa.array(leaf, pa.int64()), pa.array(chunk, pa.int32()), pa.array([1] * len(at), pa.int32()), gid, g, label, pa.nulls(len(at), pa.list_(pa.int64())), v, w], _NAMES)

    visits = asks.select("gid", "g", "label", "v", "windows").repartition(partitions(spark), "gid").mapInArrow(visit, _SEARCH)
    met = rows.unionByName(visits).repartition(partitions(spark), "leaf", "chunk").sortWithinPartitions("leaf", "chunk", "side")

    def search(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        here: tuple | None = None
        chunk: Chunk | None = None
        for batch in batches:
            if not batch.num_rows:
                continue
            key = np.stack([batch.column(k).to_numpy() for k in range(3)])
            cuts = [0, *(np.nonzero((key[:, 1:] != key[:, :-1]).any(axis=0))[0] + 1).tolist(), batch.num_rows]
            for a, b in zip(cuts, cuts[1:], strict=False):
                part, (leaf, number, side) = batch.slice(a, b - a), key[:, a].tolist()
                if here != (leaf, number):
                    here, held, chunk = (leaf, number), [], None
                if not side:
                    held.append(part)
                    continue
                if chunk is None and held:
                    rows = pa.Table.from_batches(held).combine_chunks()
                    chunk = Chunk(matrix(rows["v"].combine_chunks(), dim), rows["label"].to_numpy(), rows["ids"].to_pylist(), most, BUCKET)
                if chunk is None:
                    continue
                out: list[tuple] = []
                for gid, g, label, query, windows in zip(part["gid"].to_pylist(), part["g"].to_pylist(), part["label"].to_pylist(), matrix(part["v"], dim), part["windows"].to_pylist(), strict=True):
                    for w, found in enumerate(chunk.search(query, label, windows)):
                        out += [(gid, g, w, s, i) for s, i in found]
                columns = list(zip(*out, strict=True)) or [[]] * 5
                yield pa.record_batch([pa.array(c, t) for c, t in zip(columns, [pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64()], strict=True)], ["gid", "g", "w", "score", "id"])

    return met.mapInArrow(search, "gid long, g long, w int, score long, id long")


def mine(
    vectors: DataFrame, anchors: Column, id_col: str = "vec_id", vector_col: str = "embedding", label: Column | None = None, positives: int = POSITIVES, negatives: int = NEGATIVES,
    low: int = LOW, high: int = HIGH, sample: int = SAMPLE, leaf_rows: int = LEAF_ROWS,
) -> DataFrame:
    """``anchor_id, positive_id, rank, negative_id, positive_score, negative_score``; ``anchors`` is a condition on the column ``id``."""
    spark = vectors.sparkSession
    small_batches(spark)
    rows = materialize(clean(vectors, id_col, vector_col, F.col("label") if label is None else label), "vectors")
    most = max(positives + 1, negatives)  # a query's own id may be among them
    ranked = rows.withColumn("n", F.row_number().over(Window.partitionBy("label", "v").orderBy("id"))).filter(F.col("n") <= most)
    groups = materialize(ranked.groupBy("label", "v").agg(F.sort_array(F.collect_list("id")).alias("ids")).withColumn("ids0", F.col("ids")[0]), "groups")
    built = build(groups, sample, leaf_rows)
    if built is None:
        return spark.createDataFrame([], "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long")
    index, routed = built
    asks = rows.filter(anchors).groupBy("label", "v", F.floor(F.col("id") / ID_BLOCK).alias("block")).agg(F.sort_array(F.collect_list("id")).alias("members"))  # ``ID_BLOCK`` ids at most
    asks = materialize(asks.select(F.col("members")[0].alias("gid"), F.xxhash64("label", "v").alias("g"), "label", "v", "members"), "asks")

    def first(found: DataFrame, k: int) -> DataFrame:
        order = Window.partitionBy("gid", "g", "w").orderBy(F.col("score").desc(), F.col("id"))
        return found.withColumn("n", F.row_number().over(order)).filter(F.col("n") <= k).groupBy("gid", "g", "w").agg(F.sort_array(F.collect_list(F.struct("n", "score", "id"))).alias("rows"))

    whole = F.array(F.struct(F.lit(-(2**63)).cast("long").alias("lo"), F.lit(_LONG).cast("long").alias("hi"), F.lit(True).alias("same"), F.lit(positives + 1).alias("k")))
    near = first(window_search(index, routed, asks.withColumn("windows", whole)), positives + 1).select("gid", "g", F.col("rows").alias("positives"))
    asked = asks.join(near, ["gid", "g"]).withColumn("levels", F.filter(F.array_distinct(F.transform("positives", lambda p: p["score"])), lambda s: s >= 0))

    def window(s: Column) -> Column:
        whole = s.cast("decimal(19,0)")
        return F.struct(F.ceil(whole * low / 100).cast("long").alias("lo"), F.floor(whole * high / 100).cast("long").alias("hi"), F.lit(False).alias("same"), F.lit(negatives).alias("k"))

    asked = materialize(asked.withColumn("windows", F.transform("levels", window)), "windows")
    far = first(window_search(index, routed, asked), negatives).groupBy("gid", "g").agg(F.map_from_entries(F.collect_list(F.struct("w", "rows"))).alias("negatives"))
    each = asked.join(far, ["gid", "g"]).select("negatives", "levels", "positives", F.explode("members").alias("anchor_id"))
    own = F.slice(F.filter("positives", lambda p: p["id"] != F.col("anchor_id")), 1, positives)
    each = each.select("anchor_id", "negatives", "levels", F.explode(own).alias("p"))
    each = each.select("anchor_id", "p", F.explode(F.element_at("negatives", (F.array_position("levels", F.col("p.score")) - 1).cast("int"))).alias("f"))
    release(groups, collect=False)
    return each.select("anchor_id", F.col("p.id").alias("positive_id"), F.col("f.n").alias("rank"), F.col("f.id").alias("negative_id"), F.col("p.score").alias("positive_score"), F.col("f.score").alias("negative_score"))


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three negatives for each of the five positives of every fiftieth vector, after some labels are moved."""
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return mine(table(spark, sf_dir, "embeddings"), F.col("id") % 50 == 0, label=moved)


OP11_SQL = f"""
WITH v AS (
  SELECT vec_id AS id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v
  FROM embeddings WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
),
s AS (SELECT a.id AS anchor_id, b.id, a.label = b.label AS same, list_dot_product(a.v, b.v)::BIGINT AS score FROM v a JOIN v b ON a.id <> b.id WHERE a.id % 50 = 0),
p AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) AS n FROM s WHERE same) WHERE n <= {POSITIVES})
SELECT * FROM (
  SELECT p.anchor_id, p.id AS positive_id, row_number() OVER (PARTITION BY p.anchor_id, p.id ORDER BY s.score DESC, s.id)::INTEGER AS rank, s.id AS negative_id, p.score AS positive_score, s.score AS negative_score
  FROM p JOIN s ON s.anchor_id = p.anchor_id AND NOT s.same AND 100 * s.score BETWEEN {LOW} * p.score AND {HIGH} * p.score
) WHERE rank <= {NEGATIVES}
"""
