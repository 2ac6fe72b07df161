"""SimHash near-duplicate groups through a Gray-order hierarchical index.

Fingerprints of distinct texts are dealt by blocks of bits that two linked fingerprints must share
(pigeonhole: of ``threshold + r`` blocks, ``r`` are equal).  Inside a task the fingerprints lie in Gray-rank order; runs of
neighbours form nodes that keep only the bits on which all members agree (masked pattern), and nodes are
grouped again up to a root.  A join of the tree with itself descends pair by pair: the differences of two
masked patterns are a lower bound for all pairs beneath, so whole groups are pruned as soon as the
accumulated differences exceed the threshold, or once both sides already belong to one component.
Only a spanning star of each local component leaves the task; global components follow by alternating
large-star and small-star rounds whose state is written to the shared folder.

Defined results: null or empty text has fingerprint zero and links like any other; repeated rows stay,
all with the same component; a null id takes part but is never a representative unless its whole
component has none; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from itertools import accumulate, combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from basinsift.llm.common import fresh, lower_ascii, materialize, partitions, portions, release, small_batches, table

SEED = 42
SHINGLE_WORDS = 3
THRESHOLD = 3
#: Bits for removing near copies from a corpus: one changed word moves up to six bits of a short text.
NEAR_COPY_THRESHOLD = 6
FANOUT = 8
#: Fingerprints of one join group held in memory; larger groups are split into pairs of chunks.
GROUP_CAP = 100_000
#: Ids that may be broadcast (8 bytes each).
MAX_BROADCAST_IDS = 1_000_000
#: Rows a task gathers before it joins them.
BUFFER_ROWS = 400_000
_PAIRS = 1 << 19


def fingerprint(text: str | None, width: int = SHINGLE_WORDS, seed: int = SEED) -> int:
    """64-bit SimHash: a bit is 1 if set in over half the hashes of the text's word shingles."""
    words = lower_ascii((text or "").encode("utf-8", "surrogatepass")).split()
    if not words:
        return 0
    joined = b" ".join(words)
    ends = list(accumulate(len(w) + 1 for w in words))
    starts = [0, *ends]
    span = min(width, len(words)) - 1
    digest = xxhash.xxh64_intdigest
    hashes = np.fromiter((digest(joined[s : e - 1], seed) for s, e in zip(starts, ends[span:], strict=False)), np.uint64, len(words) - span)
    counts = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 1 << 14):
        part = hashes[at : at + (1 << 14)]
        counts += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int32)
    return int(np.packbits(counts * 2 > len(hashes), bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, width: int = SHINGLE_WORDS, seed: int = SEED) -> DataFrame:
    """``doc_id, fp`` (signed 64-bit) of every row; the text is read once and never shuffled."""
    small_batches(docs.sparkSession)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (p for b in batches for p in portions(b)):
            fps = np.array([fingerprint(t, width, seed) for t in batch.column(1).to_pylist()], np.uint64)
            yield pa.record_batch([batch.column(0), pa.array(fps.view(np.int64))], ["doc_id", "fp"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, fp long")


def gray_rank(codes: np.ndarray) -> np.ndarray:
    """Position of each 64-bit code in the reflected Gray sequence; of wider codes, one word in each column, the words of the position."""
    rank = codes.copy()
    for shift in (1, 2, 4, 8, 16, 32):
        rank ^= rank >> np.uint64(shift)
    if codes.ndim > 1:
        odd = (np.bitwise_count(codes) & 1).astype(bool)
        before = np.logical_xor.accumulate(odd, axis=1)[:, :-1]
        rank[:, 1:] ^= np.where(before, ~np.uint64(0), np.uint64(0))
    return rank


class GrayIndex:
    """Hierarchy of masked bit patterns over codes in Gray order, within groups.

    ``codes`` holds 64-bit words, in several columns for wider codes.  ``group`` separates codes that must
    not be compared; it is part of the sort order, so a node covers an interval of groups and two nodes with
    disjoint intervals are pruned at once.
    """

    def __init__(self, codes: np.ndarray, group: np.ndarray, fanout: int = FANOUT):
        codes = codes.reshape(len(codes), -1)
        order = np.lexsort((*gray_rank(codes).T[::-1], group))
        self.order, self.fanout = order, fanout
        ones, zeros = codes[order], ~codes[order]
        low = high = group[order]
        self.levels = [(ones, zeros, low, high)]
        while len(ones) > 1:
            at = np.arange(0, len(ones), fanout)
            ones, zeros = np.bitwise_and.reduceat(ones, at), np.bitwise_and.reduceat(zeros, at)
            low, high = low[at], high[np.minimum(at + fanout, len(high)) - 1]
            self.levels.append((ones, zeros, low, high))

    def near(self, level: int, a: np.ndarray, b: np.ndarray, threshold: int) -> np.ndarray:
        """Which node pairs may hold codes at most ``threshold`` bits apart: bits surely 1 on one side and 0 on the other add up, word by word."""
        ones, zeros, low, high = self.levels[level]
        keep = (low[a] <= high[b]) & (low[b] <= high[a])
        left = np.flatnonzero(keep)
        total = np.zeros(len(left), np.int64)
        for word in range(ones.shape[1]):
            x, y = a[left], b[left]
            total += np.bitwise_count((ones[x, word] & zeros[y, word]) | (zeros[x, word] & ones[y, word]))
            fits = total <= threshold
            left, total = left[fits], total[fits]
        keep[:] = False
        keep[left] = True
        return keep

    def components(self, threshold: int) -> np.ndarray:
        """Label of each code (in input order): the least sorted position of its component."""
        n = len(self.order)
        label = np.arange(n)
        if n:
            top = len(self.levels) - 1
            stack = [(top, np.zeros(1, np.int64), np.zeros(1, np.int64))]
            uniform = self._uniform(label)
            step = np.arange(self.fanout)
            while stack:
                level, a, b = stack.pop()
                if len(a) > _PAIRS:
                    stack += [(level, a[k : k + _PAIRS], b[k : k + _PAIRS]) for k in range(0, len(a), _PAIRS)][::-1]
                    continue
                keep = self.near(level, a, b, threshold)
                same = uniform[level]
                keep &= (same[a] < 0) | (same[a] != same[b]) if level else label[a] != label[b]
                a, b = a[keep], b[keep]
                if not len(a):
                    continue
                if level == 0:
                    if self._unite(label, a, b):
                        uniform = self._uniform(label)
                    continue
                size = len(self.levels[level - 1][0])
                x = np.repeat(a[:, None] * self.fanout + step, self.fanout, axis=1).ravel()
                y = np.tile(b[:, None] * self.fanout + step, (1, self.fanout)).ravel()
                fit = (x < size) & (y < size) & (x <= y if level > 1 else x < y)
                x, y = x[fit], y[fit]
                # Far pairs first on the stack: neighbours in Gray order, the likeliest links, are compared first.
                far = x // self.fanout != y // self.fanout
                stack.append((level - 1, x[far], y[far]))
                stack.append((level - 1, x[~far], y[~far]))
        out = np.empty(n, np.int64)
        out[self.order] = label
        return out

    def _uniform(self, label: np.ndarray) -> list[np.ndarray]:
        """Per level: the component that all codes of a node share, or -1."""
        found, low, high = [label], label, label
        for _ in self.levels[1:]:
            at = np.arange(0, len(low), self.fanout)
            low, high = np.minimum.reduceat(low, at), np.maximum.reduceat(high, at)
            found.append(np.where(low == high, low, -1))
        return found

    @staticmethod
    def _unite(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> bool:
        pairs = np.unique(np.stack([np.minimum(label[a], label[b]), np.maximum(label[a], label[b])]), axis=1)
        pairs = pairs[:, pairs[0] != pairs[1]]
        if not pairs.shape[1]:
            return False
        root: dict[int, int] = {}

        def find(x: int) -> int:
            path = []
            while (up := root.get(x, x)) != x:
                path.append(x)
                x = up
            for p in path:
                root[p] = x
            return x

        for x, y in pairs.T.tolist():
            x, y = find(x), find(y)
            if x != y:
                root[max(x, y)] = min(x, y)
        old = np.array(sorted(root), np.int64)
        new = np.array([find(x) for x in old.tolist()], np.int64)
        at = np.minimum(np.searchsorted(old, label), len(old) - 1)
        hit = old[at] == label
        label[hit] = new[at[hit]]
        return True


def local_stars(nodes: np.ndarray, codes: np.ndarray, group: np.ndarray, threshold: int) -> tuple[np.ndarray, np.ndarray]:
    """Spanning stars (member, representative) of the components within each group; ``nodes`` are the signed names of the codes."""
    label = GrayIndex(codes, group).components(threshold)
    uniq, inverse = np.unique(label, return_inverse=True)
    rep = np.full(len(uniq), np.iinfo(np.int64).max)
    np.minimum.at(rep, inverse, nodes)
    rep = rep[inverse]
    keep = rep != nodes
    return nodes[keep], rep[keep]


def links(distinct: DataFrame, threshold: int = THRESHOLD, cap: int = GROUP_CAP) -> DataFrame:
    """``u, v``: links that span every component of fingerprints (column ``fp``) within ``threshold`` bits.

    Two linked fingerprints differ in at most ``threshold`` of ``threshold + r`` blocks, so they agree in
    ``r`` of them and meet in the group of those blocks; ``r`` is the least that makes groups of unrelated
    fingerprints a tenth of ``cap`` at most, given their number, and share 16 bits.
    """
    n, equal = distinct.count(), 1
    while equal < 4 and (64 * equal // (threshold + equal) < 14 or n > (cap // 10) << 64 * equal // (threshold + equal)):
        equal += 1
    blocks = threshold + equal
    edges = [round(64 * k / blocks) for k in range(blocks + 1)]
    parts = [F.shiftrightunsigned("fp", edges[k]).bitwiseAND(F.lit((1 << (edges[k + 1] - edges[k])) - 1)) for k in range(blocks)]
    keys = []
    for t, chosen in enumerate(combinations(range(blocks), equal)):
        value = F.lit(0).cast("long")
        for k in chosen:
            value = F.shiftleft(value, edges[k + 1] - edges[k]).bitwiseOR(parts[k])
        keys.append(F.struct(F.lit(t).alias("t"), value.alias("v")))
    return grouped_links(distinct.select("fp", F.inline(F.array(*keys))), "fp", [], threshold, cap)


def grouped_links(dealt: DataFrame, node: str, words: list[str], threshold: int, cap: int = GROUP_CAP) -> DataFrame:
    """``u, v``: links of nodes within ``threshold`` bits that meet in a group ``t, v``, by a Gray index in each task.

    The code of a node is in the columns ``words``, or is the node itself where there are none.  A group
    above ``cap`` is split into chunks; each pair of chunks is a group of its own.
    """
    hot = dealt.groupBy("t", "v").count().filter(F.col("count") > cap).select("t", "v", F.ceil(F.col("count") / cap).cast("int").alias("chunks"))
    chunk = F.pmod(F.xxhash64(node), F.col("chunks")).cast("int")
    pairs = F.expr("transform(sequence(0, chunks - 1), c -> struct(least(c, chunk) AS i, greatest(c, chunk) AS j))")
    dealt = (
        dealt.join(hot, ["t", "v"], "left")
        .withColumn("chunk", chunk)
        .withColumn("p", F.when(F.col("chunks").isNull(), F.expr("array(struct(0 AS i, 0 AS j))")).otherwise(pairs))
        .select(node, *words, "t", "v", F.inline("p"))
        .repartition(F.col("t"), F.col("v"), F.col("i"), F.col("j"))
        .sortWithinPartitions("t", "v", "i", "j")
    )
    first = 1 + len(words)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def flush(held: list[np.ndarray]) -> pa.RecordBatch:
            rows = np.concatenate(held, axis=1)
            new = np.r_[False, (rows[first:, 1:] != rows[first:, :-1]).any(axis=0)]
            codes = np.ascontiguousarray(rows[1:first].T if words else rows[:1].T).view(np.uint64)
            u, v = local_stars(rows[0], codes, np.cumsum(new), threshold)
            return pa.record_batch([pa.array(u), pa.array(v)], ["u", "v"])

        held: list[np.ndarray] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            held.append(np.stack([c.to_numpy(zero_copy_only=False).astype(np.int64) for c in batch.columns]))
            if sum(x.shape[1] for x in held) >= BUFFER_ROWS:
                rows = np.concatenate(held, axis=1)
                cut = rows.shape[1]
                while cut and (rows[first:, cut - 1] == rows[first:, -1]).all():
                    step = (rows[first:, :cut] != rows[first:, -1:]).any(axis=0)
                    cut = int(np.nonzero(step)[0][-1]) + 1 if step.any() else 0
                if cut:
                    yield flush([rows[:, :cut]])
                held = [rows[:, cut:]] if cut < rows.shape[1] else []
        if held:
            yield flush(held)

    return dealt.mapInArrow(run, "u long, v long")


def spread_join(rows: DataFrame, keys: DataFrame, on: str, weight: str, total: int) -> DataFrame:
    """``rows`` joined with ``keys`` (one row for each key, ``weight`` being its number of rows) so that no key holds up a task.

    Keys with more than a fourth of a partition's share of the ``total`` rows, of which there are at most
    four times as many as partitions, are broadcast; the others are dealt by the key.
    """
    share = total // (4 * partitions(rows.sparkSession)) + 1
    hot, cold = keys.filter(F.col(weight) > share).drop(weight), keys.filter(F.col(weight) <= share).drop(weight)
    hot = F.broadcast(hot)
    return rows.join(hot, on).unionByName(rows.join(F.broadcast(hot.select(on)), on, "left_anti").join(cold, on))


def components(edges: DataFrame) -> DataFrame:
    """``node, root``: connected components of ``u, v`` by alternating large-star and small-star rounds, until nothing changes.

    Each round's state is written to the shared folder; centres of large stars are joined by broadcast.
    """
    def state() -> tuple:
        return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())

    edges = materialize(edges.filter("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "links")
    mark = state()
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"), F.count("*").alias("c"))
        large = spread_join(both, least, "u", "c", 2 * mark[0]).filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = materialize(large.filter("u <> v").distinct(), "large")
        # The greater end of a link has few links after a large star: one for each centre it met.
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.inline(F.expr("array(struct(v AS u, m AS v), struct(u AS u, m AS v))")))
        before, edges = edges, materialize(small.filter("u <> v").distinct(), "small")
        now = state()
        release(before, large, collect=now == mark)
        if now == mark:
            break
        mark = now
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))


def near_duplicates(docs: DataFrame, threshold: int = THRESHOLD, width: int = SHINGLE_WORDS, seed: int = SEED) -> DataFrame:
    """``doc_id, fp, component_id`` of every row: the smallest id reachable over links of ``threshold`` bits or fewer."""
    prints = materialize(fingerprints(docs, width, seed), "fingerprints")
    distinct = materialize(prints.groupBy("fp").agg(F.min("doc_id").alias("least"), F.count("*").alias("c")), "distinct")
    roots = components(links(distinct.select("fp"), threshold))
    named = materialize(distinct.join(roots.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp")), "named")
    least = materialize(named.groupBy("root").agg(F.min("least").alias("component_id"), F.count("*").alias("n")), "least")
    of = materialize(spread_join(named, least, "root", "n", named.count()).select("fp", "component_id", "c"), "members")
    return spread_join(prints, of, "fp", "c", prints.count()).select("doc_id", "fp", "component_id")


def deduplicate(docs: DataFrame, threshold: int = NEAR_COPY_THRESHOLD) -> DataFrame:
    """The rows of ``docs`` whose id stands for its group; of rows that repeat that id, the one with the least text.

    Rows without an id stay.  The ids that go are broadcast while they are few, so that texts are not shuffled.
    """
    groups = near_duplicates(docs, threshold).filter("doc_id IS NOT NULL")
    ids = materialize(groups.groupBy("doc_id").agg(F.count("*").alias("n"), F.max(F.col("doc_id") == F.col("component_id")).alias("stays")), "decided")
    gone, repeated = ids.filter("NOT stays").select("doc_id"), ids.filter("stays AND n > 1").select("doc_id")
    few = gone.count() <= MAX_BROADCAST_IDS
    kept = docs.join(F.broadcast(gone) if few else gone, "doc_id", "left_anti").select(docs.columns)
    if repeated.isEmpty():
        return kept
    n = fresh(docs.columns, "n")
    first = Window.partitionBy("doc_id").orderBy("text", F.xxhash64(*docs.columns))
    ranked = kept.join(repeated, "doc_id", "left_semi").withColumn(n, F.row_number().over(first)).filter(F.col(n) == 1)
    return kept.join(repeated, "doc_id", "left_anti").select(docs.columns).unionByName(ranked.select(docs.columns))


def op7_simhash(spark, sf_dir: str) -> DataFrame:
    """Component of every document."""
    out = near_duplicates(table(spark, sf_dir, "documents"))
    return out.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
