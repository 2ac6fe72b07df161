"""Removal of near copies: the Gray-order SimHash index finds families, five-word shingle sets decide.

Two texts are near copies if their sets of five-word shingles have a Jaccard similarity of 0.8 or more.
A fingerprint of 64 bits cannot tell such pairs (they differ in up to 18 bits), so the stage uses prints of
256 bits: texts that are similar enough differ in at most ``THRESHOLD`` of them, unrelated ones in half.
Prints are dealt by many choices of some bits; those that agree in one of the choices meet in a task, whose
Gray index links them.  The number of bits follows the number of prints, so that few strangers meet, and the
number of choices follows from that and ``RECALL``.  The search is not exhaustive; the README gives the
measured share of near copies that it finds.

The components of these links are families.  Only texts of families with several different sets are looked
at again: the sets of a family meet in one task, or, if they are many, in one for each pair of chunks, and
pairs within ``THRESHOLD`` bits are verified on the whole sets, nearest first.  Pairs that are joined
already are passed over, so a family of light edits takes a number of verifications in proportion to its
size, and no task emits more than links that span its groups.

Defined results: words are cut at white space, A-Z count as a-z; a text of fewer words than a shingle is one
shingle; null and empty texts are copies of each other and of nothing else; groups are the components of
verified links; rows without an id take no part and stay.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from basinsift.llm import simhash
from basinsift.llm.common import fresh, lower_ascii, materialize, portions, release, small_batches

#: Words of a shingle of the sets that decide, and of the prints that find candidates.
SHINGLE_WORDS, PRINT_WORDS = 5, 3
#: Words of 64 bits of a print, and bits in which near copies may differ.
WORDS, THRESHOLD = 4, 56
#: Share of bits that two texts of similarity 0.8 differ in, and of such pairs that should meet.
APART, RECALL = 0.13, 0.99
#: Least number of bits by which prints meet, and unrelated prints that may share them.
KEY_BITS, STRANGERS = 12, 1024
#: Shingles and sets that one chunk of a family may have; families above ``SPREAD_SETS`` are cut into up to
#: ``SPREAD`` chunks anyway, so that a large one is spread over tasks.
CHUNK_SHINGLES, CHUNK_SETS = 1 << 20, 2048
SPREAD_SETS, SPREAD = 128, 16
_FACTORS = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F], np.uint64)
_MIX = (np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB))
_CODE = [f"c{k}" for k in range(WORDS)]
_PRINT = "place long, doc_id long, fp long, n int, " + ", ".join(f"{c} long" for c in _CODE) + ", shingles array<int>"


def _mixed(x: np.ndarray) -> np.ndarray:
    """Every bit of the result depends on every bit of ``x``."""
    x = (x ^ (x >> np.uint64(30))) * _MIX[0]
    x = (x ^ (x >> np.uint64(27))) * _MIX[1]
    return x ^ (x >> np.uint64(31))


def shingle_hashes(words: np.ndarray, width: int) -> np.ndarray:
    """64-bit hashes of the shingles of a text, in order, from the hashes of its words."""
    span = min(width, len(words))
    total = np.full(max(0, len(words) - span + 1) if span else 0, span, np.uint64)
    for k in range(span):
        total += words[k : len(words) - span + 1 + k] * _FACTORS[k]
    return _mixed(total)


def word_hashes(text: str | None) -> np.ndarray:
    digest = xxhash.xxh64_intdigest
    words = lower_ascii((text or "").encode("utf-8", "surrogatepass")).split()
    return np.fromiter(map(digest, words), np.uint64, len(words))


def shingle_set(words: np.ndarray) -> np.ndarray:
    """Ascending distinct hashes of the five-word shingles."""
    return np.unique(shingle_hashes(words, SHINGLE_WORDS))


def wide_print(words: np.ndarray) -> np.ndarray:
    """SimHash of ``WORDS`` times 64 bits over the three-word shingles; zero without words."""
    hashes = shingle_hashes(words, PRINT_WORDS)
    counts = np.zeros(64 * WORDS, np.int64)
    for at in range(0, len(hashes), 255):
        part = hashes[at : at + 255, None] + _FACTORS[:WORDS]
        bits = np.unpackbits(_mixed(part).view(np.uint8), axis=1, bitorder="little")
        counts += np.add.reduce(bits, axis=0, dtype=np.uint8)
    return np.packbits(counts * 2 > len(hashes), bitorder="little").view(np.uint64)


def set_key(shingles: np.ndarray) -> int:
    """Equal for equal sets; signed 64-bit, zero for the empty set."""
    return int(np.uint64(xxhash.xxh64_intdigest(shingles.tobytes())).view(np.int64)) if len(shingles) else 0


def prints(docs: DataFrame) -> DataFrame:
    """Per row with an id: a number of its own, id, key and size of the set, print, the set (the upper halves of its hashes)."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place = TaskContext.get().partitionId() << 40
        for batch in (p for b in batches for p in portions(b)):
            words = [word_hashes(t) for t in batch.column(1).to_pylist()]
            sets, codes = [shingle_set(w) for w in words], np.stack([wide_print(w) for w in words]).view(np.int64)
            bounds = np.cumsum([0, *map(len, sets)])
            flat = (np.concatenate(sets) >> np.uint64(32)).astype(np.uint32).view(np.int32)
            columns = [
                pa.array(np.arange(place, place + len(sets))), batch.column(0), pa.array([set_key(s) for s in sets], pa.int64()), pa.array(np.diff(bounds), pa.int32()),
                *(pa.array(codes[:, k]) for k in range(WORDS)), pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(flat)),
            ]
            place += len(sets)
            yield pa.record_batch(columns, ["place", "doc_id", "fp", "n", *_CODE, "shingles"])

    small_batches(docs.sparkSession)
    texts = docs.filter("doc_id IS NOT NULL").select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return materialize(texts.mapInArrow(run, _PRINT), "prints")


def keyed(docs: DataFrame, name: str) -> DataFrame:
    """Adds the key of each row's set."""

    @F.pandas_udf("long")
    def key(texts):
        return texts.map(lambda t: set_key(shingle_set(word_hashes(t))))

    small_batches(docs.sparkSession)
    return docs.withColumn(name, key(F.col("text").cast("string")))


def choices(prints: int) -> list[list[tuple[int, int]]]:
    """For each choice of bits: the place, and the number of bits, that it takes from each word."""
    bits = KEY_BITS
    while bits < 48 and prints > STRANGERS << bits:
        bits += WORDS
    count = math.ceil(math.log(1 - RECALL) / math.log(1 - (1 - APART) ** bits))
    part = bits // WORDS
    # Odd steps run through all places; different ones for the words give each choice its own combination.
    return [[((t * step + t * part // 64 * (w + 1)) % 64, part) for w, step in enumerate((part, part + 1, part + 3, part + 5))] for t in range(count)]


def families(distinct: DataFrame) -> DataFrame:
    """``fp, family``: sets whose prints are linked, directly or over others, to that of another set.

    Each choice takes as many bits from every word of the print, at places of its own in each.
    """
    keys = []
    for t, places in enumerate(choices(distinct.count())):
        value = F.lit(0).cast("long")
        for c, (at, bits) in zip(_CODE, places, strict=True):
            turned = F.col(c) if not at else F.shiftrightunsigned(c, at).bitwiseOR(F.shiftleft(c, 64 - at))
            value = F.shiftleft(value, bits).bitwiseOR(turned.bitwiseAND(F.lit((1 << bits) - 1)))
        keys.append(F.struct(F.lit(t).alias("t"), value.alias("v")))
    dealt = distinct.filter("n > 0").select("fp", *_CODE, F.inline(F.array(*keys)))
    found = simhash.components(simhash.grouped_links(dealt, "fp", _CODE, THRESHOLD)).toDF("fp", "family")
    return found.unionByName(found.select(F.col("family").alias("fp"), "family").distinct())


def bitmaps(sizes: np.ndarray, sets: list[np.ndarray]) -> np.ndarray:
    """A row of bits for each set: those that its hashes fall on.  A bit that another set lacks stands for one hash, or more, that it lacks.

    The rows hold about four bits for each hash of a set of mean size, and 32 MB at most in all.
    """
    bits = 1 << max(6, min(int(4 * sizes.mean()), (1 << 28) // len(sets)).bit_length())
    marks = np.zeros((len(sets), bits // 64), np.uint64)
    at = np.concatenate(sets).view(np.uint32) & np.uint32(bits - 1)
    row = np.repeat(np.arange(len(sets)), sizes)
    np.bitwise_or.at(marks, (row, at >> np.uint32(6)), np.uint64(1) << (at & np.uint32(63)).astype(np.uint64))
    return marks


def similar_groups(codes: np.ndarray, sizes: np.ndarray, sets: list[np.ndarray], chunk: np.ndarray | None = None) -> np.ndarray:
    """Per set the least position of its component of verified pairs; of two chunks, only pairs across count."""
    label, held = np.arange(len(sets)), {}

    def hashes(k: int) -> set[int]:
        if k not in held:
            held[k] = set(sets[k].tolist())
        return held[k]

    near = []
    for at in range(0, len(sets), 256):
        apart = np.zeros((len(codes[at : at + 256]), len(sets) - at), np.uint16)
        for word in range(WORDS):
            apart += np.bitwise_count(codes[at : at + 256, word, None] ^ codes[None, at:, word])
        a, b = np.nonzero(apart <= THRESHOLD)
        fits = (a < b) & (5 * sizes[a + at] >= 4 * sizes[b + at]) & (5 * sizes[b + at] >= 4 * sizes[a + at])
        if chunk is not None:
            fits &= chunk[a + at] != chunk[b + at]
        a, b = a[fits], b[fits]
        near.append(np.stack([apart[a, b], a + at, b + at]).astype(np.int32))
    pairs = np.concatenate(near, axis=1)
    pairs = pairs[1:, np.argsort(pairs[0], kind="stable")]
    marks = bitmaps(sizes, sets)
    step = 512
    while pairs.shape[1]:
        pairs = pairs[:, label[pairs[0]] != label[pairs[1]]]
        a, b = some = pairs[:, :step]
        most = np.minimum(sizes[a] - np.bitwise_count(marks[a] & ~marks[b]).sum(axis=1), sizes[b] - np.bitwise_count(marks[b] & ~marks[a]).sum(axis=1))
        for a, b in some[:, 9 * most >= 4 * (sizes[a] + sizes[b])].T.tolist():
            if label[a] != label[b] and 9 * len(hashes(a) & hashes(b)) >= 4 * (len(hashes(a)) + len(hashes(b))):
                label[label == max(label[a], label[b])] = min(label[a], label[b])
        pairs, step = pairs[:, step:], min(2 * step, 1 << 15)
    return label


def links(distinct: DataFrame, sets: DataFrame) -> DataFrame:
    """``u, v``: verified links that span every group of near copies.  ``distinct`` has ``fp, place, n`` and the print, one row for each set."""
    members = materialize(distinct.join(families(distinct), "fp").select("fp", "family", "place", "n", *_CODE), "members")
    total = members.groupBy("family").agg(F.sum(F.col("n").cast("long")).alias("total"), F.count("*").alias("c"))
    chunks = F.ceil(F.greatest(F.col("total") / CHUNK_SHINGLES, F.col("c") / CHUNK_SETS, F.least(F.col("c") / SPREAD_SETS, F.lit(float(SPREAD))))).cast("int")
    many = total.select("family", chunks.alias("chunks")).filter("chunks > 1")
    chunk = F.expr("pmod(xxhash64(fp), chunks)").cast("int")
    pairs = F.expr("transform(sequence(0, chunks - 1), x -> struct(least(x, chunk) AS i, greatest(x, chunk) AS j))")
    dealt = (
        members.join(many, "family", "left")
        .withColumn("chunk", F.coalesce(chunk, F.lit(0)))
        .withColumn("p", F.when(F.col("chunks").isNull(), F.expr("array(struct(0 AS i, 0 AS j))")).otherwise(pairs))
        .join(sets.select("place", "shingles"), "place")
        .select("fp", *_CODE, "shingles", "chunk", "family", F.inline("p"))
        .repartition("family", "i", "j")
        .sortWithinPartitions("family", "i", "j")
    )

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def flush(held: list[tuple]) -> pa.RecordBatch:
            rows, group = np.concatenate([h[0] for h in held]), [s for h in held for s in h[1]]
            sizes = np.fromiter(map(len, group), np.int64, len(group))
            across = rows[0, -2] != rows[0, -1]
            label = similar_groups(np.ascontiguousarray(rows[:, 1 : 1 + WORDS]).view(np.uint64), sizes, group, rows[:, 1 + WORDS] if across else None)
            member = np.flatnonzero(label != np.arange(len(label)))
            return pa.record_batch([pa.array(rows[member, 0]), pa.array(rows[label[member], 0])], ["u", "v"])

        held: list[tuple] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            numbers = np.stack([batch.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("fp", *_CODE, "chunk", "family", "i", "j")], axis=1)
            lists = batch.column("shingles")
            flat, edge = lists.flatten().to_numpy(), np.cumsum([0, *lists.value_lengths().to_pylist()])
            cuts = [0, *(np.flatnonzero((numbers[1:, -3:] != numbers[:-1, -3:]).any(axis=1)) + 1).tolist(), len(numbers)]
            for a, b in zip(cuts, cuts[1:], strict=False):
                if held and (held[-1][0][0, -3:] != numbers[a, -3:]).any():
                    yield flush(held)
                    held = []
                held.append((numbers[a:b], [flat[edge[k] : edge[k + 1]] for k in range(a, b)]))
        if held:
            yield flush(held)

    small_batches(distinct.sparkSession)
    return materialize(dealt.mapInArrow(run, "u long, v long"), "similar")


def groups(docs: DataFrame) -> DataFrame:
    """``doc_id, fp, root`` of every row with an id: the key of its set and that of its component."""
    sets = prints(docs)
    distinct = materialize(sets.groupBy("fp").agg(F.min_by(F.struct("place", "n", *_CODE), "place").alias("least")).select("fp", "least.*"), "distinct")
    rows, found = materialize(sets.select("doc_id", "fp"), "rows"), links(distinct, sets)
    release(sets)
    roots = simhash.components(found).toDF("fp", "root")
    return rows.join(roots, "fp", "left").select("doc_id", "fp", F.coalesce("root", "fp").alias("root"))


def deduplicate(docs: DataFrame) -> DataFrame:
    """One row of each group of near copies: the one with the smallest id, and of rows that repeat that id in the group the one with the least key and text.

    Rows without an id stay.  Texts are read again, and shuffled, only for ids that repeat.
    """
    found = materialize(groups(docs), "groups")
    best = found.groupBy("root").agg(F.min(F.struct("doc_id", "fp")).alias("best")).select("best.doc_id", "best.fp", F.lit(True).alias("stays"))
    keys = found.groupBy("doc_id", "fp").agg(F.count("*").alias("c")).join(best, ["doc_id", "fp"], "left")
    ids = materialize(keys.groupBy("doc_id").agg(F.sum("c").alias("c"), F.max(F.coalesce("stays", F.lit(False))).alias("stays")), "decided")
    gone, repeated = ids.filter("NOT stays").select("doc_id"), ids.filter("stays AND c > 1").select("doc_id")
    few = gone.count() <= simhash.MAX_BROADCAST_IDS
    kept = docs.join(F.broadcast(gone) if few else gone, "doc_id", "left_anti").select(docs.columns)
    if repeated.isEmpty():
        return kept
    fp, n = fresh(docs.columns, "fp"), fresh(docs.columns, "n")
    again = keyed(kept.join(repeated, "doc_id", "left_semi").select(docs.columns), fp)
    again = again.join(best.select("doc_id", F.col("fp").alias(fp)), ["doc_id", fp], "left_semi")
    first = Window.partitionBy("doc_id", fp).orderBy("text", F.xxhash64(*docs.columns))
    ranked = again.withColumn(n, F.row_number().over(first)).filter(F.col(n) == 1).select(docs.columns)
    return kept.join(repeated, "doc_id", "left_anti").select(docs.columns).unionByName(ranked)
