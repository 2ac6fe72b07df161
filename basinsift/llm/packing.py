"""Packing of documents into sequences of bounded length by best fit and swap-based local search.

Tasks tokenize whole texts once, cut only documents longer than a sequence, and number the pieces of each
length.  The packing problem is then a histogram of at most ``capacity`` lengths, whatever the corpus: the
driver packs it as groups of equal bins (best fit, longest first) and improves underfull bins by moving one
piece, exchanging one for one, two for one or one for two, each step increasing the sum of squared fills,
until bins become empty.  Every piece finds its place from its length and rank, without a global sort.

Defined results: null or empty text is the end id alone; repeated rows are packed once each; a null id is
kept; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import base64
import logging
import re
import zlib
from collections import defaultdict
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from basinsift.llm.common import materialize, small_batches, table

CAPACITY = 2048
END_ID = 0
#: Pair evaluations of the local search; a bound of effort, not of data.
SEARCH_STEPS = 400_000
CACHED_CHUNKS = 250_000

Pattern = tuple[tuple[int, int], ...]  # (length, pieces of that length), longest first


def vocabulary(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


class ByteBpe:
    """Ids of a byte-level BPE as little-endian 32-bit bytes, with the ids of frequent chunks kept.

    A chunk is a stretch of text up to the next space that precedes a non-space: the pre-tokenizer always
    cuts there, so chunks are independent.  Texts in which a space stands between other white space, and
    texts that contain the special token's string, go to the full tokenizer.
    """

    _odd = re.compile(r"\s (?:\s|\Z)")

    def __init__(self, json_path: str, ranks_path: str, special: str = "<|endoftext|>"):
        import public_tokenizers
        import tiktoken

        with open(ranks_path, "rb") as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        self._encode = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
        self._json_path, self._special, self._full = json_path, special, None
        encode = self._encode

        class Chunks(dict):
            def __missing__(self, chunk: str) -> bytes:
                found = np.array(encode(" " + chunk), "<u4").tobytes()
                if len(self) < CACHED_CHUNKS and len(chunk) < 40:
                    self[chunk] = found
                return found

        self._chunks = Chunks()

    def ids(self, text: str) -> bytes:
        if self._special in text or self._odd.search(text):
            if self._full is None:
                from tokenizers import Tokenizer

                self._full = Tokenizer.from_file(self._json_path)
            return np.array(self._full.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
        first, *rest = text.split(" ")
        return np.array(self._encode(first), "<u4").tobytes() + b"".join(map(self._chunks.__getitem__, rest))


def cut(ids: bytes, capacity: int = CAPACITY) -> list[tuple[int, int, int, int]]:
    """``(piece, start, length, crc32)``: whole if it fits, else full pieces behind a first one that may be shorter."""
    total = len(ids) // 4
    count = -(-total // capacity)
    first = total - (count - 1) * capacity
    bounds = [0, *range(first, total + 1, capacity)]
    return [(k, a, b - a, zlib.crc32(ids[4 * a : 4 * b])) for k, (a, b) in enumerate(zip(bounds, bounds[1:], strict=False))]


_encoders: dict[str, ByteBpe] = {}


def pieces(docs: DataFrame, json_path: str, ranks_path: str, capacity: int = CAPACITY) -> DataFrame:
    """Pieces of every document; ``task`` and ``rank`` number the pieces of each length."""
    small_batches(docs.sparkSession)
    schema = pa.schema([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("task", pa.int32()), ("rank", pa.int64())])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if json_path not in _encoders:
            _encoders[json_path] = ByteBpe(json_path, ranks_path)
        encoder, task, seen = _encoders[json_path], TaskContext.get().partitionId(), defaultdict(int)
        end = END_ID.to_bytes(4, "little")
        for batch in batches:
            rows = []
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                for piece in cut(encoder.ids(text.as_py() or "") + end, capacity):
                    rows.append((doc, *piece, task, seen[piece[2]]))
                    seen[piece[2]] += 1
            yield pa.record_batch([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True) if rows else [[]] * len(schema), schema, strict=True)], schema=schema)

    out = "doc_id long, piece int, start long, length long, ids_crc32 long, task int, rank long"
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, out)


def _size(pattern: Pattern) -> int:
    return sum(length * n for length, n in pattern)


def _with(pattern: Pattern, add: Iterable[int] = (), remove: Iterable[int] = ()) -> Pattern:
    counts = defaultdict(int, pattern)
    for length in add:
        counts[length] += 1
    for length in remove:
        counts[length] -= 1
    return tuple(sorted(((k, n) for k, n in counts.items() if n), reverse=True))


def best_fit(histogram: dict[int, int], capacity: int = CAPACITY) -> dict[Pattern, int]:
    """Groups of equal bins: each length, longest first, goes where it leaves the least room."""
    room: list[list[tuple[Pattern, int]]] = [[] for _ in range(capacity + 1)]

    def put(pattern: Pattern, bins: int, left: int) -> None:
        if bins:
            room[left].append((pattern, bins))

    for length in sorted(histogram, reverse=True):
        count = histogram[length]
        for left in range(length, capacity + 1):
            each = left // length
            kept = []
            for at, (pattern, bins) in enumerate(room[left]):
                if not count:
                    kept += room[left][at:]
                    break
                full = min(bins, count // each)
                put(pattern + ((length, each),), full, left - each * length)
                count -= full * each
                rest = bins - full
                if rest and count:
                    put(pattern + ((length, count),), 1, left - count * length)
                    count, rest = 0, rest - 1
                if rest:
                    kept.append((pattern, rest))
            room[left] = kept
            if not count:
                break
        each = capacity // length
        put(((length, each),), count // each, capacity - each * length)
        if count % each:
            put(((length, count % each),), 1, capacity - count % each * length)
    packed: dict[Pattern, int] = defaultdict(int)
    for groups in room:
        for pattern, bins in groups:
            packed[pattern] += bins
    return dict(packed)


def _best_step(fuller: Pattern, emptier: Pattern, left: int) -> tuple[int, tuple[int, ...], tuple[int, ...]] | None:
    """The step that fills most of ``left``: pieces that the fuller bin takes and those that it gives."""
    takes: dict[tuple[int, ...], int] = {(x,): x for x, _ in emptier}
    own = [x for x, n in emptier for _ in range(min(n, 2))]
    takes |= {(x, y): x + y for k, x in enumerate(own) for y in own[k + 1 :]}
    mine = [x for x, n in fuller for _ in range(min(n, 2))]
    gives: dict[tuple[int, ...], int] = {(): 0} | {(x,): x for x in mine}
    pairs = {(x, y): x + y for k, x in enumerate(mine) for y in mine[k + 1 :]}
    best = None
    for take, plus in takes.items():
        for give, minus in (gives if len(take) == 2 else gives | pairs).items():
            gain = plus - minus
            if 0 < gain <= left and (best is None or gain > best[0]) and not (len(take) == 2 and not give):
                best = (gain, take, give)
                if gain == left:
                    return best
    return best


def local_search(packed: dict[Pattern, int], capacity: int = CAPACITY, steps: int = SEARCH_STEPS, report: dict | None = None) -> dict[Pattern, int]:
    """Improves underfull bins, all equal pairs of bins at once, until no step helps, the count is the least possible or the effort ends.

    A pair of patterns is looked at once; the effort is a number of such looks, ``steps`` or a hundred for
    each pattern that best fit leaves, whichever is more.  ``report`` gets the bins before and after, the
    least possible number, the looks and what ended the search.
    """
    packed = defaultdict(int, packed)
    least = -(-sum(_size(p) * n for p, n in packed.items()) // capacity)
    fill = {p: _size(p) for p in packed}
    given_up: set[Pattern] = set()
    seen: dict[tuple[Pattern, Pattern], tuple[int, tuple[int, ...], tuple[int, ...]] | None] = {}
    effort, before = max(steps, 100 * len(packed)), sum(packed.values())
    while sum(packed.values()) > least and len(seen) < effort:
        open_bins = sorted((p for p, n in packed.items() if n and fill[p] < capacity), key=lambda p: (fill[p], p))
        source = next((p for p in open_bins if p not in given_up), None)
        if source is None:
            break
        best = None
        for target in reversed(open_bins):
            if fill[target] < fill[source] or target == source and packed[source] < 2:
                continue
            if (target, source) not in seen:
                seen[target, source] = _best_step(target, source, capacity - fill[target])
            step = seen[target, source]
            # Increase of the two bins' squared fills, for equal bins counted once.
            if step and (best is None or step[0] * (fill[target] - fill[source] + step[0]) > best[0]):
                best = (step[0] * (fill[target] - fill[source] + step[0]), target, step[1], step[2])
                if fill[target] + step[0] == capacity:
                    break
        if best is None:
            given_up.add(source)
            continue
        _, target, take, give = best
        times = packed[source] // 2 if target == source else min(packed[source], packed[target])
        packed[source] -= times
        packed[target] -= times
        for changed in (_with(target, take, give), _with(source, give, take)):
            if changed:
                packed[changed] += times
                fill[changed] = _size(changed)
        given_up.clear()
    after = sum(packed.values())
    if report is not None:
        report |= {"best_fit": before, "bins": after, "least": least, "looks": len(seen), "ended": "least reached" if after <= least else "effort" if len(seen) >= effort else "no step helps"}
    return {p: n for p, n in packed.items() if n}


def pack(docs: DataFrame, json_path: str, ranks_path: str, capacity: int = CAPACITY) -> DataFrame:
    """A row for each piece with its sequence and offset."""
    spark = docs.sparkSession
    cut_up = materialize(pieces(docs, json_path, ranks_path, capacity), "pieces")
    counts = materialize(cut_up.groupBy("task", "length").agg(F.count("*").alias("n")), "counts")
    before = Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    bases = counts.select("task", "length", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    # At most ``capacity`` rows reach the driver.
    histogram = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    report: dict = {}
    packed = local_search(best_fit(histogram, capacity), capacity, report=report)
    logging.getLogger(__name__).info("packing: %s", report)
    slots, sequence, used = [], 0, defaultdict(int)
    for pattern, bins in sorted(packed.items(), reverse=True):
        offset = 0
        for length, each in pattern:
            slots.append((length, used[length], each, sequence, offset))
            used[length] += each * bins
            offset += each * length
        sequence += bins
    slots.sort()
    slot_table = spark.sparkContext.broadcast(np.array(slots, np.int64).reshape(-1, 5).T.copy())

    def place(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        length_of, first, each, base, offset = slot_table.value
        shift = np.int64(1 << 48)
        keys = length_of * shift + first
        for batch in batches:
            length, rank = (batch.column(k).to_numpy() for k in (3, 5))
            at = np.searchsorted(keys, length * shift + rank, "right") - 1
            nth = rank - first[at]
            where = [base[at] + nth // each[at], offset[at] + nth % each[at] * length]
            yield pa.record_batch([*batch.columns[:5], *map(pa.array, where)], ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    ranked = cut_up.join(bases, ["task", "length"]).select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("base") + F.col("rank")).alias("rank"))
    return ranked.mapInArrow(place, "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sequence and place of every piece of every document."""
    return pack(table(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.json"), vocabulary("byte_bpe_50k.tiktoken"))
