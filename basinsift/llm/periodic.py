"""Periodic runs of words: a suffix automaton with ordered end-position sets merged small to large.

A run is a stretch of consecutive words with smallest period q (words q apart are equal), at least
``min_length`` words and ``min_exponent`` periods long, that no neighbouring word extends.

The sets of end positions of an automaton's states are merged upwards in the order of falling state length, the
smaller into the larger.  Two ends x < y that become neighbours in the set of a state of length m and lie y - x <= m
apart are a square: the m words before both are equal, so the stretch from x - m + 1 to y has period y - x.  It is the
smallest period, since a shorter one would put another end between them, and the stretch can't be extended to the left
unless a longer state holds both ends.  The greatest y of a start and period is where the run ends.  Only
neighbours of newly merged ends are looked at, so a document of n words costs O(n log^2 n) steps.

Before that, stretches that can't hold a run are set aside, exactly: in a run every gram of ``gram_words`` words occurs
twice or more, so runs lie within stretches whose grams all repeat inside the stretch.  Grams are compared by hash; equal
hashes of different grams only keep more words.

Each document is one row and is worked on alone: nothing is shuffled, and memory grows with the longest document.

Defined results: null and empty texts have no words and no runs; every row, repeated or not, has its own result; other
columns stay, but for those of the names of the results; an empty table gives an empty result.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from basinsift.llm.common import portions, small_batches, table

MIN_LENGTH, MIN_EXPONENT = 6, 4
_ODD = np.uint64(0x9E3779B97F4A7C15)


class Automaton:
    """Suffix automaton of a sequence of hashable words: transitions, suffix links, lengths, and the end that made a state."""

    def __init__(self, words: list):
        step, link, length, end = [{}], [-1], [0], [-1]
        last = 0
        for place, word in enumerate(words):
            here = len(step)
            step.append({})
            link.append(0)
            length.append(length[last] + 1)
            end.append(place)
            at = last
            while at >= 0 and word not in step[at]:
                step[at][word] = here
                at = link[at]
            if at >= 0:
                target = step[at][word]
                if length[target] == length[at] + 1:
                    link[here] = target
                else:
                    copy = len(step)
                    step.append(dict(step[target]))
                    link.append(link[target])
                    length.append(length[at] + 1)
                    end.append(-1)
                    while at >= 0 and step[at].get(word) == target:
                        step[at][word] = copy
                        at = link[at]
                    link[target] = link[here] = copy
            last = here
        self.link, self.length, self.end = link, length, end


def squares(words: list) -> dict[tuple[int, int], int]:
    """Last word of each run of exponent 2 or more, by its first word and smallest period."""
    automaton = Automaton(words)
    link, length = automaton.link, automaton.length
    #: Ends as negative numbers: states of falling length bring earlier ends, which are appended.
    ends: list[list[int] | None] = [[-e] if e >= 0 else None for e in automaton.end]
    merged: list[list[int]] = [[-e] if e >= 0 else [] for e in automaton.end]
    found: dict[tuple[int, int], int] = {}
    for state in np.argsort(-np.array(length), kind="stable").tolist():
        if not state:
            continue
        own, m = ends[state], length[state]
        if len(own) > 1:
            for e in merged[state]:
                at = bisect_left(own, e)
                for y, x in ((own[at - 1], e) if at else (0, 1), (e, own[at + 1]) if at + 1 < len(own) else (0, 1)):
                    q, start = x - y, 1 - x - m  # the ends are -x < -y
                    if x <= 0 and q <= m and (start == 0 or words[start - 1] != words[start - 1 + q]) and found.get((start, q), -1) < -y:
                        found[start, q] = -y
        up = link[state]
        if up:
            other = ends[up]
            if other is None:
                ends[up] = own
            else:
                small, large = (other, own) if len(other) < len(own) else (own, other)
                if small is other:
                    merged[up] = list(other)
                else:
                    merged[up].extend(small)
                for e in small:
                    if e > large[-1]:
                        large.append(e)
                    else:
                        insort(large, e)
                ends[up] = large
        ends[state] = merged[state] = None
    return found


def gram_words(min_length: int, min_exponent: int) -> int:
    """Most words of a gram that surely occurs twice in every run: a run of period q has ``max(min_length, min_exponent * q)`` words."""
    return max(1, min(max(min_length, min_exponent * q) - 2 * q + 1 for q in range(1, min_length + 2)))


def stretches(words: list[bytes], gram: int) -> list[tuple[int, int]]:
    """First and last word + 1 of the stretches in which all grams repeat; no run lies outside of them."""
    if len(words) <= gram:
        return []
    hashed = np.fromiter(map(hash, words), np.int64, len(words)).view(np.uint64)
    keys = hashed[: len(words) - gram + 1].copy()
    for k in range(1, gram):
        keys = (keys ^ (keys >> np.uint64(29))) * _ODD + hashed[k : len(words) - gram + 1 + k]
    places, stretch = np.arange(len(keys)), np.zeros(len(keys), np.uint64)
    while len(places):
        mixed = keys[places] ^ stretch * _ODD
        order = np.argsort(mixed, kind="stable")
        equal = mixed[order[1:]] == mixed[order[:-1]]
        repeats = np.zeros(len(places), bool)
        repeats[order[1:]] = equal
        repeats[order[:-1]] |= equal
        kept = places[repeats]
        if len(kept) == len(places) and stretch[-1]:
            break
        places, stretch = kept, np.cumsum(np.r_[1, (np.diff(kept) > 1).astype(np.int64)])[: len(kept)].astype(np.uint64)
    if not len(places):
        return []
    first = np.nonzero(np.r_[True, np.diff(places) > 1])[0]
    return list(zip(places[first].tolist(), (places[np.r_[first[1:], len(places)] - 1] + gram).tolist(), strict=True))


def find_runs(words: list[bytes], min_length: int = MIN_LENGTH, min_exponent: int = MIN_EXPONENT) -> list[tuple[int, int, int]]:
    """``(start, length, period)`` of all runs, by start and period."""
    if min_exponent < 2:
        raise ValueError("a run has two periods or more")
    found = []
    for a, b in stretches(words, gram_words(min_length, min_exponent)):
        for (start, q), last in squares(words[a:b]).items():
            if last - start + 1 >= max(min_length, min_exponent * q):
                found.append((a + start, last - start + 1, q))
    return sorted(found, key=lambda r: (r[0], r[2]))


def collapsed(words: list[bytes], runs: list[tuple[int, int, int]]) -> list[bytes]:
    """The words without those that a run holds after its first period."""
    if not runs:
        return words
    keep = np.ones(len(words), bool)
    for start, length, q in runs:
        keep[start + q : start + length] = False
    return [words[k] for k in np.nonzero(keep)[0].tolist()]


def with_runs(docs: DataFrame, text_col: str = "text", min_length: int = MIN_LENGTH, min_exponent: int = MIN_EXPONENT, runs: str = "runs", text: str = "collapsed") -> DataFrame:
    """Adds the runs of each whole text, an array of (start, length, period), and the text without their repeats, words joined by a space."""
    small_batches(docs.sparkSession)
    docs = docs.drop(runs, text).withColumn(text_col, F.col(text_col).cast("string"))
    at, names = docs.columns.index(text_col), [*docs.columns, runs, text]
    kind = "array<struct<start:long,length:long,period:long>>"
    schema = docs.withColumn(runs, F.lit(None).cast(kind)).withColumn(text, F.lit("")).schema
    arrow = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (p for b in batches for p in portions(b, at)):
            found, left = [], []
            for value in batch.column(at).cast(pa.binary()).to_pylist():
                words = (value or b"").split()  # at ASCII white space: \t \n \v \f \r and space
                these = find_runs(words, min_length, min_exponent)
                found.append([dict(zip(("start", "length", "period"), r, strict=True)) for r in these])
                left.append(b" ".join(collapsed(words, these)))
            yield pa.record_batch([*batch.columns, pa.array(found, arrow), pa.array(left, pa.binary()).cast(pa.string())], names)

    return docs.mapInArrow(run, schema)


def planted(doc_id: Column, text: Column) -> Column:
    """The text, or for ids whose crc32 ends in 0 the text whose words repeat from one word on; a null id counts as the empty text."""
    h = F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary"))
    g = F.floor(h / 10)

    def repeated(words: Column) -> Column:
        n = F.size(words)
        a = (g % n).cast("int")
        p = (1 + F.floor((n - a) / (3 + g % 8))).cast("int")
        tail = F.slice(F.flatten(F.array_repeat(F.slice(words, a + 1, p), F.ceil((n - a) / p).cast("int"))), F.lit(1), n - a)
        return F.when(n > 0, F.array_join(F.concat(F.slice(words, F.lit(1), a), tail), " ")).otherwise(text)

    words = F.regexp_extract_all(text, F.lit(r"([^\x20\x09-\x0D]+)"), F.lit(1))
    return F.when(h % 10 == 0, F.transform(F.array(words), repeated)[0]).otherwise(text)


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The number of runs of every document, its longest run, and digests of all its runs and of its collapsed text."""
    docs = table(spark, sf_dir, "documents").select("doc_id", planted(F.col("doc_id"), F.coalesce("text", F.lit(""))).alias("text"))
    found = with_runs(docs).drop("text")
    longest = F.array_min(F.transform("runs", lambda r: F.struct((-r["length"]).alias("l"), r["start"].alias("start"), r["period"].alias("period"))))
    lines = F.transform("runs", lambda r: F.concat_ws(",", r["start"].cast("string"), r["length"].cast("string"), r["period"].cast("string")))
    found = found.withColumn("best", longest)
    return found.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), F.col("best.start").alias("start"), (-F.col("best.l")).alias("length"), F.col("best.period").alias("period"),
        F.floor(-1000 * F.col("best.l") / F.col("best.period")).alias("exponent_milli"),
        F.sha2(F.concat(F.array_join(lines, "\n"), F.when(F.size("runs") > 0, "\n").otherwise("")), 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )
