"""Line deduplication: range-partitioned hashes of lines, streamed in order, give a compressed keep bitmap for each document.

A line's key is the line stripped of ASCII white space with A-Z lower-cased.  Keys of at least ``MIN_CHARS``
code points that ``MIN_DOCS`` documents hold lose all their lines but those of the document with the largest id.
Only 128-bit hashes of keys are shuffled, never lines: rows (hash, document, position) are partitioned by range of
*all* their columns and sorted, documents by falling id, so the first document of a hash is the one that keeps its
lines, and a very common line is spread over as many partitions as its rows need.  Each task streams its rows with a
state of one group.  A group that lies in one partition is decided there; of those cut by a border (the first
and the last of a partition) the task passes on a summary of at most three ids, so the table of summaries has two
rows for each partition and is broadcast to the undecided lines.

``keep_bitmaps`` returns no text: for each document a zlib-compressed bitmap, one bit a line, that ``apply`` joins
with the texts.

Defined results: null and empty texts are one empty line; rows with equal id are one document, and repeated rows get
the same bitmap; rows with a null id are one document with the least possible id; extra columns are ignored by
``keep_bitmaps`` and kept by ``apply``; an empty table gives an empty result.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from basinsift.llm.common import fresh, materialize, partitions, portions, release, small_batches, table

MIN_CHARS, MIN_DOCS = 20, 3
_SPACE = " \t\n\x0b\x0c\r"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Kinds of rows that a task passes on: a line that goes, a line of a group that a border cuts, the summary of such a group.
_DROPPED, _CUT, _SUMMARY = 0, 1, 2
_KEY = ["h1", "h2", "doc", "version", "pos"]


def _document(id_col: str) -> Column:
    return F.coalesce(F.col(id_col).cast("long"), F.lit(-(2**63)))


def _text(text_col: str) -> Column:
    return F.coalesce(F.col(text_col).cast("string"), F.lit(""))


def hashed_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = MIN_CHARS) -> DataFrame:
    """``h1, h2, doc, version, pos`` of each line whose key has ``min_chars`` code points; ``version`` is the text's hash."""
    keys = F.transform(F.split("text", "\n", -1), lambda line: F.translate(F.btrim(line, F.lit(_SPACE)), _UPPER, _LOWER))
    rows = docs.select(_document(id_col).alias("doc"), _text(text_col).alias("text")).withColumn("version", F.xxhash64("text"))
    rows = rows.select("doc", "version", F.posexplode(keys).alias("pos", "key")).filter(F.char_length("key") >= min_chars)
    return rows.select(F.xxhash64("key").alias("h1"), F.xxhash64(F.lit("second"), "key").alias("h2"), "doc", "version", "pos")


class _Stream:
    """The rows of one partition in order; holds the rows of one group until three documents (``least``) are seen."""

    def __init__(self, least: int):
        self.least = least
        self.held: list[np.ndarray] | None = None  # rows of the last group, or its last row alone once it is decided
        self.passed, self.base, self.docs, self.first = 0, 0, [], True

    def take(self, rows: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        if self.held is not None:
            rows = [np.concatenate(pair) for pair in zip(self.held, rows, strict=True)]
        h1, h2, doc, version, pos = rows
        n = len(h1)
        key = np.r_[True, (h1[1:] != h1[:-1]) | (h2[1:] != h2[:-1])]
        other = key | np.r_[True, doc[1:] != doc[:-1]]
        repeat = ~other & np.r_[False, (version[1:] == version[:-1]) & (pos[1:] == pos[:-1])]
        start = np.nonzero(key)[0]
        group = np.cumsum(key) - 1
        nth = np.cumsum(other) - 1  # number of the document within its group
        nth = nth - nth[start][group]
        nth[: start[1] if len(start) > 1 else n] += self.base
        documents = np.maximum.reduceat(nth, start) + 1
        fresh_rows = ~repeat & (np.arange(n) >= self.passed)
        cut = group == 0 if self.first else np.zeros(n, bool)  # the first group may have begun in the partition before
        last = group == len(start) - 1
        settled = ~last | (documents[-1] >= self.least)
        gone = fresh_rows & ~cut & settled & (documents >= self.least)[group] & (nth > 0)
        yield self.batch(_DROPPED, [c[gone] for c in rows])
        yield self.batch(_CUT, [c[fresh_rows & cut] for c in rows])
        heads = [doc[(group == g) & other].tolist() for g in {0, len(start) - 1}]
        if len(start) > 1:
            if self.first:
                yield self.summary(h1[0], h2[0], self.merged(heads[0]))
            self.docs, self.first = [], False
        self.docs = self.merged(heads[-1])
        if self.first or documents[-1] >= self.least:
            self.held, self.passed, self.base = [c[-1:].copy() for c in rows], 1, int(nth[-1])
        else:
            self.held, self.passed, self.base = [c[last].copy() for c in rows], 0, 0

    def merged(self, docs: list[int]) -> list[int]:
        return list(dict.fromkeys([*self.docs, *docs]))[: self.least]

    def end(self) -> Iterator[pa.RecordBatch]:
        if self.held is None:
            return
        if not self.passed:
            yield self.batch(_CUT, self.held)
        yield self.summary(self.held[0][-1], self.held[1][-1], self.docs)

    @staticmethod
    def batch(kind: int, rows: list[np.ndarray]) -> pa.RecordBatch:
        n = len(rows[0])
        return pa.record_batch([pa.array(np.full(n, kind, np.int32)), *(pa.array(c) for c in rows), pa.nulls(n, pa.list_(pa.int64()))], ["kind", *_KEY, "docs"])

    @staticmethod
    def summary(h1: int, h2: int, docs: list[int]) -> pa.RecordBatch:
        blank = [pa.nulls(1, pa.int64()), pa.nulls(1, pa.int64()), pa.nulls(1, pa.int32())]
        return pa.record_batch([pa.array([_SUMMARY], pa.int32()), pa.array([int(h1)]), pa.array([int(h2)]), *blank, pa.array([docs], pa.list_(pa.int64()))], ["kind", *_KEY, "docs"])


def dropped_lines(lines: DataFrame, min_docs: int = MIN_DOCS) -> DataFrame:
    """``doc, version, pos`` of the lines that go, each once."""
    order = [F.col("h1"), F.col("h2"), F.col("doc").desc(), F.col("version"), F.col("pos")]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        stream = _Stream(min_docs)
        for batch in batches:
            if batch.num_rows:
                yield from stream.take([c.to_numpy(zero_copy_only=False) for c in batch.columns])
        yield from stream.end()

    ordered = lines.select(_KEY).repartitionByRange(partitions(lines.sparkSession), *order).sortWithinPartitions(*order)
    found = materialize(ordered.mapInArrow(run, "kind int, h1 long, h2 long, doc long, version long, pos int, docs array<long>"), "lines-seen")
    cut = found.filter(F.col("kind") == _SUMMARY).groupBy("h1", "h2").agg(F.max(F.array_max("docs")).alias("top"), F.array_distinct(F.flatten(F.collect_list("docs"))).alias("all"))
    cut = cut.filter(F.size("all") >= min_docs).select("h1", "h2", "top")  # two rows for each partition at most
    at_borders = found.filter(F.col("kind") == _CUT).join(F.broadcast(cut), ["h1", "h2"]).filter("doc <> top")
    return found.filter(F.col("kind") == _DROPPED).select("doc", "version", "pos").unionByName(at_borders.select("doc", "version", "pos"))


def keep_bitmaps(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS) -> DataFrame:
    """``doc, version, n_lines, n_dropped, keep``: one row for each id and text; bit k (from the highest of a byte) of the unpacked ``keep`` is line k."""
    small_batches(docs.sparkSession)
    lines = materialize(hashed_lines(docs, id_col, text_col, min_chars), "lines")
    gone = dropped_lines(lines, min_docs).groupBy("doc", "version").agg(F.collect_list("pos").alias("gone"))  # no more than a document's lines
    texts = docs.select(_document(id_col).alias("doc"), _text(text_col).alias("text"))
    every = texts.select("doc", F.xxhash64("text").alias("version"), (F.char_length("text") - F.char_length(F.replace("text", F.lit("\n"), F.lit(""))) + 1).alias("n_lines")).distinct()

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n_lines, lost, keep = batch.column(2).to_pylist(), [], []
            for n, places in zip(n_lines, batch.column(3), strict=True):
                bits = np.ones(n, bool)
                if places.is_valid:
                    bits[places.values.to_numpy()] = False
                lost.append(n - int(bits.sum()))
                keep.append(zlib.compress(np.packbits(bits).tobytes()))
            yield pa.record_batch([batch.column(0), batch.column(1), pa.array(n_lines, pa.int64()), pa.array(lost, pa.int64()), pa.array(keep, pa.binary())], ["doc", "version", "n_lines", "n_dropped", "keep"])

    kept = materialize(every.join(gone, ["doc", "version"], "left").mapInArrow(run, "doc long, version long, n_lines long, n_dropped long, keep binary"), "bitmaps")
    release(lines, collect=False)
    return kept


def kept_lines(text: str, keep: bytes) -> str:
    """The lines of ``text`` whose bit is set."""
    lines = text.split("\n")
    bits = np.unpackbits(np.frombuffer(zlib.decompress(keep), np.uint8), count=len(lines))
    return "\n".join([lines[k] for k in np.nonzero(bits)[0].tolist()])


def apply(docs: DataFrame, bitmaps: DataFrame, id_col: str = "doc_id", text_col: str = "text", lines: str = "n_lines", dropped: str = "n_dropped") -> DataFrame:
    """The rows of ``docs`` with the kept lines as text, and the numbers of lines before and of dropped lines (in place of columns of those names)."""
    small_batches(docs.sparkSession)
    docs = docs.drop(lines, dropped)
    doc, version = fresh(docs.columns, "doc"), fresh(docs.columns, "version")
    keep = fresh([*docs.columns, lines, dropped], "keep")
    keyed = docs.withColumn(text_col, _text(text_col)).withColumn(doc, _document(id_col)).withColumn(version, F.xxhash64(text_col))
    met = keyed.join(bitmaps.select(F.col("doc").alias(doc), F.col("version").alias(version), F.col("n_lines").alias(lines), F.col("n_dropped").alias(dropped), F.col("keep").alias(keep)), [doc, version])
    met = met.select(*docs.columns, lines, dropped, keep)
    at, names = docs.columns.index(text_col), [*docs.columns, lines, dropped]
    schema = met.drop(keep).schema

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (p for b in batches for p in portions(b, at)):
            texts, lost, bits = batch.column(at).to_pylist(), batch.column(len(names) - 1).to_pylist(), batch.column(len(names)).to_pylist()
            kept = pa.array([kept_lines(t, k) if n else t for t, n, k in zip(texts, lost, bits, strict=True)], batch.column(at).type)
            yield pa.record_batch([kept if k == at else c for k, c in enumerate(batch.columns[:-1])], names)

    return met.mapInArrow(run, schema)


def op13_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines before and dropped, and the SHA-256 of what stays, of every document."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    kept = apply(docs, keep_bitmaps(docs))
    return kept.select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


OP13_SQL = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents),
l AS (SELECT r, doc_id, unnest(lines) AS line, unnest(range(len(lines))) AS pos FROM d),
k AS (SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), '{_UPPER}', '{_LOWER}') AS key FROM l),
c AS (SELECT key, max(doc_id) AS top FROM k WHERE length(key) >= {MIN_CHARS} GROUP BY key HAVING count(DISTINCT doc_id) >= {MIN_DOCS}),
m AS (SELECT k.*, c.key IS NOT NULL AND doc_id <> top AS gone FROM k LEFT JOIN c ON k.key = c.key)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM m GROUP BY r, doc_id
"""
