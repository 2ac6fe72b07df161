"""Labelled training rows: which may be learnt from, and a bounded sample of them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from basinsift.llm.common import least_within, materialize, remainder

#: Rows whose crc32 of the id has remainder 0 for this modulus are held out.
HELD_OUT_MODULUS = 5


#: Bytes of texts of a sample, and of one of its texts.
SAMPLE_BYTES, SAMPLE_TEXT = 64 << 20, 1 << 20


def training_ids(labels: DataFrame, label: str, rows: int, modulus: int = HELD_OUT_MODULUS) -> DataFrame:
    """``doc_id, label`` of at most ``rows`` labelled documents that are not held out: those with the least hash of the id.

    A document with several labels has the largest; null labels don't count.
    """
    known = labels.filter(F.col(label).isNotNull() & F.col("doc_id").isNotNull() & (remainder(F.col("doc_id"), modulus) != 0))
    known = known.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max(label).cast("int").alias("label"))
    return least_within(known, F.xxhash64("doc_id"), (F.lit(1), rows))


def training_texts(docs: DataFrame, labels: DataFrame, label: str, rows: int, modulus: int = HELD_OUT_MODULUS) -> DataFrame:
    """``doc_id, text, label`` of the sample, one row for each id: its least text.

    The ids (bounded by ``rows``) are broadcast to the documents.  Texts above ``SAMPLE_TEXT`` bytes are not
    learnt from, and all together stay within ``SAMPLE_BYTES``.
    """
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    met = texts.filter(F.octet_length("text") <= SAMPLE_TEXT).join(F.broadcast(training_ids(labels, label, rows, modulus)), "doc_id")
    sample = materialize(met.groupBy("doc_id", "label").agg(F.min("text").alias("text")), "sample")
    return least_within(sample, F.xxhash64("doc_id"), (F.octet_length("text"), SAMPLE_BYTES)).select("doc_id", "text", "label")
