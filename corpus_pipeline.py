"""Corpus preparation: four stages in order, each over all rows that its predecessor kept.

Rejected documents go, one document of each group of near copies stays, and the rest is packed into
sequences.  Every stage is judged on its own input: the models are fitted on the labelled rows among the
documents that the stage receives.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from basinsift.llm import near_copies, packing, quality, toxicity
from basinsift.llm.common import fresh, materialize, table

#: None: no stage can be expressed in SQL; the tests hold each against a plain version.
ORACLE_SQL = None


def toxic_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose restored text scores as toxic go."""
    name = fresh(docs.columns, "score")
    scored = toxicity.toxicity(docs, table(spark, sf_dir, "labels"), name)
    return scored.filter(F.col(name) < toxicity.THRESHOLD).select(docs.columns)


def low_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier rejects go."""
    name = fresh(docs.columns, "score")
    scored = quality.score(docs, quality.train(docs, table(spark, sf_dir, "labels")), name)
    return scored.filter(F.col(name) >= quality.THRESHOLD).select(docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays, the one with the smallest id."""
    return near_copies.deduplicate(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of what is left, each with its sequence and offset."""
    return packing.pack(docs, packing.vocabulary("byte_bpe_50k.json"), packing.vocabulary("byte_bpe_50k.tiktoken"))


STAGES = [("toxicity", toxic_documents), ("quality", low_quality), ("near_duplicates", near_duplicates), ("packing", packed)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
