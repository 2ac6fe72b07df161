"""Each stage of the corpus pipeline against a plain version of what it should keep."""

import collections
import random

from pyspark.sql import functions as F
from test_operators import CLASH, labelled, odd, plain_components, plain_simhash, write

import corpus_pipeline
from basinsift.llm import packing, quality, simhash, toxicity


def test_stages_in_order():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "quality", "near_duplicates", "packing"]


def test_whole_run(spark, tmp_path):
    labelled(spark, tmp_path, "nincompoop")
    folder = str(tmp_path)
    docs = spark.read.parquet(f"{folder}/documents.parquet").withColumn("score", F.lit("kept"))
    write(docs.checkpoint(), tmp_path, "documents")
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    labels = spark.read.parquet(f"{folder}/labels.parquet")
    rows = {r["doc_id"]: r["text"] for r in docs.collect()}

    clean = corpus_pipeline.STAGES[0][1](spark, docs, folder)
    assert clean.columns == docs.columns
    scores = {r["doc_id"]: r["s"] for r in toxicity.toxicity(docs, labels, "s").collect()}
    kept = {r["doc_id"] for r in clean.collect()}
    assert kept == {d for d, s in scores.items() if s < toxicity.THRESHOLD} and all("nincompoop" not in rows[d] for d in kept)

    good = corpus_pipeline.STAGES[1][1](spark, clean, folder)
    scores = {r["doc_id"]: r["s"] for r in quality.score(clean, quality.train(clean, labels), "s").collect()}
    kept = {r["doc_id"] for r in good.collect()}
    assert kept == {d for d, s in scores.items() if s >= quality.THRESHOLD}

    single = corpus_pipeline.STAGES[2][1](spark, good, folder)
    ids = sorted(kept)
    least = plain_components([plain_simhash(rows[d]) for d in ids], simhash.NEAR_COPY_THRESHOLD)
    left = {ids[k] for k in least}
    assert {r["doc_id"] for r in single.collect()} == left

    placed = corpus_pipeline.run(spark, folder).toPandas()
    assert set(placed.doc_id) == left and (placed.groupby("sequence_id").length.sum() <= packing.CAPACITY).all()


def test_copies_and_near_copies_go_and_others_stay(spark, tmp_path):
    rng = random.Random(1)
    words = lambda n: [f"w{rng.randrange(4000)}" for _ in range(n)]
    originals = [words(rng.randint(150, 400)) for _ in range(40)]
    shared = words(60)  # a passage that many documents hold
    rows = [(k, " ".join(t[:100] + shared + t[100:])) for k, t in enumerate(originals)]
    for k, t in enumerate(originals[:20]):
        near = list(t)
        near[rng.randrange(len(near))] = "other"
        rows += [(1000 + k, " ".join(t[:100] + shared + t[100:])), (2000 + k, " ".join(near[:100] + shared + near[100:]))]
    kept = collections.Counter(r["doc_id"] for r in corpus_pipeline.near_duplicates(spark, spark.createDataFrame(rows, "doc_id long, text string"), "").collect())
    assert set(range(40)) <= set(kept) and max(kept.values()) == 1
    assert not any(d in kept for d in (*range(1000, 1020), *range(2000, 2020)))


def test_odd_and_empty_input(spark, tmp_path):
    write(spark.createDataFrame([], "doc_id long, quality int, toxic int"), tmp_path, "labels")
    docs = odd(spark)
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, str(tmp_path))
        assert docs.columns == odd(spark).columns and docs.count() > 0
    write(spark.createDataFrame([], CLASH), tmp_path, "documents")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
