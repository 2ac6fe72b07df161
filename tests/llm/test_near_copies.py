"""The near-copy stage against all pairs of five-word shingle sets."""

import itertools
import random

from test_operators import DOC, shingles

import corpus_pipeline
from basinsift.llm import simhash


def plain_kept(rows):
    sets = [shingles(t or "") for _, t in rows]
    label = list(range(len(rows)))

    def find(x):
        while label[x] != x:
            x = label[x]
        return x

    for a, b in itertools.combinations(range(len(rows)), 2):
        if sets[a] == sets[b] or len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]):
            label[max(find(a), find(b))] = min(find(a), find(b))
    return sorted({rows[find(k)][0] for k in range(len(rows))})


def edited(rng, text, n):
    words = text.split()
    for at in rng.sample(range(len(words)), n):
        words[at] = f"changed{rng.randrange(100)}"
    return " ".join(words)


def test_every_pair_of_similar_texts_is_found(spark):
    rng = random.Random(4)
    originals = [" ".join(f"w{rng.randrange(3000)}" for _ in range(rng.choice([8, 30, 60, 150, 400]))) for _ in range(60)]
    passage = " ".join(f"w{rng.randrange(3000)}" for _ in range(40))
    texts = originals + [edited(rng, rng.choice(originals), rng.choice([1, 1, 2, 3, 5])) for _ in range(240)] + [f"{passage} own{k} {k} more{k}" if k % 2 else f"{k} {k + 1} {passage}" for k in range(40)]
    texts += ["", None, "two words", "Two Words", *(f"a{k} b c d e f g h" for k in range(10))]
    rows = list(enumerate(texts))
    got = corpus_pipeline.near_duplicates(spark, spark.createDataFrame(rows, DOC).repartition(3), "").collect()
    assert sorted(r["doc_id"] for r in got) == plain_kept(rows)


def test_no_edited_copy_stays(spark):
    rng = random.Random(1)
    texts = [" ".join(f"w{rng.randrange(4000)}" for _ in range(rng.randint(210, 460))) for _ in range(40)]
    rows = [*enumerate(texts), *((1000 + k, edited(rng, t, n)) for n in (1, 2, 4) for k, t in enumerate(texts))]
    got = corpus_pipeline.near_duplicates(spark, spark.createDataFrame(rows, DOC), "").collect()
    assert sorted(r["doc_id"] for r in got) == list(range(40))


def test_short_texts_are_no_copies_of_blank_ones(spark):
    sparse = next(t for k in range(100_000) if simhash.fingerprint(t := f"one two three four{k}").bit_count() <= simhash.NEAR_COPY_THRESHOLD)
    rows = [(1, ""), (2, sparse)]
    got = corpus_pipeline.near_duplicates(spark, spark.createDataFrame(rows, DOC), "").collect()
    assert sorted(r["doc_id"] for r in got) == [1, 2]


def test_unlike_texts_that_share_an_id_stay(spark):
    rows = [(1, "one two three four five six"), (1, "seven eight nine ten eleven twelve"), (1, "one two three four five six"), (2, "Seven eight nine ten eleven twelve"), (3, "x y z")]
    got = corpus_pipeline.near_duplicates(spark, spark.createDataFrame(rows, DOC), "").collect()
    assert sorted((r["doc_id"], r["text"]) for r in got) == [(1, rows[0][1]), (1, rows[1][1]), (3, "x y z")]
