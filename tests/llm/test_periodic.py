"""Periodic runs against a plain search over all periods, and odd rows."""

import hashlib
import random
import zlib

import pytest

from basinsift.llm import periodic


def plain(words, least=6, exponent=4):
    """All maximal stretches by trying every period; the smallest period of each stretch counts."""
    n, found = len(words), []
    for q in range(1, n // exponent + 1):
        i = 0
        while i + q < n:
            if words[i] != words[i + q]:
                i += 1
                continue
            start = i
            while i + q < n and words[i] == words[i + q]:
                i += 1
            length = i + q - start
            stretch = words[start : start + length]
            if length >= max(least, exponent * q) and not any(stretch[:-p] == stretch[p:] for p in range(1, q)):
                found.append((start, length, q))
    return sorted(found, key=lambda r: (r[0], r[2]))


def sequences(seed):
    rng = random.Random(seed)
    for _ in range(150):
        alphabet = [b"w%d" % k for k in range(rng.choice([1, 2, 2, 3, 4, 40]))]
        words = []
        for _ in range(rng.randint(0, 6)):
            block = [rng.choice(alphabet) for _ in range(rng.randint(1, 6))]
            words += block * rng.randint(1, 7) + block[: rng.randint(0, len(block))]
        yield words


@pytest.mark.parametrize("seed", range(6))
def test_runs(seed):
    for words in sequences(seed):
        assert periodic.find_runs(words) == plain(words)
        assert periodic.find_runs(words, 2, 2) == plain(words, 2, 2)
        assert periodic.find_runs(words, 5, 3) == plain(words, 5, 3)


@pytest.mark.parametrize("seed", range(4))
def test_squares_of_whole_sequences(seed):
    """The automaton alone, without setting stretches aside."""
    for words in sequences(100 + seed):
        assert sorted((s, e - s + 1, q) for (s, q), e in periodic.squares(words).items()) == sorted(plain(words, 2, 2))


def test_words_of_fibonacci_and_of_one_letter():
    a, b = [b"a"], [b"a", b"b"]
    for _ in range(10):
        a, b = b, b + a
    assert periodic.find_runs(b, 2, 2) == plain(b, 2, 2)
    assert periodic.find_runs([b"x"] * 5000) == [(0, 5000, 1)]


def test_gram_words():
    assert periodic.gram_words(6, 4) == 5 and periodic.gram_words(2, 2) == 1


def test_long_text_and_its_stretches():
    rng = random.Random(5)
    words = [b"%d" % rng.randint(0, 3000) for _ in range(60000)]
    block = words[100:400]
    words[20000:20000] = block * 5
    runs = periodic.find_runs(words)
    assert (20000, 1500, 300) in [(s, length - length % 300, q) for s, length, q in runs] or any(s <= 20000 and s + length >= 21500 and q == 300 for s, length, q in runs)
    assert sum(b - a for a, b in periodic.stretches(words, 5)) < 3000


def change(doc_id, text):
    h, words = zlib.crc32(b"" if doc_id is None else str(doc_id).encode()), (text or "").encode().split()
    n, g = len(words), h // 10
    if h % 10 == 0 and n:
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [words[a + (i - a) % p] if i >= a else w for i, w in enumerate(words)]
    return words


def test_query(spark, tmp_path):
    rng = random.Random(3)
    vocabulary = ["a", "é", "The", "of", "b c", "x y"]
    rows = [(d, "".join(rng.choice(vocabulary[: rng.choice([2, 6])]) + rng.choice([" ", "\n", "\t\x0b", "  "]) for _ in range(rng.randint(0, 90)))) for d in range(160)]
    rows += [(1000, None), (1001, ""), (1002, " \n "), (None, "of the of the of the of the of the"), (1003, "go " * 40000), (5, rows[5][1])]
    spark.createDataFrame([(d, t, "r", 1) for d, t in rows], "doc_id long, text string, runs string, collapsed int").repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    out = periodic.op12_periodic_runs(spark, str(tmp_path))
    want = []
    for d, t in rows:
        words = change(d, t)
        runs = periodic.find_runs(words) if len(words) > 1000 else plain(words)
        gone = {k for s, length, q in runs for k in range(s + q, s + length)}
        best = min(((-length, s, q) for s, length, q in runs), default=None)
        figures = (best[1], -best[0], best[2], 1000 * -best[0] // best[2]) if best else (None,) * 4
        listed = "".join(f"{s},{length},{q}\n" for s, length, q in runs)
        want.append((d, len(runs), *figures, hashlib.sha256(listed.encode()).hexdigest(), hashlib.sha256(b" ".join(w for k, w in enumerate(words) if k not in gone)).hexdigest()))
    assert sorted(map(str, want)) == sorted(str(tuple(r)) for r in out.collect())
    assert [f.dataType.simpleString() for f in out.schema][1:6] == ["bigint"] * 5


def test_other_columns_stay(spark):
    df = spark.createDataFrame([(1, "a b a b a b a b c", "old", 2)], "id long, text string, runs string, collapsed int")
    row = periodic.with_runs(df).first()
    assert row.asDict(True) == {"id": 1, "text": "a b a b a b a b c", "runs": [{"start": 0, "length": 8, "period": 2}], "collapsed": "a b c"}
    assert periodic.with_runs(df.limit(0)).count() == 0
