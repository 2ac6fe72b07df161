"""Hot groups, very long inputs, bounded samples and foreign data, each against a plain version."""

import base64
import collections
import gzip
import hashlib
import itertools
import math
import random

import duckdb
import numpy as np
import pytest
import sentencepiece
from pyspark.sql import functions as F
from test_operators import DOC, empty, odd, plain_components, plain_verdict, shingles, texts, write

from basinsift.llm import ann, common, labelled, lattice_lm, near_copies, packing, pieces, quality, simhash, sketch, toxicity, url_filter, warc


def model_path():
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


# -- shared bounds ---------------------------------------------------------------------------------------------------------------------


def test_least_and_greatest_stay_within_their_bounds(spark):
    df = spark.range(0, 5000, 1, 6).select("id", (F.col("id") % 50 + 1).alias("n"))
    for rows in (0, 1, 100, 4999, 5000, 9000):
        kept = common.least_within(df, F.xxhash64("id"), (F.lit(1), rows)).count()
        assert kept <= rows and kept >= min(5000, 0.5 * rows)
        top = [r["n"] for r in common.greatest_within(df, "n", rows).collect()]
        assert len(top) <= rows and (not top or min(top) >= 51 - rows / 100)
    both = common.least_within(df, F.xxhash64("id"), (F.lit(1), 4000), (F.col("n"), 2000)).agg(F.sum("n")).first()[0]
    assert 1000 < both <= 2000
    assert common.least_within(df.limit(0), F.xxhash64("id"), (F.lit(1), 5)).count() == 0


def test_portions_keep_every_row():
    import pyarrow as pa

    data = [None, "", "x" * (common.PORTION_BYTES + 5), "y", None, "z" * (common.PORTION_BYTES // 2), "w" * (common.PORTION_BYTES // 2 + 1), "é"]
    batch = pa.record_batch([pa.array(range(len(data))), pa.array(data)], ["doc_id", "text"])
    parts = list(common.portions(batch))
    assert [t for p in parts for t in p.column(1).to_pylist()] == data and len(parts) > 2
    assert list(common.portions(batch.slice(3, 0))) == [] and [p.num_rows for p in common.portions(batch.slice(3, 2))] == [2]


def test_a_session_setting_is_only_lowered(spark):
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    spark.conf.set(key, "1000")
    common.small_batches(spark)
    assert spark.conf.get(key) == "1000"
    spark.conf.unset(key)
    common.small_batches(spark)
    assert spark.conf.get(key) == str(common.BATCH_BYTES) and spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch", None) in (None, "10000")


def test_an_id_that_repeats_is_one_sample_row(spark):
    rows = [(7, f"text {k}") for k in range(10_000)] + [(k, "other") for k in range(20, 60)] + [(70, "long " * 300_000)]
    labels = spark.createDataFrame([(7, 1), (7, 0), *((k, 0) for k in range(20, 60)), (70, 1), (None, 1), (8, None)], "doc_id long, toxic int")
    got = {r["doc_id"]: (r["text"], r["label"]) for r in labelled.training_texts(spark.createDataFrame(rows, DOC), labels, "toxic", 1000).collect()}
    allowed = {k for k in [7, *range(20, 60)] if common.remainder_py(k, 5)}
    assert set(got) == allowed and (7 not in allowed or got[7] == ("text 0", 1))
    assert labelled.training_ids(labels, "toxic", 10).count() <= 10


# -- 1, 2, 3 ---------------------------------------------------------------------------------------------------------------------------


def test_one_id_for_all_rows(spark, tmp_path):
    rows = [(5, t) for t in texts(300, 9, 40)] + [(4, "first of all"), (6, "last of all")]
    write(spark.createDataFrame(rows, DOC).repartition(5), tmp_path, "documents")
    got = sketch.op1_fingerprints(spark, str(tmp_path)).collect()
    tie = {r["text"]: r["t"] for r in spark.createDataFrame(rows, DOC).select("text", F.xxhash64("text").alias("t")).collect()}
    order = sorted(rows, key=lambda r: (r[0], tie[r[1]]))
    expected = collections.Counter()
    for (doc, text), (_, following) in zip(order, order[1:] + order[:1], strict=True):
        cut = len(text) // 4
        expected[doc, hashlib.sha256((text[: len(text) - cut] + following[:cut]).encode()).hexdigest()] += 1
    assert collections.Counter((r["doc_id"], r["edited_sha256"]) for r in got) == expected


def test_conflicting_entries_and_long_urls(spark):
    listed = spark.createDataFrame([("com/", "block"), ("com/", "allow"), ("b.org/", "allow"), ("b.org/x/", "block"), (None, "block")], "key string, action string")
    urls = ["http://a.com/", "http://b.org/" + "x/" * 20_000, "http://" + "a." * 300 + "com/?" + "q" * 50_000, "http://b.org/xy", None]
    got = {r["page_id"]: (r["rule"], r["verdict"]) for r in url_filter.judge(spark.createDataFrame(list(enumerate(urls)), "page_id long, url string"), listed).collect()}
    rules = [("com/", "block"), ("b.org/", "allow"), ("b.org/x/", "block")]
    assert got == {k: plain_verdict(u, rules)[2:] for k, u in enumerate(urls)}
    assert url_filter.judge(spark.createDataFrame([], "page_id long, url string"), listed).count() == 0


def test_search_tells_how_it_ended():
    rng = random.Random(2)
    histogram = collections.Counter(rng.randint(500, 1100) for _ in range(400))
    before, report = packing.best_fit(histogram), {}
    after = packing.local_search(before, report=report)
    assert report["bins"] == sum(after.values()) <= report["best_fit"] == sum(before.values()) and report["least"] <= report["bins"]
    assert report["ended"] in ("least reached", "no step helps", "effort")
    pieces_of = lambda bins: sum((collections.Counter({x: n * m for x, n in p}) for p, m in bins.items()), collections.Counter())
    assert pieces_of(after) == histogram and all(sum(x * n for x, n in p) <= packing.CAPACITY for p in after)
    packing.local_search(packing.best_fit({2048: 5}), report=report)
    assert report["ended"] == "least reached" and report["looks"] == 0


# -- 5 ---------------------------------------------------------------------------------------------------------------------------------


def foreign(headers, block, ending=b"\r\n\r\n"):
    return b"WARC/1.0\r\n" + headers + b"Content-Length: %d\r\n\r\n" % len(block) + block + ending


@pytest.mark.parametrize("packed", [False, True])
def test_foreign_records(spark, tmp_path, packed):
    records = [
        foreign(b"WARC-Type: response\r\nWARC-Target-URI: http://caf\xe9/\r\nContent-Type: application/http\r\n", b"HTTP/1.1 200 OK\r\nX: y\r\n\r\nbody"),
        foreign(b"WARC-Type: response\r\nContent-Type: application/http\r\n", b"HTTP/1.1 204 No Content\r\nServer: x"),
        foreign(b"WARC-Type: metadata\r\nWARC-Target-URI: http://a/\r\n b\r\n\tc\r\n", b"free text\r\n\r\nwith a blank line"),
        foreign(b"WARC-Type: warcinfo\r\n", b""),
    ]
    data = b"".join(map(gzip.compress, records)) if packed else b"".join(records)
    (tmp_path / ("a.warc.gz" if packed else "a.warc")).write_bytes(data)
    got = [(r["record_type"], r["target_uri"], r["payload_bytes"], bytes(r["payload"])) for r in warc.read(spark, str(tmp_path)).collect()]
    assert got == [("response", "http://café/", 4, b"body"), ("response", None, 0, b""), ("metadata", "http://a/ b c", 30, b"free text\r\n\r\nwith a blank line"), ("warcinfo", None, 0, b"")]


def test_a_corrupt_payload_shows(spark, tmp_path):
    data = "the payload " * 50
    digest = base64.b32encode(hashlib.sha1(data.encode()).digest()).decode()
    good, bad = (warc.record(k, "u", t.encode(), digest, None, "d") for k, t in ((1, data), (2, data.replace("load", "lOad", 1))))
    (tmp_path / "a.warc").write_bytes(good + bad)
    read = warc.read(spark, str(tmp_path)).select("page_id", (F.col("payload_digest") == warc.base32_of(F.col("payload"))).alias("fine"))
    assert {r["page_id"]: r["fine"] for r in read.collect()} == {1: True, 2: False}


def test_unfinished_files_go_at_commit(spark, tmp_path):
    writer = warc.WarcWriter({"path": str(tmp_path)})
    own, other = tmp_path / f"part-{writer.job}-lost.warc.gz.writing", tmp_path / "part-else-x.warc.gz.writing"
    kept = tmp_path / f"part-{writer.job}-kept.warc.gz.writing"
    for path in (own, other, kept):
        path.write_bytes(b"x")
    writer.commit([warc.Written([str(kept)]), None])
    assert not own.exists() and other.exists() and (tmp_path / f"part-{writer.job}-kept.warc.gz").exists()


def test_pages_equal_their_sql(spark, tmp_path):
    rows = [(1, "u", "same"), (2, "u", "same"), (3, "u", None), (4, "u", ""), (5, "u", "é" * 3000), (9, None, "same")]
    write(spark.createDataFrame(rows, "page_id long, url string, html string"), tmp_path, "pages")
    con = duckdb.connect()
    con.sql(f"CREATE VIEW pages AS SELECT * FROM '{tmp_path}/pages.parquet/*.parquet'")
    columns = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]
    expected = sorted(con.sql(f"SELECT {', '.join(columns)} FROM ({warc.OP5_SQL})").fetchall())
    assert sorted(tuple(r[c] for c in columns) for r in warc.op5_warc(spark, str(tmp_path)).collect()) == expected


# -- 6, 9 ------------------------------------------------------------------------------------------------------------------------------


def plain_features(text):
    """Buckets of a text's features one at a time: n-grams without an inner gap, words, and whether a word repeats the one before."""
    mask = (1 << 64) - 1
    data = b"  " + text.encode().translate(quality._SPACES) + b" "
    bucket = lambda h: ((h ^ (h >> 29)) * 0xBF58476D1CE4E5B9 & mask) >> 40 & (quality.BUCKETS - 1)
    mixed, powers, out = [int(quality._MIX[c]) for c in data], [int(p) for p in quality._POWERS], []
    for n in quality.NGRAMS:
        for at in range(len(data) - n + 1):
            if 32 not in data[at + 1 : at + n - 1]:
                h = 0
                for m in mixed[at : at + n]:
                    h = (h * 0x100000001B3 + m) & mask
                out.append(bucket((h + n) & mask))
    previous = None
    for word in data.split(b" "):
        if word:
            h = sum(int(quality._MIX[c]) * powers[k & 255] for k, c in enumerate(word)) & mask
            out += [bucket(h), quality.BUCKETS if h == previous else quality.BUCKETS + 1]
            previous = h
    return out


def test_quality_features_are_those_of_a_plain_loop():
    for text in ["the cat the cat sat", "a", "é ß  x\tx", "word " * 30, "long" * 100]:
        found, share = quality.bag(text)
        expected = collections.Counter(plain_features(text))
        total = sum(expected.values())
        assert {int(b): s for b, s in zip(found, share, strict=True)} == pytest.approx({b: n / total for b, n in expected.items()}, rel=1e-5)


def test_quality_training_is_the_plain_gradient_descent():
    documents, labels = texts(12, 3, 6), [k % 2 for k in range(12)]
    fitted = quality.SubwordClassifier().fit(documents, labels, steps=40)
    plain = quality.SubwordClassifier()
    bags, rng = [quality.bag(t) for t in documents], np.random.default_rng(quality.SEED)
    epochs, done = 4, 0
    for _ in range(epochs):
        for k in rng.permutation(12):
            rate = quality.RATE * (1 - done / (epochs * 12))
            done += 1
            bucket, share = bags[k]
            hidden = [sum(float(s) * float(plain.vectors[b, d]) for b, s in zip(bucket, share, strict=True)) for d in range(quality.DIM)]
            z = [sum(float(plain.output[c, d]) * hidden[d] for d in range(quality.DIM)) + float(plain.bias[c]) for c in (0, 1)]
            p = [math.exp(v) / sum(map(math.exp, z)) for v in z]
            error = [p[c] - (c == labels[k]) for c in (0, 1)]
            back = [sum(error[c] * float(plain.output[c, d]) for c in (0, 1)) for d in range(quality.DIM)]
            square = sum(float(s) ** 2 for s in share)
            for c in (0, 1):
                plain.output[c] -= np.array([rate * error[c] * h for h in hidden], np.float32)
                plain.bias[c] -= rate * 0.1 * error[c]
            for b, s in zip(bucket, share, strict=True):
                plain.vectors[b] -= np.array([rate / square * 0.5 * float(s) * g for g in back], np.float32)
    assert np.allclose(fitted.output, plain.output, atol=1e-4) and np.allclose(fitted.bias, plain.bias, atol=1e-4)
    weight, intercept = fitted.bucket_weights()
    scores = quality.score_texts(documents, weight, intercept, None)
    for text, score in zip(documents, scores, strict=True):
        found = plain_features(text)
        z = sum(float(weight[b]) for b in found) / len(found) + intercept
        assert math.isclose(score, 1 / (1 + math.exp(-z)), rel_tol=1e-9)


def test_lexicon_is_the_plain_regression():
    rng = random.Random(4)
    labels = [int(rng.random() < 0.3) for _ in range(120)]
    bags = [np.array(sorted({f for f in range(30) if rng.random() < (0.5 if t and f < 6 else 0.15)}), np.uint32) for t in labels]
    model = toxicity.Lexicon().fit(bags, labels)
    held = [set(b.tolist()) for b in bags]
    a, c = sum(labels), len(labels) - sum(labels)
    chosen = []
    for f in range(30):
        pos, neg = (sum(f in b for b, t in zip(held, labels, strict=True) if t == want) for want in (1, 0))
        part = lambda n, share: n * math.log(n / ((pos + neg) * share / len(labels))) if n else 0.0
        if pos >= 2 and pos / a > neg / c and 2 * (part(pos, a) + part(neg, c)) >= toxicity.LEAST_RATIO:
            chosen.append(f)
    w, g2, bias = dict.fromkeys(chosen, 0.0), dict.fromkeys(chosen, 1e-8), math.log(a / c)
    for _ in range(toxicity.PASSES):
        p = [1 / (1 + math.exp(-(sum(w[f] for f in b if f in w) + bias))) for b in held]
        for f in chosen:
            gradient = sum(q - t for q, t, b in zip(p, labels, held, strict=True) if f in b) + 0.02 * w[f]
            g2[f] += gradient**2
            w[f] = max(0.0, w[f] - 0.5 * gradient / math.sqrt(g2[f]))
        bias -= 0.2 * (sum(p) - a) / max(1.0, a)
    assert chosen and model.weights == pytest.approx({f: x for f, x in w.items() if x > 0}) and math.isclose(model.intercept, bias, rel_tol=1e-9)


# -- 7 and near copies -----------------------------------------------------------------------------------------------------------------


def test_gray_index_of_wide_codes_is_exact():
    rng = np.random.default_rng(8)
    codes = rng.integers(0, 1 << 63, (25, 4), dtype=np.uint64)
    near = [codes]
    for flips in (3, 20, 50):
        copy = codes.copy()
        for row in copy:
            for bit in rng.choice(256, flips, replace=False):
                row[bit // 64] ^= np.uint64(1) << np.uint64(bit % 64)
        near.append(copy)
    near = np.concatenate(near)
    for threshold in (4, 30, 56):
        label = simhash.GrayIndex(near, np.zeros(len(near), np.int64)).components(threshold)
        plain = plain_components([int.from_bytes(row.tobytes(), "little") for row in near], threshold)
        assert len({(label[k], plain[k]) for k in range(len(near))}) == len(set(label)) == len(set(plain))


def test_gray_ranks_of_wide_codes_follow_the_sequence():
    def rank(code):
        out = 0
        while code:
            out, code = out ^ code, code >> 1
        return out

    codes = np.random.default_rng(2).integers(0, 1 << 63, (50, 3), dtype=np.uint64)
    whole = [int(c[0]) << 128 | int(c[1]) << 64 | int(c[2]) for c in codes]
    got = [int(r[0]) << 128 | int(r[1]) << 64 | int(r[2]) for r in simhash.gray_rank(codes)]
    assert got == [rank(c) for c in whole]


def test_a_component_with_nearly_all_nodes(spark):
    edges = [(k, 0) for k in range(1, 3000)] + [(k, k + 1) for k in range(5000, 5050)]
    got = {r["node"]: r["root"] for r in simhash.components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {k: 0 for k in range(1, 3000)} | {k: 5000 for k in range(5001, 5051)}


def test_one_copied_text_with_few_others(spark, tmp_path):
    rows = [(k, "one two three four five six") for k in range(10, 2500)] + [(3, "other words that stand alone here"), (None, "one two three four five six")]
    write(spark.createDataFrame(rows, DOC).repartition(4), tmp_path, "documents")
    got = collections.Counter((r["component_id"]) for r in simhash.op7_simhash(spark, str(tmp_path)).collect())
    assert got == {10: 2491, 3: 1}


def near_copy_rows(rng, n, edits):
    base = [f"w{rng.randrange(3000)}" for _ in range(150)]
    rows = []
    for _ in range(n):
        words = list(base)
        for at in rng.sample(range(150), rng.choice(edits)):
            words[at] = f"x{rng.randrange(100_000)}"
        rows.append(" ".join(words))
    return rows


def plain_groups(rows):
    sets = [shingles(t) for t in rows]
    label = list(range(len(rows)))
    for a, b in itertools.combinations(range(len(rows)), 2):
        if label[a] != label[b] and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]):
            low, high = sorted((label[a], label[b]))
            label = [low if x == high else x for x in label]
    return label


@pytest.mark.parametrize(("sets", "shingles_"), [(4096, 1 << 20), (40, 1 << 20), (4096, 5000)])
def test_large_families_are_split_without_loss(spark, monkeypatch, sets, shingles_):
    monkeypatch.setattr(near_copies, "CHUNK_SETS", sets)
    monkeypatch.setattr(near_copies, "CHUNK_SHINGLES", shingles_)
    rows = near_copy_rows(random.Random(11), 180, [0, 1, 2, 3, 4, 6, 9])
    kept = near_copies.deduplicate(spark.createDataFrame(list(enumerate(rows)), DOC)).collect()
    assert sorted(r["doc_id"] for r in kept) == sorted(set(plain_groups(rows)))


def test_verified_groups_equal_all_pairs():
    rows = near_copy_rows(random.Random(5), 120, [0, 1, 3, 5, 7]) + texts(40, 12, 30)
    words = [near_copies.word_hashes(t) for t in rows]
    sets = [(near_copies.shingle_set(w) >> np.uint64(32)).astype(np.uint32).view(np.int32) for w in words]
    label = near_copies.similar_groups(np.stack([near_copies.wide_print(w) for w in words]), np.array(list(map(len, sets))), sets)
    plain = plain_groups(rows)
    assert all((label[a] == label[b]) == (plain[a] == plain[b]) for a, b in itertools.combinations(range(len(rows)), 2))


def test_near_copies_of_odd_rows(spark):
    kept = near_copies.deduplicate(odd(spark))
    assert kept.columns == odd(spark).columns and sorted(r["doc_id"] or 0 for r in kept.collect()) == [0, 1, 2, 4, 5]
    assert near_copies.deduplicate(empty(spark)).count() == 0


# -- 8 ---------------------------------------------------------------------------------------------------------------------------------


def test_words_without_end_equal_the_library(spark):
    path, rng = model_path(), random.Random(3)
    vocabulary, library = pieces.Vocabulary(path), sentencepiece.SentencePieceProcessor(model_file=path)
    rows = ["".join(rng.choice("漢字仮名交じり文の例を書く。Éa") for _ in range(330_000)), "".join(rng.choice("abcdeinst") for _ in range(60_000)), "a" * 5000, "ab" * 700 + " " + "0123456789" * 90, "x" * 48, "y" * 49, "▁" * 100]
    got = {r["doc_id"]: r for r in pieces.encode_documents(spark.createDataFrame(list(enumerate(rows)), DOC), vocabulary).collect()}
    for k, text in enumerate(rows):
        assert got[k]["ids"] == library.encode(text) and got[k]["exact"] and got[k]["word_ends"][-1] == len(got[k]["ids"])


def test_merges_from_a_heap_equal_the_lattice():
    vocabulary = pieces.Vocabulary(model_path())
    words = sorted({w for t in texts(60, 4, 30) + ["naïve 漢字 ☃☃", "don't 12,345.6"] for w in vocabulary.words_of(t)})
    ids, bounds = pieces.Coder(vocabulary).lattice.encode(words)
    assert [ids[a:b].tolist() for a, b in zip(bounds, bounds[1:], strict=False)] == vocabulary.encode_long(words)


# -- 10 --------------------------------------------------------------------------------------------------------------------------------


def test_pieces_of_any_length_are_edges():
    found, weight = lattice_lm.vocabulary(model_path())
    long = [p for p in found if len(p) > 16]
    assert len(long) > 10
    lattice = lattice_lm.Lattice(found, weight / weight.sum())
    word = max(long, key=len)
    word = word.removeprefix(b" ")
    spans = {b" " + word, word}
    matrix = np.frombuffer(b" " + word, np.uint8).reshape(1, -1)
    assert any((b" " + word)[a:b] in spans for a, b, _, _ in lattice.edges(matrix))


def test_single_words_equal_words_taken_together(monkeypatch):
    monkeypatch.setattr(lattice_lm, "BLOCK", 8)
    found, weight = lattice_lm.vocabulary(model_path())
    lattice, rng = lattice_lm.Lattice(found, weight / weight.sum() * 0.9), random.Random(1)
    for length in (1, 7, 8, 9, 40, 63):
        words = [bytes(rng.choice(b"abcdeinst\xc3\xa9") for _ in range(length)) for _ in range(5)]
        matrix = np.frombuffer(b"".join(b" " + w for w in words), np.uint8).reshape(5, -1)
        edges = lattice.edges(matrix)
        assert np.allclose(lattice.forward(edges, 5, length + 1)[-1], [lattice._one(row)[-1] for row in matrix], rtol=1e-12)
        assert np.allclose(lattice.expected(edges, 5, length + 1, np.arange(1.0, 6)), sum(lattice._one_expected(row, k + 1.0) for k, row in enumerate(matrix)), atol=1e-9)


def test_a_very_long_word_has_its_plain_likelihood():
    pieces_, probability = [b" ", b" a", b"a", b"b", b"ab", b"ba", b"aba"], np.array([0.1, 0.1, 0.2, 0.2, 0.1, 0.1, 0.2])
    lattice, rng = lattice_lm.Lattice(pieces_, probability), random.Random(6)
    word = bytes(rng.choice(b"ab") for _ in range(40_000))
    text, logs = b" " + word, [0.0]
    table = dict(zip(pieces_, np.log(probability), strict=True))
    for end in range(1, len(text) + 1):
        parts = [logs[end - n] + table[text[end - n : end]] for n in range(1, min(4, end) + 1) if text[end - n : end] in table]
        most = max(parts, default=-math.inf)
        logs.append(most + math.log(sum(math.exp(p - most) for p in parts)) if parts else -math.inf)
    assert math.isclose(lattice.log_probability([word])[0], logs[-1], rel_tol=1e-9)
    assert lattice.log_probability([b"ax"])[0] == -math.inf and lattice.expectation([b"ab" * 5000], np.ones(1)).sum() > 3000


@pytest.mark.parametrize("frequent", [3, 100_000])
def test_score_is_that_of_a_plain_recursion(spark, frequent):
    rows = [*enumerate(texts(60, 21, 25)), (100, "word" * 40), (101, None), (102, "the the the")]
    got = {r["doc_id"]: r for r in lattice_lm.score(spark.createDataFrame(rows, DOC), model_path(), frequent=frequent).collect()}
    trained = [(k, t) for k, t in rows if common.remainder_py(k, 10)]
    counts = collections.Counter(w for _, t in trained for w in lattice_lm.words_of(t))
    found, weight = lattice_lm.vocabulary(model_path())
    probability = weight / weight.sum() * 0.99

    def logs(word, table, backwards=False):
        text = b" " + word
        sums = [1.0] + [0.0] * len(text)
        if not backwards:
            for end in range(1, len(text) + 1):
                sums[end] = sum(sums[a] * table.get(text[a:end], 0.0) for a in range(end))
            return sums
        sums = [0.0] * len(text) + [1.0]
        for a in range(len(text) - 1, -1, -1):
            sums[a] = sum(table.get(text[a:end], 0.0) * sums[end] for end in range(a + 1, len(text) + 1))
        return sums

    for _ in range(lattice_lm.ROUNDS):
        table, expected = dict(zip(found, probability, strict=True)), collections.Counter()
        for word in counts:
            text, forth, back = b" " + word, logs(word, table), logs(word, table, True)
            for a in range(len(text)):
                for b in range(a + 1, len(text) + 1):
                    if text[a:b] in table:
                        expected[text[a:b]] += forth[a] * table[text[a:b]] * back[b] / forth[-1]
        expected = np.array([expected[p] for p in found]) + 0.01 * len(found) * weight / weight.sum()
        probability = expected / (expected.sum() + 1)
    table = dict(zip(found, probability, strict=True))
    tokens, distinct = sum(counts.values()) + len(trained), len(counts) + 1
    once, twice = (sum(n == k for n in counts.values()) for k in (1, 2))
    discount = once / (once + 2 * twice) if once and twice else 0.5
    begins = np.array([p[:1] == b" " for p in found])
    end = (1 - probability.sum()) / (1 - probability[~begins].sum())
    figure = lambda c, share: math.log10(max(c - discount, 0) / tokens + discount * distinct / tokens * share)
    for k, text in rows:
        score = figure(len(trained), end) + sum(figure(counts[w], logs(w, table)[-1]) for w in lattice_lm.words_of(text))
        assert math.isclose(got[k]["score"], score, rel_tol=1e-7), k


# -- 4 ---------------------------------------------------------------------------------------------------------------------------------


def test_effort_comes_from_true_neighbours(spark, monkeypatch):
    monkeypatch.setattr(ann, "BLOCK", 50)
    rng = np.random.default_rng(3)
    x = rng.normal(size=(700, 8))
    forest = ann.Forest(x[:300], 4, 20)
    groups = spark.createDataFrame([(k * 3, v.tolist()) for k, v in enumerate(x)], "gid long, v array<double>").repartition(5)
    queries, leaves = ann.true_neighbours(groups, forest, x[:40], np.arange(40) * 3, 6)
    routed = forest.route(x)
    for q, found in enumerate(leaves):
        far = ((x - x[q]) ** 2).sum(axis=1)
        far[q] = np.inf
        assert sorted(map(tuple, found.tolist())) == sorted(tuple(routed[:, k].tolist()) for k in np.argsort(far)[:6])
    effort, scale = forest.effort_for(queries, leaves, 700 / 300, 0.9), 700 / 300
    hits = lambda e: sum(np.isin(found, forest.search(q, scale, e)).any(axis=1).sum() for q, found in zip(queries, leaves, strict=True))
    assert hits(effort) >= 0.9 * 240 > hits(effort * (1 - 1e-9) - 1e-6) - 1
    assert ann.true_neighbours(groups.limit(4), forest, x[:2], np.array([0, 3]), 6)[1].shape == (0, 6, 4)


def test_copies_without_number_and_ids_without_value(spark):
    vectors = [(None, [1.0, 2.0]), (100, [1.0, 2.0]), *((k, [1.0, 2.0]) for k in range(201, 900)), (900, [3.0, 1.0]), (901, [2.0, 2.0])]
    got = ann.search(spark.createDataFrame(vectors, "vec_id long, embedding array<double>"), F.col("id") % 100 == 0).toPandas()
    assert list(got[got.query_id == 100].sort_values("rank").vec_id) == list(range(201, 211))
    assert got[got.query_id == 900].sort_values("rank").vec_id.tolist()[0] == 901 and got.query_id.notna().all()
