"""Each operator against a plain version on small tables, and on nulls, empty and long texts, repeats and clashing names."""

import base64
import collections
import hashlib
import itertools
import math
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from basinsift.llm import ann, lattice_lm, packing, pieces, quality, simhash, sketch, toxicity, url_filter, warc
from basinsift.llm import queries as registered
from basinsift.llm.common import fresh, remainder_py

DOC = "doc_id long, text string"
CLASH = "doc_id long, text string, score string, key string, n int, fp string, slot int, label int, word string"


def texts(n, seed=0, words=60):
    rng = random.Random(seed)
    syllables = ["the", "er", "on", "an", "re", "in", "th", "ou", "é", "ing"]
    return ["".join(rng.choice(syllables) for _ in range(rng.randint(1, 3))) if k == 0 else " ".join("".join(rng.choice(syllables) for _ in range(rng.randint(1, 3))) for _ in range(rng.randint(1, words))) for k in range(n)]


def odd(spark):
    """Nulls, empty and long texts, repeated rows, and columns whose names the operators use inside."""
    rows = [(1, "a b c d e f g"), (1, "a b c d e f g"), (2, None), (3, ""), (None, "null id"), (4, "long " * 30000), (5, "é\t\n\x0b x"), (6, "a b c d e f g")]
    return spark.createDataFrame([(d, t, "s", "k", 1, "f", 2, 0, "w") for d, t in rows], CLASH)


def empty(spark):
    return spark.createDataFrame([], CLASH)


def write(df, folder, name):
    df.write.mode("overwrite").parquet(f"{folder}/{name}.parquet")


def test_queries_are_registered():
    assert sorted(int(k[2:].split("_")[0]) for k in registered.queries() if k.startswith("op")) == list(range(1, 14))
    assert set(registered.oracle_sql()) <= set(registered.queries())


# -- 1 ---------------------------------------------------------------------------------------------------------------------------------


def shingles(text, width=5):
    words = text.lower().split()
    return set(zip(*(words[k:] for k in range(width)), strict=False)) if len(words) >= width else {tuple(words)} if words else set()


def test_fingerprints(spark, tmp_path):
    rows = list(enumerate(texts(80, 1, 700)))
    rows[5] = (5, rows[4][1])
    random.Random(2).shuffle(rows)
    write(spark.createDataFrame(rows, DOC).repartition(3), tmp_path, "documents")
    got = {r["doc_id"]: r for r in sketch.op1_fingerprints(spark, str(tmp_path)).collect()}
    by_id = dict(rows)
    errors = []
    for k in range(80):
        text, following = by_id[k], by_id[(k + 1) % 80]
        cut = len(text) // 4
        edited = text[: len(text) - cut] + following[:cut]
        assert got[k]["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest() and got[k]["n_chars"] == len(text)
        a, b = shingles(text), shingles(edited)
        errors.append(abs(len(a & b) / len(a | b) - got[k]["near_edited"]))
    assert sum(errors) / 80 < 0.03 and max(errors) < 0.2
    assert got[4]["fingerprint"] == got[5]["fingerprint"] and got[4]["near_next"] == 1.0


def test_sketches_merge(spark):
    rows = [(k % 2, t) for k, t in enumerate(texts(12, 3, 300))]
    df = sketch.with_sketch(spark.createDataFrame(rows, "g int, text string"), {"text": "s"})
    merged = {r["g"]: r["s"] for r in sketch.merge_groups(df, ["g"], "s").collect()}
    whole = df.groupBy("g").agg(F.slice(F.sort_array(F.array_distinct(F.flatten(F.collect_list("s")))), 1, sketch.SKETCH_SIZE).alias("s"))
    assert {r["g"]: r["s"] for r in whole.collect()} == merged
    n = df.select("text", sketch.distinct_shingles(F.col("s")).alias("n"), sketch.containment(F.col("s"), F.col("s")).alias("c")).collect()
    assert all(r["c"] == 1.0 and abs(r["n"] - len(shingles(r["text"]))) <= 0.35 * len(shingles(r["text"])) + 1 for r in n)


def test_fingerprints_of_odd_rows(spark, tmp_path):
    write(odd(spark), tmp_path, "documents")
    got = sketch.op1_fingerprints(spark, str(tmp_path)).collect()
    assert len(got) == 8 and sum(r["fingerprint"] == "" for r in got) == 2
    same = {r["fingerprint"] for r in got if r["doc_id"] in (1, 6)}
    assert len(same) == 1
    write(empty(spark), tmp_path, "documents")
    assert sketch.op1_fingerprints(spark, str(tmp_path)).count() == 0


# -- 2 ---------------------------------------------------------------------------------------------------------------------------------


def plain_verdict(url, rules):
    rest = (url or "").partition("://")[2] if "://" in (url or "") else ""
    host = re.split(r"[/?#]", rest)[0]
    path = re.split(r"[?#]", rest[len(host) :])[0]
    host = "".join(c.lower() if c.isascii() else c for c in host)
    best = None
    for rule, action in rules:
        rhost, _, rpath = rule.partition("/")
        if (host == rhost or host.endswith("." + rhost)) and path.startswith("/" + rpath) and (best is None or len(rule) > len(best[0])):
            best = (rule, action)
    return host, path, best[0] if best else None, best[1] if best else "allow"


def test_url_filter(spark):
    urls = [None, "", "no scheme", "http://A.Example.com/en/x?y#z", "https://www.example.com/en/", "http://www.example.com", "http://x.net/es/", "http://net/fr/1", "http://xnet/fr/1", "http://a.com?q=/", "http://b.com/#", "http://example.com.net/fr", "x://y://z.com/", "http://example.com/EN/"]
    df = spark.createDataFrame([(k, u) for k, u in enumerate(urls + urls[3:4])] + [(0, None)], "page_id long, url string").withColumn("key", F.lit(1)).withColumn("host", F.lit("h"))
    got = sorted((r["page_id"], r["host"], r["path"], r["rule"] or "", r["verdict"]) for r in url_filter.judge(df, spark.createDataFrame(url_filter.RULES, "key string, action string")).collect())
    expected = sorted((k, *((x or "") for x in plain_verdict(u, url_filter.RULES))) for k, u in [*enumerate(urls + urls[3:4]), (0, None)])
    assert got == expected
    none = url_filter.judge(df, spark.createDataFrame([], "key string, action string"))
    assert {r["verdict"] for r in none.collect()} == {"allow"}


def test_blocked_bloom_has_no_false_negatives(spark):
    rng = np.random.default_rng(1)
    keys = rng.integers(-(1 << 63), 1 << 63, 5000)
    bloom = url_filter.BlockedBloom(url_filter.BlockedBloom.blocks_for(5000)).add(keys)
    assert bloom.may_hold(keys).all()
    assert bloom.may_hold(rng.integers(-(1 << 63), 1 << 63, 20000)).mean() < 0.01
    listed = spark.createDataFrame([(f"h{k}/",) for k in range(500)], "key string")
    hashes = np.array([r["h"] for r in listed.select(F.xxhash64("key").alias("h")).collect()])
    built = url_filter.build_filter(listed, 500)
    assert (built.bits == url_filter.BlockedBloom(built.blocks).add(hashes).bits).all()


# -- 3 ---------------------------------------------------------------------------------------------------------------------------------


def test_packing(spark, tmp_path):
    rows = [(k, t) for k, t in enumerate(texts(120, 4, 900))] + [(500, None), (501, ""), (502, "x  y \n z <|endoftext|> w "), (503, " \t  a   b"), (None, "n"), (1, "again"), (504, "word " * 9000)]
    df = spark.createDataFrame(rows, DOC).withColumn("length", F.lit("clash")).withColumn("rank", F.lit(1))
    write(df.repartition(3), tmp_path, "documents")
    got = packing.op3_packing(spark, str(tmp_path)).toPandas()
    from tokenizers import Tokenizer

    full = Tokenizer.from_file(packing.vocabulary("byte_bpe_50k.json"))
    expected = collections.Counter()
    for doc, text in rows:
        ids = np.array([*full.encode(text or "", add_special_tokens=False).ids, 0], "<u4")
        count = -(-len(ids) // 2048)
        cuts = [0, *range(len(ids) - (count - 1) * 2048, len(ids) + 1, 2048)]
        expected.update((doc, k, a, b - a, zlib.crc32(ids[a:b].tobytes())) for k, (a, b) in enumerate(itertools.pairwise(cuts)))
    ours = collections.Counter((None if math.isnan(r.doc_id) else int(r.doc_id), r.piece, r.start, r.length, r.ids_crc32) for r in got.itertuples())
    assert ours == expected
    for _, g in got.sort_values("offset").groupby("sequence_id"):
        assert g.length.sum() <= 2048 and list(g.offset) == [0, *g.length.cumsum()[:-1]]
    assert got.sequence_id.nunique() <= 1.1 * got.length.sum() / 2048 + 1
    write(df.filter("false"), tmp_path, "documents")
    assert packing.op3_packing(spark, str(tmp_path)).count() == 0


@pytest.mark.parametrize("seed", range(6))
def test_packing_keeps_every_piece(seed):
    rng = random.Random(seed)
    histogram = collections.Counter(min(100, max(1, int(rng.lognormvariate(3, 1)))) for _ in range(rng.choice([3, 50, 3000])))
    first = packing.best_fit(histogram, 100)
    final = packing.local_search(first, 100)
    for packed in (first, final):
        back = collections.Counter()
        for pattern, bins in packed.items():
            assert sum(a * n for a, n in pattern) <= 100
            for length, n in pattern:
                back[length] += n * bins
        assert back == histogram
    assert sum(final.values()) <= sum(first.values())


def test_local_search_empties_bins():
    packed = {((60, 1),): 1, ((50, 1),): 1, ((40, 1), (50, 1)): 1}
    assert sum(packing.local_search(packed, 100).values()) == 2


# -- 4 ---------------------------------------------------------------------------------------------------------------------------------


def test_nearest(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(1500, 12)).astype(np.float32)
    x[300:420] = x[7]  # copies, some of them queries
    rows = [(k, v.tolist()) for k, v in enumerate(x)] + [(9001, None), (9002, [0.0] * 12), (9003, [float("nan")] * 12), (9100, [1.0, 2.0]), (100, x[100].tolist())]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("v", F.lit("clash")).withColumn("id", F.lit(0)).withColumn("gid", F.lit(0))
    got = ann.search(df.drop("id"), F.col("id") % 100 == 0).toPandas()
    hits = total = 0
    big = x.astype(np.float64)
    for q in range(0, 1500, 100):
        far = np.sqrt(((big - big[q]) ** 2).sum(axis=1))
        far[q] = np.inf
        true = np.lexsort((np.arange(1500), far))[:10]
        mine = got[got.query_id == q].sort_values("rank")
        assert list(mine["rank"]) == list(range(1, 11)) and np.allclose(mine.score, far[mine.vec_id], rtol=1e-12, atol=0)
        hits += len(set(true) & set(mine.vec_id))
        total += 10
        if q in (300, 400):
            assert list(mine.vec_id) == [7, *[k for k in range(300, 312) if k != q][:9]]
    assert hits / total >= 0.9 and set(got.query_id) == set(range(0, 1500, 100))


def test_nearest_of_few(spark):
    df = spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.0, 1.0]), (2, [1.0, 1.0])], "vec_id long, embedding array<double>")
    got = ann.search(df, F.col("id") % 100 == 0).orderBy("rank").collect()
    assert [(r["query_id"], r["vec_id"], r["score"]) for r in got] == [(0, 2, 1.0), (0, 1, math.sqrt(2))]
    assert ann.search(df.filter("false"), F.col("id") % 100 == 0).count() == 0


# -- 5 ---------------------------------------------------------------------------------------------------------------------------------


def test_warc_round_trip(spark, tmp_path):
    rows = [(1, "http://a/", "same"), (2, None, "same"), (3, "http://b\r\n/", None), (4, "u", ""), (5, "v", "é" * 90000), (6, "u", "same"), (None, "w", "same"), (7, "x", "one\r\n\r\ntwo")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("digest", F.lit("clash")).withColumn("n", F.lit(1))
    path = str(tmp_path / "archive")
    warc.write(df.repartition(3), path)
    got = {r["page_id"]: r for r in warc.read(spark, path).collect()}
    for page, _, html in rows:
        data = (html or "").encode()
        assert got[page]["payload_bytes"] == len(data) and got[page]["payload_digest"] == base64.b32encode(hashlib.sha1(data).digest()).decode()
        if got[page]["record_type"] == "response":
            assert bytes(got[page]["payload"]) == data
    assert {k: r["refers_to"] for k, r in got.items() if r["record_type"] == "revisit"} == {1: 6, 2: 6, 3: 4}
    wanted = warc.read(spark, path).filter("record_type = 'response' AND target_uri IN ('u', 'x')")
    assert sorted(r["page_id"] for r in wanted.collect()) == [4, 6, 7]
    assert warc.read(spark, path, payload=False).filter("payload IS NOT NULL").count() == 0
    warc.write(df.filter("false"), str(tmp_path / "none"))
    assert warc.read(spark, str(tmp_path / "none")).count() == 0


def test_warc_of_others(spark, tmp_path):
    """Plain archives, and gzip records without the length field."""
    import gzip

    plain = b"".join(warc.record(k, f"u{k}", b"x" * k, "A" * 32, None, "2020-01-01T00:00:00Z") for k in (1, 5000, 3))
    (tmp_path / "a.warc").write_bytes(plain)
    (tmp_path / "b.warc.gz").write_bytes(b"".join(gzip.compress(warc.record(k, None, b"y" * k, "B" * 32, None, "d")) for k in (7, 70000, 9)))
    got = sorted((r["page_id"], r["payload_bytes"], len(r["payload"])) for r in warc.read(spark, str(tmp_path)).collect())
    assert got == [(k, k, k) for k in (1, 3, 7, 9, 5000, 70000)]
    assert warc.read(spark, str(tmp_path)).filter(F.col("payload_digest") == "B" * 32).count() == 3


# -- 6, 9 ------------------------------------------------------------------------------------------------------------------------------


def labelled(spark, folder, bad_word):
    rng = random.Random(6)
    rows, labels = [], []
    for k, text in enumerate(texts(400, 6, 80)):
        bad = rng.random() < 0.3
        rows.append((k, text + (f" {bad_word} {bad_word}" if bad else "")))
        labels.append((k, 0 if bad else 1, 1 if bad else 0))
    write(spark.createDataFrame(rows, DOC), folder, "documents")
    write(spark.createDataFrame([*labels, (None, 1, 1), (3, None, None)], "doc_id long, quality int, toxic int"), folder, "labels")
    return {k: toxic for k, _, toxic in labels}


@pytest.mark.parametrize(("query", "name"), [(toxicity.op6_toxicity, "toxic"), (quality.op9_quality, "quality")])
def test_classifiers_on_held_out_rows(spark, tmp_path, query, name):
    toxic = labelled(spark, tmp_path, "nincompoop" if name == "toxic" else "zzz### qqq$$$ xxx%%%")
    got = query(spark, str(tmp_path)).collect()
    assert len(got) == 400 and all(r["held_out"] == (remainder_py(r["doc_id"], 5) == 0) and 0 <= r["score"] <= 1 for r in got)
    wrong = [r for r in got if r["held_out"] and r["predicted"] != (toxic[r["doc_id"]] if name == "toxic" else 1 - toxic[r["doc_id"]])]
    assert len(wrong) <= 1


def test_labels_of_held_out_rows_do_not_matter(spark, tmp_path):
    labelled(spark, tmp_path, "nincompoop")
    before = {r["doc_id"]: r["score"] for r in toxicity.op6_toxicity(spark, str(tmp_path)).collect()}
    labels = spark.read.parquet(f"{tmp_path}/labels.parquet").toPandas()
    flipped = [(None if math.isnan(r.doc_id) else int(r.doc_id), 0, 1 - int(r.toxic) if not math.isnan(r.toxic) and remainder_py(int(r.doc_id) if not math.isnan(r.doc_id) else None, 5) == 0 else (None if math.isnan(r.toxic) else int(r.toxic))) for r in labels.itertuples()]
    write(spark.createDataFrame(flipped, "doc_id long, quality int, toxic int"), tmp_path, "labels")
    assert before == {r["doc_id"]: r["score"] for r in toxicity.op6_toxicity(spark, str(tmp_path)).collect()}


def test_disguises_are_undone():
    words = ["idiot", "moron", "stupid", "loser", "pathetic", "worthless", "the", "with", "this"]
    model = toxicity.CharModel(toxicity.CharModel.count([" ".join(words * 50)]))
    r = toxicity.Restorer(model)
    for disguise, word in [("1d10t", "idiot"), ("i d i o t", "idiot"), ("m0r0n", "moron"), ("stuuuupid", "stupid"), ("i.d.i.o.t", "idiot"), ("$tup!d", "stupid"), ("p@thetic", "pathetic"), ("w0rthle55", "worthless")]:
        assert r.decode(disguise) == word
    assert r.word("Wort,") == ["Wort"] and r.word("***") == [] and r.word("ther***") == ["ther"]
    assert "i d i o t" in r.words("you i d i o t there")


def test_viterbi_is_the_least_of_all_readings():
    model = toxicity.CharModel(toxicity.CharModel.count(["the idiot is a clown " * 9, "so 1 ten"]))
    r = toxicity.Restorer(model)

    def cost(reading):
        a = b = 0
        total = 0.0
        for c in toxicity.code_of(reading + " "):
            total, a, b = total + float(model.cost[a, b, int(c)]), b, int(c)
        return total

    for word in ("1d1ot", "c|0wn", "s000", "a.b", "i s", "!!5"):
        best = min((sum(c for _, c in path) + cost("".join(x for x, _ in path)), "".join(x for x, _ in path)) for path in itertools.product(*r.lattice(word)))
        assert r.decode(word) == best[1].strip()


@pytest.mark.parametrize("score", [lambda d, lab: toxicity.toxicity(d, lab), lambda d, lab: quality.score(d, quality.train(d, lab))])
def test_classifiers_on_odd_rows(spark, score):
    docs = odd(spark)
    both = spark.createDataFrame([(k, k % 2, k % 2) for k in range(1, 7)], "doc_id long, quality int, toxic int")
    for labels in (both, both.filter("false"), both.filter("quality = 1")):
        label = labels.withColumn("toxic", F.col("quality"))
        got = score(docs, label)
        assert got.columns == [*[c for c in docs.columns if c != "score"], "score"]
        rows = got.collect()
        assert len(rows) == 8 and all(0 <= r["score"] <= 1 for r in rows) and len({r["score"] for r in rows if r["doc_id"] in (1, 6)}) == 1
    assert score(empty(spark), both).count() == 0


def test_document_score_is_its_features_average():
    data = texts(5, 9, 30) + [None, ""]
    weight = np.random.default_rng(1).normal(size=quality.BUCKETS + 2)
    total, count = quality.sums(data, weight)
    for k, text in enumerate(data):
        bucket, share = quality.bag(text or "")
        assert math.isclose(total[k] / max(1, count[k]), float(share @ weight[bucket]), rel_tol=1e-4, abs_tol=1e-6)


# -- 7 ---------------------------------------------------------------------------------------------------------------------------------


def plain_simhash(text):
    import xxhash

    words = re.sub("[A-Z]", lambda m: m.group().lower(), text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", words)
    parts = [" ".join(words[k : k + 3]) for k in range(max(1, len(words) - 2))] if words else []
    hashes = [xxhash.xxh64_intdigest(p.encode(), 42) for p in parts]
    return sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hashes) * 2 > len(hashes)) if hashes else 0


def plain_components(prints, threshold):
    label = list(range(len(prints)))

    def find(x):
        while label[x] != x:
            x = label[x]
        return x

    for a, b in itertools.combinations(range(len(prints)), 2):
        if (prints[a] ^ prints[b]).bit_count() <= threshold:
            label[max(find(a), find(b))] = min(find(a), find(b))
    return [find(x) for x in range(len(prints))]


def test_simhash_components(spark, tmp_path):
    rng = random.Random(7)
    base = texts(25, 7, 120)
    rows = []
    for k in range(200):
        words = rng.choice(base).split()
        if rng.random() < 0.7 and len(words) > 3:
            words[rng.randrange(len(words))] = "Changed"
        rows.append((k * 3, " ".join(words)))
    write(spark.createDataFrame(rows, DOC).repartition(4), tmp_path, "documents")
    got = {r["doc_id"]: r for r in simhash.op7_simhash(spark, str(tmp_path)).collect()}
    prints = [plain_simhash(t) for _, t in rows]
    assert [got[d]["fingerprint"] for d, _ in rows] == [f"{p:016x}" for p in prints]
    assert [got[d]["component_id"] for d, _ in rows] == [rows[k][0] for k in plain_components(prints, 3)]
    for threshold in (3, 6):
        kept = simhash.deduplicate(spark.createDataFrame(rows, DOC), threshold).collect()
        assert sorted(r["doc_id"] for r in kept) == sorted({rows[k][0] for k in plain_components(prints, threshold)})


@pytest.mark.parametrize("threshold", [1, 3, 6])
def test_gray_index_is_exact(threshold):
    rng = np.random.default_rng(threshold)
    codes = rng.integers(0, 1 << 63, 30, dtype=np.uint64)
    near = np.concatenate([codes, *(codes ^ np.bitwise_or.reduce(np.uint64(1) << rng.integers(0, 64, (k, 30), dtype=np.uint64), axis=0) for k in (1, 2, 5, 9))])
    near = np.unique(near)
    group = np.zeros(len(near), np.int64)
    label = simhash.GrayIndex(near, group).components(threshold)
    plain = plain_components([int(x) for x in near], threshold)
    pairs = {(label[a], plain[a]) for a in range(len(near))}
    assert len(pairs) == len(set(label)) == len(set(plain))


def test_split_groups_lose_no_link(spark):
    rng = np.random.default_rng(3)
    hot = np.unique((np.uint64(0xABCD) << np.uint64(48)) | rng.integers(0, 1 << 14, 300, dtype=np.uint64))
    fps = spark.createDataFrame([(int(x),) for x in hot.view(np.int64)], "fp long")
    whole, split = ({r["node"]: r["root"] for r in simhash.components(simhash.links(fps, 3, cap)).collect()} for cap in (100_000, 20))
    assert whole == split


def test_simhash_of_odd_rows(spark, tmp_path):
    write(odd(spark), tmp_path, "documents")
    got = simhash.op7_simhash(spark, str(tmp_path)).collect()
    assert len(got) == 8 and {r["component_id"] for r in got if r["fingerprint"] == "0" * 16} == {2}
    assert {r["component_id"] for r in got if r["doc_id"] == 6} == {1}
    kept = simhash.deduplicate(odd(spark))
    assert kept.columns == odd(spark).columns
    assert sorted(r["doc_id"] or 0 for r in kept.collect()) == [0, 1, 2, 4, 5]
    write(empty(spark), tmp_path, "documents")
    assert simhash.op7_simhash(spark, str(tmp_path)).count() == 0
    assert simhash.deduplicate(empty(spark)).count() == 0


# -- 8 ---------------------------------------------------------------------------------------------------------------------------------


def test_pieces_equal_the_library(spark):
    import public_tokenizers
    import sentencepiece

    path = public_tokenizers.path("piece_bpe_32k.model")
    vocabulary, library = pieces.Vocabulary(path), sentencepiece.SentencePieceProcessor(model_file=path)
    samples = texts(60, 8, 40) + ["  two  spaces ", "a\nb\tc", "漢字 ☃ naïve", "x" * 200, "don't stop", "1234 5,678.90", "", "▁mark", "ab " * 50]
    words = sorted({w for t in samples for w in vocabulary.words_of(t)})
    df = spark.createDataFrame([(w, 1) for w in words], "word string, n long")
    got = {r["word"]: r["ids"] for r in pieces.encode_words(df, vocabulary).collect()}
    for text in samples:
        ids = [i for w in vocabulary.words_of(text) for i in got[w]]
        assert ids == library.encode(text)
    encoded = spark.createDataFrame([(k, library.encode(t)) for k, t in enumerate(samples)], "k int, ids array<int>")
    assert {r["k"]: r["text"] for r in pieces.decode_ids(encoded, vocabulary, "k").collect()} == {k: library.decode(library.encode(t)) for k, t in enumerate(samples)}


def test_piece_digests(spark, tmp_path):
    import public_tokenizers

    vocabulary = pieces.Vocabulary(public_tokenizers.path("piece_bpe_32k.model"))
    for docs in (odd(spark), empty(spark)):
        for frequent in (3, 1000):
            rows = pieces.encode(docs, vocabulary, frequent).collect()
            expected = []
            for r in docs.collect():
                words = vocabulary.words_of(r["text"])
                ids = [[vocabulary.pieces[w][0]] if w == pieces.MARK else x for w, x in zip(words, vocabulary.encode_long(words), strict=True)]
                checksum = sum(zlib.crc32(np.array(x, "<u4").tobytes()) * k for k, x in enumerate(ids, 1)) % ((1 << 61) - 1)
                expected.append((r["doc_id"] or 0, len(ids), sum(map(len, ids)), checksum, True))
            assert sorted((r["doc_id"] or 0, r["n_words"], r["n_pieces"], r["ids_checksum"], r["exact"]) for r in rows) == sorted(expected)


# -- 10 --------------------------------------------------------------------------------------------------------------------------------


def test_lattice_sums_all_segmentations():
    pieces = [b" ", b" a", b" ab", b"a", b"b", b"ab", b"ba"]
    probability = np.array([0.1, 0.1, 0.1, 0.2, 0.2, 0.1, 0.1])
    lattice = lattice_lm.Lattice(pieces, probability)
    weight = dict(zip(pieces, probability, strict=True))

    def plain(data):
        return 1.0 if not data else sum(weight[data[:k]] * plain(data[k:]) for k in range(1, len(data) + 1) if data[:k] in weight)

    words = [b"ab", b"a", b"abba", b"bab", b"b"]
    assert np.allclose(np.exp(lattice.log_probability(words)), [plain(b" " + w) for w in words])
    counts = lattice.expectation(words, np.ones(5))
    assert math.isclose((counts * [len(p) for p in pieces]).sum(), sum(len(w) + 1 for w in words))


def test_lattice_scores(spark, tmp_path):
    rows = [(k, t) for k, t in enumerate(texts(150, 10, 60))] + [(900, None), (901, ""), (902, "Ünseen-Wörd 漢字 " + "x" * 300)]
    write(spark.createDataFrame(rows, DOC).withColumn("word", F.lit("clash")).withColumn("key", F.lit(1)).repartition(3), tmp_path, "documents")
    import public_tokenizers

    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    path = public_tokenizers.path("piece_bpe_32k.model")
    got = {r["doc_id"]: r for r in lattice_lm.score(docs, path).collect()}
    few = {r["doc_id"]: r for r in lattice_lm.score(docs, path, frequent=5).collect()}
    count = collections.Counter()
    tokens = {d: [w.decode() for w in lattice_lm.words_of(t)] + ["\n"] for d, t in rows}
    for d, _ in rows:
        if remainder_py(d, 10):
            count.update(tokens[d])
    total, distinct = sum(count.values()), len(count)
    for d, _ in rows:
        base = sum(math.log10((count[w] + 0.1) / (total + 0.1 * (distinct + 1))) for w in tokens[d])
        r = got[d]
        assert math.isclose(r["base_score"], base, rel_tol=1e-9) and r["n_tokens"] == len(tokens[d]) and r["train_tokens"] == total
        assert r["n_known"] == sum(count[w] > 0 for w in tokens[d]) and r["held_out"] == (remainder_py(d, 10) == 0)
        assert math.isfinite(r["score"]) and r["score"] < 0 and math.isclose(few[d]["score"], r["score"], rel_tol=1e-9) and few[d]["n_known"] == r["n_known"]


def test_lattice_on_odd_rows(spark):
    import public_tokenizers

    path = public_tokenizers.path("piece_bpe_32k.model")
    got = lattice_lm.score(odd(spark), path).collect()
    assert len(got) == 8 and all(math.isfinite(r["score"]) for r in got)
    assert lattice_lm.score(empty(spark), path).count() == 0
    held = odd(spark).filter("doc_id IS NULL")
    assert lattice_lm.score(held, path).first()["train_tokens"] == 0


def test_fresh_names():
    assert fresh(["a", "Score", "_score"], "score") == "__score"
