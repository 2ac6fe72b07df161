"""Language-model scoring by a subword lattice: the likelihood of a word sums over all its segmentations.

The pieces and first weights are those of an existing public vocabulary (its scores are ranks, read as a
Zipf law); expectation-maximisation rounds over all distinct training words, each counted once because the
lattice serves the discounted mass that every seen word gives up alike, turn them into piece probabilities.  Pieces that begin a word carry its boundary, so piece streams spell word streams and
the marginal over segmentations (a forward recursion in log space over a word's bytes) is a distribution
over words.  A word's probability is its discounted training count plus the lattice's share of the
discounted mass, so seen words keep their frequency and unseen ones get their spelling's likelihood.

Equally long words share the steps of the recursion; long and rare lengths go word by word, in a time in
proportion to the bytes and with the sums of the last piece's length held.  Words are counted in tasks and
summed by one shuffle.  The most frequent words, ``FREQUENT`` at most, are broadcast; the rest of each
document's words meet their counts in a join that no hot word can skew.

Defined results: null or empty text is the end token alone; repeated rows are scored each; a null id counts
as held out; without training rows the lattice alone scores; an empty table gives an empty result; other
columns are ignored.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterable, Iterator
from itertools import chain, repeat

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from basinsift.llm.common import greatest_within, lower_ascii, materialize, portions, remainder_py, small_batches, table

HELD_OUT_MODULUS = 10
SMOOTHING = 0.1
#: Most frequent words whose figures are broadcast to the scoring tasks.
FREQUENT = 150_000
ROUNDS = 3
#: Words of one length are taken together if there are so many, and none is longer; others go one at a time.
TOGETHER, SHORT_BYTES = 16, 64
#: Bytes of a word whose spans are looked up at a time, and the scale at which its sums are set back to 1.
BLOCK, TINY = 1 << 14, 1e-100
#: Distinct words that a counting task holds before it passes them on, and their bytes.
HELD_WORDS, HELD_BYTES = 300_000, 16 << 20
#: About what a byte of text takes from a probability, the other way round.
BYTE_SCALE = 12.0


def words_of(text: str | None) -> list[bytes]:
    """Words between ASCII white space, A-Z lower-cased, as UTF-8."""
    return lower_ascii((text or "").encode("utf-8", "surrogatepass")).split()


def vocabulary(path: str) -> tuple[list[bytes], np.ndarray]:
    """Pieces of a SentencePiece vocabulary (word begin as a space) with weights 1 / (1 + rank); all single bytes are added."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    weight: dict[bytes, float] = {}
    for i in range(model.get_piece_size()):
        if model.is_control(i) or model.is_unknown(i) or model.is_byte(i):
            continue
        piece = model.id_to_piece(i)
        data = piece.replace("▁", " ").encode("utf-8")
        if " " not in piece[1:].replace("▁", " ") and not any(65 <= c <= 90 for c in data):
            weight[data] = 1 / (1 + max(0.0, -model.get_score(i))) if model.get_score(i) > -1e8 else 1e-6
    for c in range(256):
        weight.setdefault(bytes([c]), 1 / (1 + model.get_piece_size()))
    pieces = sorted(weight)
    return pieces, np.array([weight[p] for p in pieces])


class Lattice:
    """All segmentations of words into weighted pieces, for many words at a time.

    Pieces are found by their beginnings: ``step`` gives the beginning that is one byte longer, 0 if there is
    none, and ``piece`` the number (from 1) of the piece that a beginning is, or 0.
    """

    def __init__(self, pieces: list[bytes], probability: np.ndarray):
        self.log = np.r_[-np.inf, np.log(probability)]
        sizes = np.fromiter(map(len, pieces), np.int64, len(pieces))
        self.longest = int(sizes.max())
        #: Weights for sums that need no logarithm: every byte counts ``BYTE_SCALE`` times as much.
        self.weight = np.exp(self.log + np.log(BYTE_SCALE) * np.r_[0, sizes])
        known: dict[bytes, int] = {b"": 1}
        for piece in pieces:
            for k in range(1, len(piece) + 1):
                known.setdefault(piece[:k], len(known) + 1)
        self.step = np.zeros((len(known) + 1) * 256, np.int32)
        self.piece = np.zeros(len(known) + 1, np.int32)
        for begun, node in known.items():
            if begun:
                self.step[known[begun[:-1]] * 256 + begun[-1]] = node
        self.piece[[known[p] for p in pieces]] = np.arange(1, len(pieces) + 1)

    def edges(self, words: np.ndarray) -> list[tuple[int, int, np.ndarray, np.ndarray]]:
        """``from, to, rows, pieces``: the spans of equally long words (a byte matrix) that are pieces, by where they begin."""
        columns, found = np.ascontiguousarray(words.T).astype(np.int32), []
        for a in range(len(columns)):
            rows, node = np.arange(words.shape[0]), np.ones(words.shape[0], np.int32)
            for b in range(a, min(a + self.longest, len(columns))):
                node = self.step[node * 256 + (columns[b] if len(rows) == len(columns[b]) else columns[b][rows])]
                lives = np.flatnonzero(node)
                if len(lives) < len(rows):
                    rows, node = rows[lives], node[lives]
                if not len(rows):
                    break
                piece = self.piece[node]
                whole = np.flatnonzero(piece)
                if len(whole):
                    found.append((a, b + 1, rows[whole], piece[whole]))
        return found

    def forward(self, edges: list[tuple[int, int, np.ndarray, np.ndarray]], rows: int, length: int) -> np.ndarray:
        """Logarithms of the sums over all segmentations of each beginning."""
        alpha = np.full((length + 1, rows), -np.inf)
        alpha[0] = 0
        for a, b, at, piece in edges:
            alpha[b, at] = np.logaddexp(alpha[b, at], alpha[a, at] + self.log[piece])
        return alpha

    def expected(self, edges: list[tuple[int, int, np.ndarray, np.ndarray]], rows: int, length: int, counts: np.ndarray) -> np.ndarray:
        """Expected number of each piece in words that occur ``counts`` times; words of ``SHORT_BYTES`` don't leave the range of numbers."""
        alpha, beta = np.zeros((length + 1, rows)), np.zeros((length + 1, rows))
        alpha[0], beta[length] = 1, 1
        weights = [self.weight[piece] for *_, piece in edges]
        for (a, b, at, _), w in zip(edges, weights, strict=True):
            alpha[b, at] += alpha[a, at] * w
        share = counts / alpha[length]
        total = np.zeros(len(self.log))
        for (a, b, at, piece), w in zip(reversed(edges), reversed(weights), strict=True):
            past = beta[b, at] * w
            beta[a, at] += past
            total += np.bincount(piece, alpha[a, at] * past * share[at], len(total))
        return total[1:]

    def spans(self, word: np.ndarray, first: int, last: int) -> np.ndarray:
        """Piece number of the span of each length (row, from 1) that begins at each byte from ``first`` to before ``last``."""
        part = np.zeros(last - first + self.longest, np.int32)
        known = word[first : last + self.longest]
        part[: len(known)] = known
        found = np.zeros((self.longest, last - first), np.int32)
        at, node = np.arange(last - first), np.ones(last - first, np.int32)
        for k in range(self.longest):
            node = self.step[node * 256 + part[at + k]]
            lives = np.flatnonzero((node > 0) & (at + first + k < len(word)))
            at, node = at[lives], node[lives]
            found[k, at] = self.piece[node]
        return found

    def _one(self, word: np.ndarray) -> np.ndarray:
        """Natural logarithm of the sum over all segmentations of each beginning of a word.

        The sums of the last bytes are kept as numbers, and set back to 1 as they shrink.
        """
        n, probability, longest = len(word), np.exp(self.log), self.longest
        out = np.full(n + 1, -np.inf)
        out[0], scale = 0.0, 0.0
        sums = np.zeros(BLOCK + 2 * longest)  # of the beginnings from ``first``
        sums[0] = 1
        for first in range(0, n, BLOCK):
            last = min(n, first + BLOCK)
            edge = probability[self.spans(word, first, last)].T.copy()
            for a in range(last - first):
                now = sums[a]
                if now:
                    out[first + a] = np.log(now) + scale
                    sums[a + 1 : a + 1 + longest] += now * edge[a]
                    if now < TINY:
                        sums[a + 1 : a + 1 + longest] /= now
                        scale += np.log(now)
            sums[:longest] = sums[last - first : last - first + longest]
            sums[longest:] = 0
        if sums[0]:
            out[n] = np.log(sums[0]) + scale
        return out

    def _one_expected(self, word: np.ndarray, count: float) -> np.ndarray:
        """Expected number of each piece in a word that occurs ``count`` times: backwards, the sums of its ends."""
        n, alpha, total = len(word), self._one(word), np.zeros(len(self.log))
        probability, longest = np.exp(self.log), self.longest
        beta = np.full(n + 1 + longest, -np.inf)
        beta[n], scale = 0.0, 0.0
        window = np.zeros(longest)  # of the ends after the byte at hand
        window[0] = 1
        for first in reversed(range(0, n, BLOCK)):
            last = min(n, first + BLOCK)
            spans = self.spans(word, first, last)
            edge = probability[spans].T.copy()
            for a in range(last - first - 1, -1, -1):
                now = float(edge[a] @ window)
                window[1:] = window[:-1]
                window[0] = now
                if now:
                    beta[first + a] = np.log(now) + scale
                    if now < TINY:
                        window /= now
                        scale += np.log(now)
            for k in range(longest):
                share = np.exp(alpha[first:last] + self.log[spans[k]] + beta[first + k + 1 : last + k + 1] - alpha[n])
                total += np.bincount(spans[k], share * count, len(total))
        total[0] = 0
        return total[1:]

    def groups(self, words: pa.Array | list[bytes]) -> Iterator[tuple[np.ndarray, np.ndarray, bool]]:
        """Words of one length at a time: their positions, a byte matrix with the word begin in front, and whether to take them together."""
        words = words if isinstance(words, pa.Array) else pa.array(words, pa.binary())
        begin = np.frombuffer(words.buffers()[1], np.int32)[words.offset : words.offset + len(words) + 1].astype(np.int64)
        data, lengths = np.frombuffer(words.buffers()[2] or b"", np.uint8), np.diff(begin)
        order = np.argsort(lengths, kind="stable")
        cuts = np.flatnonzero(np.diff(lengths[order], prepend=-1))
        for at in np.split(order, cuts[1:]) if len(order) else []:
            length = int(lengths[at[0]])
            matrix = np.full((len(at), length + 1), 32, np.uint8)
            matrix[:, 1:] = data[begin[at, None] + np.arange(length)]
            yield at, matrix, len(at) >= TOGETHER and length < SHORT_BYTES

    def log_probability(self, words: pa.Array | list[bytes]) -> np.ndarray:
        """Natural logarithm of each word's marginal probability."""
        out = np.empty(len(words))
        for at, matrix, together in self.groups(words):
            out[at] = self.forward(self.edges(matrix), *matrix.shape)[-1] if together else [self._one(row)[-1] for row in matrix]
        return out

    def expectation(self, words: pa.Array | list[bytes], counts: np.ndarray) -> np.ndarray:
        total = np.zeros(len(self.log) - 1)
        for at, matrix, together in self.groups(words):
            if together:
                total += self.expected(self.edges(matrix), *matrix.shape, counts[at])
            else:
                for row, count in zip(matrix, counts[at], strict=True):
                    total += self._one_expected(row, count)
        return total


def word_counts(docs: DataFrame, modulus: int = HELD_OUT_MODULUS) -> DataFrame:
    """``word, c, n``: occurrences in training rows and in all rows of every distinct word."""
    small_batches(docs.sparkSession)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        train, held = Counter(), Counter()

        def flush() -> pa.RecordBatch:
            words = list(train.keys() | held.keys())
            c = np.fromiter((train[w] for w in words), np.int64, len(words))
            n = c + np.fromiter((held[w] for w in words), np.int64, len(words))
            train.clear()
            held.clear()
            return pa.record_batch([pa.array(words, pa.binary()), pa.array(c), pa.array(n)], ["word", "c", "n"])

        read = 0
        for batch in (p for b in batches for p in portions(b)):
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                words = words_of(text)
                if max(map(len, words), default=0) > SHORT_BYTES:
                    read += sum(len(w) for w in words if len(w) > SHORT_BYTES)
                (train if remainder_py(doc, modulus) else held).update(words)
            if len(train) + len(held) > HELD_WORDS or read > HELD_BYTES:
                yield flush()
                read = 0
        yield flush()

    part = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "word binary, c long, n long")
    return part.groupBy("word").agg(F.sum("c").alias("c"), F.sum("n").alias("n"))


def fit_lattice(counts: DataFrame, pieces: list[bytes], weight: np.ndarray, rounds: int = ROUNDS) -> tuple[Lattice, float]:
    """Lattice with piece probabilities learnt from the distinct training words, and the logarithm of the end's probability."""
    spark = counts.sparkSession
    small_batches(spark)
    probability = weight / weight.sum() * 0.99
    for _ in range(rounds):
        shared = spark.sparkContext.broadcast((pieces, probability))

        def run(batches: Iterable[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            lattice, sums = Lattice(*shared.value), np.zeros(len(shared.value[0]))
            for batch in batches:
                sums += lattice.expectation(batch.column(0), np.ones(batch.num_rows))
            at = np.nonzero(sums)[0]
            yield pa.record_batch([pa.array(at), pa.array(sums[at])], ["piece", "n"])

        got = counts.filter("c > 0").select("word").mapInArrow(run, "piece long, n double").groupBy("piece").agg(F.sum("n").alias("n")).toArrow()
        expected = np.zeros(len(pieces))
        expected[got["piece"].to_numpy()] = got["n"].to_numpy()
        # Every piece stays possible: a hundredth of an occurrence, spread by the vocabulary's own weights.
        expected += 0.01 * len(pieces) * weight / weight.sum()
        probability = expected / (expected.sum() + 1)  # the end is one more token
    begins = np.array([p[:1] == b" " for p in pieces])
    end = np.log((1 - probability.sum()) / (1 - probability[~begins].sum()))
    return Lattice(pieces, probability), float(end)


def score(docs: DataFrame, vocabulary_path: str, modulus: int = HELD_OUT_MODULUS, frequent: int = FREQUENT) -> DataFrame:
    """A row for each row of ``docs``: token counts, base score and the lattice model's log10 probability."""
    spark = docs.sparkSession
    counts = materialize(word_counts(docs, modulus), "words")
    ids = docs.select((F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % modulus).alias("r"))
    documents = ids.filter("r <> 0").count()
    sums = counts.agg(F.coalesce(F.sum("c"), F.lit(0)), F.expr("count_if(c > 0)"), F.expr("count_if(c = 1)"), F.expr("count_if(c = 2)")).first()
    tokens, distinct = sums[0] + documents, sums[1] + bool(documents)
    discount = sums[2] / (sums[2] + 2 * sums[3]) if sums[2] and sums[3] else 0.5
    spare = discount * distinct / tokens if tokens else 1.0
    pieces, weight = vocabulary(vocabulary_path)
    lattice, end = fit_lattice(counts, pieces, weight)
    shared = spark.sparkContext.broadcast((pieces, np.exp(lattice.log[1:])))

    def figures(c: np.ndarray, natural: np.ndarray) -> np.ndarray:
        """log10 of the discounted count plus the lattice's share."""
        seen = np.maximum(c - discount, 0) / tokens if tokens else np.zeros(len(c))
        with np.errstate(divide="ignore"):
            return np.logaddexp(np.log(seen), np.log(spare) + natural) / np.log(10)

    def rate(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Lattice(*shared.value)
        for batch in batches:
            c = batch.column(1).to_numpy()
            yield pa.record_batch([*batch.columns, pa.array(figures(c, own.log_probability(batch.column(0))))], ["word", "c", "n", "lp"])

    rated = materialize(counts.mapInArrow(rate, "word binary, c long, n long, lp double"), "rated")
    # Bounded: ``frequent`` rows, of words that are short.
    top = greatest_within(rated.filter(F.octet_length("word") <= SHORT_BYTES), "n", frequent).select("word", "c", "lp").toArrow()
    c = top["c"].to_numpy().astype(np.int64)
    known = {w: k for k, w in enumerate(top["word"].to_pylist())}, (c > 0).astype(np.float64), np.log10(c + SMOOTHING), top["lp"].to_numpy().astype(np.float64)
    ending = (documents > 0, float(np.log10(documents + SMOOTHING)), float(figures(np.array([documents]), np.array([end]))[0]))
    frequent_words = spark.sparkContext.broadcast(known)
    schema = pa.schema([("key", pa.int64()), ("word", pa.binary()), ("doc_id", pa.int64()), ("held_out", pa.bool_()), ("n_tokens", pa.int64()), ("n_known", pa.int64()), ("base", pa.float64()), ("lp", pa.float64())])

    def spread(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Per document one row with the sums over its frequent words, under a key that is no word, and one for each other word of it."""
        (number, *figure), task, row = frequent_words.value, TaskContext.get().partitionId(), 0
        for batch in (p for b in batches for p in portions(b)):
            words = [words_of(t) for t in batch.column(1).to_pylist()]
            sizes = np.fromiter(map(len, words), np.int64, len(words))
            every = list(chain.from_iterable(words))
            at = np.fromiter(map(number.get, every, repeat(-1)), np.int64, len(every))
            doc, keys = np.repeat(np.arange(len(words)), sizes), (task << 40) + row + np.arange(len(words))
            row += len(words)
            often, rare = np.flatnonzero(at >= 0), np.flatnonzero(at < 0)
            sums = [e + np.bincount(doc[often], f[at[often]], len(words)) for e, f in zip(ending, figure, strict=True)]
            held_out = [remainder_py(d, modulus) == 0 for d in batch.column(0).to_pylist()]
            own = [pa.array(keys), pa.array([b" %d" % k for k in keys.tolist()], pa.binary()), batch.column(0), pa.array(held_out), pa.array(sizes + 1), pa.array(sums[0].astype(np.int64)), pa.array(sums[1]), pa.array(sums[2])]
            yield pa.record_batch(own, schema=schema)
            others = [pa.array(keys[doc[rare]]), pa.array([every[k] for k in rare.tolist()], pa.binary()), *(pa.nulls(len(rare), f.type) for f in list(schema)[2:])]
            yield pa.record_batch(others, schema=schema)

    small_batches(spark)
    parts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(
        spread, "key long, word binary, doc_id long, held_out boolean, n_tokens long, n_known long, base double, lp double"
    )
    rare = rated.select("word", F.col("c").alias("wc"), F.col("lp").alias("wlp"))
    met = parts.join(rare, "word", "left").select(
        "key", "doc_id", "held_out", "n_tokens",
        F.coalesce("n_known", (F.col("wc") > 0).cast("long")).alias("n_known"),
        F.coalesce("base", F.log10(F.col("wc") + SMOOTHING)).alias("base"),
        F.coalesce("lp", "wlp").alias("lp"),
    )
    per_doc = met.groupBy("key").agg(F.max("doc_id").alias("doc_id"), F.max("held_out").alias("held_out"), F.max("n_tokens").alias("n_tokens"), F.sum("n_known").alias("n_known"), F.sum("base").alias("base"), F.sum("lp").alias("score"))
    norm = float(np.log10(tokens + SMOOTHING * (distinct + 1)))
    return per_doc.select("doc_id", "held_out", "n_tokens", "n_known", F.lit(tokens).cast("long").alias("train_tokens"), (F.col("base") - F.col("n_tokens") * norm).alias("base_score"), "score")


def op10_lattice_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lattice and base scores of every document."""
    import public_tokenizers

    return score(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


def lattice_base(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The columns of ``op10_lattice_lm`` that SQL can express: a further check."""
    return op10_lattice_lm(spark, sf_dir).select("doc_id", "held_out", "n_tokens", "n_known", "train_tokens", F.round("base_score", 4).alias("base_score"))


#: The remainder of the crc32 is computed bit by bit: 3988292384 is the reversed polynomial.
BASE_SQL = r"""
WITH d AS (SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text, list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda x: CAST(ascii(x) AS BIGINT)) AS bytes FROM documents),
r AS (SELECT doc_id, list_filter(string_split_regex(text, '[\x20\x09-\x0D]+'), lambda w: w <> '') AS words,
  xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, bytes), lambda c, b: list_reduce([xor(c, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda x, y: xor(x >> 1, 3988292384 * (x & 1))))) % 10 = 0 AS held_out FROM d),
w AS (SELECT doc_id, held_out, unnest(words) AS word FROM r),
c AS (SELECT word, count(*) AS c FROM w WHERE NOT held_out GROUP BY word),
t AS (SELECT (SELECT coalesce(sum(c), 0) FROM c) + count_if(NOT held_out) AS n, (SELECT count(*) FROM c) + CAST(count_if(NOT held_out) > 0 AS INTEGER) AS v, count_if(NOT held_out) AS docs FROM r),
s AS (SELECT doc_id, count(*) AS n_words, count(c.c) AS seen, sum(log10(coalesce(c.c, 0) + 0.1)) AS part FROM w LEFT JOIN c USING (word) GROUP BY doc_id)
SELECT r.doc_id, held_out, CAST(coalesce(n_words, 0) + 1 AS BIGINT) AS n_tokens, CAST(coalesce(seen, 0) + (docs > 0)::INTEGER AS BIGINT) AS n_known, CAST(n AS BIGINT) AS train_tokens,
  round(coalesce(part, 0) + log10(docs + 0.1) - (coalesce(n_words, 0) + 1) * log10(n + 0.1 * (v + 1)), 4) AS base_score
FROM r LEFT JOIN s ON r.doc_id = s.doc_id, t
"""
