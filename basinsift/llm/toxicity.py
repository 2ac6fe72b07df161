"""Toxicity: noisy-channel deobfuscation of words, then a score of the restored text.

A word that may be disguised (digits or symbols for letters, separators between letters, stretched letters,
letters spaced apart) spans a lattice of characters: each symbol has the letters it may stand for, a
separator or a repeat may be dropped, a space inside a run of single characters may be removed, each at the
channel's cost.  A Viterbi search picks the cheapest reading under a character trigram model of the whole
corpus.  A word of plain letters has a lattice of one path and stays.  The restored words, and their
beginnings (inflected forms), are the features of a logistic regression trained on labelled rows.

Defined results: null or empty text has no feature and the intercept's score; repeated rows are scored
alike; without labels of both classes the score is their mean, without any 0; an empty table gives an empty
result; other columns are ignored.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from basinsift.llm.common import portions, remainder, small_batches, table, with_text_score
from basinsift.llm.labelled import HELD_OUT_MODULUS, training_texts

# The letters that a digit or symbol may stand for.
LEET = {"0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "bg", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "!": "i", "|": "il", "+": "t", "(": "c", "€": "e", "£": "l", "¡": "i"}
SEPARATORS = frozenset(".-_*~'`^,:;/\\#%&=?")
#: Costs of the channel, in natural-log units.
SUBSTITUTED, KEPT, DROPPED, COLLAPSED, UNSPACED = 1.0, 6.0, 0.5, 0.5, 0.2

TRAIN_DOCS = 8000
PREFIXES = (4, 5, 6)
#: Words and beginnings that the regression may use: those whose log-likelihood ratio is at least this.
LEAST_RATIO = 11.0
FEATURES = 5000
PASSES = 60
THRESHOLD = 0.5
CACHED_WORDS = 200_000

_LETTERS = 64
_OTHER = 63
_EDGE = ".,;:?)]}>\"'*&%#=~^_`/\\-…»«“”"
_SINGLES = re.compile(r"(?<!\S)(?:\S[ \t]){2,}\S(?!\S)")
_STRETCHED = re.compile(r"(.)\1\1")


def _codes() -> np.ndarray:
    """Class of each code point: 0 for white space, a-z, accented Latin letters, digits as one, all others as one."""
    table = np.full(0x250, _OTHER, np.uint8)
    table[[9, 10, 11, 12, 13, 32]] = 0
    for k, c in enumerate("abcdefghijklmnopqrstuvwxyzàáâãäåæçèéêëìíîïñòóôõöøùúûüýßœ"):
        table[ord(c)] = k + 1
        if len(c.upper()) == 1 and ord(c.upper()) < len(table):
            table[ord(c.upper())] = k + 1
    table[ord("0") : ord("9") + 1] = 62
    return table


CODES = _codes()


def code_of(text: str) -> np.ndarray:
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    return CODES[np.minimum(points, 0x24F)]


class CharModel:
    """Interpolated character trigram model over 64 classes; costs are negative natural logarithms."""

    def __init__(self, counts: np.ndarray):
        c3 = counts.reshape(_LETTERS, _LETTERS, _LETTERS).astype(np.float64)
        c2, c1 = c3.sum(axis=0), c3.sum(axis=(0, 1))
        p1 = (c1 + 1) / (c1.sum() + _LETTERS)
        p2 = (c2 + 4 * p1) / (c2.sum(axis=1, keepdims=True) + 4)
        p3 = (c3 + 4 * p2) / (c3.sum(axis=2, keepdims=True) + 4)
        self.cost = (-np.log(p3)).astype(np.float32)

    @staticmethod
    def count(texts: Iterable[str]) -> np.ndarray:
        total = np.zeros(_LETTERS**3, np.int64)
        for text in texts:
            code = np.concatenate([[0, 0], code_of(text), [0]]).astype(np.int32)
            total += np.bincount((code[:-2] * _LETTERS + code[1:-1]) * _LETTERS + code[2:], minlength=len(total))
        return total


def char_model(docs: DataFrame) -> CharModel:
    """Trigram counts of all texts: each task sums its share, at most 64^3 sums reach the driver."""
    small_batches(docs.sparkSession)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(_LETTERS**3, np.int64)
        for batch in (p for b in batches for p in portions(b, 0)):
            total += CharModel.count([" ".join(t or "" for t in batch.column(0).to_pylist())])
        at = np.nonzero(total)[0]
        yield pa.record_batch([pa.array(at), pa.array(total[at])], ["g", "n"])

    sums = docs.select(F.col("text").cast("string").alias("text")).mapInArrow(run, "g long, n long").groupBy("g").agg(F.sum("n").alias("n")).toArrow()
    counts = np.zeros(_LETTERS**3, np.int64)
    counts[sums["g"].to_numpy()] = sums["n"].to_numpy()
    return CharModel(counts)


class Restorer:
    """Viterbi decoding of disguised words."""

    def __init__(self, model: CharModel):
        self.cost = model.cost

    def lattice(self, word: str) -> list[list[tuple[str, float]]]:
        """Per symbol: what it may read as, with the channel's cost; an empty reading drops it."""
        out, previous = [], ""
        for at, c in enumerate(word):
            if c == " ":
                options = [("", UNSPACED), (" ", 0.0)]
            elif c in LEET:
                options = [(x, SUBSTITUTED) for x in LEET[c]] + [(c, KEPT if c.isdigit() else DROPPED + SUBSTITUTED)]
                if not c.isdigit():
                    options.append(("", DROPPED))
            elif c in SEPARATORS:
                options = [("", DROPPED), (c, KEPT)]
            elif c == previous and word[max(0, at - 2) : at + 2].count(c) >= 3:
                options = [(c, 0.0), ("", COLLAPSED)]
            else:
                options = [(c, 0.0)]
            if c != " ":
                previous = c
            out.append(options)
        return out

    def decode(self, word: str) -> str:
        """Cheapest reading of a word (or run of spaced letters), bounded by spaces on both sides."""
        # State: classes of the last two characters read; value: cost and the reading as a linked list.
        states: dict[tuple[int, int], tuple[float, tuple | None]] = {(0, 0): (0.0, None)}
        for options in [*self.lattice(word), [(" ", 0.0)]]:
            after: dict[tuple[int, int], tuple[float, tuple | None]] = {}
            for (a, b), (cost, path) in states.items():
                for read, channel in options:
                    if read:
                        c = int(CODES[min(ord(read), 0x24F)])
                        total, key, link = cost + channel + float(self.cost[a, b, c]), (b, c), (read, path)
                    else:
                        total, key, link = cost + channel, (a, b), path
                    if key not in after or total < after[key][0]:
                        after[key] = (total, link)
            states = after
        _, path = min(states.values(), key=lambda x: x[0])
        read = []
        while path:
            read.append(path[0])
            path = path[1]
        return "".join(reversed(read)).strip()

    def word(self, token: str) -> list[str]:
        """The restored word or words of one lower-cased token."""
        core = token.strip(_EDGE).rstrip("!").strip(_EDGE)
        while len(core) > 2 and core[-1] == core[-2] == core[-3] and not core[-1].isalpha():
            core = core.rstrip(core[-1])
        if not core:
            return []
        if core.isalpha() and not _STRETCHED.search(core):
            return [core]
        return [x for x in self.decode(core).split() if x]

    def words(self, text: str) -> set[str]:
        """Distinct tokens of a text to restore: those between white space, and the runs of single characters."""
        low = text.lower()
        return {*low.split(), *(m.group().replace("\t", " ") for m in _SINGLES.finditer(low))}


def word_features(word: str) -> list[int]:
    """Hashes of a word and of its beginnings."""
    return [zlib.crc32(b"=" + word.encode("utf-8", "surrogatepass")), *(zlib.crc32(b"^" + word[:n].encode("utf-8", "surrogatepass")) for n in PREFIXES if len(word) >= n)]


class Lexicon:
    """Logistic regression over the presence of restored words and beginnings."""

    def __init__(self):
        self.weights: dict[int, float] = {}
        self.intercept, self.constant = 0.0, None

    def fit(self, bags: list[np.ndarray], labels: list[int], passes: int = PASSES) -> Lexicon:
        y = np.array(labels, np.float64)
        if len(np.unique(y)) < 2:
            self.constant = float(y.mean()) if len(y) else 0.0
            return self
        positive, n_pos = np.unique(np.concatenate([b for b, t in zip(bags, labels, strict=True) if t]), return_counts=True)
        everywhere, n_all = np.unique(np.concatenate(bags), return_counts=True)
        n_neg = n_all[np.searchsorted(everywhere, positive)] - n_pos
        a, c = y.sum(), len(y) - y.sum()
        ratio = 2 * (n_pos * np.log(np.maximum(n_pos, 1e-9) / ((n_pos + n_neg) * a / len(y))) + n_neg * np.log(np.maximum(n_neg, 1e-9) / ((n_pos + n_neg) * c / len(y))))
        good = (n_pos >= 2) & (n_pos / a > n_neg / c) & (ratio >= LEAST_RATIO)
        chosen = positive[good][np.argsort(-ratio[good], kind="stable")[:FEATURES]]
        chosen.sort()
        where = [np.searchsorted(chosen, np.intersect1d(b, chosen)) for b in bags]
        rows = np.repeat(np.arange(len(bags)), [len(w) for w in where])
        columns = np.concatenate([*where, np.zeros(0, np.int64)]).astype(np.int64)
        w, bias, g2 = np.zeros(len(chosen)), np.log(a / c), np.full(len(chosen), 1e-8)
        for _ in range(passes):  # full gradients with per-feature rates
            p = 1 / (1 + np.exp(-np.clip(np.bincount(rows, w[columns], len(y)) + bias, -50, 50)))
            gradient = np.bincount(columns, (p - y)[rows], len(chosen)) + 0.02 * w
            g2 += gradient**2
            w -= 0.5 * gradient / np.sqrt(g2)
            np.maximum(w, 0, out=w)
            bias -= 0.2 * (p - y).sum() / max(1.0, a)
        self.weights = {int(f): float(x) for f, x in zip(chosen, w, strict=True) if x > 0}
        self.intercept = float(bias)
        return self

    def score(self, found: Iterable[int]) -> float:
        if self.constant is not None:
            return self.constant
        z = self.intercept + sum(map(self.weights.__getitem__, found))
        return float(1 / (1 + np.exp(-min(500.0, max(-500.0, z)))))


class Scorer:
    """Scores whole texts; the features of frequent tokens are kept."""

    def __init__(self, model: CharModel, lexicon: Lexicon):
        restorer, weights = Restorer(model), lexicon.weights
        self.restorer, self.lexicon = restorer, lexicon

        class Tokens(dict):
            def __missing__(self, token: str) -> tuple[int, ...]:
                restored = restorer.word(token) if " " not in token else restorer.decode(token).split()
                found = tuple(f for word in restored for f in word_features(word) if f in weights)
                if len(self) < CACHED_WORDS and len(token) < 40:
                    self[token] = found
                return found

        self.tokens = Tokens()

    def __call__(self, text: str | None) -> float:
        found = {f for x in map(self.tokens.__getitem__, self.restorer.words(text or "")) if x for f in x}
        return self.lexicon.score(found)


def train(docs: DataFrame, labels: DataFrame, model: CharModel, label: str = "toxic", rows: int = TRAIN_DOCS) -> Lexicon:
    """Lexicon from a bounded sample of labelled rows that are not held out; tasks restore their texts."""
    spark = docs.sparkSession
    small_batches(spark)
    shared = spark.sparkContext.broadcast(model)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        restorer, cache = Restorer(shared.value), {}
        for batch in batches:
            bags = []
            for text in batch.column(0).to_pylist():
                bag: set[int] = set()
                for token in restorer.words(text or ""):
                    if token not in cache:
                        if len(cache) > CACHED_WORDS:
                            cache.clear()
                        restored = restorer.word(token) if " " not in token else restorer.decode(token).split()
                        cache[token] = [f for word in restored for f in word_features(word)]
                    bag.update(cache[token])
                bags.append(np.sort(np.fromiter(bag, np.uint32, len(bag))).tobytes())
            yield pa.record_batch([pa.array(bags, pa.binary()), batch.column(1), batch.column(2)], ["bag", "label", "doc_id"])

    sample = training_texts(docs, labels, label, rows).select("text", "label", "doc_id").mapInArrow(run, "bag binary, label int, doc_id long")
    got = sample.toArrow().sort_by("doc_id")
    return Lexicon().fit([np.frombuffer(b.as_buffer(), np.uint32) for b in got["bag"]], got["label"].to_pylist())


def score(docs: DataFrame, model: CharModel, lexicon: Lexicon, name: str = "score") -> DataFrame:
    """``docs`` with ``name``, the probability of class 1; a column that has the name is replaced."""
    shared = docs.sparkSession.sparkContext.broadcast((model, lexicon))

    def scorer():
        one = Scorer(*shared.value)
        return lambda texts: [one(t) for t in texts]

    return with_text_score(docs, name, scorer)


def toxicity(docs: DataFrame, labels: DataFrame, name: str = "score") -> DataFrame:
    """``docs`` with their toxicity score."""
    model = char_model(docs)
    return score(docs, model, train(docs, labels, model), name)


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity score of every document."""
    scored = toxicity(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "labels"))
    return scored.select("doc_id", (remainder(F.col("doc_id"), HELD_OUT_MODULUS) == 0).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
