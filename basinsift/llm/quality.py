"""Quality classifier: supervised subword embeddings, trained by stochastic gradient descent in numpy.

Words and character n-grams (over UTF-8 bytes, with word boundaries) are hashed into buckets, each bucket
has a learned vector, a document is the average of its features' vectors, and a softmax over two classes
gives the score.  A word that repeats the one before it adds a feature of its own.  Because average and
output layer are linear, scoring needs one number for each bucket; whole texts are scored.

Defined results: null or empty text has no feature and the score of an all-zero vector; repeated rows are
scored alike; without labels of both classes the score is their mean, without any 0.5; an empty table
gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterable

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from basinsift.llm.common import remainder, small_batches, table, with_text_score
from basinsift.llm.labelled import HELD_OUT_MODULUS, training_texts

BUCKETS = 1 << 18
DIM = 16
NGRAMS = (3, 4, 5)
TRAIN_DOCS = 3000
#: Least number of gradient steps; at least four passes over the sample.
STEPS = 12_000
RATE = 1.0
THRESHOLD = 0.3
SEED = 9
#: Bytes hashed at once.
SLICE = 1 << 20
_SPACES = bytes(32 if c in b"\t\n\x0b\x0c\r " else c for c in range(256))
_MIX = np.random.default_rng(SEED).integers(1, 1 << 32, 256, dtype=np.uint64) | np.uint64(1)
_POWERS = np.cumprod(np.full(256, 0x9E3779B97F4A7C15, np.uint64))


def _bucket(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return (h >> np.uint64(40)).astype(np.int64) & (BUCKETS - 1)


def features(data: bytes) -> list[tuple[np.ndarray, np.ndarray]]:
    """``(position, bucket)`` arrays of all features of space-separated bytes; a position lies inside its document."""
    b = np.frombuffer(data, np.uint8)
    if not len(b):
        return []
    mixed, gap = _MIX[b], b == 32
    found = []
    for n in NGRAMS:
        if len(b) < n:
            continue
        h, inner = np.zeros(len(b) - n + 1, np.uint64), np.zeros(len(b) - n + 1, bool)
        for k in range(n):
            h = h * np.uint64(0x100000001B3) + mixed[k : len(b) - n + 1 + k]
            if 0 < k < n - 1:
                inner |= gap[k : len(b) - n + 1 + k]
        at = np.nonzero(~inner)[0]
        found.append((at + 1, _bucket(h[at] + np.uint64(n))))
    start = np.nonzero(~gap & np.r_[True, gap[:-1]])[0]
    if len(start):
        place = np.arange(len(b)) - np.repeat(start, np.diff(np.r_[start, len(b)])) if start[0] == 0 else np.r_[np.zeros(start[0], np.int64), np.arange(start[0], len(b)) - np.repeat(start, np.diff(np.r_[start, len(b)]))]
        word = np.add.reduceat(np.where(gap, np.uint64(0), mixed * _POWERS[place & 255]), start)
        found.append((start, _bucket(word)))
        same = np.r_[False, word[1:] == word[:-1]]
        found.append((start, np.where(same, BUCKETS, BUCKETS + 1)))
    return found


def joined(texts: list[str | None]) -> tuple[bytes, np.ndarray]:
    """The texts' bytes with single-space boundaries, and where each text begins; three spaces keep features inside their text."""
    parts = [b"  " + (t or "").encode("utf-8", "surrogatepass").translate(_SPACES) + b" " for t in texts]
    return b"".join(parts), np.cumsum([0, *map(len, parts)])


def sums(texts: list[str | None], weight: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Per text: the sum of its features' weights and their number.  Features of different texts never mix."""
    total, count = np.zeros(len(texts)), np.zeros(len(texts))
    at = 0
    while at < len(texts):
        end, size = at, 0
        while end < len(texts) and (end == at or size + len(texts[end] or "") < SLICE):
            size += len(texts[end] or "")
            end += 1
        data, starts = joined(texts[at:end])
        for position, bucket in features(data):
            doc = np.searchsorted(starts, np.minimum(position, len(data) - 1), "right") - 1
            total[at:end] += np.bincount(doc, weight[bucket], end - at)
            count[at:end] += np.bincount(doc, minlength=end - at)
        at = end
    return total, count


def bag(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Distinct buckets of a text and their shares."""
    data, _ = joined([text])
    found = [b for _, b in features(data)]
    bucket, n = np.unique(np.concatenate(found) if found else np.zeros(0, np.int64), return_counts=True)
    return bucket.astype(np.int32), (n / max(1, n.sum())).astype(np.float32)


class SubwordClassifier:
    def __init__(self, seed: int = SEED):
        rng = np.random.default_rng(seed)
        self.vectors = rng.uniform(-1 / DIM, 1 / DIM, (BUCKETS + 2, DIM)).astype(np.float32)
        self.output = np.zeros((2, DIM), np.float32)
        self.bias = np.zeros(2, np.float32)
        self.constant: float | None = None

    def fit(self, texts: Iterable[str], labels: Iterable[int], steps: int = STEPS, rate: float = RATE, seed: int = SEED) -> SubwordClassifier:
        labels = np.array(list(labels), np.int64)
        if len(np.unique(labels)) < 2:
            self.constant = float(labels.mean()) if len(labels) else 0.5
            return self
        bags = [bag(t) for t in texts]
        rng = np.random.default_rng(seed)
        epochs = max(4, -(-steps // len(labels)))
        steps, done = epochs * len(labels), 0
        for _ in range(epochs):
            for k in rng.permutation(len(labels)):
                bucket, share = bags[k]
                step = rate * (1 - done / steps)
                done += 1
                rows = self.vectors[bucket]
                hidden = share @ rows
                z = self.output @ hidden + self.bias
                p = np.exp(z - z.max())
                p /= p.sum()
                p[labels[k]] -= 1
                back = p @ self.output
                self.output -= step * np.outer(p, hidden)
                self.bias -= step * 0.1 * p
                # The shares of a document sum to 1; their squares set how far one step moves its average.
                if len(bucket):
                    self.vectors[bucket] = rows - (step / float(share @ share) * 0.5 * share)[:, None] * back
        return self

    def bucket_weights(self) -> tuple[np.ndarray, float]:
        """Log-odds of class 1 that each feature adds to the average, and the intercept."""
        return (self.vectors @ (self.output[1] - self.output[0])).astype(np.float64), float(self.bias[1] - self.bias[0])


def score_texts(texts: list[str | None], weight: np.ndarray, intercept: float, constant: float | None) -> np.ndarray:
    if constant is not None:
        return np.full(len(texts), constant)
    total, count = sums(texts, weight)
    return 1 / (1 + np.exp(-np.clip(total / np.maximum(count, 1) + intercept, -500, 500)))


def train(docs: DataFrame, labels: DataFrame, label: str = "quality", rows: int = TRAIN_DOCS) -> SubwordClassifier:
    """Classifier from a bounded sample of labelled rows that are not held out."""
    small_batches(docs.sparkSession)
    sample = training_texts(docs, labels, label, rows).toArrow().sort_by("doc_id")  # bounded rows and bytes
    return SubwordClassifier().fit(sample["text"].to_pylist(), sample["label"].to_pylist())


def score(docs: DataFrame, model: SubwordClassifier, name: str = "score") -> DataFrame:
    """``docs`` with ``name``, the probability of class 1; a column that has the name is replaced."""
    weight, intercept = (None, 0.0) if model.constant is not None else model.bucket_weights()
    shared = docs.sparkSession.sparkContext.broadcast((weight, intercept, model.constant))
    return with_text_score(docs, name, lambda: lambda texts: score_texts(texts, *shared.value))


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality score of every document."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    scored = score(docs, train(docs, table(spark, sf_dir, "labels")))
    return scored.select("doc_id", (remainder(F.col("doc_id"), HELD_OUT_MODULUS) == 0).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
