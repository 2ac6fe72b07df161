"""SentencePiece encoding and decoding as a relational lattice.

A text is cut before each run of spaces (shown as word-begin marks), and between a letter and a sign that
stand side by side in no piece, where no piece can reach across; equal words are encoded once.  The
bounded substrings of each distinct word are exploded and equi-joined with the piece table, the edges that
match are grouped by word again, and the segmentation is folded over the edges of each word.  The public
vocabulary is of the byte-pair kind, for which a Viterbi recursion over its scores gives other pieces than
the library does (42 % of distinct words agree); so the fold applies merges instead: from single characters
on, the best-scored edge that joins two neighbouring pieces, the leftmost of equals.  The borders between
pieces are the bits of a 64-bit state.  A character that is no piece becomes its bytes.  The result is the
library's, which the tests check.

Explosion, join, grouping and fold run on columns of numpy inside Arrow batches of distinct words: as rows
and higher-order functions of Spark they took nearly three times the CPU seconds that there are (README).
The task that reads a document encodes the words that it has not met before, so texts are read once and
nothing is shuffled.

Words above ``LONG`` characters, whose borders do not fit the state, go through the same merges one at a
time, the next of them from a heap.

Defined results: null or empty text has no piece; repeated rows are encoded each; an empty table gives an
empty result; other columns are ignored; unknown ids decode to nothing.
"""

from __future__ import annotations

import heapq
import re
import zlib
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from basinsift.llm.common import portions, small_batches, table

MARK = "▁"
_CHUNK = re.compile(" +[^ ]*")
#: Longest piece in characters that is looked up, and the longest word that is folded over the lattice.
PIECE_CHARS, LONG = 16, 48
#: Distinct chunks that a task holds.
HELD_CHUNKS = 500_000


class Vocabulary:
    """Pieces with ids and scores, and ids of single bytes."""

    def __init__(self, path: str):
        self.path, model = path, self._library(path)
        self._word: re.Pattern | None = None
        self.pieces: dict[str, tuple[int, float]] = {}
        self.bytes = [0] * 256
        self.text: dict[int, bytes] = {}
        for i in range(model.get_piece_size()):
            piece = model.id_to_piece(i)
            if model.is_byte(i):
                self.bytes[int(piece[3:5], 16)] = i
                self.text[i] = bytes([int(piece[3:5], 16)])
            elif not (model.is_control(i) or model.is_unknown(i)):
                self.text[i] = piece.encode("utf-8")
                if len(piece) > PIECE_CHARS:
                    raise ValueError(f"piece of more than {PIECE_CHARS} characters")
                self.pieces[piece] = (i, model.get_score(i))

    @staticmethod
    def _library(path: str):
        import sentencepiece

        return sentencepiece.SentencePieceProcessor(model_file=path)

    def encode_long(self, words: list[str]) -> list[list[int]]:
        """Words of any length, one at a time: the same merges, the next of them from a heap."""
        return [self._merged(w) for w in words]

    def _merged(self, word: str) -> list[int]:
        ends, starts = list(range(1, len(word) + 1)), list(range(len(word)))  # of the piece that begins, or ends, at a place
        heap: list[tuple[float, int, int, int]] = []

        def meet(start: int, middle: int) -> None:
            if 0 <= start and middle < len(word) and (found := self.pieces.get(word[start : ends[middle]])):
                heapq.heappush(heap, (-found[1], start, middle, ends[middle]))

        for k in range(len(word) - 1):
            meet(k, k + 1)
        while heap:
            _, start, middle, end = heapq.heappop(heap)
            if ends[start] == middle and ends[middle] == end and starts[end - 1] == middle:
                ends[start], starts[end - 1], ends[middle] = end, start, -1
                meet(start, end)
                if start:
                    meet(starts[start - 1], start)
        ids, at = [], 0
        while at < len(word):
            found = self.pieces.get(word[at : ends[at]])
            ids += [found[0]] if found else [self.bytes[b] for b in word[at].encode("utf-8", "surrogatepass")]
            at = ends[at]
        return ids

    def _pattern(self) -> re.Pattern:
        """A word: begin marks and what follows up to a cut.  Signs that touch letters in some piece are no cuts."""
        pairs = {p[k : k + 2] for p in self.pieces for k in range(len(p) - 1)}
        before, after = {b for a, b in pairs if a.isalpha()}, {a for a, b in pairs if b.isalpha()}
        signs = [c for c in map(chr, range(1, 127)) if not c.isalnum() and c != " "]
        cut = f"(?<=[^\\W\\d_])(?=[{re.escape(''.join(c for c in signs if c not in before))}])|(?<=[{re.escape(''.join(c for c in signs if c not in after))}])(?=[^\\W\\d_])"
        return re.compile(f"(?={MARK})(?<!{MARK})|{cut}")

    def cut(self, chunk: str) -> list[str]:
        """The words of a chunk of ``chunks_of``."""
        if chunk[0] == " " and chunk[1:].isalpha():  # letters only hold no cut
            return [MARK + chunk[1:]]
        if self._word is None:
            self._word = self._pattern()
        return [w for w in self._word.split(chunk.replace(" ", MARK)) if w]

    def words_of(self, text: str | None) -> list[str]:
        """The words of a text."""
        return [w for chunk in chunks_of(text) for w in self.cut(chunk)]

    def __getstate__(self) -> dict:
        return self.__dict__ | {"_word": None}


def chunks_of(text: str | None) -> list[str]:
    """A text in runs of spaces with what follows each.  A mark in the text is a space to this encoding."""
    return _CHUNK.findall(" " + text.replace(MARK, " ")) if text else []


class Lattice:
    """Encodes batches of words column by column; holds the piece table as its beginnings.

    A beginning is known by the beginning that is one shorter and its last character, so substrings are
    joined with the table on an exact key, and those that begin no piece are lengthened no further.
    """

    def __init__(self, vocabulary: Vocabulary):
        step: dict[int, int] = {}
        ids, scores = [-1], [0.0]
        for piece, (i, score) in vocabulary.pieces.items():
            at = 0
            for c in piece:
                at = step.setdefault(at << 21 | ord(c), len(ids))
                if at == len(ids):
                    ids.append(-1)
                    scores.append(0.0)
            ids[at], scores[at] = i, score
        self.keys = np.array(sorted(step), np.int64)
        self.next = np.array([step[k] for k in self.keys.tolist()], np.int64)
        self.ids = np.array(ids, np.int32)
        # Place in descending order of scores; equal scores share one.
        self.rank = np.unique(-np.array(scores), return_inverse=True)[1].astype(np.int64)
        self.bytes = np.array(vocabulary.bytes, np.int32)

    def _explode(self, chars: np.ndarray, end: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """``length, start, beginning`` of all substrings that are pieces; ``end`` is that of the word of each character."""
        at, begun = np.arange(len(chars)), np.zeros(len(chars), np.int64)
        for length in range(1, PIECE_CHARS + 1):
            fits = at + length <= end[at]
            at, begun = at[fits], begun[fits]
            key = begun << 21 | chars[at + length - 1]
            found = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            joined = self.keys[found] == key
            at, begun = at[joined], self.next[found[joined]]
            piece = self.ids[begun] >= 0
            yield length, at[piece], begun[piece]

    @staticmethod
    def _fold(borders: np.ndarray, edges: np.ndarray) -> None:
        """Merges until nothing joins.  ``edges`` are sorted, packed as word, rank, start and length, so a word's best edge comes first."""
        word, start, length = edges >> 31, (edges >> 5 & 63).astype(np.uint64), (edges & 31).astype(np.uint64)
        one = np.uint64(1)
        ends = one << start | one << start + length
        within = (one << start + length) - (one << start + one)
        while len(word):
            now = borders[word]
            left = np.bitwise_count(now & within)
            lives = (now & ends == ends) & (left > 0)
            ready = np.flatnonzero(lives & (left == 1))
            best = ready[np.diff(word[ready], prepend=-1) != 0]
            borders[word[best]] &= ~within[best]
            # A word without a merge stays as it is from now on.
            goes_on = np.zeros(len(borders), bool)
            goes_on[word[best]] = True
            lives &= goes_on[word]
            word, ends, within = word[lives], ends[lives], within[lives]

    def encode(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all words in a row, and where each word's ids begin (and the last one's end)."""
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        begin = np.cumsum(sizes) - sizes
        chars = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
        word, end = np.repeat(np.arange(len(words)), sizes), np.repeat(begin + sizes, sizes)
        place = np.arange(len(chars)) - begin[word]
        piece = np.full((PIECE_CHARS + 1, len(chars)), -1, np.int32)
        edges = []
        for length, at, begun in self._explode(chars, end):
            piece[length, at] = self.ids[begun]
            if length > 1:
                edges.append(word[at] << 31 | self.rank[begun] << 11 | place[at] << 5 | length)
        borders = (np.uint64(1) << (sizes + 1).astype(np.uint64)) - np.uint64(1)
        self._fold(borders, np.sort(np.concatenate(edges)))
        starts = np.flatnonzero(borders[word] >> place.astype(np.uint64) & np.uint64(1))
        found = piece[np.diff(starts, append=len(chars)), starts]
        unknown = found < 0
        lost = chars[starts[unknown]]
        slots = np.ones(len(starts), np.int64)
        slots[unknown] += (lost > 0x7F).astype(np.int64) + (lost > 0x7FF) + (lost > 0xFFFF)
        ids = np.repeat(found, slots)
        ids[ids < 0] = self.bytes[np.frombuffer(lost.astype("<u4").tobytes().decode("utf-32-le", "surrogatepass").encode("utf-8", "surrogatepass"), np.uint8)]
        bounds = np.zeros(len(words) + 1, np.int64)
        np.cumsum(np.bincount(word[starts], slots, len(words)).astype(np.int64), out=bounds[1:])
        return ids, bounds


def spans(begin: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Positions of runs that begin at ``begin`` and are ``size`` long, one after the other."""
    return np.repeat(begin - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))


def sums_by(bounds: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Sum of the values between neighbouring bounds."""
    return np.diff(np.concatenate([[0], np.cumsum(values)])[bounds])


class Portion:
    """Some encoded texts: ids and words in a row, and where each text's begin (and the last one's end)."""

    def __init__(self, ids: np.ndarray, bounds: np.ndarray, word_sizes: np.ndarray, word_sums: np.ndarray, word_bounds: np.ndarray):
        self.ids, self.bounds = ids, bounds
        #: Number of ids of each word and crc32 of these, as little-endian 32-bit numbers.
        self.word_sizes, self.word_sums, self.word_bounds = word_sizes, word_sums, word_bounds


class Coder:
    """Encodes words, and whole texts, in a task.

    Chunks that were met are numbered; their words, and the words' ids, lie in a row.  At most ``held``
    chunks, of at most sixteen characters on average, are kept from one portion of texts to the next.
    """

    def __init__(self, vocabulary: Vocabulary, held: int = HELD_CHUNKS):
        self.vocabulary, self.lattice, self.held = vocabulary, Lattice(vocabulary), held
        self.bytes = np.zeros(max(vocabulary.text) + 2, np.int64)
        self.bytes[vocabulary.bytes] = 1
        self._forget()

    def _forget(self) -> None:
        self.known: dict[str, int] = {}
        self.chars = 0
        self.ids, self.word_begin, self.word_size, self.word_sum = np.empty(0, np.int32), *(np.empty(0, np.int64) for _ in range(3))
        self.first, self.count = np.empty(0, np.int64), np.empty(0, np.int64)

    def words(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all words in a row and the bounds of each word's; those above ``LONG`` characters one at a time."""
        long = {k for k, w in enumerate(words) if len(w) > LONG}
        if not long:
            return self.lattice.encode(words)
        ids, bounds = self.lattice.encode([w for k, w in enumerate(words) if k not in long])
        short = iter(np.split(ids, bounds[1:-1]))
        parts = [np.array(self.vocabulary.encode_long([w])[0], np.int32) if k in long else next(short) for k, w in enumerate(words)]
        return np.concatenate(parts), np.concatenate([[0], np.cumsum([len(p) for p in parts])])

    def _learn(self, chunks: list[str]) -> None:
        """Numbers new chunks and encodes their words: most are a mark and letters, which is one word."""
        whole = [c[0] == " " and c[1:].isalpha() for c in chunks]
        words = [MARK + c[1:] for c, one in zip(chunks, whole, strict=True) if one]
        place = {w: k for k, w in enumerate(words)}
        cut = [[] if one else self.vocabulary.cut(c) for c, one in zip(chunks, whole, strict=True)]
        for w in (w for own in cut for w in own):
            if w not in place:
                place[w] = len(words)
                words.append(w)
        ids, bounds = self.words(words)
        raw, edge, crc = ids.astype("<u4").tobytes(), (4 * bounds).tolist(), zlib.crc32
        sums = np.fromiter((crc(raw[a:b]) for a, b in zip(edge, edge[1:], strict=False)), np.int64, len(words))
        ones = iter(range(len(words)))
        of = np.array([w for one, own in zip(whole, cut, strict=True) for w in ([next(ones)] if one else map(place.__getitem__, own))], np.int64)
        count = np.fromiter((1 if one else len(own) for one, own in zip(whole, cut, strict=True)), np.int64, len(chunks))
        self.known.update(zip(chunks, range(len(self.known), len(self.known) + len(chunks)), strict=True))
        self.first = np.concatenate([self.first, len(self.word_begin) + np.cumsum(count) - count])
        self.count = np.concatenate([self.count, count])
        self.word_begin = np.concatenate([self.word_begin, len(self.ids) + bounds[of]])
        self.word_size = np.concatenate([self.word_size, np.diff(bounds)[of]])
        self.word_sum = np.concatenate([self.word_sum, sums[of]])
        self.ids = np.concatenate([self.ids, ids])

    def texts(self, texts: list[str | None]) -> Portion:
        cut = [chunks_of(t) for t in texts]
        every = [c for doc in cut for c in doc]
        if len(self.known) > self.held or self.chars > 16 * self.held:
            self._forget()
        known = self.known
        if new := list(dict.fromkeys([c for c in every if c not in known])):
            self._learn(new)
            self.chars += sum(map(len, new))
        at = np.fromiter(map(known.__getitem__, every), np.int64, len(every))
        count = self.count[at]
        words = spans(self.first[at], count)
        sizes = self.word_size[words]
        ids = self.ids[spans(self.word_begin[words], sizes)]
        chunk_bounds = np.cumsum([0, *map(len, cut)])
        word_bounds = np.concatenate([[0], np.cumsum(count)])[chunk_bounds]
        found = Portion(ids, np.concatenate([[0], np.cumsum(sizes)])[word_bounds], sizes, self.word_sum[words], word_bounds)
        return found


def _shared_coder(spark: SparkSession, vocabulary: Vocabulary, held: int = HELD_CHUNKS) -> Callable[[], Coder]:
    shared = spark.sparkContext.broadcast(vocabulary)
    return lambda: Coder(shared.value, held)


def encode_words(words: DataFrame, vocabulary: Vocabulary) -> DataFrame:
    """``word, n, ids`` of distinct words."""
    small_batches(words.sparkSession)
    coder = _shared_coder(words.sparkSession, vocabulary)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = coder()
        for batch in batches:
            if batch.num_rows:
                ids, bounds = own.words(batch.column(0).to_pylist())
                found = pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(ids, pa.int32()))
                yield pa.record_batch([batch.column(0), batch.column(1), found], ["word", "n", "ids"])

    return words.select("word", "n").mapInArrow(run, "word string, n long, ids array<int>")


def decode_ids(encoded: DataFrame, vocabulary: Vocabulary, key: str) -> DataFrame:
    """``key, text``: ids joined with the piece table and put together in order."""
    spark = encoded.sparkSession
    pieces = F.broadcast(spark.createDataFrame([(i, bytearray(b)) for i, b in vocabulary.text.items()], "id int, bytes binary"))
    rows = encoded.select(key, F.posexplode_outer("ids").alias("at", "id")).join(pieces, "id", "left")
    parts = rows.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("at", F.hex("bytes").alias("h")))).alias("parts"))
    text = F.decode(F.unhex(F.array_join(F.transform("parts", lambda p: F.coalesce(p.h, F.lit(""))), "")), "UTF-8")
    # The first mark is the one that encoding added.
    return parts.select(key, F.regexp_replace(F.replace(text, F.lit(MARK), F.lit(" ")), "^ ", "").alias("text"))


def _texts(docs: DataFrame) -> DataFrame:
    small_batches(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))


def encode_documents(docs: DataFrame, vocabulary: Vocabulary, held: int = HELD_CHUNKS) -> DataFrame:
    """A row for each row of ``docs``: ``doc_id, ids, word_ends, decoded, exact``.

    ``ids`` are the document's ids in order, ``word_ends`` says where each word's end, ``decoded`` is the
    text that the ids give and ``exact`` whether that is the text, a mark read as a space.  Texts are read
    once and never shuffled; a task encodes each distinct chunk that it meets once while it holds it.
    """
    coder = _shared_coder(docs.sparkSession, vocabulary, held)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = coder()
        back = Decoder(own.vocabulary.text)
        for batch in (p for b in batches for p in portions(b)):
            texts = batch.column(1).to_pylist()
            found = own.texts(texts)
            data = back(found.ids, found.bounds)
            ends = np.cumsum(found.word_sizes) - np.repeat(found.bounds[:-1], np.diff(found.word_bounds))
            columns = [
                batch.column(0), *(pa.ListArray.from_arrays(pa.array(b, pa.int32()), pa.array(x, pa.int32())) for b, x in ((found.bounds, found.ids), (found.word_bounds, ends))),
                pa.array([d.decode("utf-8", "replace") for d in data], pa.string()), pa.array([d == plain_bytes(t) for d, t in zip(data, texts, strict=True)], pa.bool_()),
            ]
            yield pa.record_batch(columns, ["doc_id", "ids", "word_ends", "decoded", "exact"])

    return _texts(docs).mapInArrow(run, "doc_id long, ids array<int>, word_ends array<int>, decoded string, exact boolean")


class Decoder:
    """Texts of ids in UTF-8, without the mark that encoding added before them; unknown ids give nothing."""

    def __init__(self, text: dict[int, bytes]):
        parts = [text.get(i, b"").replace(MARK.encode(), b" ") for i in range(max(text, default=0) + 2)]
        self.flat = np.frombuffer(b"".join(parts), np.uint8)
        self.sizes = np.fromiter(map(len, parts), np.int64, len(parts))
        self.begin = np.cumsum(self.sizes) - self.sizes

    def __call__(self, ids: np.ndarray, bounds: np.ndarray) -> list[bytes]:
        ids = np.minimum(ids.astype(np.int64), len(self.sizes) - 1)
        sizes = self.sizes[ids]
        data = self.flat[spans(self.begin[ids], sizes)].tobytes()
        edge = np.concatenate([[0], np.cumsum(sizes)])[bounds].tolist()
        return [data[a + 1 : b] for a, b in zip(edge, edge[1:], strict=False)]


def decode_bytes(ids: list[int], piece: dict[int, bytes]) -> bytes:
    """The text of a document's ids in UTF-8."""
    return Decoder(piece)(np.array(ids, np.int64), np.array([0, len(ids)]))[0]


def plain_bytes(text: str | None) -> bytes:
    """What the ids of a text should decode to: a mark counts as a space."""
    return (text or "").replace(MARK, " ").encode("utf-8", "surrogatepass")


def encode(docs: DataFrame, vocabulary: Vocabulary, held: int = HELD_CHUNKS) -> DataFrame:
    """A row for each row of ``docs``: ``doc_id, n_words, n_pieces, n_bytes, ids_checksum, exact``, from the ids of the document.

    ``n_bytes`` counts pieces that are single bytes, ``ids_checksum`` is the sum over words of the crc32 of
    the word's ids (32-bit, little-endian) times the word's place from 1, modulo 2^61 - 1, and ``exact``
    tells whether the ids decode to the document's text.
    """
    coder, prime = _shared_coder(docs.sparkSession, vocabulary, held), (1 << 61) - 1

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = coder()
        back = Decoder(own.vocabulary.text)
        for batch in (p for b in batches for p in portions(b)):
            texts = batch.column(1).to_pylist()
            found = own.texts(texts)
            n_words, n_pieces = np.diff(found.word_bounds), np.diff(found.bounds)
            place = np.arange(1, len(found.word_sums) + 1) - np.repeat(found.word_bounds[:-1], n_words)
            weighed = found.word_sums * place  # below 2^63: a portion has fewer than 2^31 words
            high, low = (sums_by(found.word_bounds, x).tolist() for x in (weighed >> 32, weighed & 0xFFFFFFFF))
            checksum = [((h << 32) + x) % prime for h, x in zip(high, low, strict=True)]
            exact = [d == plain_bytes(t) for d, t in zip(back(found.ids, found.bounds), texts, strict=True)]
            columns = [pa.array(c, pa.int64()) for c in (n_words, n_pieces, sums_by(found.bounds, own.bytes[found.ids]), checksum)]
            yield pa.record_batch([batch.column(0), *columns, pa.array(exact, pa.bool_())], ["doc_id", "n_words", "n_pieces", "n_bytes", "ids_checksum", "exact"])

    return _texts(docs).mapInArrow(run, "doc_id long, n_words long, n_pieces long, n_bytes long, ids_checksum long, exact boolean")


def op8_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Piece counts, id checksum and exactness of decoding of every document."""
    import public_tokenizers

    return encode(table(spark, sf_dir, "documents"), Vocabulary(public_tokenizers.path("piece_bpe_32k.model")))
