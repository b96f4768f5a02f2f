"""LM scoring: the probability of a text, summed over all segmentations into vocabulary pieces.

The vocabulary is an existing one, a SentencePiece model file; its scores give
the first weights of the pieces.  The weights are then fitted to the training
texts: each round runs forward and backward over every distinct word's lattice
and adds up expected piece counts, weighted by how often the word occurs.  A
piece never spans a space, so a text's marginal probability is the product of
its words' marginals and an end symbol, and each distinct word's lattice is
worked once for the whole corpus, not once per occurrence.

The base score is an add-0.1 unigram model over whole words.

Word tables grow with the corpus and are never gathered: the most frequent
words, at most ``HELD_WORDS``, are held by every task; a document's other words
meet the word table in a join, and sums come back per document.

Defined results: a NULL text is empty and has one token, the end; characters
that no piece holds are spelt by byte pieces; with no training text all base
scores are 0; repeated rows are counted and scored row by row; other columns
are not read.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from prospectra.llm.common import crc_remainder, in_runs, in_slices, ready_for_python, row_keys
from prospectra.session import write_and_read_back

ROUNDS = 2
SMOOTHING = 0.01
HELD_WORDS = 120_000
COUNTED_WORDS = 400_000
WORDS_AT_ONCE = 20_000
LONGEST_PIECE = 16
START = "▁"    # stands before a word, as in the vocabulary


def default_vocabulary() -> str:
    import public_tokenizers
    return public_tokenizers.path("piece_bpe_32k.model")


_FACTOR = np.uint64(0x9E3779B97F4A7C15)
_MIXES = tuple(np.uint64(m) for m in (0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3))
_SLOT_BITS = 17


class PieceTable:
    """Piece numbers of many substrings at once, by 64-bit hashes of their code points.

    Each piece has its own slot in one of a few small tables; pieces whose
    slot is taken go to the next table.
    """

    def __init__(self, number: dict[str, int]) -> None:
        texts = list(number)
        self._hash = np.array([self.hash_of(t) for t in texts], np.uint64)
        if len(np.unique(self._hash)) < len(texts):
            raise ValueError("two pieces share a hash")
        self._number = np.array([number[t] for t in texts], np.int64)
        self._tables = []
        left = np.arange(len(texts))
        for mix in _MIXES:
            table = np.full(1 << _SLOT_BITS, -1, np.int64)
            slots = self._slots(self._hash[left], mix)
            table[slots[::-1]] = left[::-1]
            self._tables.append((mix, table))
            left = left[table[slots] != left]
        if len(left):
            raise ValueError("more pieces than the tables hold")

    @staticmethod
    def hash_of(text: str) -> int:
        h = 0
        for char in text:
            h = (h * int(_FACTOR) + ord(char) + 1) % (1 << 64)
        return h

    @staticmethod
    def _slots(hashes: np.ndarray, mix: np.uint64) -> np.ndarray:
        return ((hashes ^ (hashes >> np.uint64(31))) * mix) >> np.uint64(64 - _SLOT_BITS)

    def numbers(self, hashes: np.ndarray) -> np.ndarray:
        """The piece of each hash, -1 where there is none."""
        out = np.full(hashes.shape, -1, np.int64)
        for mix, table in self._tables:
            at = table[self._slots(hashes, mix)]
            hit = (at >= 0) & (self._hash[at] == hashes)
            out[hit] = self._number[at[hit]]
        return out

    def substrings(self, codes: np.ndarray) -> np.ndarray:
        """Piece numbers ``[word, start, length - 1]`` of equally long words, given as rows of code points."""
        words, size = codes.shape
        hashes = np.zeros((words, size), np.uint64)
        out = np.full((words, size, LONGEST_PIECE), -1, np.int64)
        for length in range(1, min(size, LONGEST_PIECE) + 1):
            starts = size - length + 1
            hashes = hashes[:, :starts] * _FACTOR + codes[:, length - 1:] + np.uint64(1)
            out[:, :starts, length - 1] = self.numbers(hashes)
        return out


@dataclass
class Pieces:
    """Piece numbers by text, the pieces of single bytes, and the scores they come with."""
    number: dict[str, int]
    byte: list[int]
    scores: np.ndarray
    table: PieceTable

    def first_weights(self) -> np.ndarray:
        """Log weights from the vocabulary's scores, which fall by one per rank: 1 / (rank + 3), to sum 1."""
        rank = np.clip(-self.scores, 0, len(self.scores))
        weight = 1 / (rank + 3)
        return np.log(weight / weight.sum())


@lru_cache(maxsize=2)
def pieces(vocabulary: str) -> Pieces:
    import sentencepiece
    model = sentencepiece.SentencePieceProcessor(model_file=vocabulary)
    number, byte, scores = {}, [0] * 256, np.full(model.vocab_size(), -float(model.vocab_size()))
    for i in range(model.vocab_size()):
        piece = model.id_to_piece(i)
        if model.is_byte(i):
            byte[int(piece[3:5], 16)] = i
        elif not (model.is_control(i) or model.is_unknown(i) or model.is_unused(i)):
            number[piece] = i
            scores[i] = model.get_score(i)
    return Pieces(number, byte, scores, PieceTable({t: n for t, n in number.items() if len(t) <= LONGEST_PIECE}))


class Lattice:
    """Forward and backward sums over the segmentations of many words of one length at once."""
    CELLS = 2_000_000

    def __init__(self, vocabulary: Pieces, log_weights: np.ndarray) -> None:
        self._vocabulary, self._weights = vocabulary, log_weights

    def groups(self, words: list[str]) -> Iterator[list[int]]:
        """Places of words of equal length, in groups of bounded size."""
        by_length: dict[int, list[int]] = {}
        for i, w in enumerate(words):
            by_length.setdefault(len(w), []).append(i)
        for length, places in by_length.items():
            most = max(1, self.CELLS // ((length + 1) * LONGEST_PIECE))
            for at in range(0, len(places), most):
                yield places[at:at + most]

    def edges(self, words: list[str]) -> tuple[np.ndarray, np.ndarray, list[list[int]]]:
        """Piece numbers and log weights of all substrings of the (equally long) marked words,
        ``[word, start, length - 1]``, and the byte pieces behind numbers beyond the vocabulary."""
        marked = [START + w for w in words]
        codes = np.frombuffer("".join(marked).encode("utf-32-le", "surrogatepass"), np.uint32)
        number = self._vocabulary.table.substrings(codes.reshape(len(marked), -1).astype(np.uint64))
        known, spelt = len(self._weights), {}
        for w, i in zip(*np.nonzero(number[:, :, 0] < 0)):
            char = marked[w][i]
            number[w, i, 0] = spelt.setdefault(char, known + len(spelt))
        behind = [[self._vocabulary.byte[b] for b in c.encode("utf-8", "surrogatepass")] for c in spelt]
        table = np.concatenate([self._weights, [self._weights[b].sum() for b in behind], [-np.inf]])
        return number, table[number], behind

    @staticmethod
    def _sum(terms: np.ndarray) -> np.ndarray:
        top = terms.max(axis=1)
        return top + np.log(np.exp(terms - top[:, None]).sum(axis=1))

    def forward(self, weight: np.ndarray) -> np.ndarray:
        """Log sums of all ways to reach each place; single characters always have an edge."""
        size = weight.shape[1]
        reach = np.zeros((len(weight), size + 1))
        for j in range(1, size + 1):
            i = np.arange(max(0, j - LONGEST_PIECE), j)
            reach[:, j] = self._sum(reach[:, i] + weight[:, i, j - i - 1])
        return reach

    def backward(self, weight: np.ndarray) -> np.ndarray:
        size = weight.shape[1]
        rest = np.zeros((len(weight), size + 1))
        for i in range(size - 1, -1, -1):
            j = np.arange(i + 1, min(size, i + LONGEST_PIECE) + 1)
            rest[:, i] = self._sum(rest[:, j] + weight[:, i, j - i - 1])
        return rest

    def log_probabilities(self, words: list[str]) -> np.ndarray:
        """The natural log of each word's marginal probability."""
        out = np.zeros(len(words))
        for places in self.groups(words):
            _, weight, _ = self.edges([words[p] for p in places])
            out[places] = self.forward(weight)[:, -1]
        return out

    def expected_counts(self, words: list[str], times: np.ndarray) -> np.ndarray:
        """How often each piece is expected in the words, each counted ``times``."""
        total = np.zeros(len(self._weights))
        for places in self.groups(words):
            number, weight, behind = self.edges([words[p] for p in places])
            reach, rest = self.forward(weight), self.backward(weight)
            size = weight.shape[1]
            ends = np.minimum(np.arange(size)[:, None] + np.arange(1, LONGEST_PIECE + 1), size)
            share = np.exp(reach[:, :size, None] + weight + rest[:, ends] - reach[:, -1, None, None])
            share *= times[places][:, None, None]
            there = number >= 0
            counts = np.bincount(number[there], share[there], len(total) + len(behind))
            total += counts[:len(total)]
            for parts, n in zip(behind, counts[len(total):]):
                np.add.at(total, parts, n)
        return total


# Corpus tables -------------------------------------------------------------

def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").lower().split()


def _read(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    """doc_id, held_out (crc32 of the id as text is 0 modulo 10), text."""
    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), (crc_remainder(doc_id, 10) == 0).alias("held_out"),
                       F.col(text).cast("string").alias("text"))


def _count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counts of a task's texts, sent on whenever ``COUNTED_WORDS`` distinct words have come together."""
    train: Counter[bytes] = Counter()
    rest: Counter[bytes] = Counter()

    def sent() -> pa.RecordBatch:
        words = list(train.keys() | rest.keys())
        return pa.RecordBatch.from_arrays(
            [pa.array([w.decode("utf-8", "replace") for w in words], pa.string()),
             pa.array([train[w] for w in words], pa.int64()), pa.array([rest[w] for w in words], pa.int64())],
            ["word", "in_train", "in_rest"])

    for batch in in_slices(batches, 2):
        for held_out, text in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
            (rest if held_out else train).update(words_of(text))
        if len(train) + len(rest) > COUNTED_WORDS:
            yield sent()
            train.clear()
            rest.clear()
    yield sent()


def word_counts(rows: DataFrame) -> DataFrame:
    """A written table (word, in_train, in_rest) of all distinct words, counted per batch before the shuffle."""
    return write_and_read_back(
        rows.mapInArrow(_count, "word string, in_train long, in_rest long")
        .groupBy("word").agg(F.sum("in_train").alias("in_train"), F.sum("in_rest").alias("in_rest")), "word-counts")


@dataclass
class Model:
    """What the scores need besides the word table: piece weights and the training totals."""
    vocabulary: str
    log_weights: np.ndarray
    log_end: float
    train_tokens: int
    train_distinct: int
    train_docs: int

    def base_log10(self, count: int) -> float:
        return math.log10((count + 0.1) / (self.train_tokens + 0.1 * (self.train_distinct + 1)))


def fit(rows: DataFrame, words: DataFrame, vocabulary: str | None = None, rounds: int = ROUNDS) -> Model:
    """Piece weights by ``rounds`` of expected counts over all training words.

    Each round sends one number per piece and task, and the vocabulary's worth
    of numbers to the driver.
    """
    vocabulary = vocabulary or default_vocabulary()
    known = words.where("in_train > 0").agg(F.sum("in_train").alias("n"), F.count("*").alias("v")).first()
    train_docs = rows.where(~F.col("held_out")).count()
    found = pieces(vocabulary)
    occurrences = known["n"] or 0
    log_weights = found.first_weights()
    log_end = math.log(1 / (2 + occurrences / max(train_docs, 1)))
    for _ in range(rounds if occurrences else 0):
        expected = _expected(words, vocabulary, log_weights)
        total = expected.sum() + SMOOTHING * len(expected) + train_docs
        log_weights = np.log((expected + SMOOTHING) / total)
        log_end = math.log(max(train_docs, SMOOTHING) / total)
    return Model(vocabulary, log_weights, log_end, occurrences + train_docs, known["v"] + (train_docs > 0), train_docs)


def _expected(words: DataFrame, vocabulary: str, log_weights: np.ndarray) -> np.ndarray:
    weights = words.sparkSession.sparkContext.broadcast(log_weights)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lattice = Lattice(pieces(vocabulary), weights.value)
        total = np.zeros(len(weights.value))
        for batch in in_runs(batches, WORDS_AT_ONCE):
            total += lattice.expected_counts(batch.column(0).to_pylist(), batch.column(1).to_numpy().astype(float))
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], ["piece", "n"])

    sums = (words.where("in_train > 0").select("word", "in_train").mapInArrow(run, "piece long, n double")
            .groupBy("piece").agg(F.sum("n").alias("n")).toArrow())
    out = np.zeros(len(log_weights))
    out[sums.column("piece").to_numpy()] = sums.column("n").to_numpy()
    return out


def word_scores(words: DataFrame, model: Model) -> DataFrame:
    """A written table (word, uses, known, base, score): log10 values of one occurrence of each word."""
    weights = words.sparkSession.sparkContext.broadcast(model.log_weights)
    vocabulary = model.vocabulary

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lattice = Lattice(pieces(vocabulary), weights.value)
        for batch in in_runs(batches, WORDS_AT_ONCE):
            score = lattice.log_probabilities(batch.column(0).to_pylist()) / math.log(10)
            train = batch.column(1).to_numpy()
            uses = train + batch.column(2).to_numpy()
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(uses), pa.array((train > 0).astype(np.int64)), batch.column(1), pa.array(score)],
                ["word", "uses", "known", "in_train", "score"])

    scored = words.select("word", "in_train", "in_rest").mapInArrow(
        run, "word string, uses long, known long, in_train long, score double")
    base = F.log10((F.col("in_train") + 0.1) / (model.train_tokens + 0.1 * (model.train_distinct + 1)))
    return write_and_read_back(scored.select("word", "uses", "known", base.alias("base"), "score"), "word-scores")


def held_words(scores: DataFrame, most: int = HELD_WORDS) -> dict[bytes, tuple[int, float, float]]:
    """The most used words, at most ``most``: all words from the smallest use count that few enough reach."""
    total, least = 0, None
    for row in scores.groupBy("uses").count().orderBy(F.desc("uses")).limit(most).toLocalIterator():
        total += row["count"]
        if total > most:
            break
        least = row["uses"]
    if least is None:
        return {}
    rows = scores.where(F.col("uses") >= least).select("word", "known", "base", "score").toArrow()
    return {w.encode(): (k, b, s) for w, k, b, s in zip(*(c.to_pylist() for c in rows.columns))}


_SUMS = ("row_key long, doc_id long, held_out boolean, n_tokens long, n_known long, base double, score double, "
         "words array<string>, times array<int>")


def _score(held: Broadcast, end: tuple[int, float, float]):
    """Per document: the sums over held words and the end, and its other words with their counts."""
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, look_up = row_keys(), held.value.get
        for batch in in_slices(batches, 2):
            rows, words, times = [], [], []
            for text in batch.column(2).to_pylist():
                found = words_of(text)
                known, base, score = end
                other, n = [], []
                for w, c in Counter(found).items():
                    values = look_up(w)
                    if values is None:
                        other.append(w.decode("utf-8", "replace"))
                        n.append(c)
                    else:
                        known += c * values[0]
                        base += c * values[1]
                        score += c * values[2]
                rows.append((next(keys), len(found) + 1, known, base, score))
                words.append(other)
                times.append(n)
            key, tokens, known, base, score = zip(*rows) if rows else ((),) * 5
            yield pa.RecordBatch.from_arrays(
                [pa.array(key, pa.int64()), batch.column(0), batch.column(1), pa.array(tokens, pa.int64()),
                 pa.array(known, pa.int64()), pa.array(base, pa.float64()), pa.array(score, pa.float64()),
                 pa.array(words, pa.list_(pa.string())), pa.array(times, pa.list_(pa.int32()))],
                ["row_key", "doc_id", "held_out", "n_tokens", "n_known", "base", "score", "words", "times"])
    return run


def score_documents(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", vocabulary: str | None = None,
                    rounds: int = ROUNDS, held: int = HELD_WORDS) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score), one row per document."""
    ready_for_python(docs)
    rows = _read(docs, doc_id, text)
    words = word_counts(rows)
    model = fit(rows, words, vocabulary, rounds)
    scores = word_scores(words, model)
    end = (int(model.train_docs > 0), model.base_log10(model.train_docs), model.log_end / math.log(10))
    kept = docs.sparkSession.sparkContext.broadcast(held_words(scores, held))
    sums = write_and_read_back(rows.mapInArrow(_score(kept, end), _SUMS), "document-sums")
    other = sums.select("row_key", F.explode(F.arrays_zip("words", "times")).alias("w")).select(
        "row_key", F.col("w.words").alias("word"), F.col("w.times").alias("times"))
    met = other.join(scores.select("word", "known", "base", "score"), "word").groupBy("row_key").agg(
        F.sum(F.col("times") * F.col("known")).alias("more_known"), F.sum(F.col("times") * F.col("base")).alias("more_base"),
        F.sum(F.col("times") * F.col("score")).alias("more_score"))
    met = write_and_read_back(met, "other-word-sums")
    return sums.drop("words", "times").join(met, "row_key", "left").select(
        "doc_id", "held_out", "n_tokens", (F.col("n_known") + F.coalesce("more_known", F.lit(0))).alias("n_known"),
        F.lit(model.train_tokens).cast("long").alias("train_tokens"),
        (F.col("base") + F.coalesce("more_base", F.lit(0.0))).alias("base_score"),
        (F.col("score") + F.coalesce("more_score", F.lit(0.0))).alias("score"))
