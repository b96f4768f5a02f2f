"""Quality classifier: an additive model with pairwise terms over bin tables.

Each text becomes a row of numbers.  Every number is cut into quantile bins;
the model is one score per bin and, for the strongest pairs, one per cell of a
small grid.  The tables are learnt by cyclic boosting: round after round, each
feature in turn gets a shallow tree over its bins, fitted to the current
gradient and added with a small rate.  Scoring adds looked-up bins, vectorised.

Labelled rows for the fit are bounded by ``MAX_TRAINING_ROWS``: the ones with
the smallest hash of the id.  Everything else runs over all rows.

Defined results: a NULL or empty text has all-zero features and a score like
any other; rows without a label are scored only; with no labelled row, or one
class only, the score is the smoothed share of label 1.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from prospectra.llm.common import crc_remainder, in_slices, ready_for_python
from prospectra.session import write_and_read_back

MAX_TRAINING_ROWS = 20_000
THRESHOLD = 0.3
ROUNDS, PAIR_ROUNDS, RATE = 120, 60, 0.15
BINS, PAIR_BINS, PAIRS, DEPTH = 48, 8, 8, 2
LEAST_ROWS = 8

FEATURES = ("log_words", "word_length", "symbols", "upper", "exclamation", "bars", "unique_words", "adjacent_repeats",
            "punctuation", "digits", "repeated_lines", "top_word", "log_line_words", "capitalised", "non_ascii",
            "symbol_ends")

_UPPER, _SYMBOLS, _DIGITS = bytes(range(65, 91)), b"#*$%&|<>", b"0123456789"
_SPACE = b" \t\n\x0b\x0c\r"
_CASED = re.compile(rb"(?:^|(?<=\s))[A-Z]")
_SYMBOL_END = re.compile(rb"[#*$%&|<>!](?=\s|$)")


def features_of(text: str | None) -> list[float]:
    data = (text or "").encode("utf-8", "surrogatepass")
    words = data.split()
    n = len(words)
    if not n:
        return [0.0] * len(FEATURES)

    def share(chars: bytes) -> float:
        return (len(data) - len(data.translate(None, chars))) / solid

    solid = len(data.translate(None, _SPACE))
    count = Counter(words)
    lines = [x for x in data.split(b"\n") if x.strip()]
    return [np.log1p(n), solid / n, share(_SYMBOLS), share(_UPPER), share(b"!"), share(b"|"), len(count) / n,
            sum(a == b for a, b in zip(words, words[1:])) / n, share(b".,;:?"), share(_DIGITS),
            1 - len(set(lines)) / len(lines), max(count.values()) / n, np.log1p(n / len(lines)),
            len(_CASED.findall(data)) / n, len(data.translate(None, bytes(range(128)))) / solid,
            len(_SYMBOL_END.findall(data)) / n]


@dataclass
class AdditiveModel:
    """Bin edges, one table per feature, one grid per pair, and the intercept."""
    intercept: float
    edges: list[np.ndarray]
    tables: list[np.ndarray]
    pair_edges: list[np.ndarray]
    pairs: list[tuple[int, int]]
    grids: list[np.ndarray]

    def scores(self, x: np.ndarray) -> np.ndarray:
        total = np.full(len(x), self.intercept)
        for j, (edges, table) in enumerate(zip(self.edges, self.tables)):
            total += table[np.searchsorted(edges, x[:, j], side="right")]
        if self.pairs:
            coarse = [np.searchsorted(e, x[:, j], side="right") for j, e in enumerate(self.pair_edges)]
            for (a, b), grid in zip(self.pairs, self.grids):
                total += grid[coarse[a], coarse[b]]
        return 1 / (1 + np.exp(-total))


def _edges(column: np.ndarray, bins: int) -> np.ndarray:
    return np.unique(np.quantile(column, np.arange(1, bins) / bins, method="higher")) if len(column) else np.empty(0)


def _tree(gradient: np.ndarray, hessian: np.ndarray, rows: np.ndarray, depth: int = DEPTH) -> np.ndarray:
    """The values of a shallow regression tree over ordered bins: best cuts by gain, recursively."""
    out = np.zeros(len(gradient))

    def grow(lo: int, hi: int, left: int) -> None:
        g, h, n = (np.cumsum(v[lo:hi]) for v in (gradient, hessian, rows))
        if left and hi - lo > 1:
            gl, hl, nl = g[:-1], h[:-1], n[:-1]
            gain = gl ** 2 / (hl + 1) + (g[-1] - gl) ** 2 / (h[-1] - hl + 1) - g[-1] ** 2 / (h[-1] + 1)
            gain[(nl < LEAST_ROWS) | (n[-1] - nl < LEAST_ROWS)] = 0
            cut = int(np.argmax(gain))
            if gain[cut] > 1e-9:
                grow(lo, lo + cut + 1, left - 1)
                grow(lo + cut + 1, hi, left - 1)
                return
        out[lo:hi] = g[-1] / (h[-1] + 1)

    grow(0, len(gradient), depth)
    return out


def _pair_tree(gradient: np.ndarray, hessian: np.ndarray) -> tuple[np.ndarray, float]:
    """The best cross cut of a grid into four quadrants: values and gain."""
    g = np.pad(gradient.cumsum(0).cumsum(1), ((1, 0), (1, 0)))
    h = np.pad(hessian.cumsum(0).cumsum(1), ((1, 0), (1, 0)))
    rows, cols = gradient.shape
    best, values = 0.0, np.zeros_like(gradient)
    for i in range(1, rows):
        for j in range(1, cols):
            quads = [(slice(0, i), slice(0, j), g[i, j], h[i, j]),
                     (slice(0, i), slice(j, cols), g[i, -1] - g[i, j], h[i, -1] - h[i, j]),
                     (slice(i, rows), slice(0, j), g[-1, j] - g[i, j], h[-1, j] - h[i, j]),
                     (slice(i, rows), slice(j, cols), g[-1, -1] - g[i, -1] - g[-1, j] + g[i, j],
                      h[-1, -1] - h[i, -1] - h[-1, j] + h[i, j])]
            gain = sum(a ** 2 / (b + 1) for _, _, a, b in quads)
            if gain > best:
                best, values = gain, np.zeros_like(gradient)
                for r, c, a, b in quads:
                    values[r, c] = a / (b + 1)
    return values, best


def fit(x: np.ndarray, y: np.ndarray) -> AdditiveModel:
    """Cyclic boosting of the bin tables, then of the strongest pairs' grids."""
    n, width = len(x), x.shape[1] if x.ndim == 2 else len(FEATURES)
    intercept = float(np.log((y.sum() + 0.5) / (n - y.sum() + 0.5)))
    edges = [_edges(x[:, j], BINS) if n else np.empty(0) for j in range(width)]
    tables = [np.zeros(len(e) + 1) for e in edges]
    model = AdditiveModel(intercept, edges, tables, [], [], [])
    if not 0 < y.sum() < n:
        return model
    place = [np.searchsorted(e, x[:, j], side="right") for j, e in enumerate(edges)]
    rows = [np.bincount(p, minlength=len(t)) for p, t in zip(place, tables)]
    logit = np.full(n, intercept)
    for _ in range(ROUNDS):
        for p, table, m in zip(place, tables, rows):
            prob = 1 / (1 + np.exp(-logit))
            step = RATE * _tree(np.bincount(p, y - prob, len(table)), np.bincount(p, prob * (1 - prob), len(table)), m)
            table += step
            logit += step[p]
    model.pair_edges = [_edges(x[:, j], PAIR_BINS) for j in range(width)]
    coarse = [np.searchsorted(e, x[:, j], side="right") for j, e in enumerate(model.pair_edges)]
    sides = [len(e) + 1 for e in model.pair_edges]

    def step_of(a: int, b: int) -> tuple[np.ndarray, float]:
        prob = 1 / (1 + np.exp(-logit))
        cell, cells = coarse[a] * sides[b] + coarse[b], sides[a] * sides[b]
        shape = (sides[a], sides[b])
        return _pair_tree(np.bincount(cell, y - prob, cells).reshape(shape),
                          np.bincount(cell, prob * (1 - prob), cells).reshape(shape))

    ranked = sorted(((step_of(a, b)[1], a, b) for a in range(width) for b in range(a)), reverse=True)
    model.pairs = [(a, b) for gain, a, b in ranked[:PAIRS] if gain > 0]
    model.grids = [np.zeros((sides[a], sides[b])) for a, b in model.pairs]
    for _ in range(PAIR_ROUNDS):
        for (a, b), grid in zip(model.pairs, model.grids):
            step = RATE * step_of(a, b)[0]
            grid += step
            logit += step[coarse[a], coarse[b]]
    return model


def featurize(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """A written table (doc_id, features), one row per document."""
    ready_for_python(docs)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in in_slices(batches, 1):
            rows = [features_of(t) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(rows, pa.list_(pa.float64()))],
                                             ["doc_id", "features"])

    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    return write_and_read_back(rows.mapInArrow(run, "doc_id long, features array<double>"), "quality-features")


def train(features: DataFrame, labels: DataFrame, label: str = "quality", doc_id: str = "doc_id",
          max_rows: int = MAX_TRAINING_ROWS) -> AdditiveModel:
    """Fit on at most ``max_rows`` labelled rows that are not held out.

    A row is held out where crc32 of its id, as text, is 0 modulo 5.
    """
    known = (labels.where(F.col(label).isin(0, 1) & F.col(doc_id).isNotNull() & (crc_remainder(doc_id, 5) != 0))
             .select(F.col(doc_id).cast("long").alias("doc_id"), F.col(label).cast("int").alias("y")))
    rows = (features.join(known, "doc_id")
            .select("features", "y", F.xxhash64(F.col("doc_id"), F.lit(1)).alias("h"), "doc_id")
            .orderBy("h", "doc_id", "y", "features").limit(max_rows).select("features", "y").toPandas())
    x = np.array(rows["features"].tolist(), dtype=float).reshape(len(rows), len(FEATURES))
    return fit(x, rows["y"].to_numpy(dtype=float))


def score(features: DataFrame, model: AdditiveModel) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every row of ``featurize``'s table."""
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            flat = batch.column(1).flatten().to_numpy(zero_copy_only=False)
            found = model.scores(flat.reshape(batch.num_rows, len(FEATURES)))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found)], ["doc_id", "score"])

    ready_for_python(features)
    return features.mapInArrow(run, "doc_id long, score double").select(
        "doc_id", (crc_remainder("doc_id", 5) == 0).alias("held_out"), "score",
        (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, model: AdditiveModel, text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs`` that score at least the threshold, with all their columns.  No shuffle."""
    ready_for_python(docs)
    at = docs.columns.index(text)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in in_slices(batches, at):
            x = np.array([features_of(t) for t in batch.column(at).to_pylist()], dtype=float)
            yield batch.filter(pa.array(model.scores(x.reshape(batch.num_rows, len(FEATURES))) >= threshold))

    return docs.mapInArrow(run, docs.schema)
