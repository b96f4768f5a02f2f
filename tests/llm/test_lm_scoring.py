import math
import zlib
from collections import Counter

import numpy as np
import pytest

from prospectra.llm import lm_scoring as lm
from tests.llm import edge_rows as e


def tokens(text):
    return e.words(e.ascii_lower(text))


def held(doc_id):
    return zlib.crc32(("" if doc_id is None else str(doc_id)).encode()) % 10 == 0


def brute_base(data):
    train = Counter()
    for doc_id, text, *_ in data:
        if not held(doc_id):
            train.update([*tokens(text), None])
    n, v = sum(train.values()), len(train)
    return [(d, held(d), len(tokens(t)) + 1, sum(train[w] > 0 for w in [*tokens(t), None]), n,
             sum(math.log10((train[w] + 0.1) / (n + 0.1 * (v + 1))) for w in [*tokens(t), None])) for d, t, *_ in data]


def all_segmentations(word, vocabulary, weights):
    """Probability and expected piece counts by listing every segmentation."""
    marked, total, counts = lm.START + word, 0.0, Counter()

    def walk(at, p, used):
        nonlocal total
        if at == len(marked):
            total += p
            for u in used:
                counts[u] += p
            return
        for j in range(at + 1, min(len(marked), at + lm.LONGEST_PIECE) + 1):
            i = vocabulary.number.get(marked[at:j])
            if i is not None:
                walk(j, p * math.exp(weights[i]), [*used, i])
        if marked[at] not in vocabulary.number:
            own = [vocabulary.byte[b] for b in marked[at].encode()]
            walk(at + 1, p * math.exp(sum(weights[i] for i in own)), [*used, *own])

    walk(0, 1.0, [])
    return total, {k: c / total for k, c in counts.items()}


@pytest.fixture(scope="module")
def vocabulary():
    return lm.pieces(lm.default_vocabulary())


def test_lattice_equals_listing_all_segmentations(vocabulary):
    weights = vocabulary.first_weights()
    lattice = lm.Lattice(vocabulary, weights)
    words = ["the", "thea", "onation", "é", "漢字x", "🙂", "a", "ererer", "inging"]
    listed = [all_segmentations(w, vocabulary, weights) for w in words]
    assert np.allclose(lattice.log_probabilities(words), [math.log(p) for p, _ in listed])
    times = np.arange(1.0, len(words) + 1)
    expected = np.zeros(len(weights))
    for n, (_, counts) in zip(times, listed):
        for piece, c in counts.items():
            expected[piece] += n * c
    assert np.allclose(lattice.expected_counts(words, times), expected)


def test_long_words_stay_finite(vocabulary):
    lattice = lm.Lattice(vocabulary, vocabulary.first_weights())
    assert np.isfinite(lattice.log_probabilities(["z" * 30_000, "漢" * 500])).all()


def test_base_scores_and_counts_equal_brute_force(spark):
    df = e.table(spark, extra=True)
    want = sorted(brute_base(e.rows()), key=str)
    for most in (lm.HELD_WORDS, 7, 0):          # from all words held to all words joined
        found = sorted((tuple(r) for r in lm.score_documents(df, rounds=1, held=most).collect()), key=str)
        assert [f[:5] for f in found] == [w[:5] for w in want]
        assert np.allclose([f[5] for f in found], [w[5] for w in want])


def test_scores_are_marginals_under_the_fitted_weights(spark, vocabulary):
    data = [(i, e.prose(i, 20), "en", "a", 0) for i in range(20)] + [(30, None, "en", "a", 0)]
    df = e.table(spark, data)
    rows = lm._read(df, "doc_id", "text")
    model = lm.fit(rows, lm.word_counts(rows))
    assert math.isclose(np.exp(model.log_weights).sum() + math.exp(model.log_end), 1, rel_tol=1e-9)
    for r in lm.score_documents(df).collect():
        text = next(t for d, t, *_ in data if d == r["doc_id"])
        parts = [math.log10(all_segmentations(w, vocabulary, model.log_weights)[0]) for w in tokens(text)]
        assert math.isclose(r["score"], sum(parts) + model.log_end / math.log(10), rel_tol=1e-9)


def test_fitting_raises_the_likelihood(spark):
    df = e.table(spark, [(i, e.prose(i, 60), "en", "a", 0) for i in range(40)])
    totals = [lm.score_documents(df, rounds=n).groupBy().sum("score").first()[0] for n in (0, 1, 2)]
    assert totals[0] < totals[1] < totals[2]


def test_no_training_rows_and_empty_table(spark):
    out = [i for i in range(2000) if held(i)][:3]
    found = lm.score_documents(e.table(spark, [(i, "some words", "en", "a", 0) for i in out])).collect()
    assert all(r["held_out"] and r["n_known"] == 0 and r["train_tokens"] == 0 and r["base_score"] == 0 for r in found)
    assert lm.score_documents(e.empty(spark)).collect() == []
