import hashlib

import numpy as np
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st

from prospectra.llm import bpe
from tests.llm import edge_rows as e


@pytest.fixture(scope="module")
def codec():
    return bpe.codec(bpe.default_vocabulary(), bpe.default_pattern())


@pytest.fixture(scope="module")
def judge(codec):
    return tiktoken.Encoding("own", pat_str=bpe.default_pattern(), mergeable_ranks=codec.ranks, special_tokens={})


def test_queue_gives_the_smallest_rank():
    queue = bpe.RankQueue()
    assert queue.first() == -1
    for rank in (50_000, 4096, 63, 64, 5):
        queue.open(rank, [1])
    seen = []
    while (rank := queue.first()) >= 0:
        seen.append(rank)
        queue.close(rank)
    assert seen == [5, 63, 64, 4096, 50_000]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.text(max_size=60), max_size=8))
def test_equals_the_library_and_decodes(codec, judge, texts):
    for text, ids in zip(texts, codec.encode_batch(texts)):
        numbers = np.frombuffer(ids, np.uint32).tolist()
        assert numbers == judge.encode_ordinary(text)
        assert codec.decode(numbers) == text.encode()


def test_lower_ranks_that_appear_are_taken_first():
    """'b'+'c' has rank 2 and comes first, but 'ab'+... must not be missed: compare with a plain rescan."""
    pieces = [b"a", b"b", b"c", b"abc", b"bc", b"ab", b"cab", b"abcab"]
    ranks = {p: i for i, p in enumerate(pieces)}

    def rescan(word):
        parts = [word[i:i + 1] for i in range(len(word))]
        while True:
            pairs = [(ranks[parts[i] + parts[i + 1]], i) for i in range(len(parts) - 1) if parts[i] + parts[i + 1] in ranks]
            if not pairs:
                return [ranks[p] for p in parts]
            _, i = min(pairs)
            parts[i:i + 2] = [parts[i] + parts[i + 1]]

    rng = np.random.default_rng(1)
    words = [bytes(rng.choice(list(b"abc"), size=rng.integers(1, 30)).tolist()) for _ in range(400)]
    assert bpe.Codec(ranks, ".+").merge_all(words) == [rescan(w) for w in words]


def test_very_long_pretokens(codec, judge):
    for text in ("a" * 20_000, "ab" * 10_000, "th" * 5_000 + "🙂" * 500):
        assert codec.encode(text) == judge.encode_ordinary(text)


def test_table_of_awkward_texts(spark, judge):
    df = e.table(spark, extra=True)
    found = sorted((tuple(r) for r in bpe.digests(df).collect()), key=str)
    want = []
    for doc_id, text, *_ in e.rows():
        ids = judge.encode_ordinary(text or "")
        want.append((doc_id, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(),
                     hashlib.sha256((text or "").encode()).hexdigest()))
    assert found == sorted(want, key=str)
    encoded = bpe.encode(df, ids="ids")
    assert encoded.columns == [*df.columns, "_ids"]     # the table has an "ids" of its own
    assert bpe.decode(encoded, "_ids").where("decoded <> cast(coalesce(text, '') as binary)").count() == 0
    assert bpe.digests(e.empty(spark)).collect() == []


