import hashlib
import random

import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st

from prospectra.llm import sentence_pieces
from tests.llm import edge_rows as e


@pytest.fixture(scope="module")
def codec():
    return sentence_pieces.codec(sentence_pieces.default_model())


@pytest.fixture(scope="module")
def judge():
    return sentencepiece.SentencePieceProcessor(model_file=sentence_pieces.default_model())


def small(**scores):
    """A codec of a few pieces besides the bytes."""
    pieces = [(p, s, 1) for p, s in scores.items()] + [(f"<0x{b:02X}>", 0.0, 6) for b in range(256)]
    return sentence_pieces.Codec(pieces)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.text(max_size=60), max_size=8))
def test_equals_the_library(codec, judge, texts):
    for text, packed in zip(texts, codec.encode_batch(texts)):
        ids = memoryview(packed).cast("I").tolist()
        assert ids == judge.encode(text)
        assert codec.decode(ids) == judge.decode(ids)


def test_rows_of_pieces_and_blanks(codec, judge):
    rng = random.Random(4)
    pieces = list(codec.score)
    for _ in range(20_000):
        text = "".join(rng.choice(pieces) for _ in range(rng.randint(1, 6))).replace(sentence_pieces.BLANK, " ")
        text = " " * rng.choice([0, 0, 1, 2, 15, 17, 40]) + text
        assert codec.encode(text) == judge.encode(text)


def test_decodes_any_ids(codec, judge):
    rng = random.Random(5)
    kinds = (lambda: rng.randrange(3), lambda: rng.randrange(3, 259), lambda: rng.randrange(259, 32000), lambda: 28705)
    for _ in range(10_000):
        ids = [rng.choice(kinds)() for _ in range(rng.randint(0, 7))]
        assert codec.decode(ids) == judge.decode(ids)


@pytest.mark.parametrize("seed", range(30))
def test_search_equals_plain_merging(seed):
    """Random vocabularies with equal scores: the search must step back and still give the merged result."""
    rng = random.Random(seed)
    texts = {"".join(rng.choice("abc") for _ in range(rng.randint(2, 5))) for _ in range(14)}
    scores = {**{c: 0.0 for c in "abc"}, **{t: float(-rng.randint(1, 6)) for t in texts}}
    own = small(**scores)
    for _ in range(200):
        text = "".join(rng.choice("abc") for _ in range(rng.randint(1, 25)))
        assert list(own.pieces_of([text])) == [own.merge(text)]


def test_compatible_is_merging_anew(codec):
    rng = random.Random(6)
    pieces = [p for p in codec.score if len(p) > 1]
    for _ in range(5_000):
        a, b = rng.choice(pieces), rng.choice(pieces)
        assert codec.compatible(a, b) == (codec.merge(a + b) == [a, b])


def test_very_long_texts(codec, judge):
    for text in ("z" * 300_000, " " * 100_000, "ab" * 100_000, "漢字" * 50_000, "the " * 50_000):
        assert codec.encode(text) == judge.encode(text)


def test_memory_of_parts_is_bounded(judge, monkeypatch):
    monkeypatch.setattr(sentence_pieces, "REMEMBERED", 40)
    monkeypatch.setattr(sentence_pieces, "REMEMBERED_PAIRS", 10)
    own = sentence_pieces.codec.__wrapped__(sentence_pieces.default_model())
    for i in range(60):
        text = e.prose(i, 20)
        assert own.encode(text) == judge.encode(text)
    assert len(own._parts) + len(own._older) < 40 + 2 * 60


def test_other_models_are_refused(tmp_path):
    from sentencepiece import sentencepiece_model_pb2
    model = sentencepiece_model_pb2.ModelProto()
    with open(sentence_pieces.default_model(), "rb") as f:
        model.ParseFromString(f.read())
    model.normalizer_spec.remove_extra_whitespaces = True
    path = tmp_path / "other.model"
    path.write_bytes(model.SerializeToString())
    with pytest.raises(ValueError, match="keeps texts as they are"):
        sentence_pieces.codec(str(path))
    with pytest.raises(ValueError, match="every byte"):
        sentence_pieces.Codec([("a", 0.0, 1)])


def test_table_of_awkward_texts(spark, judge):
    df = e.table(spark, extra=True)
    sha = lambda text: hashlib.sha256(text.encode()).hexdigest()
    want = []
    for doc_id, text, *_ in e.rows():
        ids = judge.encode(text or "")
        want.append((doc_id, len(ids), sha(",".join(map(str, ids))), sha(judge.decode(ids))))
    found = [tuple(r) for r in sentence_pieces.digests(df).collect()]
    assert sorted(found, key=str) == sorted(want, key=str)
    encoded = sentence_pieces.encode(df)
    assert encoded.columns == [*df.columns, "_ids"]     # the table has an "ids" of its own
    back = sentence_pieces.decode(encoded, "_ids")
    assert back.where(f"decoded <> replace(coalesce(text, ''), '{sentence_pieces.BLANK}', ' ')").count() == 0
    assert sentence_pieces.decode(encoded.selectExpr("cast(null as array<int>) ids")).where("decoded is not null").count() == 0
    assert sentence_pieces.digests(e.empty(spark)).collect() == []
