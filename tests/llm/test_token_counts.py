import pytest
import tiktoken

from prospectra.llm import bpe, token_counts
from tests.llm import edge_rows as e


def brute(text, rule):
    judge = tiktoken.Encoding("own", pat_str=bpe.default_pattern(), special_tokens={},
                              mergeable_ranks=bpe.codec(bpe.default_vocabulary(), bpe.default_pattern()).ranks)
    parts = text.split("\n")
    sections = [p + "\n" for p in parts[:-1]] + ([parts[-1]] if parts[-1] or len(parts) == 1 else [])
    owner = [i for i, s in enumerate(sections) for _ in s]
    of_byte = [c for c, ch in enumerate(text) for _ in ch.encode()]
    counts, crossing, at = [0] * len(sections), [0] * len(sections), 0
    for token in judge.encode_ordinary(text):
        n = len(judge.decode_single_token_bytes(token))
        owners = [owner[c] for c in sorted(set(of_byte[at:at + n]))]
        at += n
        chosen = {"first": owners[0], "last": owners[-1], "largest": max(dict.fromkeys(owners), key=owners.count)}[rule]
        counts[chosen] += 1
        crossing[chosen] += len(set(owners)) > 1
    return [(i, counts[i], crossing[i]) for i in range(len(sections))]


@pytest.mark.parametrize("rule", token_counts.RULES)
def test_equals_brute_force(spark, rule):
    data = [*e.rows(), (80, "a\n\n\n\nb \n \n", "en", "a", 0), (81, "\n", "en", "a", 0), (82, "é\n漢\n🙂\n\n", "en", "a", 0)]
    found = token_counts.count_by_section(e.table(spark, data, extra=True), rule=rule).collect()
    got = sorted(((r["doc_id"], r["section"], r["n_tokens"], r["n_crossing"]) for r in found), key=str)
    want = [(d, *row) for d, text, *_ in data for row in brute(text or "", rule)]
    assert got == sorted(want, key=str)
    lengths = {}
    for r in found:
        lengths.setdefault(r["doc_id"], []).append((r["start_char"], r["end_char"]))
    assert all(a <= b for spans in lengths.values() for a, b in spans)
    assert any(r["n_crossing"] for r in found)


def test_empty_table_and_unknown_rule(spark):
    assert token_counts.count_by_section(e.empty(spark)).collect() == []
    with pytest.raises(ValueError):
        token_counts.count_by_section(e.empty(spark), rule="middle")
