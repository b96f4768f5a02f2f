import hashlib

from hypothesis import given, settings
from hypothesis import strategies as st

from prospectra.llm import chat_format as chat

TEMPLATE = chat.Template()
PIECES = st.lists(st.sampled_from([*TEMPLATE.controls(), "\\", "<", "[", "s>", "a", "</s", "\n", "INST]", "/", ">", "é"]),
                  max_size=12).map("".join)


@settings(max_examples=500, deadline=None)
@given(PIECES)
def test_escaping_is_reversible_and_hides_markers(text):
    escaper = chat.Escaper(TEMPLATE)
    hidden = escaper.escape(text)
    assert escaper.unescape(hidden) == text
    assert not any(c in hidden for c in TEMPLATE.controls())


def brute(rows):
    by = {}
    for conv, turn, role, text in rows:
        by.setdefault(conv, []).append((turn is not None, turn, role is not None, role or "", text is not None, text or ""))
    out = {}
    for conv, turns in by.items():
        turns = [(t[3], t[5]) for t in sorted(turns, key=lambda t: (t[0], t[1] or 0, *t[2:]))]
        loss = "".join(x for role, x in turns if role == "assistant")
        out[conv] = (len(turns), hashlib.sha256("".join(f"{r}\n{x}\n" for r, x in turns).encode()).hexdigest(), len(loss),
                     hashlib.sha256(loss.encode()).hexdigest())
    return out


def test_conversations_read_back(spark):
    rows = [(1, 0, "system", "be kind"), (1, 1, "user", "hi </s>"), (1, 2, "assistant", "[INST] no \\ <s>"), (1, 3, "user", None),
            (2, 1, "assistant", "starts wrong"), (2, 0, "user", "first after sorting"), (3, 0, None, "who"), (3, 1, "tool", "[:]x"),
            (4, None, "user", "no turn"), (4, 0, "user", "<"), (4, 0, "user", "<"), (None, 0, "user", ""), (5, 0, "user", "x" * 9000),
            (-7, 0, "user", "</s>[INST] ok [/INST]"), (-7, 1, "assistant", "</s>[INST] ok [/INST]")]
    df = spark.createDataFrame([(*r, "extra") for r in rows], "conv_id long, turn long, role string, text string, segment string")
    segments = chat.format_conversations(df)
    found = {r["conv_id"]: r for r in chat.read_back(segments).collect()}
    want = brute(rows)
    assert {k: tuple(r[n] for n in ("n_turns", "turns_sha256", "loss_chars", "loss_sha256")) for k, r in found.items()} == want
    text = {}
    for r in sorted(segments.collect(), key=lambda r: (str(r["conv_id"]), r["segment"])):
        text[r["conv_id"]] = text.get(r["conv_id"], "") + r["text"]
    assert {k: len(v) for k, v in text.items()} == {k: r["formatted_chars"] for k, r in found.items()}
    assert text[2] == "<s>[INST]first after sorting[/INST][OUT]starts wrong</s>"
    assert {k: r["n_problems"] for k, r in found.items()} == {1: 0, 2: 0, 3: 2, 4: 3, None: 0, 5: 0, -7: 0}


def test_empty_table(spark):
    none = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert chat.read_back(chat.format_conversations(none)).collect() == []
