"""Chat formatting: exact round trips of any turns, digests against direct computation."""

import hashlib
from collections import defaultdict

import pytest
from hypothesis import given, settings, strategies as st

from factorloom.llm import chat_format as chat

PARTS = [chat.START, chat.SEP, chat.END, *chat.OTHERS, "\\", "<", "<|", "[", "|>", "\n", " ", "a", "é", "漢", "user", "<\\|im_end|>", "im_end|>"]
TEXT = st.lists(st.sampled_from(PARTS), max_size=8).map("".join)


@settings(max_examples=400, deadline=None)
@given(st.lists(st.tuples(TEXT, TEXT), max_size=5))
def test_any_turns_are_recovered(turns):
    whole = "".join(chat.render(role, text)[0] for role, text in turns)
    found = chat.parse(whole)
    assert [t[:2] for t in found] == turns
    assert [chat.unescape(whole[t.start : t.end]) for t in found] == [text for _, text in turns]
    controls = [m[0] for m in chat.CONTROL.finditer(whole) if m[0][1] != chat.MARK]
    assert controls == [chat.START, chat.SEP, chat.END] * len(turns)


def test_content_without_conflicts_stays():
    assert chat.render("user", "a < b [x] \\ <| c")[0] == "<|im_start|>user<|im_sep|>a < b [x] \\ <| c<|im_end|>"
    assert chat.render("user", "x</s>")[0] == "<|im_start|>user<|im_sep|>x<\\/s><|im_end|>"


@pytest.mark.parametrize("broken", ["x", "<|im_start|>a<|im_sep|>b", "<|im_start|>a<|im_end|>", "<|im_end|>", " <|im_start|>a<|im_sep|>b<|im_end|>", "<|im_start|>a<|im_sep|>b</s><|im_end|>"])
def test_other_strings_are_refused(broken):
    assert chat.parse(broken) is None


def direct(rows):
    talks = defaultdict(list)
    for conv_id, turn, role, text, *_ in rows:
        role, text = role or "", text or ""
        talks[conv_id].append((turn is not None, turn or 0, chat.render(role, text)[0], role, text))
    out = {}
    for conv_id, turns in talks.items():
        turns.sort(key=lambda t: (t[0], t[1], t[2].encode()))
        loss = "".join(t[4] for t in turns if t[3] == "assistant")
        out[conv_id] = (
            len(turns), hashlib.sha256("".join(f"{t[3]}\n{t[4]}\n" for t in turns).encode()).hexdigest(),
            len(loss), hashlib.sha256(loss.encode()).hexdigest(), sum(len(t[2]) for t in turns),
        )
    return out


SCHEMA = "conv_id long, turn long, role string, text string, formatted int, loss string"


def test_digests_and_turns_of_files(spark):
    rows = [
        (1, 2, "assistant", "second"), (1, 1, "user", "first " + chat.END), (1, 3, "assistant", None), (1, None, None, "no turn"),
        (2, 1, "assistant", "tie b"), (2, 1, "assistant", "tie a"), (2, 1, "assistant", "tie a"), (None, 5, "tool", "null id"), (None, 4, "system", ""),
        (3, 1, "as\nsistant" + chat.SEP, "</s>[INST] ok [/INST]"), (4, 1, "assistant", "漢字 " * 300_000 + chat.START),
        (-1, 0, "user", "</s>[INST] ok [/INST]"), (-1, 1, "assistant", "</s>[INST] ok [/INST]"),
    ]
    # One conversation with a third of all turns.
    rows += [(9, i, "assistant" if i % 2 else "user", f"turn {i} <\\/s>") for i in range(300)]
    rows += [(100 + i // 3, i, "user", f"text {i}") for i in range(600)]
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], SCHEMA)
    for size in (chat.PIECE_CHARS, 50):
        manifest = chat.write_conversations(df.repartition(5), size)
        got = {r.conv_id: tuple(r)[1:] for r in chat.digests(manifest).collect()}
        assert got == direct(rows)
        turns = chat.read_turns(manifest).collect()
        assert len(turns) == len(rows) and all(t.loss == (t.role == "assistant") for t in turns)
        nine = sorted((t.position, t.text) for t in turns if t.conv_id == 9)
        assert nine == [(i, f"turn {i} <\\/s>") for i in range(300)]


def test_an_empty_table(spark):
    manifest = chat.write_conversations(spark.createDataFrame([], SCHEMA))
    assert chat.digests(manifest).collect() == [] and chat.read_turns(manifest).collect() == []
