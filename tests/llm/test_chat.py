import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from partloom.llm.chat import CONTROLS, escape, format_chats, read_back, render, spans, unescape

PARTS = st.lists(st.sampled_from([*CONTROLS, "\\", "<", "[", "]", "/", "|", "a", "\n", " ", "TURN", "\x02"]) | st.text(max_size=3), max_size=12)
TEXT = PARTS.map("".join)


@settings(max_examples=400, deadline=None)
@given(st.lists(st.tuples(TEXT, TEXT), max_size=5))
def test_round_trip(turns):
    formatted, found, rewritten = spans(render, turns, {r for r, _ in turns})
    assert rewritten is None and read_back(formatted) == turns
    assert [unescape(formatted[s["text_start"] : s["text_end"]]) for s in found] == [t for _, t in turns]
    for before, after in zip(found, found[1:]):
        assert before["end"] == after["start"]


@given(TEXT)
def test_no_control_string_survives(text):
    assert not any(c in escape(text) for c in CONTROLS) and unescape(escape(text)) == text


def strip_thoughts(turns):
    """A template that drops what was thought in all answers but the last."""
    out = []
    for i, (role, text) in enumerate(turns):
        text = text if i == len(turns) - 1 else text.split("|")[-1]
        out.append(f"<{role}>{text}\n")
    return "".join(out)


def test_rewriting_templates_are_found():
    turns = [("user", "q"), ("assistant", "thought|a"), ("user", "r"), ("assistant", "more|b")]
    formatted, found, rewritten = spans(strip_thoughts, turns, {"assistant"})
    assert rewritten == 3 and formatted == strip_thoughts(turns)
    assert spans(strip_thoughts, turns[:2], {"assistant"})[2] is None


def test_rows(spark):
    rows = [
        (1, 1, "assistant", "b"), (1, 0, "user", "a"), (2, 0, None, None), (None, 0, "user", "x"), (1, 1, "assistant", "b"),
        (3, None, "assistant", "<s>[TURN x]"), (3, 0, "user", "long " * 50000),
    ]
    turns = spark.createDataFrame([(*r, 1, 2) for r in rows], "conv_id long, turn long, role string, text string, turns int, formatted int")
    got = {r["conv_id"]: r for r in format_chats(turns).collect()}
    assert read_back(got[1]["formatted"]) == [("user", "a"), ("assistant", "b"), ("assistant", "b")]
    assert read_back(got[2]["formatted"]) == [("", "")]
    assert read_back(got[None]["formatted"]) == [("user", "x")]
    assert read_back(got[3]["formatted"])[0] == ("assistant", "<s>[TURN x]")
    assert [s["text_start"] is not None for s in got[1]["spans"]] == [False, True, True]
    assert format_chats(turns.limit(0)).count() == 0


def test_read_back_refuses_other_texts():
    with pytest.raises(ValueError):
        read_back("<s>[TURN user]\nunclosed")
