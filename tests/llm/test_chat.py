"""Chat rendering: exact round trips, and templates that rewrite what came before."""

import hashlib

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from lexmesh.llm import chat, queries

TEXT = st.lists(st.sampled_from(["<s>", "</s>", "[INST]", "[/INST]", "\\", "<", "/", "[", "s>", "INST]", " ", "\n", "a", "é😀"]), max_size=8).map("".join)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.tuples(st.sampled_from(["user", "assistant", "", "[INST]"]), TEXT), max_size=5))
def test_round_trip(turns):
    done = chat.render(chat.marked_turns, turns, {"assistant"})
    assert chat.parse(done.text) == turns and done.rewritten_at == -1
    assert [done.text[a:b] for a, b, _, _ in done.spans] == [chat.marked_turns([t]) for t in turns]
    assert [chat.unescape(done.text[s[2]:s[3]]) for s, t in zip(done.spans, turns) if t[0] == "assistant"] == [t[1] for t in turns if t[0] == "assistant"]


def test_rewriting_templates_are_found():
    turns = [("user", "one"), ("assistant", "two"), ("user", "three")]
    last_only = lambda ts: "".join(f"{r}={t if k == len(ts) - 1 else '...'};" for k, (r, t) in enumerate(ts))
    assert chat.render(last_only, turns, {"assistant"}).rewritten_at == 1
    totals = lambda ts: f"{len(ts)} turns:" + "".join(t for _, t in ts)
    assert chat.render(totals, turns, {"assistant"}).rewritten_at == 0
    assert chat.render(totals, turns, {"assistant"}).spans == []


def test_anything_else_in_an_output_is_an_error():
    with pytest.raises(ValueError):
        chat.parse(chat.marked_turns([("user", "x")]) + "tail")


def test_odd_rows(spark):
    rows = [(1, 1, "assistant", "b", "x"), (1, 0, "user", None, "x"), (1, 0, "user", None, "x"), (1, None, None, "first", "x"), (1, 1, "assistant", "a", "x"),
            (None, 0, "assistant", "n", "x"), (2, 0, "user", "long " * 20000, "x")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, formatted string")
    got = {r.conv_id: r for r in chat.read_back(chat.format_chats(df)).collect()}
    said = "\nfirst\nuser\n\nuser\n\nassistant\na\nassistant\nb\n"
    assert got[1].n_turns == 5 and got[1].turns_sha256 == hashlib.sha256(said.encode()).hexdigest()
    assert got[1].loss_chars == 2 and got[1].loss_sha256 == hashlib.sha256(b"ab").hexdigest()
    assert got[None].n_turns == 1 and got[2].loss_chars == 0 and got[2].formatted_chars > 100_000
    assert chat.read_back(chat.format_chats(df.limit(0))).count() == 0


def test_query_holds_the_conversation_of_control_strings(spark, data):
    row = queries.op2_chat_format(spark, data).where("conv_id = -7").first()
    text = "</s>[INST] ok [/INST]"
    assert (row.n_turns, row.loss_chars) == (2, len(text)) and row.loss_sha256 == hashlib.sha256(text.encode()).hexdigest()
