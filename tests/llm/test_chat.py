from __future__ import annotations

import hashlib

from hypothesis import given
from hypothesis import strategies as st

from vellum.llm import chat, queries

texts = st.text(alphabet="ab<>&;/ \n\\trnugmpl[INST]é😀", max_size=12)


@given(st.lists(st.tuples(st.sampled_from(["user", "assistant", "a<b>", ""]), texts), max_size=6))
def test_round_trip_and_spans(messages):
    t = chat.Tagged()
    formatted, turns = chat.locate(t, messages)
    assert t.read(formatted) == messages
    assert [t.unescape(formatted[x.content_start : x.content_end]) for x in turns] == [m[1] for m in messages]
    assert not any(x.rewrites for x in turns)
    assert [x.end for x in turns[:-1]] == [x.start for x in turns[1:]]


def test_a_template_that_rewrites_history_is_found():
    def shortens(messages):
        return "".join(f"[{r}]{x if i == len(messages) - 1 else x[:2]}\n" for i, (r, x) in enumerate(messages))

    text, turns = chat.locate(shortens, [("user", "hello"), ("assistant", "there")])
    assert [t.rewrites for t in turns] == [False, True] and text == "[user]he\n[assistant]there\n"
    assert [(t.content_start, t.content_end) for t in turns] == [(None, None), (20, 25)]  # what was cut short isn't there whole
    assert [text[t.start : t.end] for t in turns] == ["[user]he\n", "[assistant]there\n"]


def contents(render, messages):
    text, turns = chat.locate(render, messages)
    assert text == render(messages)
    return [None if t.content_start is None else text[t.content_start : t.content_end] for t in turns], turns, text


SAID = [("user", "hello"), ("assistant", "there"), ("user", ""), ("assistant", "[x]\n"), ("assistant", "end")]


def test_spans_in_templates_that_move_or_change_what_was_there():
    turn = lambda r, x: f"[{r}]{x}\n"
    trailer = lambda m: "".join(turn(*x) for x in m) + "[END]"
    found, turns, text = contents(trailer, SAID)
    assert found == [x for _, x in SAID] and not any(t.rewrites for t in turns)
    assert [text[t.start : t.end] for t in turns] == [turn(*x) for x in SAID]
    prompt = lambda m: "<s>" + "".join(turn(*x) for x in m) + ("[assistant]" if m and m[-1][0] == "user" else "")
    assert contents(prompt, SAID[:4])[0] == [x for _, x in SAID[:4]]
    counts = lambda m: f"{len(m)} turns:" + "".join(turn(*x) for x in m)
    found, turns, _ = contents(counts, SAID)
    assert found == [x for _, x in SAID] and all(t.rewrites for t in turns[1:])
    last = lambda m: "".join(turn(*x) for x in m[-2:])
    found, turns, _ = contents(last, SAID)
    assert found == [None, None, None, "[x]\n", "end"]
    upper = lambda m: "".join(turn(r, x.upper() if i < len(m) - 1 else x) for i, (r, x) in enumerate(m))
    assert contents(upper, SAID)[0] == ["HELLO", "THERE", "", "[X]\n", "end"]


def test_no_loss_where_a_learnt_text_is_not_whole(spark):
    def last(messages):
        return "".join(f"[{r}]{x}\n" for r, x in messages[-2:])

    rows = spark.createDataFrame([(c, i, r, x) for c, n in ((1, 2), (2, 4)) for i, (r, x) in enumerate(SAID[:n])], "conv_id long, turn long, role string, text string")
    out = {r["conv_id"]: r for r in chat.format_conversations(rows, last).collect()}
    assert out[2]["loss"] is None and out[2]["rewrites_history"] and out[2]["turns"][0]["content_start"] is None
    x = out[1]["loss"][0]
    assert out[1]["formatted"][x["start"] : x["end"]] == "there"


def test_many_turns():
    messages = [("user" if i % 2 else "assistant", "text <&> " * 50) for i in range(500)]
    formatted, turns = chat.locate(chat.Tagged(), messages)
    assert chat.Tagged().read(formatted) == messages and len(turns) == 500


def test_edges(spark):
    rows = [(1, 2, "assistant", "b"), (1, 1, "user", None), (1, 2, "assistant", "a"), (2, 0, None, "x"), (None, 0, "assistant", "</turn>"), (3, None, "user", ""), (1, 2, "assistant", "b")]
    said = spark.createDataFrame([(*r, "clash", 0) for r in rows], "conv_id long, turn long, role string, text string, formatted string, said int")
    out = {r["conv_id"]: r for r in chat.digests(chat.format_conversations(said)).collect()}
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    assert out[1]["n_turns"] == 4 and out[1]["loss_sha256"] == sha("abb") and out[1]["turns_sha256"] == sha("user\n\nassistant\na\nassistant\nb\nassistant\nb\n")
    assert out[None]["loss_sha256"] == sha("</turn>") and out[2]["turns_sha256"] == sha("\nx\n") and out[3]["loss_chars"] == 0
    assert chat.digests(chat.format_conversations(said.limit(0))).collect() == []


def test_the_odd_conversation(spark):
    row = queries.QUERIES["op7_chat"](spark, "/root/testdata/sf0.001").filter("conv_id = -7").first()
    assert row["n_turns"] == 2 and row["loss_sha256"] == hashlib.sha256(b"</s>[INST] ok [/INST]").hexdigest()
