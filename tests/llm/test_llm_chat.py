"""Conversations as training text: spans by prefixes, reversible escapes, reading back, rewritten history."""

import dataclasses
import hashlib

import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from stellwerk.llm import chat
from stellwerk.llm.queries import QUERIES

tricky = st.text(alphabet="<>/[]\\s INSTROLEY\n", max_size=40) | st.lists(
    st.sampled_from(["<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>", "[ROLE x]", "[/ROLE]", "\\", "<", "[", " ", "\n", "ok"]), max_size=8
).map("".join)


@settings(max_examples=400, deadline=None)
@given(tricky)
def test_escapes_are_reversible_and_leave_no_control_string(text):
    inner = chat.escape(text)
    assert chat.unescape(inner) == text
    assert not any(mark in inner for mark in ("<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>", "[ROLE ", "[/ROLE]"))


@settings(max_examples=150, deadline=None)
@given(st.lists(st.tuples(st.sampled_from(["user", "assistant", "system", "tool", "", "a]b c"]), tricky), min_size=1, max_size=8))
def test_turns_are_read_back_and_found_by_their_spans(turns):
    whole = chat.render_marked(turns)
    assert chat.read_marked(whole, True) == (turns, len(whole))
    for memory in (None, 2, 1):
        output = ""
        for (role, text), (kept, piece, start, stop) in zip(turns, chat.spans(iter(turns), chat.Template(chat.render_marked, chat.read_marked, memory=memory))):
            assert kept == len(output)
            output += piece
            assert chat.unescape(output[start:stop]) == text
        assert output == whole


def rewriting():
    """Like templates that take the reasoning out of all answers but the last; workers get it by value."""

    def drops_old_answers(turns):
        last = max((i for i, (role, _) in enumerate(turns) if role == "assistant"), default=-1)
        return "".join(f"<{role}>{text if role != 'assistant' or i == last else 'old'}</{role}>\n" for i, (role, text) in enumerate(turns))

    return drops_old_answers


def test_templates_that_rewrite_history_are_detected(spark):
    drops_old_answers = rewriting()
    template = chat.Template(drops_old_answers, lambda text, first: ([], len(text)))
    turns = [("user", "a"), ("assistant", "first"), ("user", "b"), ("assistant", "second")]
    assert chat.probe_rewriting(turns, template) == 3
    assert chat.probe_rewriting(turns, chat.MARKED) is None
    rows = spark.createDataFrame([(7, i, r, t) for i, (r, t) in enumerate(turns)], "conv_id bigint, turn int, role string, text string")
    formatted = chat.format_conversations(rows, template).orderBy("place").collect()
    assert [r.rewrites for r in formatted] == [False, False, False, True]
    output = ""
    for r in formatted:
        output = output[: r.kept] + r.piece
    assert output == drops_old_answers(turns)
    back = chat.read_back(chat.format_conversations(rows, template), template, whole=True).first()
    # What the first answer said is no longer in the output, so only the second one can be learned.
    assert back.rewritten and back.loss_chars == len("second") and back.formatted_chars == len(output)
    streamed = chat.read_back(chat.format_conversations(rows, template), template).first()
    assert streamed.rewritten and streamed.loss_sha256 is None


def test_text_that_the_template_changes_is_not_located(spark):
    template = chat.Template(lambda turns: "".join(f"<{r}>{t if t in ('a', 'b') else t.upper() + str(len(t))}" for r, t in turns), lambda text, first: ([], len(text)))
    found = list(chat.spans(iter([("user", "hello")]), template))
    assert found[0][2:] == (6, 12)  # the probes can't tell: the text is what stands between header and trailer
    shouting = chat.Template(lambda turns: "".join(f"{t}{r}{t}" for r, t in turns), template.read)
    assert list(chat.spans(iter([("user", "hello")]), shouting))[0][2:] == (None, None)


def expected(rows):
    talks = {}
    for conv_id, turn, role, text in rows:
        talks.setdefault(conv_id, []).append((turn is not None, turn or 0, role or "", text or ""))
    out = set()
    for conv_id, turns in talks.items():
        turns.sort()
        said = "".join(t[3] for t in turns if t[2] == "assistant")
        marks = "".join(f"{t[2]}\n{t[3]}\n" for t in turns)
        out.add((conv_id, len(turns), hashlib.sha256(marks.encode()).hexdigest(), len(said), hashlib.sha256(said.encode()).hexdigest(), len(chat.render_marked([t[2:] for t in turns]))))
    return out


def test_odd_rows(spark):
    rows = [
        (1, 1, "assistant", "x</s>"), (1, 0, "user", "hi [INST]"), (1, 0, "user", "hi [INST]"), (1, None, None, None), (2, 0, "tool", ""),
        (None, 0, "user", "no id"), (None, 1, "assistant", "nor here"), (3, 0, "assistant", "ä𝄞" * 40_000), (4, 5, "a]b", "<s>"), (4, 4, "assistant", None),
    ]
    rows += [(9, i, ("user", "assistant")[i % 2], f"turn {i} \\</s>") for i in range(3000)]
    frame = spark.createDataFrame(rows, "conv_id bigint, turn int, role string, text string")
    frame = frame.withColumns({c: F.lit("x") for c in ("place", "kept", "piece", "learn", "n_turns")}).repartition(3)
    back = chat.read_back(chat.format_conversations(frame))
    assert {tuple(r)[:6] for r in back.collect()} == expected(rows)
    assert not back.filter("rewritten").count()
    assert {tuple(r)[:6] for r in chat.read_back(chat.format_conversations(frame), whole=True).collect()} == expected(rows)
    assert chat.read_back(chat.format_conversations(frame.limit(0))).count() == 0


def test_long_conversations_cost_linear_time():
    calls = []

    def render(turns):
        calls.append(len(turns))
        return chat.render_marked(turns)

    turns = [("user", str(i)) for i in range(5000)]
    assert sum(1 for _ in chat.spans(iter(turns), chat.Template(render, chat.read_marked, memory=2))) == 5000
    assert max(calls) == 4


def test_query_renders_every_turn_of_every_prefix():
    calls = set()

    def render(turns):
        calls.add(len(turns))
        return chat.render_marked(turns)

    turns = [("user", str(i)) for i in range(30)]
    assert len(list(chat.spans(iter(turns), dataclasses.replace(chat.MARKED, render=render)))) == 30
    assert calls == set(range(1, 31))


def counting():
    """Shows the number of turns in front of them, and of the fourth turn only its length once there are seven."""

    def render(turns):
        shown = [(role, str(len(text)) if i == 3 and len(turns) > 6 else text) for i, (role, text) in enumerate(turns)]
        return "".join(f"<{role} {i}>{text}</{role}>" for i, (role, text) in enumerate(shown))

    return render


@pytest.mark.parametrize("conv_id", [5, None])
def test_blocks_of_a_long_conversation_show_full_prefixes(spark, conv_id):
    template = chat.Template(counting(), lambda text, first: ([], len(text)))
    turns = [(("user", "assistant")[i % 2], f"text {i}") for i in range(11)]
    rows = [(conv_id, i, *turn) for i, turn in enumerate(turns)] + [(6, 0, "user", "short")]
    frame = spark.createDataFrame(rows, "conv_id bigint, turn int, role string, text string").repartition(3)
    whole = chat.format_conversations(frame, template).collect()
    for block_turns in (1, 3, 4, 7):
        assert sorted(map(repr, chat.format_conversations(frame, template, block_turns=block_turns).collect())) == sorted(map(repr, whole))
    assert [r.place for r in whole if r.rewrites] == [6]
    output = ""
    for r in sorted((r for r in whole if r.conv_id == conv_id), key=lambda r: r.place):
        output = output[: r.kept] + r.piece
    assert output == template.render(turns)


@pytest.mark.parametrize("sf", ["sf0.001"])
def test_query_holds_the_contract(spark, sf):
    frame = QUERIES["op12_chat"](spark, f"/root/testdata/{sf}")
    assert dict(frame.dtypes) == {
        "conv_id": "bigint", "n_turns": "bigint", "turns_sha256": "string", "loss_chars": "bigint", "loss_sha256": "string",
        "formatted_chars": "bigint", "rewritten": "boolean",
    }
    rows = [(r.conv_id, r.turn, r.role, r.text) for r in spark.read.parquet(f"/root/testdata/{sf}/conversations.parquet").collect()]
    rows += [(-1, i, role, "</s>[INST] ok [/INST]") for i, role in enumerate(("user", "assistant"))]
    assert {tuple(r)[:6] for r in frame.collect()} == expected(rows)
