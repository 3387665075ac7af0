"""Conversations as training text: a template is a black box, and what it does to each turn is found by comparing.

A template turns a list of (role, text) into one string. The operator renders a conversation's turns one
prefix after the other. Where an output begins with the one before it, the rest is the new turn's span.
Where it doesn't, the template has rewritten history: ``kept`` says how much of the earlier output still
stands. Inside its span a turn's text is found by two probes, the same prefix with the texts "a" and "b":
what both have in front of the letter is the header, what both have behind it the trailer.

Every prefix is rendered in full, the registered query's too. That costs the square of a conversation's length,
so the prefixes of one longer than ``BLOCK_TURNS`` are dealt to tasks in blocks; each has the turns up to its own
last one, which a full prefix asks for. A template may state a ``memory`` instead: what it writes for a turn depends on
the first turn and that many turns before it, and prefixes leave out the turns between.

The rows of a conversation are sorted by Spark. Reading back is a stream in one task (the digests are sequential)
that holds no more than a few turns. The output is a row per turn, so no conversation becomes a single cell.

Defined results: rows of one conversation are ordered by turn (null first), then role, then text; rows
that are repeated are turns of their own. A null text is empty, a null role is ''. Rows without a
conv_id form one conversation, whose id is null. An empty table gives an empty table; further columns are left out.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from itertools import islice
from urllib.parse import quote, unquote

import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

Turns = list[tuple[str, str]]

# Rows of an output batch end at about this many characters.
BATCH_CHARS = 1 << 22

# The prefixes of a longer conversation are rendered in several blocks of so many turns.
BLOCK_TURNS = 1000

# A worker forgets the marked turns it keeps at this many characters.
KEPT_CHARS = 1 << 24


@dataclass(frozen=True)
class Template:
    """``render`` is the black box. ``read`` takes the complete turns off the front of an output's text,
    given whether that text begins the output, and returns them with the number of characters taken."""

    render: Callable[[Turns], str]
    read: Callable[[str, bool], tuple[Turns, int]]
    unescape: Callable[[str], str] = field(default=lambda text: text)
    memory: int | None = None


# --- the template of the registered query ---

BEGIN = "<s>"
_TAIL = r"(\\*(?:/?s>|</?SYS>>))"
_BRACKET_TAIL = r"(\\*(?:/?INST\]|ROLE |/ROLE\]))"
_CONTROL = re.compile(rf"(<){_TAIL}|(\[){_BRACKET_TAIL}")
_ESCAPED = re.compile(rf"(<)\\{_TAIL}|(\[)\\{_BRACKET_TAIL}")
_TURN = re.compile(
    r"\[INST\] (?P<user>.*?) \[/INST\]"
    r"| (?P<assistant>.*?) </s>"
    r"|<<SYS>>\n(?P<system>.*?)\n<</SYS>>\n"
    r"|\[ROLE (?P<name>[^\]]*)\] (?P<other>.*?) \[/ROLE\]",
    re.DOTALL,
)


def escape(text: str) -> str:
    """No control string stands in the result: one backslash more follows the first character of each, and
    of each that already has backslashes there, so that ``unescape`` gives the text back."""
    return _CONTROL.sub(lambda m: f"{m[1] or m[3]}\\{m[2] or m[4]}", text)


def unescape(text: str) -> str:
    return _ESCAPED.sub(lambda m: f"{m[1] or m[3]}{m[2] or m[4]}", text)


def _marked(role: str, text: str) -> str:
    inner = escape(text)
    if role == "user":
        return f"[INST] {inner} [/INST]"
    if role == "assistant":
        return f" {inner} </s>"
    if role == "system":
        return f"<<SYS>>\n{inner}\n<</SYS>>\n"
    return f"[ROLE {quote(role, safe='')}] {inner} [/ROLE]"


class _MarkedTurns(dict):
    """Turns as they are marked: a prefix shows them again and again."""

    chars = 0

    def __missing__(self, turn: tuple[str, str]) -> str:
        marked = _marked(*turn)
        self.chars += len(turn[1]) + len(marked)
        if self.chars > KEPT_CHARS:
            self.clear()
            self.chars = len(turn[1]) + len(marked)
        self[turn] = marked
        return marked


_marked_turns = _MarkedTurns()


def render_marked(turns: Turns) -> str:
    return BEGIN + "".join(map(_marked_turns.__getitem__, turns))


def read_marked(text: str, first: bool) -> tuple[Turns, int]:
    at, turns = len(BEGIN) if first and text.startswith(BEGIN) else 0, []
    while found := _TURN.match(text, at):
        role = "other" if found["name"] is not None else found.lastgroup
        turns.append((unquote(found["name"]) if role == "other" else role, unescape(found[role])))
        at = found.end()
    return turns, at


MARKED = Template(render_marked, read_marked, unescape)


# --- rendering by prefixes ---


def _common_prefix(a: str, b: str) -> int:
    low, high = 0, min(len(a), len(b))
    while low < high:
        middle = (low + high + 1) // 2
        if a[low:middle] == b[low:middle]:
            low = middle
        else:
            high = middle - 1
    return low


def spans(
    turns: Iterator[tuple[str, str]], template: Template, earlier: Turns | None = None
) -> Iterator[tuple[int, str, int | None, int | None]]:
    """(kept, piece, text start, text stop) per turn; offsets count characters of the whole output.

    The output after a turn is the first ``kept`` characters of the output before it, then ``piece``.
    Start and stop are None where the template shows the text other than between header and trailer.
    ``earlier`` are the turns before, for a template without ``memory``.
    """
    shown: Turns = list(earlier or ())
    before = template.render(shown) if shown else ""
    length = len(before)
    for role, text in turns:
        head = shown if template.memory is None else shown[:1] + shown[1:][-template.memory :]
        if len(head) < len(shown):
            before = template.render(head)
        now = template.render([*head, (role, text)])
        same = len(before) if now.startswith(before) else _common_prefix(before, now)
        kept = length - (len(before) - same)
        a, b = (template.render([*head, (role, probe)]) for probe in "ab")
        start = _common_prefix(a, b)
        tail = _common_prefix(a[::-1], b[::-1])
        offset = kept - same
        located = (
            len(a) == start + 1 + tail and len(now) >= start + tail and now[:start] == a[:start] and now.endswith(a[start + 1 :])
        )
        yield kept, now[same:], *((offset + start, offset + len(now) - tail) if located else (None, None))
        length, before = offset + len(now), now
        shown = head
        shown.append((role, text))


_FORMATTED = (
    "conv_id bigint, place bigint, role string, kept bigint, piece string, text_start bigint, text_stop bigint, learn boolean, rewrites boolean"
)


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    for batch in batches:
        for start in range(0, len(batch), 500):
            yield from batch.slice(start, 500).to_pylist()


def _by_conversation(rows: Iterator[dict]) -> Iterator[tuple[tuple[int | None, int], Iterator[dict]]]:
    """Neighbouring rows with the same conv_id and block, as streams; each is read to its end before the next one."""
    row = next(rows, None)
    while row is not None:
        key, ended = (row["conv_id"], row.get("block", 0)), False

        def own() -> Iterator[dict]:
            nonlocal row, ended
            while row is not None and (row["conv_id"], row.get("block", 0)) == key:
                yield row
                row = next(rows, None)
            ended = True

        stream = own()
        yield key, stream
        if not ended:
            for _ in stream:
                pass


def _batched(rows: Iterator[dict], schema: pa.Schema, size: Callable[[dict], int]) -> Iterator[pa.RecordBatch]:
    held, chars = [], 0
    for row in rows:
        held.append(row)
        chars += size(row) + 100
        if chars >= BATCH_CHARS:
            yield pa.RecordBatch.from_pylist(held, schema)
            held, chars = [], 0
    if held:
        yield pa.RecordBatch.from_pylist(held, schema)


def _in_blocks(rows: DataFrame, block_turns: int) -> DataFrame:
    """The rows with a ``block``. A conversation of more than ``block_turns`` rows has several: the turns of a block stand in
    it and in all later ones, whose prefixes begin with them."""
    counted = rows.groupBy(F.col("conv_id").alias("_conv_id")).agg(F.count("*").alias("_turns")).filter(F.col("_turns") > block_turns)
    if counted.isEmpty():
        return rows.withColumn("block", F.lit(0))
    # At most a row for each ``block_turns`` rows.
    known = rows.join(F.broadcast(counted), F.col("conv_id").eqNullSafe(F.col("_conv_id")), "left").drop("_conv_id")
    place = F.row_number().over(Window.partitionBy("conv_id").orderBy("turn", "role", "text")) - 1
    block = lambda at: F.floor(at / block_turns).cast("int")
    dealt = known.filter("_turns IS NOT NULL").withColumn("_place", place)
    dealt = dealt.withColumn("block", F.explode(F.sequence(block(F.col("_place")), block(F.col("_turns") - 1))))
    return known.filter("_turns IS NULL").drop("_turns").withColumn("block", F.lit(0)).unionByName(dealt.drop("_turns", "_place"))


def format_conversations(
    conversations: DataFrame, template: Template = MARKED, learned: tuple[str, ...] = ("assistant",), block_turns: int = BLOCK_TURNS
) -> DataFrame:
    """A row per turn: ``conv_id, place, role, kept, piece, text_start, text_stop, learn, rewrites``.

    A conversation's output are its pieces in the order of ``place``, each put behind the first ``kept``
    characters of what came before. ``learn`` marks the turns whose text (from ``text_start`` to ``text_stop``)
    is under the loss mask; ``rewrites`` those whose rendering changed what earlier turns had given.
    """
    schema = pa.schema(
        [("conv_id", pa.int64()), ("place", pa.int64()), ("role", pa.string()), ("kept", pa.int64()), ("piece", pa.string())]
        + [("text_start", pa.int64()), ("text_stop", pa.int64()), ("learn", pa.bool_()), ("rewrites", pa.bool_())]
    )

    def formatted(rows: Iterator[dict]) -> Iterator[dict]:
        for (conv_id, block), own in _by_conversation(rows):
            first = block * block_turns
            earlier = [(row["role"] or "", row["text"] or "") for row in islice(own, first)]
            roles: list[str] = []

            def turns() -> Iterator[tuple[str, str]]:
                for row in own:
                    roles.append(row["role"] or "")
                    yield roles[-1], row["text"] or ""

            length = len(template.render(earlier)) if earlier else 0
            for place, (kept, piece, start, stop) in enumerate(spans(turns(), template, earlier), first):
                role = roles.pop()
                yield {
                    "conv_id": conv_id, "place": place, "role": role, "kept": kept, "piece": piece, "text_start": start,
                    "text_stop": stop, "learn": role in learned, "rewrites": kept < length,
                }
                length = kept + len(piece)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from _batched(formatted(_rows(batches)), schema, lambda row: len(row["piece"]))

    columns = [F.col("conv_id").cast("bigint").alias("conv_id"), "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text")]
    rows = conversations.select(*columns)
    rows = rows.withColumn("block", F.lit(0)) if template.memory is not None else _in_blocks(rows, block_turns)
    ordered = rows.repartition("conv_id", "block").sortWithinPartitions("conv_id", "block", "turn", "role", "text")
    return ordered.select("conv_id", "block", "role", "text").mapInArrow(run, _FORMATTED)


def read_back(formatted: DataFrame, template: Template = MARKED, whole: bool = False) -> DataFrame:
    """Per conversation what its formatted output holds: ``conv_id, n_turns, turns_sha256, loss_chars,
    loss_sha256, formatted_chars, rewritten``.

    Turns are read from the marks in the output, the loss from its mask; both are unescaped. With ``whole``
    a conversation's output is put together before it is read, as rewriting templates need; otherwise turns are taken off
    as they are complete, and for a conversation whose history was rewritten the turns and the loss are null.
    A turn under the mask whose text was not located makes the loss null.
    """
    schema = pa.schema(
        [("conv_id", pa.int64()), ("n_turns", pa.int64()), ("turns_sha256", pa.string()), ("loss_chars", pa.int64())]
        + [("loss_sha256", pa.string()), ("formatted_chars", pa.int64()), ("rewritten", pa.bool_())]
    )

    def digested(rows: Iterator[dict]) -> Iterator[dict]:
        for (conv_id, _), own in _by_conversation(rows):
            turns_sha, loss_sha = hashlib.sha256(), hashlib.sha256()
            n_turns = loss_chars = length = 0
            held, first, rewritten, located = "", True, False, True
            masked: list[tuple[int, int]] = []

            def take(text: str) -> str:
                nonlocal n_turns, first
                turns, taken = template.read(text, first)
                for role, said in turns:
                    turns_sha.update(f"{role}\n{said}\n".encode())
                n_turns += len(turns)
                first = first and not taken
                return text[taken:]

            def learn(said: str) -> None:
                nonlocal loss_chars
                loss_sha.update(template.unescape(said).encode())
                loss_chars += len(template.unescape(said))

            for row in own:
                rewritten |= row["kept"] < length
                length = row["kept"] + len(row["piece"])
                if whole:
                    held = held[: row["kept"]] + row["piece"]
                    # A rewritten span can't be learned from any more.
                    masked = [span for span in masked if span[1] <= row["kept"]]
                elif not rewritten:
                    held = take(held + row["piece"])
                if row["learn"] and row["text_start"] is None:
                    located = False
                elif row["learn"] and whole:
                    masked.append((row["text_start"], row["text_stop"]))
                elif row["learn"] and not rewritten:
                    learn(row["piece"][row["text_start"] - row["kept"] : row["text_stop"] - row["kept"]])
            if whole:
                for start, stop in masked:
                    learn(held[start:stop])
                take(held)
            known = whole or not rewritten
            yield {
                "conv_id": conv_id, "n_turns": n_turns if known else None, "turns_sha256": turns_sha.hexdigest() if known else None,
                "loss_chars": loss_chars if known and located else None, "loss_sha256": loss_sha.hexdigest() if known and located else None,
                "formatted_chars": length, "rewritten": rewritten,
            }

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from _batched(digested(_rows(batches)), schema, lambda row: 200)

    ordered = formatted.repartition("conv_id").sortWithinPartitions("conv_id", "place")
    return ordered.select("conv_id", "place", "kept", "piece", "text_start", "text_stop", "learn").mapInArrow(
        run, "conv_id bigint, n_turns bigint, turns_sha256 string, loss_chars bigint, loss_sha256 string, formatted_chars bigint, rewritten boolean"
    )


def probe_rewriting(turns: Turns, template: Template) -> int | None:
    """The first place whose rendering changes what came before it, by full prefixes; None if there is none."""
    length = 0
    for place, (kept, piece, *_) in enumerate(spans(iter(turns), Template(template.render, template.read, template.unescape))):
        if kept < length:
            return place
        length = kept + len(piece)
    return None
