"""Which tokens of two tokenizers stand for the same bytes, and how often two ids do so in a corpus.

Both tokenizers cut the bytes of a text. ``pandas.merge_asof`` per batch, keyed by text, finds for each token
start the other side's covering token; the union of both directions are all overlaps. Where overlapping
tokens end at the same byte a group ends: the shortest stretches that both sides cut out as a whole.

A corpus repeats its words, and both tokenizers begin anew at a single space between two characters that are no
white space. ``corpus_digests`` therefore keys the merge by the distinct stretches between such spaces, once
for each block of documents, and puts documents together from stretches. ``alignments`` keys it by document.

The counts of id pairs are found without sending documents around: a block's distinct pairs are summed over the
corpus, joined back to their blocks, and each block, which is bounded, works out its documents' sums.

Defined results: null and empty texts, and texts whose token bytes differ from space + text, have no tokens: zeros, no
groups, and '' for the digest. Rows that are repeated are documents of their own, each counted; a null doc_id stays null.
An empty table gives an empty table. Further columns are left out.
"""

from __future__ import annotations

import hashlib
import os
import re
from collections import defaultdict
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import cached_property, lru_cache
from itertools import chain, count, pairwise

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from stellwerk.llm.batches import stored

# A block of documents ends at so many stretches, or so many different ones.
BLOCK_STRETCHES, BLOCK_DISTINCT = 1 << 20, 1 << 18

# Texts that are encoded and merged at once.
_AT_ONCE = 1 << 14

# Stretches that are encoded as one text, which spares most of what a call costs.
_TOGETHER = 64

_UNCLEAN = re.compile(r"\s | \s|\A \s|\s\Z")
_CUT = re.compile(r"(?<=\S) (?=\S)")


class Tokenizer:
    """``encode`` gives all ids of a list of texts and where each text's end; ``token_bytes`` the bytes of every id.

    Texts are given as space + text, which both kinds turn into the same bytes.
    """

    token_bytes: list[bytes]

    @cached_property
    def sizes(self) -> np.ndarray:
        return np.array([len(x) for x in self.token_bytes], np.int64)

    @cached_property
    def names(self) -> pa.Array:
        return pa.array(map(str, range(len(self.token_bytes))), pa.large_string())

    @cached_property
    def _all_bytes(self) -> pa.Array:
        return pa.array(self.token_bytes, pa.large_binary())

    def joined(self, ids: np.ndarray) -> bytes:
        """The bytes of all ``ids``, one after the other."""
        data = self._all_bytes.take(pa.array(ids, pa.int64())).buffers()[2] if len(ids) else None
        return b"" if data is None else data.slice(0, int(self.sizes[ids].sum())).to_pybytes()

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        ids = self._ids(texts)
        ends = np.concatenate(([0], np.cumsum(list(map(len, ids)), dtype=np.int64)))
        return np.fromiter(chain.from_iterable(ids), np.int64, ends[-1]), ends

    def encode_joined(self, texts: list[str], bounds: list[int], base: np.ndarray, plain: bytes) -> tuple[np.ndarray, np.ndarray]:
        """As ``encode``, but each run of texts between neighbouring ``bounds`` is encoded as one text, and its ids dealt
        out by their bytes. Runs whose bytes or bounds of texts the tokens don't keep are encoded text by text."""
        ids, run_ends = self.encode(["".join(texts[i:j]) for i, j in pairwise(bounds)])
        total, data = np.concatenate(([0], np.cumsum(self.sizes[ids]))), self.joined(ids)
        if data == plain:
            ends = np.searchsorted(total, base)
            if np.array_equal(total[ends], base):
                return ids, ends
        parts, counts, alone = [], [], []
        for (i, j), (low, high) in zip(pairwise(bounds), pairwise(run_ends.tolist())):
            own, wanted = total[low : high + 1] - total[low], base[i : j + 1] - base[i]
            ends = np.array([0, high - low]) if j == i + 1 else np.searchsorted(own, wanted)
            kept = data[total[low] : total[high]] == plain[base[i] : base[j]] and np.array_equal(own[ends], wanted)
            if j > i + 1 and not kept:
                alone.append((len(parts), i, j))
            parts.append(ids[low:high])
            counts.append(np.diff(ends))
        again, again_ends = self.encode([text for _, i, j in alone for text in texts[i:j]])
        done = 0
        for place, i, j in alone:
            ends = again_ends[done : done + j - i + 1]
            parts[place], counts[place] = again[ends[0] : ends[-1]], np.diff(ends)
            done += j - i
        return np.concatenate(parts), np.concatenate(([0], np.cumsum(np.concatenate(counts))))


def _byte_of_letter() -> dict[str, int]:
    """The byte-level alphabet: printable Latin-1 bytes stand for themselves, the others for letters from U+0100 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(others)}


class ByteLevel(Tokenizer):
    """A byte-level BPE file of the ``tokenizers`` library; special tokens in texts are plain text."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer as Library

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self._library = Library.from_file(path)
        self._library.encode_special_tokens = True
        letter = _byte_of_letter()
        vocabulary = self._library.get_vocab(with_added_tokens=False)
        self.token_bytes = [b""] * (max(vocabulary.values()) + 1)
        for token, number in vocabulary.items():
            self.token_bytes[number] = bytes(letter[c] for c in token) if all(c in letter for c in token) else token.encode()

    def _ids(self, texts: list[str]) -> list[list[int]]:
        return [found.ids for found in self._library.encode_batch_fast(texts, add_special_tokens=False)]


class Pieces(Tokenizer):
    """A ``sentencepiece`` model that puts a space in front itself; byte pieces stand for their byte."""

    def __init__(self, path: str):
        import sentencepiece

        self._library = sentencepiece.SentencePieceProcessor(model_file=path)
        pieces = [self._library.id_to_piece(i) for i in range(self._library.get_piece_size())]
        self.token_bytes = [
            bytes([int(piece[3:5], 16)]) if self._library.is_byte(i) else piece.replace("▁", " ").encode() for i, piece in enumerate(pieces)
        ]

    def _ids(self, texts: list[str]) -> list[list[int]]:
        return self._library.encode([text[1:] for text in texts], num_threads=1)


Load = tuple[Callable[[str], Tokenizer], str]


@lru_cache(maxsize=4)
def loaded(kind: Callable[[str], Tokenizer], path: str) -> Tokenizer:
    return kind(path)


def stretches(text: str) -> list[str]:
    """``text`` cut in front of each single space that stands between characters that are no white space."""
    parts = text.split(" ")
    # A space in front, and no other white space beside a space or at the end.
    if not parts[0] and parts.count("") == 1 and list(map(str.strip, parts)) == parts:
        return [" " + part for part in parts[1:]]
    if _UNCLEAN.search(text):
        parts = _CUT.split(text)
        return [parts[0], *(" " + part for part in parts[1:])]
    parts = text.split(" ")
    return [" " + part for part in parts[1:]] if not parts[0] else [parts[0], *(" " + part for part in parts[1:])]


def _runs(texts: list[str]) -> list[int]:
    """Bounds of runs of ``texts`` that ``stretches`` cuts out of them again; the other texts are alone."""
    bounds = [0]
    for i in range(0, len(texts), _TOGETHER):
        run = texts[i : i + _TOGETHER]
        bounds.extend([i + len(run)] if stretches("".join(run)) == run else range(i + 1, i + len(run) + 1))
    return bounds


@dataclass
class Aligned:
    """Tokens, overlaps and groups of some texts. Groups are numbered through all texts, as are tokens."""

    intact: np.ndarray
    ids: tuple[np.ndarray, np.ndarray]
    text_of: tuple[np.ndarray, np.ndarray]
    overlaps: pd.DataFrame
    group_of: tuple[np.ndarray, np.ndarray]
    group_text: np.ndarray


def _tokens(ids: np.ndarray, text: np.ndarray, sizes: np.ndarray, base: np.ndarray, ends: np.ndarray) -> pd.DataFrame:
    """``key, start, end, place`` of tokens; starts and ends are bytes in all texts put one after the other."""
    length = sizes[ids]
    total = np.concatenate(([0], np.cumsum(length)))
    begin = base[text] + total[:-1] - total[ends[:-1]][text]
    return pd.DataFrame({"key": text, "start": begin, "end": begin + length, "place": np.arange(len(ids))})


def overlapping(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
    """``a, b``: places of overlapping tokens, with the ends of both. Two tokens overlap where one's start lies in the other."""

    def covering(these: pd.DataFrame, others: pd.DataFrame, names: tuple[str, str]) -> pd.DataFrame:
        met = pd.merge_asof(these, others, on="start", by="key", suffixes=("", "_other"))
        columns = {"place": names[0], "place_other": names[1], "end": f"end_{names[0]}", "end_other": f"end_{names[1]}"}
        return met.dropna(subset=["place_other"]).rename(columns=columns)[["a", "b", "end_a", "end_b"]].astype(np.int64)

    both = pd.concat([covering(a, b, ("a", "b")), covering(b, a, ("b", "a"))], ignore_index=True)
    # Found from both sides where both tokens start together.
    _, first = np.unique((both["a"] * max(len(b), 1) + both["b"]).to_numpy(), return_index=True)
    return both.iloc[first]


def align(texts: list[str], a: Tokenizer, b: Tokenizer, cut: bool = False) -> Aligned:
    """Align the tokens of ``texts`` (each with its leading space; ``cut``: they are ``stretches``), some of them at a time."""
    parts, text, groups, tokens = [], 0, 0, (0, 0)
    for start in range(0, max(len(texts), 1), _AT_ONCE):
        part = _align(texts[start : start + _AT_ONCE], a, b, cut)
        moved = part.overlaps + np.array(tokens)
        parts.append(Aligned(part.intact, part.ids, tuple(x + text for x in part.text_of), moved, tuple(x + groups for x in part.group_of), part.group_text + text))
        text, groups, tokens = text + len(part.intact), groups + len(part.group_text), tuple(n + len(x) for n, x in zip(tokens, part.ids))
    if len(parts) == 1:
        return parts[0]
    both = lambda name: tuple(np.concatenate([getattr(part, name)[side] for part in parts]) for side in (0, 1))
    one = lambda name: np.concatenate([getattr(part, name) for part in parts])
    return Aligned(one("intact"), both("ids"), both("text_of"), pd.concat([part.overlaps for part in parts], ignore_index=True), both("group_of"), one("group_text"))


def _align(texts: list[str], a: Tokenizer, b: Tokenizer, cut: bool) -> Aligned:
    plain = [text.encode() for text in texts]
    intact = np.array([text != " " for text in texts], bool)
    encoded = []
    base = np.concatenate(([0], np.cumsum(list(map(len, plain)), dtype=np.int64)))
    whole, bounds = b"".join(plain), _runs(texts) if cut else None
    for side in (a, b):
        ids, ends = side.encode_joined(texts, bounds, base, whole) if cut else side.encode(texts)
        joined = side.joined(ids)
        begin = np.concatenate(([0], np.cumsum(side.sizes[ids])))[ends]
        if not np.array_equal(begin, base) or joined != whole:
            bounds = begin.tolist()
            intact &= [joined[i:j] == text for i, j, text in zip(bounds, bounds[1:], plain)]
        encoded.append((ids, ends))
    frames, kept = [], []
    for side, (ids, ends) in zip((a, b), encoded):
        text = np.repeat(np.arange(len(texts)), np.diff(ends))
        frame = _tokens(ids, text, side.sizes, base, ends)
        frame = frame[intact[text]].reset_index(drop=True)
        kept.append((ids[frame["place"].to_numpy()], text[frame["place"].to_numpy()]))
        frames.append(frame.assign(place=np.arange(len(frame))))
    overlaps = overlapping(*frames)
    cuts = overlaps.loc[overlaps["end_a"] == overlaps["end_b"], "end_a"].to_numpy()
    groups = tuple(np.searchsorted(cuts, frame["end"].to_numpy()) for frame in frames)
    group_text = np.zeros(len(cuts), np.int64)
    group_text[groups[0]] = kept[0][1]
    return Aligned(intact, (kept[0][0], kept[1][0]), (kept[0][1], kept[1][1]), overlaps[["a", "b"]], groups, group_text)


def _put_together(parts: pa.Array, ends: np.ndarray, sign: str) -> pa.Array:
    """``parts`` between neighbouring ends as one text each, with ``sign`` between them."""
    return pc.binary_join(pa.LargeListArray.from_arrays(pa.array(ends, pa.int64()), parts), pa.scalar(sign, parts.type))


def _group_texts(found: Aligned, *tokenizers: Tokenizer) -> pa.Array:
    sides = []
    for ids, group, tokenizer in zip(found.ids, found.group_of, tokenizers):
        ends = np.searchsorted(group, np.arange(len(found.group_text) + 1))
        sides.append(_put_together(tokenizer.names.take(pa.array(ids, pa.int64())), ends, ","))
    return pc.binary_join_element_wise(*sides, pa.scalar("|", pa.large_string()))


def group_texts(found: Aligned, *tokenizers: Tokenizer) -> list[str]:
    """``a1,a2|b1`` for each group."""
    return _group_texts(found, *tokenizers).to_pylist()


def alignments(docs: DataFrame, a: Load, b: Load) -> DataFrame:
    """Per document ``doc_id, a_ids, b_ids, overlaps, groups``: overlaps are pairs of places in the two lists of ids,
    groups the numbers of tokens that each group has on either side."""
    pair = pa.list_(pa.struct([("a", pa.int32()), ("b", pa.int32())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, len(batch), 64):
                part = batch.slice(start, 64)
                texts = [" " + (text or "") for text in part.column("text").to_pylist()]
                found = align(texts, loaded(*a), loaded(*b))
                ends = [np.searchsorted(text, np.arange(len(texts) + 1)) for text in found.text_of]
                over = [found.overlaps["a"].to_numpy(), found.overlaps["b"].to_numpy()]
                over_ends = np.searchsorted(over[0], ends[0])
                counts = [np.bincount(group, minlength=len(found.group_text)) for group in found.group_of]
                group_ends = np.searchsorted(found.group_text, np.arange(len(texts) + 1))
                columns = [part.column("doc_id").to_pylist(), [], [], [], []]
                for i in range(len(texts)):
                    for side in (0, 1):
                        columns[1 + side].append(found.ids[side][ends[side][i] : ends[side][i + 1]])
                    for out, (left, right), (low, high) in (
                        (columns[3], (over[0] - ends[0][i], over[1] - ends[1][i]), over_ends[i : i + 2]),
                        (columns[4], counts, group_ends[i : i + 2]),
                    ):
                        out.append([{"a": x, "b": y} for x, y in zip(left[low:high].tolist(), right[low:high].tolist())])
                kinds = (pa.int64(), pa.list_(pa.int32()), pa.list_(pa.int32()), pair, pair)
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], ["doc_id", "a_ids", "b_ids", "overlaps", "groups"])

    pairs = "array<struct<a:int,b:int>>"
    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").mapInArrow(
        run, f"doc_id bigint, a_ids array<int>, b_ids array<int>, overlaps {pairs}, groups {pairs}"
    )


# --- corpus-wide counts ---


def _packed(values: np.ndarray) -> bytes:
    return pa.compress(np.ascontiguousarray(values, np.uint32).tobytes(), "zstd", asbytes=True)


def _unpacked(data: bytes, count: int) -> np.ndarray:
    return np.frombuffer(pa.decompress(data, count * 4, "zstd", asbytes=True), np.uint32).astype(np.int64) if count else np.empty(0, np.int64)


def _sums(values: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Sums between neighbouring ends, as whole numbers."""
    total = np.concatenate(([0], np.cumsum(values, dtype=np.int64)))
    return total[ends[1:]] - total[ends[:-1]]


_DOC_COLUMNS = ("n_a", "n_b", "n_groups", "n_links", "n_overlaps")
_BLOCK = (
    "block bigint, doc_id array<bigint>, " + ", ".join(f"{c} array<bigint>" for c in _DOC_COLUMNS) + ", groups_sha256 array<string>, "
    "pair array<bigint>, docs array<int>, sizes array<bigint>, "
    "doc_ends binary, doc_stretch binary, doc_times binary, stretch_ends binary, stretch_pair binary, stretch_times binary"
)


def _pairs_of(found: Aligned, texts: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(pairs, ends, pair, times): distinct id pairs (A id in the upper half) of all groups, and each text's with
    the number of its links. Equal ids of a group are counted before both sides meet."""
    groups = len(found.group_text)
    sides = []
    for ids, group in zip(found.ids, found.group_of):
        both, times = np.unique(group.astype(np.int64) << 32 | ids, return_counts=True)
        sides.append((both >> 32, both & 0xFFFFFFFF, times))
    (a_group, a_id, a_times), (b_group, b_id, b_times) = sides
    b_begin = np.searchsorted(b_group, np.arange(groups + 1))
    met = np.diff(b_begin)[a_group]
    left = np.repeat(np.arange(len(a_group)), met)
    right = np.repeat(b_begin[a_group], met) + np.arange(len(left)) - np.repeat(np.cumsum(met) - met, met)
    pairs, pair = np.unique(a_id[left] << 32 | b_id[right], return_inverse=True)
    key = found.group_text[a_group[left]] * max(len(pairs), 1) + pair
    order = np.argsort(key, kind="stable")
    key, times = key[order], (a_times[left] * b_times[right])[order]
    first = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1]))) if len(key) else np.empty(0, np.int64)
    text, pair = key[first] // max(len(pairs), 1), key[first] % max(len(pairs), 1)
    summed = np.add.reduceat(times, first) if len(first) else times
    return pairs, np.searchsorted(text, np.arange(texts + 1)), pair, summed


def _block(number: int, doc_ids: list, docs: list[np.ndarray], texts: list[str], a: Tokenizer, b: Tokenizer) -> dict:
    """One row for a block: its documents as counted stretches, its stretches as counted pairs, its pairs with the
    number of its documents that hold them."""
    found = align(texts, a, b, cut=True)
    count = len(texts)
    pairs, stretch_ends, stretch_pair, stretch_times = _pairs_of(found, count)
    group_ends = np.searchsorted(found.group_text, np.arange(count + 1))
    named = _put_together(_group_texts(found, a, b), group_ends, ";")
    over_ends = np.searchsorted(found.overlaps["a"].to_numpy(), np.searchsorted(found.text_of[0], np.arange(count + 1)))
    each = {
        "n_a": np.bincount(found.text_of[0], minlength=count), "n_b": np.bincount(found.text_of[1], minlength=count),
        "n_groups": np.diff(group_ends), "n_links": _sums(stretch_times, stretch_ends), "n_overlaps": np.diff(over_ends),
    }
    # A document with a stretch that isn't intact has no tokens.
    docs = [doc if found.intact[doc].all() else doc[:0] for doc in docs]
    ends = np.concatenate(([0], np.cumsum([len(doc) for doc in docs]))).astype(np.int64)
    flat = np.concatenate([*docs, np.empty(0, np.int64)]).astype(np.int64)
    row = {"block": number, "doc_id": doc_ids} | {name: _sums(values[flat], ends) for name, values in each.items()}
    row["groups_sha256"] = [
        hashlib.sha256(_put_together(named.take(pa.array(doc, pa.int64())), [0, len(doc)], ";")[0].as_buffer()).hexdigest() if len(doc) else ""
        for doc in docs
    ]
    owner = np.repeat(np.arange(len(docs)), np.diff(ends))
    both, times = np.unique(owner * max(count, 1) + flat, return_counts=True)
    owner, stretch = both // max(count, 1), both % max(count, 1)
    # Each document's distinct pairs, to count the documents of a pair.
    met = np.diff(stretch_ends)[stretch]
    at = np.repeat(stretch_ends[stretch], met) + np.arange(met.sum()) - np.repeat(np.cumsum(met) - met, met)
    held = np.sort(np.repeat(owner, met) * max(len(pairs), 1) + stretch_pair[at])
    held = held[np.concatenate(([True], held[1:] != held[:-1]))[: len(held)]] % max(len(pairs), 1)
    row["docs"] = np.bincount(held, minlength=len(pairs)).astype(np.int32)
    row["pair"] = pairs
    row["sizes"] = [len(docs), len(stretch), count, len(stretch_pair)]
    packed = {
        "doc_ends": np.searchsorted(owner, np.arange(len(docs) + 1)), "doc_stretch": stretch, "doc_times": times,
        "stretch_ends": stretch_ends, "stretch_pair": stretch_pair, "stretch_times": stretch_times,
    }
    return row | {name: _packed(values) for name, values in packed.items()}


def blocks(docs: DataFrame, a: Load, b: Load, most: tuple[int, int] = (BLOCK_STRETCHES, BLOCK_DISTINCT)) -> DataFrame:
    """The corpus as bounded blocks of documents, a row each. A longer single document is a block of its own."""
    longs, ints = pa.list_(pa.int64()), pa.list_(pa.int32())
    schema = pa.schema(
        [("block", pa.int64()), ("doc_id", longs), *((c, longs) for c in _DOC_COLUMNS), ("groups_sha256", pa.list_(pa.string())), ("pair", longs)]
        + [("docs", ints), ("sizes", longs)]
        + [(c, pa.binary()) for c in ("doc_ends", "doc_stretch", "doc_times", "stretch_ends", "stretch_pair", "stretch_times")]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 32

        def fresh() -> tuple[list, list, defaultdict]:
            return [], [], defaultdict(count().__next__)

        doc_ids, held, numbers = fresh()
        length = 0

        def made() -> pa.RecordBatch:
            row = _block(number, doc_ids, held, list(numbers), loaded(*a), loaded(*b))
            return pa.RecordBatch.from_arrays([pa.array([row[f.name]], f.type) for f in schema], schema=schema)

        for batch in batches:
            for doc_id, text in zip(batch.column("doc_id"), batch.column("text")):
                text = text.as_py()
                parts = stretches(" " + text) if text else []
                doc_ids.append(doc_id.as_py())
                held.append(np.fromiter(map(numbers.__getitem__, parts), np.int64, len(parts)))
                length += len(parts) + 1
                if length >= most[0] or len(numbers) >= most[1]:
                    yield made()
                    number, length = number + 1, 0
                    doc_ids, held, numbers = fresh()
        if doc_ids:
            yield made()

    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").mapInArrow(run, _BLOCK)


def pair_counts(made: DataFrame) -> DataFrame:
    """``pair, n, best`` for ``blocks``: in how many documents an id pair is linked, and whether that is the
    highest count of its A id."""
    held = made.select(F.explode(F.arrays_zip("pair", "docs")).alias("p")).select("p.pair", "p.docs")
    counts = stored(held.groupBy("pair").agg(F.sum("docs").alias("n")), "pair-counts")
    a_id = F.call_function("shiftright", F.col("pair"), F.lit(32))
    # At most a row for each id of the vocabulary.
    highest = counts.groupBy(a_id.alias("a_id")).agg(F.max("n").alias("highest"))
    joined = counts.withColumn("a_id", a_id).join(F.broadcast(highest), "a_id")
    return joined.select("pair", "n", (F.col("n") == F.col("highest")).alias("best"))


def _answer(own: pa.Table, counted: pa.Table) -> pa.Table:
    """The documents of a block, given its pairs' counts."""
    row = {name: own.column(name)[0] for name in own.column_names}
    docs, doc_entries, count, entries = row["sizes"].as_py()
    counted = counted.sort_by("pair")
    n, best = counted.column("n").to_numpy(), counted.column("best").to_numpy(zero_copy_only=False).astype(np.int64)
    unpacked = lambda name, length: _unpacked(row[name].as_py(), length)
    stretch_ends, pair, times = unpacked("stretch_ends", count + 1), unpacked("stretch_pair", entries), unpacked("stretch_times", entries)
    doc_ends, stretch, doc_times = unpacked("doc_ends", docs + 1), unpacked("doc_stretch", doc_entries), unpacked("doc_times", doc_entries)
    sums = [_sums(_sums(times * values[pair], stretch_ends)[stretch] * doc_times, doc_ends) for values in (best, n)]
    named = {name: row[name].values for name in ("doc_id", *_DOC_COLUMNS, "groups_sha256")}
    named |= {"n_best": pa.array(sums[0]), "count_sum": pa.array(sums[1])}
    return pa.table({name: named[name] for name in ("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256", "n_overlaps")})


def corpus_digests(docs: DataFrame, a: Load, b: Load, most: tuple[int, int] = (BLOCK_STRETCHES, BLOCK_DISTINCT)) -> DataFrame:
    """Per document ``doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256, n_overlaps``.

    Links are all pairs of an A and a B token of one group. ``count_sum`` adds up, over the links, in how many documents of
    the corpus their id pair is linked; ``n_best`` counts the links whose pair has the highest such count of its A id.
    """
    made = stored(blocks(docs, a, b, most), "blocks")
    counts = stored(pair_counts(made), "counts")
    asked = made.select(F.col("block").alias("of_block"), F.explode("pair").alias("pair")).join(counts, "pair")
    return (
        made.drop("pair", "docs")
        .groupBy("block")
        .cogroup(asked.select("of_block", "pair", "n", "best").groupBy("of_block"))
        .applyInArrow(
            _answer,
            "doc_id bigint, n_a bigint, n_b bigint, n_groups bigint, n_links bigint, n_best bigint, count_sum bigint, groups_sha256 string, n_overlaps bigint",
        )
    )
