"""Benchmark decontamination: passages of training text against a BM25 index of test items.

The index holds an item's terms with BM25 weights, divided by the score the item gives itself: a
score is the share of an item, by weight, that a passage has. Posting lists are cut into blocks of
items, each with its greatest weight. All passages (overlapping windows of a text) are queried. As in
block-max WAND, nothing is scored whose upper bound stays below the threshold: the terms with the longest lists,
as long as together they can't reach the threshold, open no block and count with an upper bound; the others open
the blocks on their lists; then block maxima take the place of the bounds, and only what is still above the
threshold is scored in full. This is done for all passages of a slice of texts at once.

What is retrieved is verified in the document: a sufficient share of the n-grams of the question and of
the answer must each occur in the passage. Without columns of those names, the last sentence of an
item is its answer and the rest its question (one sentence alone is both).

Letters and digits make words, other ASCII signs separate them. In scripts that are written without spaces
(``SPACELESS``) each character is a word. Items below ``MIN_WORDS`` words are too short for shares: they are found where
a document holds all their words in a row, with a score of 1. Words and n-grams are told apart by 64-bit hashes.

The index is built in tasks, a shard of items each, whose size is bounded; their number grows with the benchmark. Document
frequencies and the mean length are counted over all items before, so a score doesn't depend on the shards. Every
distinct row of the benchmark is an item, whatever its id: rows that share an id are found one by one, and those without an
id are found with a null one. Items without a word (null, empty, signs only) are in no document. Null or empty texts match
nothing; repeated documents are matched each; an empty table gives an empty result. Other columns play no part.
"""

from __future__ import annotations

import pickle
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession, functions as F

from stellwerk.llm.batches import SLICE_BYTES, kept_rows, mix, stored, text_slices
from stellwerk.llm.shingles import words

THRESHOLD = 0.5
OVERLAP = 0.5
MIN_WORDS = 5
GRAM = 3
BLOCK_ITEMS = 8
# Passages start every STEP words and are twice as long. Longer items are indexed in parts of STEP words.
STEP = 64
SHARD_BYTES = 8 << 20
K1, B = 1.2, 0.75
# Bounds err on the safe side by this much; scores are compared as they are.
SAFE = 1e-6
# Postings and bounds of blocks held at once, and pairs of passage and block scored at once.
OPENED, PAIRS = 1 << 20, 1 << 13

# Of lower-cased texts, letters and digits stay; other ASCII bytes separate words.
_CLEAN = np.arange(256, dtype=np.uint8)
_CLEAN[[b for b in range(128) if not chr(b).isalnum()]] = 32
_WORD = re.compile(r"[0-9A-Za-z]|[^\x00-\x7f]")
_FACTOR = np.uint64(0x9E3779B97F4A7C15)

SPACELESS = ("Han", "Hiragana", "Katakana", "Bopomofo", "Yi", "Thai", "Lao", "Khmer", "Myanmar", "Tibetan", "Javanese", "Balinese")
_SPACELESS = "([" + "".join(rf"\p{{{script}}}" for script in SPACELESS) + "])"


def _spaced(texts: pa.Array) -> pa.Array:
    """Lower-cased texts, with spaces around the characters of scripts that have none."""
    low = pc.utf8_lower(texts.cast(pa.large_string()))
    # Most texts have no such character; a null text is as good as an empty one.
    other = pc.fill_null(pc.invert(pc.string_is_ascii(low)), False)
    other = pc.and_(other, pc.fill_null(pc.match_substring_regex(pc.if_else(other, low, ""), _SPACELESS), False))
    if not pc.any(other).as_py():
        return low
    return pc.replace_with_mask(low, other, pc.replace_substring_regex(low.filter(other), _SPACELESS, r" \1 "))


def _words(offsets: np.ndarray, data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, hash) of the words of a slice. A single long text is read in stretches that end between words."""
    clean = _CLEAN[data]
    if len(offsets) > 2 or len(clean) <= SLICE_BYTES:
        return words(offsets, clean)
    raw, codes, start = clean.tobytes(), [], 0
    while start < len(raw):
        stop = raw.find(b" ", start + SLICE_BYTES)
        stop = len(raw) if stop < 0 else stop
        codes.append(words(np.array([0, stop - start]), clean[start:stop])[1])
        start = stop
    code = np.concatenate(codes)
    return np.zeros(len(code), np.int64), code


def _words_of(texts: list[str]) -> list[np.ndarray]:
    """The hashed words of each text."""
    result = []
    for _, offsets, data in text_slices(_spaced(pa.array(texts, pa.large_string()))):
        row, code = _words(offsets, data)
        result += np.split(code, np.cumsum(np.bincount(row, minlength=len(offsets) - 1))[:-1])
    return result


def _runs(code: np.ndarray, size: int) -> np.ndarray:
    """A hash of each run of ``size`` neighbouring words, by its first word."""
    n = max(len(code) - size + 1, 0)
    run = np.full(n, size, np.uint64)
    for i in range(size):
        run = mix(run * _FACTOR + code[i : i + n])
    return run


def _grams(code: np.ndarray) -> tuple[int, np.ndarray]:
    """(size, distinct n-grams); fewer words than ``GRAM`` are one n-gram."""
    size = min(GRAM, len(code))
    return size, np.unique(_runs(code, size)) if size else np.empty(0, np.uint64)


def _entries(code: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """(distinct terms, their counts) of each part that an item is indexed in; none for a short item."""
    if len(code) < MIN_WORDS:
        return []
    return [np.unique(part, return_counts=True) for part in np.array_split(code, max(1, round(len(code) / STEP)))]


def question_and_answer(text: str) -> tuple[str, str]:
    sentences = [s for s in re.split(r"(?<=[.!?])\s+|(?<=[\u3002\uff01\uff1f])", text.strip()) if _WORD.search(s)]
    if len(sentences) < 2:
        return text, text
    return " ".join(sentences[:-1]), sentences[-1]


@dataclass(frozen=True)
class Lists:
    """Posting lists of all terms, one after the other: ``at[starts[t]:starts[t + 1]]`` are term t's."""

    starts: np.ndarray
    at: np.ndarray
    weight: np.ndarray

    def open(self, terms: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(which of ``terms``, place, weight) of all their postings."""
        which, posting = _ranges(self.starts[terms], self.starts[terms + 1])
        return which, self.at[posting], self.weight[posting]


def _ranges(begins: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(which range, number in it) of all numbers of some ranges."""
    size = ends - begins
    return np.repeat(np.arange(len(size)), size), np.repeat(begins - (np.cumsum(size) - size), size) + np.arange(size.sum())


@dataclass(frozen=True)
class Statistics:
    """Over all items: how many entries hold each term (terms sorted), how many there are, and their mean length."""

    terms: np.ndarray
    df: np.ndarray
    entries: int
    mean: float


@dataclass(frozen=True)
class Index:
    terms: np.ndarray  # hashes, sorted
    items: np.ndarray  # item of each entry, by its place among the rows
    ids: list[int | None]  # id of each item, which others may share
    parts: list[tuple[tuple[int, np.ndarray], tuple[int, np.ndarray]]]  # n-grams of question and answer
    entries: Lists
    blocks: Lists
    block_keys: np.ndarray  # term and block of each block on a list, as one number
    block_starts: np.ndarray  # first posting of each block on a list, and the end
    greatest: np.ndarray
    short: dict[int, tuple[np.ndarray, np.ndarray]]  # by number of words: hashes (sorted) and items of short ones


def count_terms(codes: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, int, int]:
    """(terms, number of entries with each, entries, their words)."""
    entries = [entry for code in codes for entry in _entries(code)]
    terms, df = np.unique(np.concatenate([np.empty(0, np.uint64), *(t for t, _ in entries)]), return_counts=True)
    return terms, df, len(entries), int(sum(n.sum() for _, n in entries))


def build_index(rows: list[tuple[int | None, str, str, str]], statistics: Statistics | None = None) -> Index:
    """Index (item id, text, question, answer) rows; rows with the same id or none are items of their own.

    ``statistics`` of a benchmark that the rows are a part of; by default the rows are all there is.
    """
    codes = _words_of([text for _, text, _, _ in rows])
    questions, answers = (_words_of([row[i] for row in rows]) for i in (2, 3))
    if statistics is None:
        known, df, n_entries, n_words = count_terms(codes)
        statistics = Statistics(known, df, n_entries, n_words / max(n_entries, 1))
    entries, items, short = [], [], {}
    for item, code in enumerate(codes):
        own = _entries(code)
        entries += own
        items += [item] * len(own)
        if not own and len(code):
            short.setdefault(len(code), []).append((_runs(code, len(code))[0], item))
    terms = np.unique(np.concatenate([np.empty(0, np.uint64), *(t for t, _ in entries)]))
    df = statistics.df[np.searchsorted(statistics.terms, terms)] if len(terms) else np.empty(0)
    idf = np.log(1 + (statistics.entries - df + 0.5) / (df + 0.5))
    term, place, weight = [np.empty(0, np.int64)], [np.empty(0, np.int64)], [np.empty(0)]
    for number, (own_terms, tf) in enumerate(entries):
        at = np.searchsorted(terms, own_terms)
        own = idf[at] * tf * (K1 + 1) / (tf + K1 * (1 - B + B * tf.sum() / statistics.mean))
        term.append(at)
        place.append(np.full(len(at), number))
        weight.append(own / own.sum())
    term, place, weight = (np.concatenate(x) for x in (term, place, weight))
    order = np.lexsort((place, term))
    term, place, weight = term[order], place[order], weight[order]
    # The greatest weight of each term in each block of entries.
    n_blocks = len(entries) // BLOCK_ITEMS + 1
    key = term * n_blocks + place // BLOCK_ITEMS
    first = np.flatnonzero(np.diff(key, prepend=-1))
    block_max = np.maximum.reduceat(weight, first) if len(key) else np.empty(0)
    block_term, numbers = term[first], np.arange(len(terms) + 1)
    greatest = np.zeros(len(terms))
    np.maximum.at(greatest, block_term, block_max)
    exact = {}
    for size, found in short.items():
        code, item = (np.array(x) for x in zip(*sorted(found)))
        exact[size] = code.astype(np.uint64), item
    return Index(
        terms,
        np.array(items, np.int64),
        [row[0] for row in rows],
        [(_grams(q), _grams(a)) for q, a in zip(questions, answers)],
        Lists(np.searchsorted(term, numbers), place, weight),
        Lists(np.searchsorted(block_term, numbers), place[first] // BLOCK_ITEMS, block_max),
        key[first],
        np.append(first, len(key)),
        greatest,
        exact,
    )


def retrieve(index: Index, passage: np.ndarray, term: np.ndarray, passages: int, threshold: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(passage, entry, score) of everything that scores at least ``threshold``.

    ``passage`` and ``term`` are the distinct known terms of each of ``passages`` passages, in order.
    """
    found = [(np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0))]
    size = index.blocks.starts[term + 1] - index.blocks.starts[term]
    order = np.lexsort((-size, passage))
    starts = np.searchsorted(passage, np.arange(passages + 1))
    # Terms with long lists open no block, as long as all of them together stay below the threshold.
    total = np.append(0.0, np.cumsum(index.greatest[term[order]]))
    opens = total[1:] - total[starts[passage]] >= threshold - SAFE
    opening = np.zeros(len(term), bool)
    opening[order] = opens
    ceiling = np.bincount(passage[~opening], index.greatest[term[~opening]], passages)
    # Passages go in groups of about OPENED postings and places for bounds.
    n_blocks = len(index.items) // BLOCK_ITEMS + 1
    work = np.cumsum(np.bincount(passage, size, passages) + n_blocks)
    cuts = np.unique(np.searchsorted(work, np.arange(0, work[-1], OPENED))).tolist() if len(term) else []
    for low, high in zip(cuts, [*cuts[1:], passages]):
        part = slice(starts[low], starts[high])
        own, row, some = term[part], passage[part] - low, opening[part]

        def bounds(chosen: np.ndarray) -> np.ndarray:
            which, block, weight = index.blocks.open(own[chosen])
            return np.bincount(row[chosen][which] * n_blocks + block, weight, (high - low) * n_blocks).reshape(-1, n_blocks)

        bound = bounds(some)
        still = bound + ceiling[low:high, None] >= threshold - SAFE
        # The other terms' block maxima, only for passages that have an open block.
        bound += bounds(~some & still.any(axis=1)[row])
        key = np.flatnonzero(still & (bound >= threshold - SAFE)) + low * n_blocks
        for begin in range(0, len(key), PAIRS):
            found.append(_score(index, key[begin : begin + PAIRS], starts, term, threshold))
    return tuple(np.concatenate(x) for x in zip(*found))


def _score(index: Index, pairs: np.ndarray, starts: np.ndarray, term: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``retrieve`` within some pairs of passage and block."""
    n_blocks, n_entries = len(index.items) // BLOCK_ITEMS + 1, len(index.items)
    owner = pairs // n_blocks
    pair, at = _ranges(starts[owner], starts[owner + 1])
    key = term[at] * n_blocks + (pairs % n_blocks)[pair]
    listed = np.minimum(np.searchsorted(index.block_keys, key), len(index.block_keys) - 1)
    there = index.block_keys[listed] == key
    pair, listed = pair[there], listed[there]
    which, posting = _ranges(index.block_starts[listed], index.block_starts[listed + 1])
    key, place = np.unique(owner[pair[which]] * n_entries + index.entries.at[posting], return_inverse=True)
    score = np.bincount(place, index.entries.weight[posting], len(key))
    enough = score >= threshold - 1e-9
    return key[enough] // n_entries, key[enough] % n_entries, score[enough]


def _passages(index: Index, code: np.ndarray, inside: np.ndarray, lengths: np.ndarray, threshold: float) -> tuple[np.ndarray, ...]:
    """(row, first word, entry, score) of all that is retrieved for the passages of a slice of texts."""
    at = np.minimum(np.searchsorted(index.terms, code), len(index.terms) - 1)
    known = index.terms[at] == code
    # Word i of a row lies in the passages i // STEP and i // STEP - 1 of the row.
    per_row = np.maximum((lengths + STEP - 1) // STEP, 1)
    first = np.cumsum(per_row) - per_row
    passage = np.repeat(first, lengths) + inside // STEP
    earlier = known & (inside >= STEP)
    n = len(index.terms)
    key = np.unique(np.concatenate([passage[known] * n + at[known], (passage[earlier] - 1) * n + at[earlier]]))
    owner, entry, score = retrieve(index, key // n, key % n, int(per_row.sum()), threshold)
    row = np.searchsorted(first, owner, "right") - 1
    return row, (owner - first[row]) * STEP, entry, score


def matches(index: Index, texts: pa.Array, threshold: float, overlap: float) -> Iterator[tuple[int, int | None, float, float, float]]:
    """(row, item id, score, question overlap, answer overlap) for every verified match, by its best passage."""
    for start, offsets, data in text_slices(_spaced(texts)):
        row_of, code = _words(offsets, data)
        lengths = np.bincount(row_of, minlength=len(offsets) - 1)
        begins = np.cumsum(lengths) - lengths
        best: dict[tuple[int, int], tuple[float, float, float]] = {}
        if len(index.items) and len(code):
            runs = {}
            found = _passages(index, code, np.arange(len(code)) - begins[row_of], lengths, threshold)
            for row, begin, entry, score in zip(*(x.tolist() for x in found)):
                item = int(index.items[entry])
                parts = index.parts[item]
                # An item's other parts lie around this passage.
                reach = max(sum(len(grams) for _, grams in parts), STEP) + GRAM
                low = int(begins[row]) + max(begin - reach, 0)
                high = int(begins[row]) + min(begin + 2 * STEP + reach, int(lengths[row]))
                shares = []
                for size, grams in parts:
                    if size and size not in runs:
                        runs[size] = _runs(code, size)
                    shares.append(float(np.isin(grams, runs[size][low : max(high - size + 1, low)]).mean()) if size else 1.0)
                if min(shares) >= overlap:
                    best[row, item] = max(best.get((row, item), (0.0, 0.0, 0.0)), (score, *shares))
        for size, (codes, items) in index.short.items():
            run = _runs(code, size)
            low, high = np.searchsorted(codes, run), np.searchsorted(codes, run, "right")
            at = np.flatnonzero((high > low) & (row_of[: len(run)] == row_of[size - 1 :][: len(run)]))
            which, held = _ranges(low[at], high[at])
            for row, item in set(zip(row_of[at][which].tolist(), items[held].tolist())):
                best[row, item] = (1.0, 1.0, 1.0)
        for (row, item), values in best.items():
            yield (start + row, index.ids[item], *values)


def _count_shards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``shard, term, entries, words``: a row per shard and term, and one without term for the shard's sums."""
    for batch in batches:
        shard_of = np.asarray(batch.column("shard"))
        codes = _words_of(batch.column("text").to_pylist())
        for shard in np.unique(shard_of).tolist():
            terms, df, entries, total = count_terms([codes[i] for i in np.flatnonzero(shard_of == shard)])
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.full(len(terms) + 1, shard, np.int32)),
                    pa.array([None, *terms.view(np.int64).tolist()], pa.int64()),
                    pa.array(np.append(entries, df).astype(np.int64)),
                    pa.array(np.append(total, np.zeros(len(terms))).astype(np.int64)),
                ],
                ["shard", "term", "entries", "words"],
            )


def _shard_builder(entries: int, mean: float) -> Callable[[pa.Table, pa.Table], pa.Table]:
    def build(items: pa.Table, known: pa.Table) -> pa.Table:
        # Every shard has items, and the same order of them whatever order they came in.
        rows = items.drop_columns("shard").to_pylist()
        rows.sort(key=lambda r: [(v is not None, v) if v is not None else (False, 0) for v in r.values()])
        full = [
            (r["item_id"], r["text"], *((r["question"] or "", r["answer"] or "") if "question" in r else question_and_answer(r["text"])))
            for r in rows
        ]
        terms = np.asarray(known.column("term").combine_chunks()).view(np.uint64)
        order = np.argsort(terms)
        df = np.asarray(known.column("df").combine_chunks())
        index = build_index(full, Statistics(terms[order], df[order], entries, mean))
        shard = items.column("shard")[0].as_py()
        return pa.table({"shard": pa.array([shard], pa.int32()), "index": pa.array([pickle.dumps(index)], pa.binary())})

    return build


def indexes(spark: SparkSession, items: DataFrame) -> Iterator[Broadcast]:
    """A broadcast index per shard of items; a shard's texts have about ``SHARD_BYTES``."""
    given = {"question", "answer"} <= set(items.columns)
    strings = ["text", *(["question", "answer"] if given else [])]
    chosen = items.select(F.col("item_id").cast("bigint").alias("item_id"), *[F.col(c).cast("string").alias(c) for c in strings])
    rows = stored(chosen.filter("text IS NOT NULL").distinct(), "benchmark")
    lengths = [F.coalesce(F.octet_length(c), F.lit(0)) for c in strings]
    shards = -(-(rows.agg(F.sum(sum(lengths[1:], lengths[0]))).first()[0] or 0) // SHARD_BYTES) or 1
    rows = rows.withColumn("shard", F.pmod(F.xxhash64("item_id", *strings), F.lit(shards)).cast("int"))
    counts = stored(rows.select("shard", "text").mapInArrow(_count_shards, "shard int, term bigint, entries bigint, words bigint"), "terms")
    sums = counts.filter("term IS NULL").agg(F.sum("entries"), F.sum("words")).first()
    terms = counts.filter("term IS NOT NULL")
    known = terms.select("shard", "term").distinct().join(terms.groupBy("term").agg(F.sum("entries").alias("df")), "term")
    build = _shard_builder(sums[0] or 0, (sums[1] or 0) / max(sums[0] or 0, 1))
    built = stored(
        rows.groupBy("shard").cogroup(known.select("shard", "term", "df").groupBy("shard")).applyInArrow(build, "shard int, index binary"),
        "index",
    )
    for shard in range(shards):
        found = built.filter(F.col("shard") == shard).select("index").first()
        if found:
            yield spark.sparkContext.broadcast(pickle.loads(found[0]))


_FOUND = "doc_id bigint, item_id bigint, score double, question_overlap double, answer_overlap double"


def contaminations(
    spark: SparkSession, docs: DataFrame, items: DataFrame, threshold: float = THRESHOLD, overlap: float = OVERLAP
) -> DataFrame:
    """``doc_id, item_id, score, question_overlap, answer_overlap``: every document that holds an item.

    A row per document row and item (two where two items of one id are held); documents without a match have no row.
    """
    result = spark.createDataFrame([], _FOUND)
    for index in indexes(spark, items):

        def run(batches: Iterator[pa.RecordBatch], index=index) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                found = list(matches(index.value, batch.column("text"), threshold, overlap))
                rows, *columns = zip(*found) if found else ((),) * 5
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").take(pa.array(rows, pa.int64()))]
                    + [pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.float64(), pa.float64(), pa.float64()))],
                    ["doc_id", "item_id", "score", "question_overlap", "answer_overlap"],
                )

        result = result.unionByName(docs.select("doc_id", "text").mapInArrow(run, _FOUND))
    return result


def keep_clean(spark: SparkSession, docs: DataFrame, items: DataFrame, threshold: float = THRESHOLD, overlap: float = OVERLAP) -> DataFrame:
    """The rows of ``docs`` that hold no item, with all their columns. One pass per shard of the index; what a pass
    keeps is written, so that a worker holds one shard at a time."""
    for number, index in enumerate(indexes(spark, items)):

        def clean(texts: pa.Array, index=index) -> np.ndarray:
            keep = np.ones(len(texts), bool)
            keep[[m[0] for m in matches(index.value, texts, threshold, overlap)]] = False
            return keep

        docs = kept_rows(stored(docs, "clean") if number else docs, clean)
    return docs
