"""Spelling variants: words one error apart, found by search schemes over bidirectional FM-indexes.

Words are maximal runs of letters, A-Z lower-cased. Where 97 divides the crc32 of ``<doc_id>:<run>`` the run
loses a code point in that document. The vocabulary are the results that are long and frequent enough.

Two words one error apart share the first or the second half of either. The vocabulary is therefore kept
twice, in ranges of (length, word) and of (length, word reversed), each range a shard of bounded size with
a bidirectional FM-index of its own. A word is sent to the shards that hold words of its own length or one more or
less with its first half in front (or its second half at the end), which is a range of each order. There
the half is matched exactly and the search goes on across the other half allowing one error. A word that
shares both halves with its neighbour is reported by the first search only.

What the driver holds is the first word of each shard. A shard's queries are dealt out to
several tasks where there are many, each with a copy of the shard.

A word's form is its near word of largest count if that is at least ``ratio`` times its own count. Counts
grow along forms, so chains are short; their ends are found by doubling steps.

Defined results: null and empty texts have no words; rows that are repeated count each; a null doc_id is hashed
as ''. An empty table gives an empty table. Further columns are left out.
"""

from __future__ import annotations

import re
import zlib
from bisect import bisect_left, bisect_right
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from stellwerk.llm.batches import stored
from stellwerk.llm.fm_index import Index

RUN = re.compile("[A-Za-zÀ-ÿ]+")
LETTERS = 5
OCCURRENCES = 3
RATIO = 2
DELETED = 97

# Words and letters of a shard; queries and letters of a task that searches one.
SHARD_WORDS, SHARD_LETTERS = 1 << 16, 1 << 20
QUERY_WORDS, QUERY_LETTERS = 1 << 18, 1 << 22
# Distinct words a task counts before it hands them on.
_HELD = 200_000
_LOWER = {upper: upper + 32 for upper in range(65, 91)}


def words_of(doc_id: int | None, text: str) -> Iterator[tuple[str, int]]:
    """(word, occurrences) of one document; a word may come more than once."""
    begun = zlib.crc32(f"{'' if doc_id is None else doc_id}:".encode())
    for run, count in Counter(RUN.findall(text)).items():
        low = run.lower() if run.isascii() else run.translate(_LOWER)
        hashed = zlib.crc32(low.encode(), begun)
        if hashed % DELETED == 0:
            at = hashed % len(low)
            low = low[:at] + low[at + 1 :]
        yield low, count


def vocabulary(docs: DataFrame, letters: int = LETTERS, occurrences: int = OCCURRENCES) -> DataFrame:
    """``word, n``: words of at least so many code points that occur so often in all texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter[str] = Counter()

        def handed_on() -> pa.RecordBatch:
            return pa.RecordBatch.from_pydict({"word": pa.array(list(held), pa.string()), "n": pa.array(list(held.values()), pa.int64())})

        for batch in batches:
            for doc_id, text in zip(batch.column("doc_id"), batch.column("text")):
                for word, count in words_of(doc_id.as_py(), text.as_py() or ""):
                    if len(word) >= letters:
                        held[word] += count
                if len(held) >= _HELD:
                    yield handed_on()
                    held.clear()
        if held:
            yield handed_on()

    counted = docs.select("doc_id", "text").mapInArrow(run, "word string, n bigint")
    return counted.groupBy("word").agg(F.sum("n").alias("n")).filter(F.col("n") >= occurrences)


def _sharded(words: DataFrame, shards: int, shard_words: int) -> DataFrame:
    """``shard, length, key, word, n`` in ranges of (length, key); no shard is larger than the bounds."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = count = letters = 0
        for batch in batches:
            lengths = batch.column("length").to_numpy()
            shard = np.empty(len(batch), np.int64)
            for i, length in enumerate(lengths.tolist()):
                if count and (count >= shard_words or letters + length > SHARD_LETTERS):
                    number, count, letters = number + 1, 0, 0
                count, letters = count + 1, letters + length
                shard[i] = number
            part = batch.column("part").to_numpy().astype(np.int64)
            yield pa.RecordBatch.from_arrays(
                [pa.array((part << 32) | shard), *(batch.column(c) for c in ("length", "key", "word", "n"))], ["shard", "length", "key", "word", "n"]
            )

    dealt = words.repartitionByRange(shards, "length", "key").sortWithinPartitions("length", "key")
    return dealt.select(F.spark_partition_id().alias("part"), "length", "key", "word", "n").mapInArrow(
        run, "shard bigint, length int, key string, word string, n bigint"
    )


def _half(length: int, side: int) -> int:
    """The letters of the half that is matched exactly: the first one with side 1, the second one with side 0."""
    return length // 2 if side == 1 else length - length // 2


def _routed(words: DataFrame, bounds: list[tuple[int, str, int]], side: int) -> DataFrame:
    """``shard, word, n`` for each shard that can hold a word's neighbours with the half of that side."""
    begins, numbers = [(length, key) for length, key, _ in bounds], [shard for *_, shard in bounds]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            shards, rows = [], []
            for row, key in enumerate(batch.column("key").to_pylist()):
                half = key[: _half(len(key), side)]
                met: set[int] = set()
                for length in (len(key) - 1, len(key), len(key) + 1):
                    # Words in the vocabulary are letters up to U+00FF.
                    first = max(bisect_right(begins, (length, half)) - 1, 0)
                    last = bisect_left(begins, (length, half + "Ā"))
                    met.update(range(first, last))
                shards += [numbers[i] for i in met]
                rows += [row] * len(met)
            taken = batch.select(["word", "n"]).take(pa.array(rows, pa.int64()))
            yield pa.RecordBatch.from_arrays([pa.array(shards, pa.int64()), *taken.columns], ["shard", "word", "n"])

    return words.select("key", "word", "n").mapInArrow(run, "shard bigint, word string, n bigint")


def _letters(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """All words' code points and their ends."""
    ends = np.concatenate(([0], np.cumsum([len(w) for w in words]))).astype(np.int64)
    return np.frombuffer("".join(words).encode("utf-32-le"), np.uint32).astype(np.int64), ends


def _search(side: int):
    """Pairs of the queries and the words of one shard: ``word, n, near, near_n``."""

    def run(indexed: pa.Table, asked: pa.Table) -> pa.Table:
        names = ["word", "n", "near", "near_n"]
        if not len(indexed) or not len(asked):
            return pa.table([pa.array([], t) for t in (pa.string(), pa.int64(), pa.string(), pa.int64())], names)
        words = indexed.column("word").to_pylist()
        letters, ends = _letters(words)
        # Symbols are the code points that the shard has, in order; all others are one symbol that matches nothing.
        known = np.unique(letters)
        index = Index(np.searchsorted(known, letters) + 1, ends)
        found: list[pa.Table] = []
        for start in range(0, len(asked), SHARD_WORDS):
            part = asked.slice(start, SHARD_WORDS).combine_chunks()
            queries = part.column("word").to_pylist()
            symbols, query_ends = _letters(queries)
            place = np.minimum(np.searchsorted(known, symbols), len(known) - 1)
            symbols = np.where(known[place] == symbols, place + 1, len(known) + 1)
            lengths = np.diff(query_ends)
            halves = lengths // 2 if side == 1 else lengths - lengths // 2
            query, word = index.near(symbols, query_ends, halves, side)
            if side == 0:
                new = [not words[w].startswith(queries[q][: len(queries[q]) // 2]) for q, w in zip(query.tolist(), word.tolist())]
                query, word = query[new], word[new]
            near = indexed.take(pa.array(word))
            mine = part.take(pa.array(query))
            found.append(pa.table([mine.column("word"), mine.column("n"), near.column("word"), near.column("n")], names))
        return pa.concat_tables(found)

    return run


def _one_side(words: DataFrame, shards: int, side: int, shard_words: int, query_words: int) -> DataFrame:
    key = F.col("word") if side == 1 else F.reverse("word")
    keyed = words.select(F.length("word").alias("length"), key.alias("key"), "word", "n")
    indexed = stored(_sharded(keyed, shards, shard_words), "shards")
    bounds = [tuple(r) for r in indexed.groupBy("shard").agg(F.min(F.struct("length", "key")).alias("b")).select("b.*", "shard").collect()]
    asked = stored(_routed(keyed, sorted(bounds), side), "queries")
    loads = asked.groupBy("shard").agg(
        F.ceil(F.greatest(F.count("*") / query_words, F.sum(F.length("word")) / QUERY_LETTERS)).alias("tasks")
    )
    # A few columns for each shard: the planner broadcasts them where their measured size allows.
    asked = asked.join(loads, "shard").withColumn("task", F.pmod(F.xxhash64("word"), F.col("tasks")))
    copies = indexed.select("shard", "word", "n").join(loads, "shard").withColumn("task", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("tasks") - 1)))
    return (
        copies.select("shard", "task", "word", "n")
        .groupBy("shard", "task")
        .cogroup(asked.select("shard", "task", "word", "n").groupBy("shard", "task"))
        .applyInArrow(
            lambda left, right: _search(side)(left.select(["word", "n"]), right.select(["word", "n"])), "word string, n bigint, near string, near_n bigint"
        )
    )


def near_words(words: DataFrame, shard_words: int = SHARD_WORDS, query_words: int = QUERY_WORDS) -> DataFrame:
    """``word, n, near, near_n`` for every ordered pair of words of ``word, n`` one error apart.

    One error is one inserted, deleted or replaced code point. Words must be distinct, of letters up to
    U+00FF and of at least four of them.
    """
    count = words.count()
    shards = max(-(-count // shard_words), 1)
    sides = [_one_side(words, shards, side, shard_words, query_words) for side in (1, 0)]
    return sides[0].unionByName(sides[1])


def forms(words: DataFrame, pairs: DataFrame, ratio: int = RATIO) -> DataFrame:
    """``word, n, n_near, form, form_n`` for every word; the form is null where no near word is that much more frequent."""
    near = pairs.groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("less"), "near")).alias("best"))
    joined = words.join(near, "word", "left")
    enough = -F.col("best.less") >= ratio * F.col("n")
    return joined.select(
        "word", "n", F.coalesce("n_near", F.lit(0)).cast("bigint").alias("n_near"),
        F.when(enough, F.col("best.near")).alias("form"), F.when(enough, -F.col("best.less")).alias("form_n"),
    )


def with_roots(formed: DataFrame) -> DataFrame:
    """Add ``root``, the last word that forms lead to. Each step doubles the part of a chain that is known;
    counts at least double along a chain, so its length is at most the logarithm of the largest count."""
    now = formed.withColumn("root", F.coalesce("form", "word"))
    chains = stored(now.filter("form IS NOT NULL").select("word", "root"), "chains")
    while True:
        onward = chains.select(F.col("word").alias("root"), F.col("root").alias("next"))
        stepped = stored(chains.join(onward, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "chains")
        moved = stepped.filter("moved").limit(1).count()
        chains = stepped.select("word", "root")
        if not moved:
            break
    ends = chains.withColumnRenamed("root", "end")
    return now.join(ends, "word", "left").withColumn("root", F.coalesce("end", "root")).drop("end")


def variants(docs: DataFrame, letters: int = LETTERS, occurrences: int = OCCURRENCES, ratio: int = RATIO) -> DataFrame:
    """``word, n, n_near, form, form_n, root`` for the vocabulary of ``doc_id, text``."""
    words = stored(vocabulary(docs, letters, occurrences), "vocabulary")
    formed = stored(forms(words, near_words(words), ratio), "forms")
    return with_roots(formed).select("word", "n", "n_near", "form", "form_n", "root")
