"""Language-model scoring by context-tree weighting over bytes, beside a word unigram baseline.

The model predicts the bytes of the text (A-Z lower-cased) and an end mark, each byte as eight binary
decisions. Every decision has a context tree over the ``DEPTH`` bytes before. A node's estimate is
Krichevsky and Trofimov's; a node's weighted probability mixes its own estimate and the product of
its children, half and half, at all depths. Both depend on nothing but counts, so learning is counting: the
corpus is reduced to counts of byte n-grams of ``DEPTH + 1``, and the trees are weighted over those.
Scoring uses the learned counts without learning further: along a context's path, each node has the
share that its weighting gave it, and an n-gram's probability is that of its eight decisions. N-grams
met only in scored texts are nodes without counts, which predict one half.

The trees are cut at ``TOP`` context bytes: subtrees below are dealt out and weighted in tasks, the levels
above are aggregates. Of the finished table, keys counted often (at most ``MOST_SHARED`` of them, found
by a histogram of counts) are sent to the tasks; for all others the texts' rows (text, key, times) are
joined with the table. Words and n-grams take the same way; words are told apart by 64-bit hashes.

A null text counts as empty: its only token is the end. Rows with a null id are scored but not learned from, and
their ``held_out`` is null. Each of repeated rows is scored by itself.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from stellwerk.llm.batches import lower_ascii, stored, text_slices
from stellwerk.llm.shingles import words

DEPTH = 5
TOP = 3
MOST_SHARED = 1_000_000
BUCKET_GRAMS = 500_000
# What a task counts before it hands on its counts.
_HELD = 2_000_000
_SLICE = 1 << 20
_MARK = 255  # before the first byte and as the end; never part of UTF-8
_GRAM, _WORD = 0, 1
_END = -1  # the end's key among the words
_ROW_BITS = 16


def _log_gamma(x, log=np.log):
    """Stirling's series after eight steps of the recurrence; for arrays and for columns."""
    product = x
    for i in range(1, 8):
        product = product * (x + i)
    y = x + 8.0
    return (y - 0.5) * log(y) - y + 0.5 * math.log(2 * math.pi) + 1 / (12 * y) - 1 / (360 * y * y * y) - log(product)


def log_kt(zeros, ones, log=np.log):
    """Log of the Krichevsky-Trofimov probability of so many zeros and ones."""
    return _log_gamma(zeros + 0.5, log) + _log_gamma(ones + 0.5, log) - _log_gamma(zeros + ones + 1.0, log) - math.log(math.pi)


def text_grams(offsets: np.ndarray, data: np.ndarray, depth: int = DEPTH) -> tuple[np.ndarray, np.ndarray]:
    """(row, n-gram) for every byte and the end of every row; marks stand before a row's first byte."""
    n = len(offsets) - 1
    # Each row with its marks before and its end behind.
    lengths = np.diff(offsets) + depth + 1
    begins = np.cumsum(lengths) - lengths
    padded = np.full(int(lengths.sum()), _MARK, np.uint64)
    inner = np.repeat(begins + depth - offsets[:-1], np.diff(offsets)) + np.arange(len(data))
    padded[inner] = lower_ascii(data)
    code = np.zeros(max(len(padded) - depth, 0), np.uint64)
    for i in range(depth + 1):
        code = (code << np.uint64(8)) | padded[i : len(padded) - depth + i]
    row = np.repeat(np.arange(n), np.diff(offsets) + 1)
    at = np.repeat(begins - (np.cumsum(np.diff(offsets) + 1) - np.diff(offsets) - 1), np.diff(offsets) + 1) + np.arange(len(row))
    return row, code[at].astype(np.int64)


def _summed(keys: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(keys, kind="stable")
    keys, values = keys[order], values[order]
    first = np.flatnonzero(np.diff(keys, prepend=keys[0] - 1)) if len(keys) else np.empty(0, np.int64)
    return keys[first], np.add.reduceat(values, first) if len(keys) else values


class _Counts:
    """Counts by key, kept within a bound by handing them on."""

    def __init__(self, kind: int):
        self.kind, self.parts, self.held = kind, [], 0

    def add(self, keys: np.ndarray, values: np.ndarray) -> Iterator[pa.RecordBatch]:
        self.parts.append((keys, values))
        self.held += len(keys)
        if self.held > _HELD:
            self.parts = [_summed(*(np.concatenate(x) for x in zip(*self.parts)))]
            self.held = len(self.parts[0][0])
            if self.held > _HELD // 2:
                yield from self.flush()

    def flush(self) -> Iterator[pa.RecordBatch]:
        if self.parts:
            keys, values = _summed(*(np.concatenate(x) for x in zip(*self.parts)))
            for a in range(0, len(keys), 100_000):
                part = keys[a : a + 100_000]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(part), self.kind, np.int32)), pa.array(part), pa.array(values[a : a + 100_000])],
                    ["kind", "key", "n"],
                )
        self.parts, self.held = [], 0


def counts(docs: DataFrame) -> DataFrame:
    """``kind, key, n`` over ``text, learn``: n-grams of all texts and words of the learned ones; n counts learned texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grams, tokens = _Counts(_GRAM), _Counts(_WORD)
        for batch in batches:
            learn = batch.column("learn").to_numpy(zero_copy_only=False)
            for start, offsets, data in text_slices(batch.column("text"), _SLICE):
                learned = learn[start : start + len(offsets) - 1]
                row, gram = text_grams(offsets, data)
                # The learned ones sort behind the others within each n-gram.
                packed = np.sort((gram << 1) | learned[row])
                first = np.flatnonzero(np.diff(packed, prepend=packed[0] - 1)) if len(packed) else np.empty(0, np.int64)
                times = np.diff(first, append=len(packed))
                yield from grams.add(packed[first] >> 1, np.where(packed[first] & 1, times, 0))
                row, word = words(offsets, data)
                word = np.sort(word[learned[row]].view(np.int64))
                first = np.flatnonzero(np.concatenate(([True], word[1:] != word[:-1]))) if len(word) else np.empty(0, np.int64)
                yield from tokens.add(word[first], np.diff(first, append=len(word)))
                if learned.any():
                    yield from tokens.add(np.array([_END]), np.array([int(learned.sum())]))
        yield from grams.flush()
        yield from tokens.flush()

    return docs.select("text", "learn").mapInArrow(run, "kind int, key bigint, n bigint").groupBy("kind", "key").agg(F.sum("n").alias("n"))


# --- the trees -----------------------------------------------------------------------------------


def _leaves(grams: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """n-gram x 8: the node (context, bits of the byte so far behind a leading one) and the next bit."""
    byte, context = grams & 255, grams >> 8
    steps = np.arange(8)
    prefix = (1 << steps) | (byte[:, None] >> (8 - steps))
    return (context[:, None] << 8) | prefix, (byte[:, None] >> (7 - steps)) & 1


def _parent(nodes: np.ndarray, depth: int) -> np.ndarray:
    """The nodes' keys with ``depth`` context bytes."""
    return (((nodes >> 8) & ((1 << 8 * depth) - 1)) << 8) | (nodes & 255)


def weighted(grams: np.ndarray, times: np.ndarray, top: int, depth: int = DEPTH) -> list[dict[str, np.ndarray]]:
    """The levels from ``top`` down to ``depth`` of the trees over these n-grams.

    A level has ``node``, ``zeros``, ``ones``, ``own`` (log estimate), ``mixed`` (log weighted probability) and
    ``up``, the place of each node's parent in the level above.
    """
    leaf, bit = _leaves(grams)
    node, place = np.unique(leaf.ravel(), return_inverse=True)
    n = np.repeat(times.astype(np.float64), 8)
    zeros, ones = np.bincount(place, n * (1 - bit.ravel()), len(node)), np.bincount(place, n * bit.ravel(), len(node))
    own = log_kt(zeros, ones)
    levels = [{"node": node, "zeros": zeros, "ones": ones, "own": own, "mixed": own}]
    for d in range(depth - 1, top - 1, -1):
        below = levels[0]
        node, up = np.unique(_parent(below["node"], d), return_inverse=True)
        zeros, ones, children = (np.bincount(up, below[c], len(node)) for c in ("zeros", "ones", "mixed"))
        own = log_kt(zeros, ones)
        below["up"] = up
        levels.insert(0, {"node": node, "zeros": zeros, "ones": ones, "own": own, "mixed": np.logaddexp(own, children) - math.log(2)})
    return levels


def log10_probabilities(grams: np.ndarray, levels: list[dict[str, np.ndarray]], sure: np.ndarray, rest: np.ndarray) -> np.ndarray:
    """log10 of each n-gram's probability. ``sure`` and ``rest``: for the nodes of the first level, the
    probability of a one that the levels above give, and the share they leave to this one."""
    for i, level in enumerate(levels):
        if i:
            sure, rest = sure[level["up"]], rest[level["up"]]
        one = (level["ones"] + 0.5) / (level["zeros"] + level["ones"] + 1)
        share = np.exp(level["own"] - math.log(2) - level["mixed"]) if i + 1 < len(levels) else 1.0
        sure, rest = sure + rest * share * one, rest * (1 - share)
    leaf, bit = _leaves(grams)
    one = sure[np.searchsorted(levels[-1]["node"], leaf)]
    return np.log10(np.where(bit == 1, one, 1 - one)).sum(axis=1)


def _with_estimates(nodes: DataFrame) -> DataFrame:
    own = log_kt(F.col("zeros"), F.col("ones"), F.log)
    high, low = F.greatest("own", "children"), F.least("own", "children")
    return nodes.withColumn("own", own).withColumn("mixed", high + F.log1p(F.exp(low - high)) - math.log(2))


def _parent_column(node: Column, depth: int) -> Column:
    context = F.shiftright(node, 8).bitwiseAND(F.lit((1 << 8 * depth) - 1))
    return F.shiftleft(context, 8).bitwiseOR(node.bitwiseAND(F.lit(255)))


def gram_scores(counted: DataFrame) -> DataFrame:
    """``key, n, value``: log10 of the model's probability of each n-gram's last byte after the others."""
    grams = counted.filter(F.col("kind") == _GRAM)
    buckets = max(16, -(-grams.count() // BUCKET_GRAMS))
    low = F.shiftright("key", 8).bitwiseAND(F.lit((1 << 8 * TOP) - 1))
    dealt = grams.select("key", "n", F.pmod(F.xxhash64(low), F.lit(buckets)).cast("int").alias("bucket"))

    def subtrees(group: pa.Table) -> pa.Table:
        top = weighted(group.column("key").to_numpy(), group.column("n").to_numpy(), TOP)[0]
        bucket = np.full(len(top["node"]), group.column("bucket")[0].as_py(), np.int32)
        return pa.table({"bucket": bucket, **{c: top[c] for c in ("node", "zeros", "ones", "mixed")}})

    base = stored(
        dealt.groupBy("bucket").applyInArrow(subtrees, "bucket int, node bigint, zeros double, ones double, mixed double"),
        "subtrees",
    )
    levels = [base]
    for depth in range(TOP - 1, -1, -1):
        above = (
            levels[0]
            .groupBy(_parent_column(F.col("node"), depth).alias("node"))
            .agg(F.sum("zeros").alias("zeros"), F.sum("ones").alias("ones"), F.sum("mixed").alias("children"))
        )
        levels.insert(0, stored(_with_estimates(above), "tree-level"))
    flow = None
    for depth, level in enumerate(levels[:-1]):
        if flow is None:
            level = level.withColumns({"sure": F.lit(0.0), "rest": F.lit(1.0)})
        else:
            level = level.join(flow, _parent_column(F.col("node"), depth - 1) == F.col("parent"))
        one = (F.col("ones") + 0.5) / (F.col("zeros") + F.col("ones") + 1)
        share = F.exp(F.col("own") - math.log(2) - F.col("mixed"))
        flow = level.select(
            F.col("node").alias("parent"), (F.col("sure") + F.col("rest") * share * one).alias("sure"), (F.col("rest") * (1 - share)).alias("rest")
        )
    incoming = base.select("bucket", "node").join(flow, _parent_column(F.col("node"), TOP - 1) == F.col("parent"))

    def finish(group: pa.Table, above: pa.Table) -> pa.Table:
        keys, n = group.column("key").to_numpy(), group.column("n").to_numpy()
        above = above.sort_by("node")
        value = log10_probabilities(keys, weighted(keys, n, TOP), above.column("sure").to_numpy(), above.column("rest").to_numpy())
        return pa.table({"key": keys, "n": n, "value": value})

    pairs = dealt.groupBy("bucket").cogroup(incoming.select("bucket", "node", "sure", "rest").groupBy("bucket"))
    return pairs.applyInArrow(finish, "key bigint, n bigint, value double")


# --- scoring -------------------------------------------------------------------------------------


def _shared_part(table: DataFrame, most: int) -> tuple[DataFrame, tuple[np.ndarray, np.ndarray]]:
    """The often counted part of ``key, n, value`` as sorted arrays, at most ``most`` rows, and the remaining table."""
    size = F.floor(F.log2(F.greatest("n", F.lit(1)))).cast("int")
    histogram = {r["size"]: r["count"] for r in table.groupBy(size.alias("size")).count().collect()}
    least, total = max(histogram, default=0) + 1, 0
    while least > 0 and total + histogram.get(least - 1, 0) <= most:
        least -= 1
        total += histogram.get(least, 0)
    part = table.filter(size >= least).select("key", "value").toArrow()
    keys, values = part.column("key").to_numpy(), part.column("value").to_numpy()
    order = np.argsort(keys)
    return table.filter(size < least), (keys[order], values[order])


def _lookup(table: tuple[np.ndarray, np.ndarray], keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(found, value or 0) of each key."""
    if not len(table[0]):
        return np.zeros(len(keys), bool), np.zeros(len(keys))
    at = np.minimum(np.searchsorted(table[0], keys), len(table[0]) - 1)
    found = table[0][at] == keys
    return found, np.where(found, table[1][at], 0.0)


def score(spark: SparkSession, docs: DataFrame, learn: Column, most_shared: int = MOST_SHARED) -> DataFrame:
    """``doc_id, learn, n_tokens, n_known, train_tokens, base_score, score`` for every row of ``doc_id, text``.

    Learns from the rows for which ``learn`` holds. ``base_score`` and ``score`` are log10 probabilities of
    the whole text, by the word unigram and by the trees.
    """
    rows = docs.select("doc_id", "text", F.coalesce(learn, F.lit(False)).alias("learn"))
    counted = stored(counts(rows), "corpus-counts")
    tokens = counted.filter(F.col("kind") == _WORD)
    total, distinct = tokens.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    # Without learned texts there are no tokens, and every token has the same share.
    norm = math.log10(total + 0.1 * (distinct + 1))
    word_table = tokens.select("key", "n", (F.log10(F.col("n") + 0.1)).alias("value"))
    grams = stored(gram_scores(counted), "gram-scores")
    word_rest, word_shared = _shared_part(word_table, most_shared)
    gram_rest, gram_shared = _shared_part(grams, most_shared)
    shared = spark.sparkContext.broadcast((gram_shared, word_shared))
    schema = "row bigint, doc_id bigint, learn boolean, n_tokens bigint, n_known bigint, base double, model double, kind int, key bigint, times bigint"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gram_table, token_table = shared.value
        for batch in batches:
            for start, offsets, data in text_slices(batch.column("text"), _SLICE):
                for a in range(0, len(offsets) - 1, 1 << _ROW_BITS):
                    part = offsets[a : a + (1 << _ROW_BITS) + 1]
                    yield from slice_rows(
                        batch.slice(start + a, len(part) - 1), part - part[0], data[part[0] : part[-1]], gram_table, token_table
                    )

    def slice_rows(batch, offsets, data, gram_table, token_table) -> Iterator[pa.RecordBatch]:
        n = len(offsets) - 1
        row, gram = text_grams(offsets, data)
        packed = np.sort((gram.astype(np.uint64) << np.uint64(_ROW_BITS)) | row.astype(np.uint64))
        first = np.flatnonzero(np.concatenate(([True], packed[1:] != packed[:-1]))) if len(packed) else np.empty(0, np.int64)
        times = np.diff(first, append=len(packed))
        key = (packed[first] >> np.uint64(_ROW_BITS)).astype(np.int64)
        owner = (packed[first] & np.uint64((1 << _ROW_BITS) - 1)).astype(np.int64)
        found, value = _lookup(gram_table, key)
        model = np.bincount(owner, value * times, n)
        rest = [(np.full((~found).sum(), _GRAM, np.int32), owner[~found], key[~found], times[~found])]
        row, word = words(offsets, data)
        row, word = np.concatenate([row, np.arange(n)]), np.concatenate([word.view(np.int64), np.full(n, _END)])
        found, value = _lookup(token_table, word)
        n_tokens, n_known = np.bincount(row, minlength=n), np.bincount(row, found, n).astype(np.int64)
        base = np.bincount(row, value, n)
        left = np.stack([row[~found], word[~found]], axis=1)
        if len(left):
            left, often = np.unique(left, axis=0, return_counts=True)
            rest.append((np.full(len(left), _WORD, np.int32), left[:, 0], left[:, 1], often))
        ids = batch.column("row").to_numpy()
        kind, place, keys, times = (np.concatenate(x) for x in zip(*rest))
        nothing = lambda kind_, size: pa.nulls(size, kind_)
        names = ["row", "doc_id", "learn", "n_tokens", "n_known", "base", "model", "kind", "key", "times"]
        yield pa.RecordBatch.from_arrays(
            [batch.column("row"), batch.column("doc_id"), batch.column("learn"), *map(pa.array, (n_tokens, n_known, base, model))]
            + [nothing(pa.int32(), n), nothing(pa.int64(), n), nothing(pa.int64(), n)],
            names,
        )
        size = len(keys)
        yield pa.RecordBatch.from_arrays(
            [pa.array(ids[place]), nothing(pa.int64(), size), nothing(pa.bool_(), size), nothing(pa.int64(), size), nothing(pa.int64(), size)]
            + [nothing(pa.float64(), size), nothing(pa.float64(), size), *map(pa.array, (kind, keys, times.astype(np.int64)))],
            names,
        )

    numbered = rows.withColumn("row", F.monotonically_increasing_id())
    scored = stored(numbered.mapInArrow(run, schema), "scored")
    table = gram_rest.select(F.lit(_GRAM).alias("kind"), "key", "value").unionByName(
        word_rest.select(F.lit(_WORD).alias("kind"), "key", "value")
    )
    is_word = F.col("kind") == _WORD
    # A word that isn't in the table was never learned.
    value = F.coalesce("value", F.when(is_word, F.lit(math.log10(0.1))))
    late = (
        scored.filter("kind IS NOT NULL")
        .select("row", "kind", "key", "times")
        .join(table, ["kind", "key"], "left")
        .groupBy("row")
        .agg(
            F.sum(F.when(is_word & F.col("value").isNotNull(), F.col("times"))).alias("late_known"),
            F.sum(F.when(is_word, value * F.col("times"))).alias("late_base"),
            F.sum(F.when(~is_word, value * F.col("times"))).alias("late_model"),
        )
    )
    whole = scored.filter("kind IS NULL").select("row", "doc_id", "learn", "n_tokens", "n_known", "base", "model").join(late, "row", "left")
    plus = lambda a, b: F.col(a) + F.coalesce(F.col(b), F.lit(0))
    return whole.select(
        "doc_id",
        "learn",
        "n_tokens",
        plus("n_known", "late_known").alias("n_known"),
        F.lit(total).cast("bigint").alias("train_tokens"),
        (plus("base", "late_base") - F.col("n_tokens") * norm).alias("base_score"),
        plus("model", "late_model").alias("score"),
    )
