"""Text quality from weak labels: heuristic labellers, expectation-maximisation, a hashed linear scorer.

Each labeller votes bad, good or abstains. Their votes overlap and err; how often each errs is
estimated by expectation-maximisation over the counts of vote patterns in all documents, with a
hidden class per document (every labeller has a table of vote probabilities for each class). The
number of patterns is bounded by the labellers, not by the documents. A hashed linear scorer then
learns the posterior of the class from the texts themselves, on a bounded sample.

A null text counts as empty. A text without words has no features and is rejected with quality 0.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from stellwerk.llm.batches import kept_rows, text_slices
from stellwerk.llm.linear import counted, fit_logistic, ngram_buckets, sigmoid, unit_rows

BITS = 16
SIZES = (1, 2, 3)
TRAINING_ROWS = 6_000
FULL_BYTES = 200
ITERATIONS = 100

GOOD, BAD, ABSTAIN = 0, 1, 2
# Statistic, good up to, bad from; between them the labeller abstains.
LABELLERS = {
    "symbols": (0.04, 0.12),  # of all characters but white space: neither letter, digit nor punctuation
    "capitals": (0.25, 0.60),  # of ASCII letters
    "bare_symbols": (0.02, 0.15),  # of words: without letter or digit
    "odd_endings": (0.05, 0.25),  # of words: ending in a symbol or in more than one mark
    "repeats": (0.05, 0.25),  # of words: equal to the word before
    "repeated_triples": (0.15, 0.50),  # of three-word runs: seen before in the text
    "long_words": (0.02, 0.20),  # of words: longer than 30 bytes
    "few_letters": (0.25, 0.50),  # of all characters but white space: neither letters nor digits
}
STATISTICS = list(LABELLERS)

_CLASS = np.zeros(256, np.int8)  # 0 symbol, 1 letter, 2 digit, 3 punctuation, 4 white space
for _byte in range(256):
    _char = chr(_byte)
    _CLASS[_byte] = (
        1 if _byte >= 128 or _char.isalpha() else 2 if _char.isdigit() else 4 if _byte <= 32 else 3 if _char in ".,;:!?'\"()-" else 0
    )
_MARKS = b".,;:!?'\"()-"
_PLAIN_END = frozenset(range(128, 256)) | frozenset(b for b in range(128) if chr(b).isalnum()) | frozenset(_MARKS)


@dataclass(frozen=True)
class QualityModel:
    weights: np.ndarray
    bias: float
    vote_tables: np.ndarray  # labeller x class x vote
    bad_share: float


def _word_statistics(text: bytes) -> tuple[float, float, float, float, float]:
    words = text.split()
    n = len(words)
    if not n:
        return 0.0, 0.0, 0.0, 0.0, 0.0
    bare = odd = long = 0
    for word in words:
        last = word[-1]
        if not word.isalnum():
            if last not in _PLAIN_END or (len(word) > 1 and last in _MARKS and word[-2] in _MARKS):
                odd += 1
            # Bytes of other scripts count as letters.
            if word.isascii() and not any(chr(b).isalnum() for b in word):
                bare += 1
        if len(word) > 30:
            long += 1
    repeats = sum(map(bytes.__eq__, words, words[1:]))
    triples = max(n - 2, 1)
    seen = len(set(zip(words, words[1:], words[2:]))) if n > 2 else 1
    return bare / n, odd / n, repeats / n, 1 - seen / triples, long / n


def statistics(offsets: np.ndarray, data: np.ndarray) -> np.ndarray:
    """Row x statistic, in the order of ``STATISTICS``."""
    n = len(offsets) - 1
    row = np.repeat(np.arange(n), np.diff(offsets))
    kinds = np.bincount(row * 5 + _CLASS[data], minlength=5 * n).reshape(n, 5).astype(np.float64)
    upper = np.bincount(row, (data >= 65) & (data <= 90), n)
    lower = np.bincount(row, (data >= 97) & (data <= 122), n)
    visible = np.maximum(kinds[:, :4].sum(axis=1), 1)
    words = np.array([_word_statistics(data[a:b].tobytes()) for a, b in zip(offsets[:-1], offsets[1:])]).reshape(n, 5)
    table = {
        "symbols": kinds[:, 0] / visible,
        "capitals": upper / np.maximum(upper + lower, 1),
        "bare_symbols": words[:, 0],
        "odd_endings": words[:, 1],
        "repeats": words[:, 2],
        "repeated_triples": words[:, 3],
        "long_words": words[:, 4],
        "few_letters": 1 - (kinds[:, 1] + kinds[:, 2]) / visible,
    }
    return np.stack([table[name] for name in STATISTICS], axis=1)


def votes(stats: np.ndarray) -> np.ndarray:
    """Row x labeller, each GOOD, BAD or ABSTAIN."""
    good, bad = (np.array([LABELLERS[name][i] for name in STATISTICS]) for i in (0, 1))
    return np.where(stats <= good, GOOD, np.where(stats >= bad, BAD, ABSTAIN))


def _code(cast: np.ndarray) -> np.ndarray:
    return (cast * 3 ** np.arange(cast.shape[1])).sum(axis=1)


def _decode(codes: np.ndarray) -> np.ndarray:
    return codes[:, None] // 3 ** np.arange(len(STATISTICS)) % 3


def estimate(patterns: np.ndarray, counts: np.ndarray, iterations: int = ITERATIONS) -> tuple[np.ndarray, float]:
    """Vote tables (labeller x class x vote) and the share of bad documents, from counted patterns.

    Starts from the share of bad votes among the votes cast; every probability keeps a pseudo-count.
    """
    cast = (patterns != ABSTAIN).sum(axis=1)
    bad = np.where((patterns == BAD).any(axis=1), 0.9, np.where(cast > 0, 0.02, 0.1))
    weight, tables, share = counts.astype(np.float64), np.zeros((patterns.shape[1], 2, 3)), 0.1
    for _ in range(iterations):
        share = (weight @ bad + 1) / (weight.sum() + 2)
        for j in range(patterns.shape[1]):
            for k, belongs in enumerate((1 - bad, bad)):
                seen = np.bincount(patterns[:, j], weight * belongs, 3) + 0.5
                tables[j, k] = seen / seen.sum()
        bad = posterior(patterns, tables, share)
    return tables, float(share)


def posterior(patterns: np.ndarray, tables: np.ndarray, share: float) -> np.ndarray:
    """Probability that a document with these votes is bad."""
    log_odds = np.full(len(patterns), np.log(share / (1 - share)))
    for j in range(patterns.shape[1]):
        log_odds += np.log(tables[j, 1] / tables[j, 0])[patterns[:, j]]
    return sigmoid(log_odds)


def _features(offsets: np.ndarray, data: np.ndarray, stats: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, bucket, value): unit vectors of byte n-grams, and each statistic's level as a further bucket.

    Levels take the last buckets of the table. Texts shorter than ``FULL_BYTES`` have shorter vectors,
    for a few words tell little.
    """
    n = len(offsets) - 1
    trust = np.minimum(1.0, np.sqrt(np.diff(offsets) / FULL_BYTES)).astype(np.float32)
    row, bucket, times = counted(*ngram_buckets(offsets, data, SIZES, BITS), BITS)
    value = unit_rows(row, times, n) * trust[row]
    level = np.minimum((stats * 20).astype(np.int64), 19) + 20 * np.arange(stats.shape[1])
    full = np.flatnonzero(np.diff(offsets))
    rows = np.concatenate([row, np.repeat(full.astype(np.int32), stats.shape[1])])
    buckets = np.concatenate([bucket, ((1 << BITS) - 1 - level[full].ravel()).astype(np.int32)])
    values = np.concatenate([value, np.repeat(0.5 * trust[full], stats.shape[1])])
    order = np.argsort(rows, kind="stable")
    return rows[order], buckets[order], values[order]


def _pattern_counts(docs: DataFrame) -> DataFrame:
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(3 ** len(STATISTICS), np.int64)
        for batch in batches:
            for _, offsets, data in text_slices(batch.column("text")):
                total += np.bincount(_code(votes(statistics(offsets, data)))[np.diff(offsets) > 0], minlength=len(total))
        found = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(found), pa.array(total[found])], ["pattern", "docs"])

    return docs.select("text").mapInArrow(count, "pattern bigint, docs bigint").groupBy("pattern").agg(F.sum("docs").alias("docs"))


def train(docs: DataFrame, training_rows: int = TRAINING_ROWS) -> QualityModel:
    """Estimate the labellers over all documents; fit the scorer on about ``training_rows`` of them."""
    found = _pattern_counts(docs).orderBy("pattern").toArrow()
    patterns, counts = _decode(found.column("pattern").to_numpy()), found.column("docs").to_numpy()
    tables, share = estimate(patterns, counts)

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start, offsets, data in text_slices(batch.column("text")):
                stats = statistics(offsets, data)
                row, bucket, value = _features(offsets, data, stats)
                ends = np.searchsorted(row, np.arange(len(offsets))).astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("place").slice(start, len(stats)),
                        pa.array(_code(votes(stats))),
                        pa.ListArray.from_arrays(ends, pa.array(bucket)),
                        pa.ListArray.from_arrays(ends, pa.array(value)),
                    ],
                    ["place", "pattern", "buckets", "values"],
                )

    total = int(counts.sum())
    part = int((1 << 30) * min(1.0, training_rows / max(total, 1)))
    place = F.xxhash64("doc_id", "text")
    sample = docs.select("text", place.alias("place")).filter(
        (F.octet_length("text") > 0) & (F.col("place").bitwiseAND(F.lit((1 << 30) - 1)) < part)
    )
    rows = (
        sample.mapInArrow(features, "place bigint, pattern bigint, buckets array<int>, values array<float>")
        .orderBy("place")
        .toArrow()
        .combine_chunks()
    )
    if not rows.num_rows:
        return QualityModel(np.zeros(1 << BITS, np.float32), 0.0, tables, share)
    lists = rows.column("buckets").combine_chunks()
    row = np.repeat(np.arange(rows.num_rows), np.diff(lists.offsets.to_numpy()))
    bucket, value = lists.flatten().to_numpy(), rows.column("values").combine_chunks().flatten().to_numpy()
    target = posterior(_decode(rows.column("pattern").to_numpy()), tables, share)
    weights, bias = fit_logistic(row, bucket, value, target, 1 << BITS, epochs=15)
    return QualityModel(weights, bias, tables, share)


def rate(texts: pa.Array, model: QualityModel) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(quality by the scorer, quality by the labellers, accepted) of each text."""
    score, weak = np.zeros(len(texts)), np.zeros(len(texts))
    for start, offsets, data in text_slices(texts):
        n = len(offsets) - 1
        stats = statistics(offsets, data)
        row, bucket, value = _features(offsets, data, stats)
        raw = np.bincount(row, value * model.weights[bucket], n) + model.bias
        has_words = np.bincount(np.repeat(np.arange(n), np.diff(offsets)), _CLASS[data] != 4, n) > 0
        score[start : start + n] = np.where(has_words, 1 - sigmoid(raw), 0.0)
        weak[start : start + n] = np.where(has_words, 1 - posterior(votes(stats), model.vote_tables, model.bad_share), 0.0)
    return score, weak, score >= 0.5


def classify(spark: SparkSession, docs: DataFrame, model: QualityModel) -> DataFrame:
    """``doc_id, quality, labeller_quality, accepted`` for every row, by its whole text."""
    shared = spark.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), *map(pa.array, rate(batch.column("text"), shared.value))],
                ["doc_id", "quality", "labeller_quality", "accepted"],
            )

    return docs.select("doc_id", "text").mapInArrow(
        run, "doc_id bigint, quality double, labeller_quality double, accepted boolean"
    )


def keep_accepted(spark: SparkSession, docs: DataFrame, model: QualityModel) -> DataFrame:
    """The rows of ``docs`` that the scorer accepts, with all their columns."""
    shared = spark.sparkContext.broadcast(model)
    return kept_rows(docs, lambda texts: rate(texts, shared.value)[2])
