"""Language identification: averaged hashed subword embeddings and a linear softmax.

The n-grams of the lower-cased text are hashed into buckets; a text is the mean of its buckets'
embeddings, and a softmax over that mean gives the languages. Embeddings and softmax are trained
together by stochastic gradient descent in numpy, on a bounded sample of labelled rows (features are
counted in the tasks, so the driver sees bucket counts and never texts). A part of the sample is
kept back to set the temperature of the softmax and the confidence below which a text is rejected.

A null text, or one without a letter, is ``und`` with score 0 and not accepted. Without labelled rows
every text is ``und``. Repeated rows are learned from as often as they come, and a null ``doc_id`` is scored
like any other (its ``held_out`` is null).
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from stellwerk.llm.batches import kept_rows, text_slices
from stellwerk.llm.linear import counted, ngram_buckets

UNKNOWN = "und"
BITS = 13
SIZES = (2, 3, 4)
DIMENSIONS = 16
# Bound of the training sample: rows for each language. Every language in the labelled rows is learned.
ROWS_PER_LANGUAGE = 1_000
BATCH = 32
LEAST_STEPS = 1_500
# The rejection threshold loses at most this share of rightly labelled texts.
MOST_LOST = 0.001

_LETTER = re.compile(r"[^\W\d_]")
# ASCII bytes other than letters separate words; bytes of other characters are kept.
_SEPARATE = np.arange(256, dtype=np.uint8)
_SEPARATE[[b for b in range(128) if not chr(b).isalpha()]] = 32


@dataclass(frozen=True)
class LanguageModel:
    languages: list[str]
    table: np.ndarray  # bucket x language: embeddings times softmax weights
    bias: np.ndarray
    temperature: float
    threshold: float


def _ngrams(texts: pa.Array) -> Iterator[tuple[int, int, list[tuple[np.ndarray, np.ndarray]]]]:
    """(first row, rows, [(row, bucket) for each n-gram size]) per slice; rows in order."""
    for start, offsets, data in text_slices(pc.utf8_lower(texts)):
        clean = _SEPARATE[data]
        yield start, len(offsets) - 1, [ngram_buckets(offsets, clean, (size,), BITS) for size in SIZES]


def _sample(labelled: DataFrame, rows_per_language: int) -> DataFrame:
    """About so many rows of each language, picked by a hash of the id; all of a rarer one.

    The languages' counts are collected, a row each, as the model has a column of floats for each anyway.
    """
    counts = labelled.groupBy("lang").count().collect()
    shares = [(row["lang"], int((1 << 30) * min(1.0, rows_per_language / row["count"]))) for row in counts]
    below = labelled.sparkSession.createDataFrame(shares, "lang string, below bigint")
    place = F.xxhash64("doc_id", "text").bitwiseAND(F.lit((1 << 30) - 1))
    return labelled.join(F.broadcast(below), "lang").filter(place < F.col("below")).drop("below")


def _bucket_counts(labelled: DataFrame) -> DataFrame:
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start, n, grams in _ngrams(batch.column("text")):
                row, bucket, times = counted(*(np.concatenate(x) for x in zip(*grams)), BITS)
                ends = np.searchsorted(row, np.arange(n + 1)).astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("doc_id").slice(start, n),
                        batch.column("lang").slice(start, n),
                        pa.ListArray.from_arrays(ends, pa.array(bucket)),
                        pa.ListArray.from_arrays(ends, pa.array(times)),
                    ],
                    ["doc_id", "lang", "buckets", "times"],
                )

    return labelled.select("doc_id", "lang", "text").mapInArrow(
        count, "doc_id bigint, lang string, buckets array<int>, times array<float>"
    )


def _softmax(logits: np.ndarray) -> np.ndarray:
    e = np.exp(logits - logits.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def train(
    docs: DataFrame, learn: Column | None = None, rows_per_language: int = ROWS_PER_LANGUAGE, epochs: int = 12, seed: int = 11
) -> LanguageModel:
    """Fit on the rows of ``doc_id, text, lang`` for which ``learn`` holds and text and lang are not null."""
    labelled = docs.select("doc_id", "text", "lang").filter(F.col("lang").isNotNull() & F.col("text").isNotNull())
    if learn is not None:
        labelled = labelled.filter(learn)
    # In a fixed order, so that training gives the same model again.
    rows = _bucket_counts(_sample(labelled, rows_per_language)).orderBy("lang", "doc_id", F.size("buckets")).toArrow().combine_chunks()
    names = rows.column("lang").to_pylist()
    buckets, times = ([x.values.to_numpy() for x in rows.column(c)] for c in ("buckets", "times"))
    generator = np.random.default_rng(seed)
    keep = generator.permutation([i for i, b in enumerate(buckets) if len(b)]).astype(np.int64)
    languages = sorted({names[i] for i in keep})
    if not languages:
        return LanguageModel([], np.zeros((1 << BITS, 0), np.float32), np.zeros(0, np.float32), 1.0, 1.0)
    target = np.array([languages.index(names[i]) for i in keep])

    def dense(chosen) -> np.ndarray:
        x = np.zeros((len(chosen), 1 << BITS), np.float32)
        for at, i in enumerate(chosen):
            x[at, buckets[keep[i]]] = times[keep[i]] / times[keep[i]].sum()
        return x

    held = np.arange(len(keep)) % 5 == 0 if len(keep) >= 50 else np.zeros(len(keep), bool)
    learners = np.flatnonzero(~held)
    embeddings = generator.normal(0, 0.1, (1 << BITS, DIMENSIONS)).astype(np.float32)
    weights = generator.normal(0, 0.1, (DIMENSIONS, len(languages))).astype(np.float32)
    bias = np.zeros(len(languages), np.float32)
    # Few rows are gone through more often, so that the model always takes enough steps.
    epochs = max(epochs, -(-LEAST_STEPS * BATCH // max(len(learners), 1)))
    # Means over hundreds of n-grams are small; the embeddings' steps are larger in proportion.
    for epoch in range(epochs):
        rate = 1.0 - epoch / epochs
        learners = generator.permutation(learners)
        for first in range(0, len(learners), BATCH):
            chosen = learners[first : first + BATCH]
            x = dense(chosen)
            used = np.flatnonzero(x.any(axis=0))
            x = x[:, used]
            mean = x @ embeddings[used]
            error = _softmax(mean @ weights + bias)
            error[np.arange(len(chosen)), target[chosen]] -= 1
            error /= len(chosen)
            back = error @ weights.T
            weights -= rate * 2.0 * (mean.T @ error)
            bias -= rate * 0.1 * error.sum(axis=0)
            embeddings[used] -= rate * 40.0 * (x.T @ back)
    table = (embeddings @ weights).astype(np.float32)
    temperature, threshold = 1.0, 0.0
    if held.any():
        kept_back = np.flatnonzero(held)
        logits = np.concatenate([dense(kept_back[i : i + 256]) @ table + bias for i in range(0, len(kept_back), 256)])
        temperature, threshold = calibrate(logits, target[kept_back])
    return LanguageModel(languages, table, bias, temperature, threshold)


def calibrate(logits: np.ndarray, target: np.ndarray, most_lost: float = MOST_LOST) -> tuple[float, float]:
    """Temperature of least log loss, and the threshold that loses few rightly labelled texts.

    The threshold never passes one half: a language more likely than all others together is kept.
    """
    grid = np.geomspace(0.2, 5.0, 33)
    losses = [-np.log(np.maximum(_softmax(logits / t)[np.arange(len(target)), target], 1e-12)).mean() for t in grid]
    temperature = float(grid[int(np.argmin(losses))])
    probability = _softmax(logits / temperature)
    right = probability.argmax(axis=1) == target
    best = probability.max(axis=1)[right]
    return temperature, float(min(np.quantile(best, most_lost), 0.5)) if len(best) else 0.5


def predict(texts: pa.Array, model: LanguageModel) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Language, probability and acceptance of each text."""
    language, score = [UNKNOWN] * len(texts), np.zeros(len(texts))
    if model.languages:
        for start, n, grams in _ngrams(texts):
            sums, count = np.zeros((n, len(model.languages)), np.float32), np.zeros(n, np.int64)
            for row, bucket in grams:
                times = np.bincount(row, minlength=n)
                first = np.flatnonzero(times)
                if len(first):
                    at = (np.cumsum(times) - times)[first]
                    sums[first] += np.add.reduceat(model.table[bucket], at, axis=0)
                count += times
            logits = (sums / np.maximum(count, 1)[:, None] + model.bias) / model.temperature
            probability = _softmax(logits)
            best = probability.argmax(axis=1)
            for i in range(n):
                text = texts[start + i].as_py()
                if text and _LETTER.search(text):
                    language[start + i], score[start + i] = model.languages[best[i]], probability[i, best[i]]
    accepted = np.array([name != UNKNOWN for name in language], bool) & (score >= model.threshold)
    return language, score, accepted


def identify(spark: SparkSession, docs: DataFrame, model: LanguageModel) -> DataFrame:
    """``doc_id, lang_pred, score, accepted`` for every row, by its whole text."""
    shared = spark.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            language, score, accepted = predict(batch.column("text"), shared.value)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(language, pa.string()), pa.array(score), pa.array(accepted)],
                ["doc_id", "lang_pred", "score", "accepted"],
            )

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id bigint, lang_pred string, score double, accepted boolean")


def keep_accepted(spark: SparkSession, docs: DataFrame, model: LanguageModel) -> DataFrame:
    """The rows of ``docs`` whose language was accepted, with all their columns."""
    shared = spark.sparkContext.broadcast(model)
    return kept_rows(docs, lambda texts: predict(texts, shared.value)[2])
