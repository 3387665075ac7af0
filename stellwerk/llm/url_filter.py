"""URL verdicts: rules for hosts and paths first, then a logistic regression on character n-grams.

The regression is trained on the driver from a small labelled table of urls. Features are hashed
byte n-grams of host and of path, kept apart, as a vector of unit length.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from stellwerk.llm.batches import text_slices
from stellwerk.llm.linear import counted, fit_logistic, ngram_buckets, sigmoid, unit_rows

BITS = 16
SIZES = (2, 3, 4, 5)
# At most so many labelled urls are used for training, those with the smallest hashes.
TRAINING_URLS = 20_000

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


@dataclass(frozen=True)
class Rule:
    """A verdict for a host with its subdomains, below a path."""

    host: str
    path: str
    verdict: str

    @property
    def text(self) -> str:
        return self.host + self.path

    def fits(self) -> Column:
        host = F.col("host")
        return ((host == self.host) | host.endswith("." + self.host)) & F.col("path").startswith(self.path)


@dataclass(frozen=True)
class UrlModel:
    weights: np.ndarray
    bias: float


def split_url(urls: DataFrame) -> DataFrame:
    """Add ``host`` and ``path``; a null url, or one without ``://``, has both empty."""
    rest = F.coalesce(F.when(F.instr("url", "://") > 0, F.expr("substring(url, instr(url, '://') + 3)")), F.lit(""))
    return urls.withColumn("host", F.translate(F.regexp_extract(rest, r"^([^/?#]*)", 1), _UPPER, _LOWER)).withColumn(
        "path", F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    )


def with_rule(urls: DataFrame, rules: list[Rule]) -> DataFrame:
    """Add ``rule`` and ``rule_verdict``, of the longest rule that fits host and path; else null.

    Rules are a list in the job's configuration, compared in one pass over the rows.
    """
    rule = verdict = F.lit(None).cast("string")
    for r in sorted(rules, key=lambda r: (len(r.text), r.text)):
        rule, verdict = F.when(r.fits(), F.lit(r.text)).otherwise(rule), F.when(r.fits(), F.lit(r.verdict)).otherwise(verdict)
    return urls.withColumn("rule", rule).withColumn("rule_verdict", verdict)


def _features(hosts: pa.Array, paths: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray]]:
    """(first row, rows, row, bucket, value) per slice."""
    for (start, host_offsets, host), (_, path_offsets, path) in zip(
        text_slices(hosts, 1 << 62), text_slices(paths, 1 << 62), strict=True
    ):
        n = len(host_offsets) - 1
        parts = [ngram_buckets(host_offsets, host, SIZES, BITS, 1), ngram_buckets(path_offsets, path, SIZES, BITS, 2)]
        row, bucket, count = counted(*(np.concatenate(x) for x in zip(*parts)), BITS)
        yield start, n, row, bucket, unit_rows(row, count, n)


def train(labelled: DataFrame, most: int = TRAINING_URLS) -> UrlModel:
    """Fit on ``host, path, label`` (1: block). Repeated urls count once; null labels are left out.

    Takes the ``most`` urls with the smallest hashes, so the choice doesn't depend on their order.
    An empty table gives a model that scores every url 0.5.
    """
    sample = (
        labelled.filter("label IS NOT NULL AND host IS NOT NULL AND path IS NOT NULL")
        .groupBy("host", "path")
        .agg(F.max("label").alias("label"))
        .orderBy(F.xxhash64("host", "path"), "host", "path")
        .limit(most)
        .toArrow()
        .combine_chunks()
    )
    if not sample.num_rows:
        return UrlModel(np.zeros(1 << BITS, np.float32), 0.0)
    hosts, paths = (sample.column(c).combine_chunks() for c in ("host", "path"))
    _, _, row, bucket, value = next(_features(hosts, paths))
    target = sample.column("label").to_numpy().astype(np.float64)
    return UrlModel(*fit_logistic(row, bucket, value, target, 1 << BITS, epochs=15))


def judge(spark: SparkSession, pages: DataFrame, rules: list[Rule], labelled: DataFrame | None = None) -> DataFrame:
    """``page_id, host, path, rule, verdict, score`` for every page.

    ``score`` is the regression's probability of a block; from 0.5 it blocks where no rule fits.
    ``labelled`` (host, path, label) defaults to the pages that a rule decides.
    """
    ruled = with_rule(split_url(pages.select("page_id", "url")), rules)
    if labelled is None:
        labelled = ruled.filter("rule IS NOT NULL").select("host", "path", (F.col("rule_verdict") == "block").cast("int").alias("label"))
    model = spark.sparkContext.broadcast(train(labelled))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = np.full(len(batch), sigmoid(np.float64(model.value.bias)))
            for start, n, row, bucket, value in _features(batch.column("host"), batch.column("path")):
                raw = np.bincount(row, value * model.value.weights[bucket], n) + model.value.bias
                out[start : start + n] = sigmoid(raw)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out)], [*batch.schema.names, "score"])

    scored = ruled.select("page_id", "host", "path", "rule", "rule_verdict").mapInArrow(
        score, "page_id bigint, host string, path string, rule string, rule_verdict string, score double"
    )
    by_model = F.when(F.col("score") >= 0.5, "block").otherwise("allow")
    return scored.select("page_id", "host", "path", "rule", F.coalesce("rule_verdict", by_model).alias("verdict"), "score")
