"""The pipeline, stage by stage, each stage against a plain version over its own input."""

import base64
import hashlib

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F
from test_llm_pairs import brute_components

import corpus_pipeline
from stellwerk.llm.batches import stored

SF_DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def outputs(spark):
    """(stage, rows in, rows out) with a further column and rows that no stage may trip over."""
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet").withColumn("row", F.lit("kept"))
    odd = [(90001, None, None, None, None, "kept"), (90002, "", "en", None, 0, "kept"), (90003, "12 !!", None, "s", 5, "kept")]
    docs = docs.unionByName(spark.createDataFrame(odd, docs.schema)).unionByName(docs.limit(5))
    result = []
    for name, stage in corpus_pipeline.STAGES:
        out = stored(stage(spark, docs, SF_DIR), name)
        result.append((name, docs, out))
        docs = out
    return result


def by_id(frame):
    return {r.doc_id: r.text for r in frame.collect()}


def test_stages_and_columns(outputs):
    assert [name for name, _ in corpus_pipeline.STAGES] == [name for name, _, _ in outputs]
    for _, before, after in outputs[:-1]:
        assert after.columns == before.columns
        assert {tuple(r) for r in after.collect()} <= {tuple(r) for r in before.collect()}


def test_language_and_quality_keep_good_rows(spark, outputs):
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF_DIR}/labels.parquet").collect()}
    (_, raw, known), (_, _, good) = outputs[:2]
    assert {90001, 90002, 90003}.isdisjoint(by_id(known))
    assert len(by_id(known)) >= 0.98 * (len(by_id(raw)) - 3)
    before, after = set(by_id(known)), set(by_id(good))
    clean = {i for i in before if labels.get(i) == 1}
    junk = {i for i in before if labels.get(i) == 0}
    assert len(clean & after) >= 0.97 * len(clean) and len(junk & after) <= 0.2 * len(junk)


def test_one_row_of_each_group_stays(outputs):
    _, before, after = outputs[2]
    rows = [(r.doc_id, r.text) for r in before.collect()]
    want = {d for d, _, c in brute_components(rows, 5, (80, 100)) if d == c}
    assert sorted(r.doc_id for r in after.collect()) == sorted(want)


def test_rows_with_items_go(spark, outputs):
    _, before, after = outputs[3]
    items = [r.text.lower().split() for r in spark.read.parquet(f"{SF_DIR}/benchmark.parquet").collect()]
    grams = lambda words: {tuple(words[i : i + 5]) for i in range(len(words) - 4)}
    held = set()
    for doc_id, text in by_id(before).items():
        have = grams(text.lower().split())
        if any(len(grams(item) & have) >= 0.5 * len(grams(item)) for item in items if grams(item)):
            held.add(doc_id)
    assert held and set(by_id(before)) - set(by_id(after)) == held


def test_ids_are_those_of_the_library(outputs):
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb"))}
    encoding = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    _, before, after = outputs[4]
    want = {
        (i, hashlib.sha256(np.array(encoding.encode_ordinary(t), "<u4").tobytes()).hexdigest()) for i, t in by_id(before).items()
    }
    assert {(r.doc_id, r.ids_sha256) for r in after.collect()} == want


def test_an_empty_table_passes_through(spark):
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet").limit(0)
    for name, stage in corpus_pipeline.STAGES:
        docs = stored(stage(spark, docs, SF_DIR), name)
    assert docs.count() == 0
