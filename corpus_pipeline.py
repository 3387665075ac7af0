"""The corpus pipeline: a raw table of documents becomes token ids, stage by stage.

Each stage takes (spark, docs, sf_dir), works on all rows its predecessor kept and returns a table;
``run`` writes it as Parquet in a fresh shared folder and reads it again for the next stage. All
stages but the last return the columns of ``documents`` and only drop rows:

1. language_id: rows whose language isn't recognised with the calibrated confidence go. The model
   learns from the labelled rows of the table itself, as in ``op5_language``.
2. quality: rows that the weak-label scorer rejects go.
3. near_duplicates: of each group linked by five-word shingles and a Jaccard similarity of 0.8 or more,
   the row with the smallest id stays.
4. decontamination: rows that hold a test item of ``benchmark`` go.
5. token_ids: the rest is encoded, a row per document with ids and digests.

Each stage keeps the session's batches small (``bound_batches``), since several stages share an executor's memory
with the workers of the stages before.

Null texts have no language and go at the first stage; an empty table gives an empty table.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from stellwerk.llm import bpe, decontaminate, jaccard, langid, quality
from stellwerk.llm.batches import bound_batches, remainder, stored, table


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    bound_batches(spark)
    return langid.keep_accepted(spark, docs, langid.train(docs, learn=remainder(F.col("doc_id"), 4) != 2))


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    bound_batches(spark)
    return quality.keep_accepted(spark, docs, quality.train(docs))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    bound_batches(spark)
    return jaccard.keep_one(spark, docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    bound_batches(spark)
    return decontaminate.keep_clean(spark, docs, table(spark, sf_dir, "benchmark"))


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    bound_batches(spark)
    return bpe.encode_documents(
        spark, docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN
    )


STAGES = [
    ("language_id", language_id),
    ("quality", good_quality),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("token_ids", token_ids),
]

# Learned stages have no SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), name)
    return docs
