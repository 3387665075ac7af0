"""Byte-level BPE encoding and decoding of whole texts, long ones in overlapping chunks.

A text longer than ``chunk_chars`` is cut into chunks that each run ``overlap`` characters into the
next one. Chunks are split into pre-tokens side by side, each from its own first character, which
may lie inside a pre-token. The splitting has no memory: once the splits of two neighbouring
chunks have a boundary in common, they agree from there on. The first common boundary in an
overlap therefore ends one piece and starts the next; pieces are encoded by themselves and their
ids joined in order. Where two chunks share no boundary (one pre-token longer than the overlap),
the rest of the text stays one piece.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
import tiktoken
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from stellwerk.llm.batches import stored

CHUNK_CHARS = 32_768
OVERLAP = 1_024
# A pre-token that ends this near to a cut might have ended elsewhere in the whole text: the
# longest look ahead is that of the contractions, two characters.
_UNSURE = 3


def read_ranks(path: str) -> bytes:
    """A rank file, as the driver sends it to the tasks (a vocabulary: its size is fixed)."""
    with open(path, "rb") as file:
        return file.read()


@lru_cache(maxsize=2)
def _encoding(ranks: bytes, pattern: str) -> tiktoken.Encoding:
    pairs = (line.split() for line in ranks.splitlines() if line)
    return tiktoken.Encoding(
        "ranks",
        pat_str=pattern,
        mergeable_ranks={base64.b64decode(token): int(rank) for token, rank in pairs},
        special_tokens={},
    )


def safe_boundaries(text: str, pattern: str, at_start: bool, at_end: bool) -> list[int]:
    """Where a piece of ``text`` may end, by the split that starts at the first character.

    A boundary behind white space is not offered: how a run of white space is split depends on
    what follows it. Nor is one that the cut at the end of a chunk might have moved.
    """
    found = [0] if at_start else []
    last = len(text) if at_end else len(text) - _UNSURE
    for match in regex.finditer(pattern, text):
        end = match.end()
        if end > last:
            break
        if not text[end - 1].isspace():
            found.append(end)
    return found


def _digest_ids(ids: list[int]) -> str:
    return hashlib.sha256(np.asarray(ids, "<u4").tobytes()).hexdigest()


def encode(
    docs: DataFrame, ranks: Broadcast, pattern: str, chunk_chars: int = CHUNK_CHARS, overlap: int = OVERLAP
) -> DataFrame:
    """``doc_id, ids``: the token ids of every text.

    ``ranks`` is a broadcast rank file. A null or empty text has no ids. Repeated rows are encoded
    each by itself; other columns are not looked at. Texts of one chunk are encoded where they are read.
    """
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    short = rows.filter(F.length("text") <= chunk_chars)
    pieces = _pieces(rows.filter(F.length("text") > chunk_chars), pattern, chunk_chars, overlap)
    # No more than one text meets in a group.
    in_order = F.transform(F.array_sort(F.collect_list(F.struct("piece", "ids"))), lambda x: x["ids"])
    joined = _encoded(pieces, ranks, pattern).groupBy("doc_id", "row").agg(F.flatten(in_order).alias("ids"))
    return _encoded(short, ranks, pattern).select("doc_id", "ids").unionByName(joined.select("doc_id", "ids"))


def _encoded(texts: DataFrame, ranks: Broadcast, pattern: str) -> DataFrame:
    """Replace ``text`` by the ``ids`` of its tokens."""
    others = [field for field in texts.schema.fields if field.name != "text"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoding = _encoding(ranks.value, pattern)
        for batch in batches:
            for start in range(0, len(batch), 256):
                part = batch.slice(start, 256)
                ids = [encoding.encode_ordinary(text.as_py()) for text in part.column("text")]
                yield pa.RecordBatch.from_arrays(
                    [*(part.column(f.name) for f in others), pa.array(ids, pa.list_(pa.int32()))], [*(f.name for f in others), "ids"]
                )

    return texts.mapInArrow(run, ", ".join([*(f"{f.name} {f.dataType.simpleString()}" for f in others), "ids array<int>"]))


def _pieces(rows: DataFrame, pattern: str, chunk_chars: int, overlap: int) -> DataFrame:
    """Cut long texts into pieces at boundaries on which neighbouring chunks agree."""
    rows = rows.withColumn("row", F.monotonically_increasing_id())

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for doc_id, text, row in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "text", "row")), strict=True):
                parts = [text[start : start + chunk_chars + overlap] for start in range(0, len(text), chunk_chars)]
                n = len(parts)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([doc_id] * n, pa.int64()),
                        pa.array([row] * n, pa.int64()),
                        pa.array([len(text)] * n, pa.int64()),
                        pa.array(range(n), pa.int32()),
                        pa.array(parts, pa.string()),
                    ],
                    ["doc_id", "row", "chars", "chunk", "text"],
                )

    # Chunks of one text are dealt out to all tasks.
    chunks = rows.mapInArrow(cut, "doc_id bigint, row bigint, chars bigint, chunk int, text string").repartition("row", "chunk")

    def boundaries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            head, tail = [], []
            for chunk, chars, text in zip(*(batch.column(c).to_pylist() for c in ("chunk", "chars", "text")), strict=True):
                at_end = chunk * chunk_chars + len(text) == chars
                found = np.asarray(safe_boundaries(text, pattern, chunk == 0, at_end), np.int64)
                head.append((found[found <= overlap] + chunk * chunk_chars).tolist())
                tail.append((found[found >= chunk_chars] + chunk * chunk_chars).tolist())
            offsets = pa.list_(pa.int64())
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in ("doc_id", "row", "chars", "chunk", "text")), pa.array(head, offsets), pa.array(tail, offsets)],
                ["doc_id", "row", "chars", "chunk", "text", "head", "tail"],
            )

    split = stored(
        chunks.mapInArrow(
            boundaries,
            "doc_id bigint, row bigint, chars bigint, chunk int, text string, head array<bigint>, tail array<bigint>",
        ),
        "bpe-chunks",
    )
    in_order = Window.partitionBy("row").orderBy("chunk")
    cuts = split.select("row", "chunk", "head", F.lag("tail").over(in_order).alias("before")).select(
        "row", "chunk", F.when(F.col("chunk") == 0, 0).otherwise(F.array_min(F.array_intersect("head", "before"))).alias("cut")
    )
    # A chunk without a cut joins the piece before it, and so does all that follows: its own split
    # was never seen to agree with the true one.
    cuts = cuts.withColumn("cut", F.when(F.min(F.col("cut").isNotNull()).over(in_order), F.col("cut")))
    cuts = cuts.withColumn("piece", F.last(F.when(F.col("cut").isNotNull(), F.col("chunk")), True).over(in_order))
    cuts = cuts.withColumn("next", F.lead("cut").over(in_order))
    parts = split.select("doc_id", "row", "chunk", "text").join(cuts, ["row", "chunk"])
    begin = F.coalesce(F.col("cut") - F.col("chunk") * chunk_chars, F.lit(0)).cast("int")
    # Up to the next piece's cut; inside a piece up to the next chunk.
    end = F.coalesce(F.col("next") - F.col("chunk") * chunk_chars, F.lit(chunk_chars)).cast("int")
    return (
        parts.select("doc_id", "row", "piece", "chunk", F.substring("text", begin + 1, end - begin).alias("part"))
        .groupBy("doc_id", "row", "piece")
        .agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("chunk", "part"))), lambda x: x["part"]), "").alias("text"))
    )


def decode(encoded: DataFrame, ranks: Broadcast, pattern: str) -> DataFrame:
    """``doc_id, n_tokens, ids_sha256, decoded_sha256, decoded``: the bytes of the ids, joined."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoding = _encoding(ranks.value, pattern)
        for batch in batches:
            for start in range(0, len(batch), 256):
                part = batch.slice(start, 256)
                ids = part.column("ids").to_pylist()
                texts = [encoding.decode_bytes(row) for row in ids]
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column("doc_id"),
                        pa.array([len(row) for row in ids], pa.int64()),
                        pa.array([_digest_ids(row) for row in ids], pa.string()),
                        pa.array([hashlib.sha256(text).hexdigest() for text in texts], pa.string()),
                        pa.array(texts, pa.binary()),
                    ],
                    ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "decoded"],
                )

    return encoded.mapInArrow(
        run, "doc_id bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string, decoded binary"
    )


def encode_documents(
    spark: SparkSession, docs: DataFrame, rank_path: str, pattern: str, chunk_chars: int = CHUNK_CHARS, overlap: int = OVERLAP
) -> DataFrame:
    """Encode every whole text, decode the ids again, and return the digests of both per document.

    Every row gives one row, repeated rows and null ids included; a null text counts as empty.
    """
    ranks = spark.sparkContext.broadcast(read_ranks(rank_path))
    return decode(encode(docs, ranks, pattern, chunk_chars, overlap), ranks, pattern).drop("decoded")
