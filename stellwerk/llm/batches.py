"""Text columns of Arrow batches as flat byte arrays, and helpers shared by the operators."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from stellwerk.session import new_run_dir, release_memory

# Texts are worked on in slices of about this many bytes, so that a batch of long texts does not
# multiply its size in temporary arrays. A longer single text is a slice of its own.
SLICE_BYTES = 1 << 20


def text_slices(column: pa.Array, max_bytes: int = SLICE_BYTES) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Yield (first row, offsets, bytes) per slice of rows; a null text counts as empty.

    ``offsets`` has one entry more than the slice has rows and starts at 0.
    """
    column = column.cast(pa.large_string()).fill_null("")
    n = len(column)
    if not n:
        return
    _, offset_buffer, data_buffer = column.buffers()
    offsets = np.frombuffer(offset_buffer, np.int64)[column.offset : column.offset + n + 1]
    data = np.frombuffer(data_buffer, np.uint8) if data_buffer is not None else np.empty(0, np.uint8)
    start = 0
    while start < n:
        stop = int(np.searchsorted(offsets, offsets[start] + max_bytes, "right")) - 1
        stop = min(max(stop, start + 1), n)
        yield start, offsets[start : stop + 1] - offsets[start], data[offsets[start] : offsets[stop]]
        start = stop


def text_bytes(column: pa.Array) -> Iterator[bytes]:
    """The UTF-8 bytes of each text; a null text counts as empty."""
    for value in column.cast(pa.large_binary()):
        yield value.as_py() or b""


def lower_ascii(data: np.ndarray) -> np.ndarray:
    """A copy with A-Z lower-cased, all other bytes as they are."""
    return data + ((data >= 65) & (data <= 90)).astype(np.uint8) * np.uint8(32)


def mix(codes: np.ndarray) -> np.ndarray:
    """Spread 64-bit codes over all 64 bits (the finisher of splitmix64)."""
    x = codes.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def remainder(doc_id: Column, modulus: int) -> Column:
    """The fold of a row: crc32 of the id's decimal text, modulo; null for a null id."""
    return F.crc32(doc_id.cast("string").cast("binary")) % modulus


def map_batches(df: DataFrame, make: Callable[[pa.RecordBatch], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """``mapInArrow`` with a function of one batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield from make(batch)

    return df.mapInArrow(run, schema)


# Spark's defaults count rows, which for long texts makes batches of many megabytes on either side.
_BOUNDS = {
    "spark.sql.execution.arrow.maxRecordsPerBatch": ("10000", "500"),
    "spark.sql.parquet.columnarReaderBatchSize": ("4096", "512"),
}


def bound_batches(spark: SparkSession) -> None:
    """Lower the session's batch sizes for texts, where they are still Spark's defaults. They stay so, since plans
    read them when they run."""
    for key, (default, bound) in _BOUNDS.items():
        if spark.conf.get(key) == default:
            spark.conf.set(key, bound)


def kept_rows(docs: DataFrame, keep: Callable[[pa.Array], np.ndarray]) -> DataFrame:
    """The rows of ``docs`` whose text ``keep`` says yes to. Only texts go to Python, only booleans come back."""

    def flags(texts: pa.Array) -> pa.Array:
        kept = pa.array(np.asarray(keep(texts), bool))
        release_memory()
        return kept

    flags.__annotations__ = {"texts": pa.Array, "return": pa.Array}
    return docs.filter(F.arrow_udf(flags, "boolean")(F.col("text")))


def stored(df: DataFrame, label: str) -> DataFrame:
    """Write a table to a fresh folder all executors share and read it back.

    Cuts the lineage: after the loss of executors nothing above the files is computed again.
    """
    spark: SparkSession = df.sparkSession
    path = new_run_dir(spark, label)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
