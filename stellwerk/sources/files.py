"""Snapshots, and import of indented JSON files."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from stellwerk import schema
from stellwerk.functions.text import platform_rank


def write_snapshot(df: DataFrame, path: str) -> None:
    """Persist a stage right after it was computed, so later stages can be run again. Stages carry whole texts, of which
    zstd leaves much less than Spark's default."""
    df.write.mode("overwrite").option("compression", "zstd").parquet(path)


def read_snapshot(spark: SparkSession, path: str, ddl: str | None = None) -> DataFrame:
    """Replay a snapshot; a missing one is an error."""
    reader = spark.read.schema(ddl) if ddl else spark.read
    return reader.parquet(path)


def materialise(df: DataFrame, path: str) -> DataFrame:
    """Write and read back: cuts the lineage at a table every executor can read again."""
    write_snapshot(df, path)
    return read_snapshot(df.sparkSession, path)


def path_missing(error: AnalysisException) -> bool:
    return error.getCondition() == "PATH_NOT_FOUND"


def read_indented_json(spark: SparkSession, path: str, record: str, order: list[str] | None = None) -> DataFrame:
    """Records of a JSON file written with an indent of two, either ``[{…}, …]`` or
    ``{"key": {…}, …}``.

    Such a file ends each record with its own line, which cannot occur inside a JSON
    string, so the file is split there and read in parallel. A record that does not parse
    is an error.

    ``order`` names three columns to add, whose values give the records' order in the file: where the block
    of the file begins that a record was read from, its place in there, and the file's own place among
    all files by path.
    """
    pieces = spark.read.option("lineSep", "\n  },").text(path)
    if order:
        # Blocks of one file are read by one task each, or by one after the other.
        place = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)).cast("int")
        block = (F.col("_metadata.file_block_start") / 4096).cast("int")
        file = F.col("_metadata.file_path").alias("_file")
        pieces = pieces.select("value", block.alias(order[0]), place.alias(order[1]), file)
        # A row per file, from the listing that the driver holds anyway.
        files = spark.read.format("binaryFile").load(path).select(file).distinct()
        number = F.row_number().over(Window.orderBy("_file")) - 1
        pieces = pieces.join(F.broadcast(files.select("_file", number.alias(order[2]))), "_file").drop("_file")
    body = F.regexp_extract("value", r'(?s)^\s*[\[{]?\s*(?:"(?:[^"\\]|\\.)*+":\s*)?(\{.*)$', 1)
    # The last piece still has the closing brackets of the record and of the file.
    body = F.regexp_replace(body, r"\s*\}\s*[\]}]\s*\z", "")
    record_type = f"struct<{', '.join(p.strip().replace(' ', ':') for p in record.split(','))}>"
    parsed = F.from_json(F.concat(body, F.lit("}")), record_type, {"mode": "FAILFAST"})
    empty = F.col("value").rlike(r"^\s*(\[\s*\]|\{\s*\})?\s*$")
    return pieces.filter(~empty).select(parsed.alias("r"), *(order or [])).select("r.*", *(order or []))


def read_scrape_cache(spark: SparkSession, path: str) -> DataFrame:
    """A JSON scrape cache as postings in file order, ready to be delivered.

    The order columns: the board's rank, the file's place among several ordered by their paths, and the place
    of a record in the file as page and card. ``observed_at`` is the time of reading.
    """
    rows = read_indented_json(spark, path, schema.CACHED_POSTING, ["page_no", "card_pos", "query_idx"])
    return rows.withColumns(
        {
            "platform_rank": platform_rank(F.col("platform")),
            "observed_at": F.current_timestamp(),
        }
    )
