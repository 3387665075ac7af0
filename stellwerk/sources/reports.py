"""Run reports and digests as files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F


def run_report(
    postings: DataFrame, queries: list[str], pages_per_query: int | None, filters_applied: bool, test_run: Column
) -> DataFrame:
    """The one-row summary of a run; its postings stay a table of their own."""
    return postings.agg(F.count("*").alias("total_matched")).select(
        test_run.alias("test_run"),
        F.array(*[F.lit(q) for q in queries]).alias("queries"),
        F.lit(pages_per_query).cast("int").alias("pages_per_query"),
        F.lit(filters_applied).alias("filters_applied"),
        "total_matched",
    )


def write_report(report: DataFrame, postings: DataFrame, path: str) -> None:
    """``summary`` holds the run's row, ``jobs`` one JSON line per posting."""
    report.write.mode("overwrite").json(f"{path}/summary")
    postings.write.mode("overwrite").json(f"{path}/jobs")


def write_digest(parts: DataFrame, path: str) -> None:
    """Digest parts as a table, range-sorted so that reading the files in order gives each
    digest's text."""
    parts.orderBy("digest_id", "part_no").write.mode("overwrite").option("compression", "zstd").parquet(path)
