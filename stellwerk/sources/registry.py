"""Named sources that fail on their own."""

from __future__ import annotations

import logging
from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, functions as F

from stellwerk import schema
from stellwerk.sources.files import read_snapshot, write_snapshot

log = logging.getLogger("stellwerk")


def materialise_sources(
    spark: SparkSession, sources: dict[str, Callable[[SparkSession], DataFrame]], run_dir: str
) -> dict[str, DataFrame]:
    """Write every source's rows; a source that fails yields none and the others go on.

    A lazy plan only fails when it runs, so each source is written before the next starts. Its
    ``platform_rank`` is its place among all registered sources.
    """
    done = {}
    for number, (name, build) in enumerate(sources.items()):
        path = f"{run_dir}/source-{number}"
        try:
            write_snapshot(build(spark).withColumn("platform_rank", F.lit(number)), path)
        except Exception:
            log.exception("source %s failed and is left out", name)
        else:
            done[name] = read_snapshot(spark, path)
    return done


def union_platforms(
    frames: dict[str, DataFrame], spark: SparkSession | None = None, ddl: str = schema.POSTINGS
) -> DataFrame:
    """Concatenate sources in their given order; duplicates stay.

    A frame that already has a ``platform_rank`` keeps it, so that a failed source doesn't shift
    the ranks of the others. With no frame left the result is empty, with the columns of ``ddl``.
    """
    if not frames:
        return (spark or SparkSession.active()).createDataFrame([], ddl)
    ranked = [
        df if "platform_rank" in df.columns else df.withColumn("platform_rank", F.lit(rank))
        for rank, df in enumerate(frames.values())
    ]
    return reduce(lambda left, right: left.unionByName(right, allowMissingColumns=True), ranked)
