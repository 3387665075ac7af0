"""Running numbers without a single-task sort."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F


def number_rows(
    df: DataFrame, group: list[str], order: list[str], number: str = "n", total: str | None = None
) -> DataFrame:
    """Number each group's rows from 1 in the given order.

    The order columns but the last split a group into blocks. Blocks are counted by an
    aggregate; each block's start is the sum, level by level, of the counts before it; rows
    are then only numbered inside their block. No window sees a whole group, only one
    level's distinct values or one block. There must be a group column, and key and order
    columns must not be null.
    """
    *levels, leaf = order
    block = [*group, *levels]
    starts = df.groupBy(*block).agg(F.count("*").alias("_rows"))
    # From the innermost level outwards: counts per prefix of the order columns.
    counts = {len(levels): starts}
    for depth in range(len(levels) - 1, -1, -1):
        counts[depth] = counts[depth + 1].groupBy(*group, *levels[:depth]).agg(F.sum("_rows").alias("_rows"))
    offsets = counts[0].select(*group, F.lit(0).cast("bigint").alias("_start"), F.col("_rows").alias("_total"))
    for depth in range(1, len(levels) + 1):
        prefix = [*group, *levels[: depth - 1]]
        before = Window.partitionBy(*prefix).orderBy(levels[depth - 1]).rowsBetween(Window.unboundedPreceding, -1)
        step = counts[depth].select(
            *prefix, levels[depth - 1], F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_step")
        )
        offsets = step.join(offsets, prefix).withColumn("_start", F.col("_start") + F.col("_step")).drop("_step")
    inside = F.row_number().over(Window.partitionBy(*block).orderBy(leaf))
    rows = df.withColumn("_inside", inside).join(offsets, block)
    rows = rows.withColumn(number, F.col("_start") + F.col("_inside"))
    if total:
        rows = rows.withColumnRenamed("_total", total)
    return rows.drop("_inside", "_start", "_total")
