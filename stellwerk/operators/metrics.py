"""Counts over the funnel, the boards and the run."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

STAGES = ["cards", "loc", "date", "title", "detail", "matched"]


def funnel_by_query(rows: DataFrame, keys: tuple[str, ...] = ("platform", "query_idx")) -> DataFrame:
    """Rows that got to each stage, per query. Stages are cumulative; input flags are
    ``location_ok``, ``date_ok``, ``title_ok``, ``detailed`` and ``match``."""
    reached, counts = F.lit(True), [F.count("*").alias("cards")]
    flags = ["location_ok", "date_ok", "title_ok", "detailed", "match"]
    for stage, flag in zip(STAGES[1:], flags):
        reached = reached & F.coalesce(flag, F.lit(False))
        counts.append(F.count_if(reached).alias(stage))
    return rows.groupBy(*keys).agg(*counts)


def source_funnel(
    pages: DataFrame, flagged: DataFrame, matched: DataFrame, keys: tuple[str, ...] = ("platform", "query_idx")
) -> DataFrame:
    """Funnel of a single-source run. Cards are counted as listed on the pages, before
    unusable ones are dropped; matches after scoring. The three counts have a row per query
    each and are joined."""
    listed = pages.groupBy(*keys).agg(F.sum("listed").alias("cards"))
    passed = flagged.groupBy(*keys).agg(
        F.count_if("location_ok").alias("loc"),
        F.count_if(F.expr("location_ok AND date_ok")).alias("date"),
        F.count_if(F.expr("location_ok AND date_ok AND title_ok")).alias("title"),
        F.count_if("detailed").alias("detail"),
    )
    hits = matched.groupBy(*keys).agg(F.count("*").alias("matched"))
    joined = listed.join(passed, list(keys), "left").join(hits, list(keys), "left")
    return joined.select(*keys, *[F.coalesce(stage, F.lit(0)).alias(stage) for stage in STAGES])


def funnel_total(funnel: DataFrame) -> DataFrame:
    """Per-query rows, a row per board and a grand total, summed from the funnel rows."""
    sums = [F.sum(stage).alias(stage) for stage in STAGES]
    totals = funnel.rollup("platform", "query_idx").agg(F.grouping_id().alias("level"), *sums)
    name = (
        F.when(F.col("level") == 3, F.lit("TOTAL"))
        .when(F.col("level") == 1, F.concat("platform", F.lit(" TOTAL")))
        .otherwise(F.col("platform"))
    )
    return totals.withColumn("platform", name).drop("level")


def unique_matched(scored: DataFrame, approximate: bool = False) -> DataFrame:
    count = F.approx_count_distinct if approximate else F.count_distinct
    return scored.filter("match").agg(count("job_id").alias("unique_matched"))


def platform_counts(postings: DataFrame) -> DataFrame:
    return postings.groupBy("platform").agg(
        F.count("*").alias("candidates"), F.count_distinct("job_id").alias("unique_jobs")
    )


def match_rate(scored: DataFrame) -> DataFrame:
    return scored.agg(F.count_if("match").alias("matched"), F.count("*").alias("evaluated"))


def run_summary_of_counts(runs: DataFrame, delivered: DataFrame) -> DataFrame:
    """The same from the counts that the runs before committed, without their rows. The delivered
    postings hold each id once and none that was delivered before."""
    before = runs.agg(F.coalesce(F.sum("new_ids"), F.lit(0)).alias("ledger_before"))
    new = delivered.agg(F.count("job_id").alias("new_jobs"))
    counts = new.withColumn("ledger_before", before.scalar())
    return counts.withColumn("ledger_after", F.col("ledger_before") + F.col("new_jobs"))


def run_summary(ledger_before: DataFrame, delivered: DataFrame) -> DataFrame:
    """New postings, and the ledger's size before and after them: one aggregate."""
    marks = ledger_before.select("job_id", F.lit(True).alias("old")).unionByName(
        delivered.select("job_id", F.lit(False).alias("old"))
    )
    per_job = marks.groupBy("job_id").agg(
        F.max("old").alias("old"), F.max(~F.col("old")).alias("new")
    )
    return per_job.agg(
        F.count_if("new").alias("new_jobs"),
        F.count_if("old").alias("ledger_before"),
        F.count("*").alias("ledger_after"),
    )
