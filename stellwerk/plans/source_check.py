"""A run over captures that only measures: funnel counts, unique matches, a report."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, functions as F

from stellwerk import vocab
from stellwerk.operators import funnel, identity, metrics, scoring
from stellwerk.operators.frontier import served_boards
from stellwerk.plans.daily_run import QUERY_KEYS, limited_pages
from stellwerk.sources import captures as pages
from stellwerk.sources.files import materialise
from stellwerk.sources.reports import run_report, write_report


def check_source(
    captures: DataFrame,
    run_dir: str,
    score: Callable[[DataFrame], DataFrame],
    queries: list[str],
    test_run: Column,
    apply_filters: bool = True,
    pages_per_query: int | None = None,
    country: str = "Germany",
    hours: int = vocab.MAX_AGE_HOURS,
    blocks: list[str] = vocab.TITLE_BLOCKS,
    on_score_error: str = "fail",
    disabled: list[str] | None = None,
) -> tuple[DataFrame, DataFrame]:
    """Funnel counts per query, and the unique matched postings.

    Neither the cap on detail pages nor the ledger apply, and all captured pages count unless
    ``pages_per_query`` limits them. Boards are those that serve the country. Without filters every card goes on
    to its detail page and counts as a match; the tests are still counted.
    """
    boards = served_boards(country, disabled)
    captures = captures.filter(F.col("platform").isin(list(boards)))
    search = limited_pages(captures, pages_per_query)
    parsed = materialise(pages.parse_search_pages(search, boards.get(vocab.STEPSTONE)), f"{run_dir}/pages")
    reached = funnel.pagination_stop(parsed, QUERY_KEYS, F.col("is_last"))
    flagged = funnel.funnel_flags(pages.explode_cards(reached), country=country, hours=hours, blocks=blocks)
    wanted = F.expr("location_ok AND date_ok AND title_ok") if apply_filters else F.lit(True)
    flagged = materialise(flagged.withColumn("detailed", wanted), f"{run_dir}/listings")
    chosen = flagged.filter("detailed")
    details = materialise(pages.parse_details(captures, wanted=chosen), f"{run_dir}/details")
    enriched = funnel.as_postings(funnel.join_detail(chosen, details))
    stage = score if apply_filters else scoring.pass_all
    scored = scoring.score_or_pass(enriched, stage, f"{run_dir}/scored", on_score_error)
    matched = scoring.matched_only(scored)
    unique = materialise(identity.first_global(matched), f"{run_dir}/matched")
    report = run_report(unique, queries, pages_per_query, apply_filters, test_run)
    write_report(report, unique, f"{run_dir}/report")
    return metrics.source_funnel(reached, flagged, matched), unique
