"""A whole run: captures to postings, postings to a digest and ledger rows."""

from __future__ import annotations

from collections.abc import Callable
from datetime import timedelta

from pyspark.sql import Column, DataFrame, functions as F

from stellwerk import vocab
from stellwerk.functions.text import is_blank, job_id
from stellwerk.operators import digest, funnel, identity, metrics, scoring
from stellwerk.operators.frontier import served_boards
from stellwerk.sources import captures as pages
from stellwerk.sources import ledger as ledgers
from stellwerk.sources.files import materialise
from stellwerk.sources.reports import write_digest

QUERY_KEYS = ["platform", "query_idx"]


def limited_pages(captures: DataFrame, pages_per_query: int | None) -> DataFrame:
    """Captures without the search pages behind the limit, if there is one."""
    if pages_per_query is None:
        return captures
    return captures.filter(F.col("page_no").isNull() | (F.col("page_no") <= pages_per_query))


def acquire(
    captures: DataFrame,
    run_dir: str,
    country: str = "Germany",
    pages_per_query: int | None = None,
    details_per_query: int | None = None,
    hours: int = vocab.MAX_AGE_HOURS,
    blocks: list[str] = vocab.TITLE_BLOCKS,
    disabled: list[str] | None = None,
    wait: bool = False,
    waited: DataFrame | None = None,
    early: DataFrame | None = None,
    now: Column | None = None,
    patience: timedelta = timedelta(0),
    keep_early: timedelta = timedelta(days=14),
) -> DataFrame:
    """Postings of one run's captures, written to ``run_dir/postings``.

    With ``wait``, candidates without a detail page are left out and written to ``run_dir/waiting``, and detail pages
    that no candidate asks for to ``run_dir/early``. Both are given to the next run. There a waiting candidate goes
    on as soon as its page has come, and without it once it has waited for ``patience``, but never in the run it
    came in. Unasked pages are kept for ``keep_early``. ``now`` is the run's time.

    Only boards that serve the country and are not ``disabled`` are read. All captured pages
    and candidates count, unless ``pages_per_query`` or ``details_per_query`` set a limit.

    Parsing pages is the costly stage, so its results are written; the cheap tests and the
    cap run on the small card rows, and only the detail pages they leave are parsed.
    """
    boards = served_boards(country, disabled)
    captures = captures.filter(F.col("platform").isin(list(boards)))
    search = limited_pages(captures, pages_per_query)
    parsed = materialise(pages.parse_search_pages(search, boards.get(vocab.STEPSTONE)), f"{run_dir}/pages")
    listings = pages.explode_cards(funnel.pagination_stop(parsed, QUERY_KEYS, F.col("is_last")))
    flagged = funnel.funnel_flags(listings, country=country, hours=hours, blocks=blocks)
    candidates = funnel.candidates(flagged)
    if details_per_query is not None:
        candidates = funnel.cap_details(candidates, details_per_query)
    capped = materialise(candidates, f"{run_dir}/candidates")
    if wait:
        now = F.current_timestamp() if now is None else now
        wanted, details = _ready(captures, capped, waited, early, run_dir, now, patience, keep_early)
    else:
        wanted, details = capped, materialise(pages.parse_details(captures, wanted=capped), f"{run_dir}/details")
    # Which rows stay is found without descriptions; these are joined to them afterwards.
    described = F.when(is_blank(F.col("description")), F.lit("")).otherwise(F.lit("described"))
    rows = funnel.join_detail(wanted, details.select("platform", "url", "detail_date", described.alias("description")))
    rows = funnel.nonempty_description(funnel.late_fresh_check(rows, F.col("observed_at"), hours))
    named = rows.withColumn("job_id", job_id(F.col("title"), F.col("company"), F.col("location")))
    first = identity.first_per_platform(named).drop("job_id", "detail_date", "description")
    return materialise(funnel.as_postings(funnel.join_detail(first, details)), f"{run_dir}/postings")


def _ready(
    captures: DataFrame,
    fresh: DataFrame,
    waited: DataFrame | None,
    early: DataFrame | None,
    run_dir: str,
    now: Column,
    patience: timedelta,
    keep_early: timedelta,
) -> tuple[DataFrame, DataFrame]:
    """The candidates that go on, and the details that are there; what stays behind is written."""
    page = ["platform", "url"]
    asked = fresh.withColumns({"waiting_since": now, "waits": F.lit(False)})
    if waited is not None:
        asked = asked.unionByName(waited.withColumn("waits", F.lit(True)))
    # Written, since the time differs from one query to the next.
    asked = materialise(asked, f"{run_dir}/asked")
    arrived = captures.filter(F.col("kind") != "search").withColumn("arrived", now)
    if early is not None:
        arrived, captures = pages.stacked(arrived, early), pages.stacked(captures, early.drop("arrived"))
    details = materialise(pages.parse_details(captures, wanted=asked), f"{run_dir}/details")
    found = details.select(*page)
    missing = asked.join(found, page, "left_anti")
    overdue = F.col("waits") & F.coalesce(F.col("waiting_since") <= now - F.lit(patience), F.lit(True))
    state = ["waiting_since", "waits"]
    materialise(missing.filter(~overdue).drop("waits"), f"{run_dir}/waiting")
    # A page that was asked for is used in this run; others are kept until they are too old.
    unasked = arrived.filter(F.col("arrived") > now - F.lit(keep_early)).join(asked.select(*page).distinct(), page, "left_anti")
    materialise(unasked.drop("_file", "_row"), f"{run_dir}/early")
    go = asked.join(found, page, "left_semi").unionByName(materialise(missing.filter(overdue), f"{run_dir}/overdue"))
    return go.drop(*state), details


def deliver(
    postings: DataFrame,
    score: Callable[[DataFrame], DataFrame],
    ledger_path: str,
    run_dir: str,
    run_id: str,
    sent_at: Column,
    country: str = "Germany",
    send: Callable[[DataFrame, DataFrame], bool] | None = None,
    on_score_error: str = "fail",
) -> DataFrame:
    """Score what is new, write the digest and, once it is delivered, the ledger.

    Postings sent before are taken out ahead of scoring; that changes nothing but the work,
    as the ledger test depends on the id alone. First occurrences are chosen after scoring,
    among matches. ``score`` adds ``llm_score``, ``llm_reason`` and ``match``. The digest is
    written plain to ``digest`` and as HTML to ``digest-html``, both with their subject; ``send``
    is given both tables. Returns the one-row run summary.
    """
    spark = postings.sparkSession
    ledger = ledgers.read_ledger(spark, ledger_path, except_run=run_id)
    fresh = identity.anti_ledger(postings, ledger)
    scored = scoring.score_or_pass(fresh, score, f"{run_dir}/scored", on_score_error)
    matched = materialise(
        identity.first_global(scoring.matched_only(scored)), f"{run_dir}/matched"
    )
    # No digest shows the whole description, so it isn't sent along.
    shown = matched.drop("description", "summary").withColumn("digest_id", F.lit(run_id))
    numbered = materialise(digest.digest_number(shown), f"{run_dir}/numbered")
    wanted = spark.createDataFrame([(run_id,)], "digest_id string")
    date = F.date_format(sent_at, "yyyy-MM-dd")
    title = digest.subject(country, date)
    for html, folder in ((False, "digest"), (True, "digest-html")):
        parts = digest.digest_assemble(wanted, numbered, date, country, html=html)
        write_digest(parts.withColumn("subject", title), f"{run_dir}/{folder}")
    delivered = send is None or send(*(spark.read.parquet(f"{run_dir}/{f}") for f in ("digest", "digest-html")))
    # Written before the ledger grows, since it reports the ledger's size before the run.
    runs = ledgers.run_counts(spark, ledger_path, except_run=run_id)
    # Runs that were recorded without a count may share ids with others.
    counted = runs.filter("new_ids IS NULL").isEmpty()
    summary = metrics.run_summary_of_counts(runs, matched) if counted else metrics.run_summary(ledger, matched)
    summary = materialise(summary, f"{run_dir}/summary")
    if delivered:
        ledgers.append_ledger(matched, ledger_path, run_id, sent_at, counted=True)
    return summary
