"""The filter funnel between listing cards and scored postings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from stellwerk import vocab
from stellwerk.functions.predicates import listed, location_target, posting_fresh, title_relevant
from stellwerk.functions.text import is_blank, job_id, summary
from stellwerk.operators.identity import first_by, top_by


def page_limit(pages: DataFrame, pages_per_query: int = vocab.PAGES_PER_QUERY) -> DataFrame:
    return pages.filter(F.col("page_no") <= pages_per_query)


def pagination_stop(pages: DataFrame, keys: list[str], is_last: Column) -> DataFrame:
    """Drop the pages after the first one that ends a query's paging.

    The first such page is found by an aggregate, which combines on the map side; a window
    over the query would pull all its pages into one task. The ends are one narrow row per
    query, so the join becomes a broadcast at run time as soon as their measured size allows.
    """
    ends = pages.filter(is_last).groupBy(*keys).agg(F.min("page_no").alias("_end"))
    reached = F.col("_end").isNull() | (F.col("page_no") <= F.col("_end"))
    return pages.join(ends, keys, "left").filter(reached).drop("_end")


def required_fields(listings: DataFrame, fields: list[str]) -> DataFrame:
    keep = F.lit(True)
    for field in fields:
        keep = keep & (F.coalesce(field, F.lit("")) != "")
    return listings.filter(keep)


def first_url_in_page(listings: DataFrame, page_keys: list[str], order: list[str]) -> DataFrame:
    return first_by(listings, [*page_keys, "url"], order)


def funnel_flags(
    listings: DataFrame,
    country: str = "Germany",
    as_of: Column | None = None,
    hours: int = vocab.MAX_AGE_HOURS,
    blocks: list[str] = vocab.TITLE_BLOCKS,
    germany_keywords: list[str] = vocab.GERMANY_KEYWORDS,
    location_boards: list[str] = vocab.NEEDS_LOCATION_CHECK,
) -> DataFrame:
    """The three cheap tests as columns; the location test applies to some boards only."""
    as_of = F.col("observed_at") if as_of is None else as_of
    location_ok = ~listed(F.col("platform"), location_boards) | location_target(
        F.col("location"), country, germany_keywords
    )
    return listings.withColumns(
        {
            "location_ok": location_ok,
            "date_ok": posting_fresh(F.col("posting_date"), as_of, hours),
            "title_ok": title_relevant(F.col("title"), blocks),
        }
    )


def candidates(flagged: DataFrame) -> DataFrame:
    """Rows that pass all three tests."""
    flags = ["location_ok", "date_ok", "title_ok"]
    return flagged.filter(" AND ".join(flags)).drop(*flags)


def cap_details(
    rows: DataFrame,
    limit: int = vocab.DETAILS_PER_QUERY,
    keys: tuple[str, ...] = ("platform", "query_idx"),
    order: tuple[str, ...] = ("page_no", "card_pos"),
) -> DataFrame:
    """The first candidates of each query, across its pages. Rows dropped after the detail
    page were counted here and are not replaced."""
    return top_by(rows, list(keys), list(order), limit)


def join_detail(listings: DataFrame, details: DataFrame) -> DataFrame:
    """Add detail fields; a listing whose detail is missing stays, with empty ones."""
    joined = listings.join(details, ["platform", "url"], "left")
    filled = {name: F.coalesce(name, F.lit("")) for name in details.columns if name not in ("platform", "url")}
    return joined.withColumns(filled)


def late_fresh_check(
    rows: DataFrame,
    as_of: Column,
    hours: int = vocab.MAX_AGE_HOURS,
    boards: list[str] = vocab.CHECKS_DATE_AFTER_DETAIL,
) -> DataFrame:
    """On some boards the detail page fills a blank date, which is then tested once more."""
    checked = listed(F.col("platform"), boards)
    fill = checked & is_blank(F.col("posting_date"))
    dated = rows.withColumn(
        "posting_date", F.when(fill, F.col("detail_date")).otherwise(F.col("posting_date"))
    )
    return dated.filter(~checked | posting_fresh(F.col("posting_date"), as_of, hours))


def nonempty_description(
    rows: DataFrame, boards: list[str] = vocab.DROPS_BLANK_DESCRIPTION
) -> DataFrame:
    return rows.filter(~(listed(F.col("platform"), boards) & is_blank(F.col("description"))))


def as_postings(rows: DataFrame) -> DataFrame:
    """Identity and summary for enriched listings, in the posting layout."""
    return rows.select(
        job_id(F.col("title"), F.col("company"), F.col("location")).alias("job_id"),
        "title",
        "company",
        "location",
        "url",
        "posting_date",
        "platform",
        "experience_level",
        "description",
        summary(F.col("description")).alias("summary"),
        "platform_rank",
        "query_idx",
        "page_no",
        "card_pos",
        "observed_at",
    )
