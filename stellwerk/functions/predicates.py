"""Row tests of the posting funnel, as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from stellwerk import vocab
from stellwerk.functions.text import MAYBE_SPACES, SPACES, collapse, contains_any, is_blank, strip


def title_relevant(
    title: Column,
    blocks: list[str] = vocab.TITLE_BLOCKS,
    accept_first: list[str] | None = None,
) -> Column:
    """False only for titles holding a blocked word. ``accept_first`` is an option: words
    that rescue a title even though a blocked word occurs in it."""
    lowered = F.lower(F.coalesce(title, F.lit("")))
    relevant = ~contains_any(lowered, blocks)
    return contains_any(lowered, accept_first) | relevant if accept_first else relevant


def title_tag(
    title: Column,
    blocks: list[str] = vocab.TITLE_BLOCKS,
    keywords: list[str] = vocab.TITLE_KEYWORDS,
    broad_terms: list[str] = vocab.TITLE_BROAD_TERMS,
    signals: list[str] = vocab.TITLE_SIGNALS,
) -> Column:
    """Why a title is kept or dropped."""
    lowered = F.lower(F.coalesce(title, F.lit("")))
    return (
        F.when(contains_any(lowered, blocks), F.lit("blocked"))
        .when(contains_any(lowered, keywords), F.lit("keyword"))
        .when(
            contains_any(lowered, broad_terms) & contains_any(lowered, signals),
            F.lit("broad+signal"),
        )
        .otherwise(F.lit("ambiguous"))
    )


def location_germany(location: Column, keywords: list[str] = vocab.GERMANY_KEYWORDS) -> Column:
    return contains_any(F.lower(F.coalesce(location, F.lit(""))), keywords)


def location_target(
    location: Column,
    country: Column | str,
    keywords: list[str] = vocab.GERMANY_KEYWORDS,
) -> Column:
    """Is the posting in the search country?

    Germany goes by its keyword list. Any other country has to appear as a whole phrase,
    with any separators between its words, unless the posting is remote, hybrid or blank.
    """
    country = F.lit(country) if isinstance(country, str) else country
    lowered = F.lower(F.coalesce(location, F.lit("")))
    name = F.lower(country)
    # \Q…\E quotes each word; a literal country is folded to one constant pattern.
    phrase = F.concat(
        F.lit(r"(?U)\b\Q"),
        F.array_join(F.split(strip(name), SPACES), r"\E\W+\Q"),
        F.lit(r"\E\b"),
    )
    elsewhere = (
        F.rlike(lowered, phrase) | contains_any(lowered, vocab.REMOTE_WORDS) | is_blank(lowered)
    )
    return F.when(name == "germany", location_germany(location, keywords)).otherwise(elsewhere)


# --- posting age --------------------------------------------------------------------------

_ZONE = r"(?:Z|[+-](?:[01]\d|2[0-3]):?[0-5]\d)"
_DAY = r"(?:0?[1-9]|[12]\d|3[01])"
_MONTH = r"(?:0?[1-9]|1[0-2])"
_CLOCK = r"(?:[01]?\d|2[0-3]):[0-5]?\d:[0-5]?\d"
_MONTH_NAME = "(?:jan|feb|mar|apr|may|jun|jul|aug|sep|oct|nov|dec)"

# The date formats. Per format: the text it fits, whole but for outer whitespace; what is added to make the
# zone explicit (times without one are UTC); and the pattern that reads it. The guards run on
# the raw text, so a text is stripped only in the branch that reads it.
_DATE_FORMATS = [
    (rf"\d{{4}}-{_MONTH}-{_DAY}(?i:T){_CLOCK}{_ZONE}", "", "yyyy-M-d'T'H:m:s[XXX][XX]"),
    (rf"\d{{4}}-{_MONTH}-{_DAY}(?i:T){_CLOCK}", "Z", "yyyy-M-d'T'H:m:sXXX"),
    (rf"\d{{4}}-{_MONTH}-{_DAY}", " Z", "yyyy-M-d XXX"),
    (rf"{_DAY}\.{_MONTH}\.\d{{4}}", " Z", "d.M.yyyy XXX"),
    (rf"(?i){_DAY}{SPACES}{_MONTH_NAME}{SPACES}\d{{4}}", " Z", "d MMM yyyy XXX"),
    (rf"(?i){_MONTH_NAME}{SPACES}{_DAY},{SPACES}\d{{4}}", " Z", "MMM d, yyyy XXX"),
]

# Phrases for an age. First match wins. The factor turns the number found into hours; zero means "just now".
_JUST_NOW = rf"(?i)just{MAYBE_SPACES}posted|gerade|^{MAYBE_SPACES}(?:heute|today){MAYBE_SPACES}$"
_AGE_UNITS = [
    (rf"(?i)(\d+){MAYBE_SPACES}(?:minute|min|minuten?)", 0),
    (rf"(?i)(\d+){MAYBE_SPACES}(?:hours?|stunden?|std\.?)", 1),
    (rf"(?i)(\d+){MAYBE_SPACES}(?:days?|tagen?|tag)", 24),
    (rf"(?i)(\d+){MAYBE_SPACES}(?:weeks?|wochen?|woche)", 168),
]


def _names_age(text: Column) -> Column:
    """Whether the text is a phrase for an age, however large."""
    named = text.rlike(_JUST_NOW)
    for pattern, _ in _AGE_UNITS:
        named = named | text.rlike(pattern)
    return named


def relative_age_hours(text: Column) -> Column:
    """Age in hours of phrases such as "2 days ago" or "vor 3 Stunden", else null.

    Also null for an age too large for a bigint; ``age_status`` still calls it relative, and
    ``posting_fresh`` takes it for older than any window.
    """
    age = F.when(text.rlike(_JUST_NOW), F.lit(0).cast("bigint"))
    for pattern, factor in _AGE_UNITS:
        number = F.regexp_extract(text, pattern, 1).try_cast("bigint")
        hours = F.try_multiply(number, F.lit(factor).cast("bigint")) if factor else F.lit(0).cast("bigint")
        age = age.when(text.rlike(pattern), hours)
    return age


def posted_at(text: Column) -> Column:
    """The instant a structured date stands for, or null."""
    instant = F.lit(None).cast("timestamp")
    for pattern, zone, layout in reversed(_DATE_FORMATS):
        plain = collapse(text) if " " in layout else strip(text)
        value = F.try_to_timestamp(F.concat(plain, F.lit(zone)), F.lit(layout))
        instant = F.when(text.rlike(rf"^{MAYBE_SPACES}{pattern}{MAYBE_SPACES}$"), value).otherwise(instant)
    return instant


def age_status(text: Column) -> Column:
    return (
        F.when(is_blank(text), F.lit("blank"))
        .when(posted_at(text).isNotNull(), F.lit("dated"))
        .when(_names_age(text), F.lit("relative"))
        .otherwise(F.lit("unknown"))
    )


def posting_fresh(text: Column, as_of: Column, hours: int = vocab.MAX_AGE_HOURS) -> Column:
    """Inside the age window? Blank and unreadable dates count as fresh."""
    cutoff = as_of - F.make_dt_interval(hours=F.lit(hours))
    return F.when(is_blank(text), F.lit(True)).otherwise(
        F.coalesce(posted_at(text) >= cutoff, relative_age_hours(text) <= hours, ~_names_age(text))
    )


# --- other tests --------------------------------------------------------------------------


def is_search_link(url: Column, marker: str = vocab.XING_SEARCH_MARKER) -> Column:
    return url.contains(marker)


def run_blocking_quota(error: Column, markers: list[str] = vocab.RUN_BLOCKING_MARKERS) -> Column:
    """Does this error mean the model is used up for the rest of the run?"""
    return contains_any(F.lower(F.coalesce(error, F.lit(""))), markers)


def listed(platform: Column, platforms: list[str]) -> Column:
    """Does a per-board rule apply to this row?"""
    return platform.isin(platforms)
