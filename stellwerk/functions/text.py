"""Text functions on posting fields; all stay inside the JVM."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, functions as F

from stellwerk import vocab

# The 29 characters that count as whitespace when text is stripped or split.
WHITESPACE = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680"
    "\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)
# The same set for regular expressions: at least one, and any number. The Unicode class knows
# all but four of them and matches twice as fast as a list of ranges.
SPACES = r"(?U:[\s\x1c-\x1f]+)"
MAYBE_SPACES = r"(?U:[\s\x1c-\x1f]*)"

SUMMARY_SENTENCES = 5
SUMMARY_MIN_CHARS = 20
SUMMARY_CHARS = 700


def strip(text: Column) -> Column:
    """Remove Unicode whitespace at both ends (SQL ``trim`` only knows the space)."""
    return F.btrim(text, F.lit(WHITESPACE))


def is_blank(text: Column) -> Column:
    return F.coalesce(strip(text), F.lit("")) == ""


def first_filled(*texts: Column) -> Column:
    """The first text that is not blank, stripped; an empty string when all are."""
    filled = [F.nullif(strip(text), F.lit("")) for text in texts]
    return F.coalesce(*filled, F.lit(""))


def collapse(text: Column) -> Column:
    return strip(F.regexp_replace(text, SPACES, " "))


def contains_any(text: Column, words: list[str]) -> Column:
    """True when the text holds one of the words.

    ``exists`` over the text alone names it once for all tests. Written as a plain chain, a
    filter splits into one predicate per word and lower-cases the text for each of them; one
    alternation pattern is slower still.
    """
    if not words:
        return F.lit(False)
    return F.exists(F.array(text), lambda bound: reduce(or_, [bound.contains(word) for word in words]))


def job_id(title: Column, company: Column, location: Column) -> Column:
    """Content hash of title, company and location, ignoring case and outer whitespace."""
    title, company, location = (
        strip(F.lower(F.coalesce(part, F.lit("")))) for part in (title, company, location)
    )
    digest = F.sha2(F.concat(title, F.lit("|"), company, F.lit("|"), location), 256)
    # Never null, so that joins on the id need no null test that would hash once more.
    return F.coalesce(digest, F.lit(""))


def summary(description: Column, sentences: int = SUMMARY_SENTENCES) -> Column:
    """The first few sentences that are long enough, cut at 700 characters."""
    pieces = F.split(collapse(F.coalesce(description, F.lit(""))), r"(?<=[.!?]) ")
    kept = F.filter(pieces, lambda piece: F.length(piece) > SUMMARY_MIN_CHARS)
    joined = F.array_join(F.slice(kept, 1, sentences), " ")
    cut = F.when(
        F.length(joined) > SUMMARY_CHARS,
        F.concat(F.substring(joined, 1, SUMMARY_CHARS - 3), F.lit("…")),
    ).otherwise(joined)
    return F.when(cut == "", F.lit(vocab.NO_DESCRIPTION)).otherwise(cut)


def prompt_truncate(description: Column, limit: int = vocab.PROMPT_CHARS) -> Column:
    """Cut an over-long description after the last sentence end inside the limit."""
    head = F.substring(description, 1, limit)
    whole_sentences = F.regexp_extract(head, r"(?s)^(.*[.!?])", 1)
    cut = F.when(whole_sentences == "", head).otherwise(whole_sentences)
    return F.when(
        F.length(description) > limit, F.concat(cut, F.lit(vocab.TRUNCATION_NOTE))
    ).otherwise(description)


def platform_rank(platform: Column) -> Column:
    rank = F.lit(len(vocab.PLATFORM_RANK))
    for name, value in vocab.PLATFORM_RANK.items():
        rank = F.when(platform == name, F.lit(value)).otherwise(rank)
    return rank.cast("int")
