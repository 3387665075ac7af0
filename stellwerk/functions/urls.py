"""Posting links and search links."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from stellwerk import vocab
from stellwerk.functions.text import SPACES, strip


def percent_encode(text: Column, keep_slash: bool = True) -> Column:
    """RFC 3986 percent encoding, built on the form encoding Spark offers."""
    encoded = F.url_encode(text)
    for found, wanted in (("+", "%20"), ("%7E", "~"), ("*", "%2A")):
        encoded = F.replace(encoded, F.lit(found), F.lit(wanted))
    return F.replace(encoded, F.lit("%2F"), F.lit("/")) if keep_slash else encoded


def without_query(url: Column) -> Column:
    return F.substring_index(url, "?", 1)


def fold_subdomain(url: Column, pattern: str, target: str) -> Column:
    """Replace every host that matches the pattern (regional, mobile …) by one host."""
    return F.regexp_replace(url, pattern, target)


def linkedin_url(href: Column) -> Column:
    return fold_subdomain(
        without_query(href), r"https?://[a-z]{2}\.linkedin\.com", "https://www.linkedin.com"
    )


def xing_url(href: Column) -> Column:
    absolute = F.when(href.startswith("/"), F.concat(F.lit(vocab.XING_ORIGIN), href))
    return without_query(absolute.otherwise(href))


def stepstone_url(href: Column, domain: Column) -> Column:
    filled = (href != "") & ~href.startswith("http")
    return F.when(filled, F.concat(F.lit("https://"), domain, href)).otherwise(href)


def canonical_url(platform: Column, href: Column, domain: Column) -> Column:
    """Each board's own rule for turning a card's link into the posting's link."""
    href = F.coalesce(href, F.lit(""))
    return (
        F.when(platform == vocab.LINKEDIN, linkedin_url(href))
        .when(platform == vocab.XING, xing_url(href))
        .when(platform == vocab.STEPSTONE, stepstone_url(href, domain))
        .otherwise(href)
    )


def detail_url(refnr: Column) -> Column:
    return F.concat(F.lit(vocab.BA_DETAIL_PREFIX), percent_encode(refnr, keep_slash=False))


def search_url(
    platform: Column,
    query: Column,
    page_no: Column,
    country: Column,
    domain: Column,
    route: Column,
    path: Column,
) -> Column:
    """The search page a board shows for a query; ``page_no`` counts from one. The address
    formats are fixed values."""
    page = page_no.cast("string")
    offset = ((page_no - 1) * vocab.LINKEDIN_PAGE_SIZE).cast("string")
    slug = F.array_join(F.split(strip(query), SPACES), "-")
    linkedin = F.concat(
        F.lit("https://www.linkedin.com/jobs/search/?keywords="), percent_encode(query),
        F.lit("&location="), percent_encode(country),
        F.lit("&f_E=2%2C3&f_TPR=r86400&start="), offset,
    )
    stepstone = F.concat(
        F.lit("https://"), domain, F.lit("/"), route, F.lit("/"), percent_encode(slug),
        F.lit("/"), path, F.lit("?sort=2&datePosted=1&page="), page,
    )
    xing = F.concat(
        F.lit("https://www.xing.com/jobs/search?keywords="), percent_encode(query),
        F.lit("&location=Germany&page="), page,
    )
    # Form encoding: a space stays "+", only the tilde and the star differ from Spark's.
    form = F.replace(F.replace(F.url_encode(query), F.lit("%7E"), F.lit("~")), F.lit("*"), F.lit("%2A"))
    agency = F.concat(
        F.lit("https://rest.arbeitsagentur.de/jobboerse/jobsuche-service/pc/v4/jobs?was="), form,
        F.lit("&wo=Deutschland&angebotsart=1&veroeffentlichtseit=1&page="), page,
        F.lit(f"&size={vocab.BA_PAGE_SIZE}"),
    )
    return (
        F.when(platform == vocab.LINKEDIN, linkedin)
        .when(platform == vocab.STEPSTONE, stepstone)
        .when(platform == vocab.XING, xing)
        .when(platform == vocab.BA, agency)
    )
