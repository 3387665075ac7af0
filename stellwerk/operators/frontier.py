"""Which search pages to capture: boards, countries, queries, pages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from stellwerk import vocab
from stellwerk.functions.urls import search_url


def platform_country_table(spark: SparkSession) -> DataFrame:
    """The fixed rule table; its size does not depend on the data."""
    return spark.createDataFrame(
        vocab.PLATFORM_COUNTRY,
        "platform string, country_key string, rule string, domain string, route string, path string",
    )


def served_boards(country: str, disabled: list[str] | None = None) -> dict[str, str]:
    """The boards that are on and serve a country, with their domains."""
    fits = {
        "any": lambda key: True,
        "exact": lambda key: country == key,
        "ignore_case": lambda key: country.lower() == key.lower(),
    }
    return {
        board: domain
        for board, key, rule, domain, _, _ in vocab.PLATFORM_COUNTRY
        if fits[rule](key) and board not in (disabled or [])
    }


def search_query_table(spark: SparkSession, queries: dict = vocab.SEARCH_QUERIES) -> DataFrame:
    rows = [(name, idx, query) for name, list_ in queries.items() for idx, query in enumerate(list_)]
    return spark.createDataFrame(rows, "platform string, query_idx int, query string")


def _rule_fits(country: Column) -> Column:
    key, rule = F.col("country_key"), F.col("rule")
    return (
        (rule == "any")
        | ((rule == "exact") & (country == key))
        | ((rule == "ignore_case") & (F.lower(country) == F.lower(key)))
    )


def platform_country(searches: DataFrame, disabled: list[str] | None = None) -> DataFrame:
    """Keep searches whose board is on and serves their ``country``; add its address parts.

    The rule table is a constant of seven rows, hence the broadcast.
    """
    rules = F.broadcast(platform_country_table(searches.sparkSession))
    kept = searches.join(rules, "platform").filter(_rule_fits(F.col("country")))
    if disabled:
        kept = kept.filter(~F.col("platform").isin(disabled))
    return kept.drop("country_key", "rule")


def search_frontier(searches: DataFrame, pages: int = vocab.PAGES_PER_QUERY) -> DataFrame:
    """Every page of every search, with its address. Needs ``platform_country`` columns."""
    paged = searches.withColumn("page_no", F.explode(F.sequence(F.lit(1), F.lit(pages))))
    names = ["platform", "query", "page_no", "country", "domain", "route", "path"]
    return paged.withColumn("url", search_url(*[F.col(name) for name in names]))
