"""Which posting is which: first occurrences, and the ledger of what was sent."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from stellwerk import schema

_RN = "_rn"


def top_by(df: DataFrame, keys: list[str], order: list[str | Column], n: int) -> DataFrame:
    """The first ``n`` rows per key.

    Spark prunes every map task to ``n`` rows per key before the shuffle, so a key that
    holds most of the rows does not end up whole in one task.
    """
    window = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn(_RN, F.row_number().over(window)).filter(F.col(_RN) <= n).drop(_RN)


def first_by(df: DataFrame, keys: list[str], order: list[str | Column]) -> DataFrame:
    return top_by(df, keys, order, 1)


def has_job_id(df: DataFrame) -> DataFrame:
    return df.filter(F.coalesce("job_id", F.lit("")) != "")


def first_per_platform(postings: DataFrame) -> DataFrame:
    """First occurrence of a posting among one board's queries; blank ids are dropped."""
    return first_by(
        has_job_id(postings), ["platform", "job_id"], ["query_idx", "page_no", "card_pos"]
    )


def first_global(postings: DataFrame) -> DataFrame:
    """First occurrence across boards, in acquisition order. Meant for postings that matched
    and were not sent: the survivor is the first *matched* row of an id."""
    return first_by(has_job_id(postings), ["job_id"], schema.ORDER_COLUMNS)


def anti_ledger(postings: DataFrame, ledger: DataFrame) -> DataFrame:
    """Postings not delivered before. The planner broadcasts the ledger only when its
    measured size allows; beyond that both sides shuffle on the id.

    The ledger is joined as it is: it holds an id about once, and an aggregate between its
    shuffle and the join would keep adaptive execution from splitting a hot id's postings.
    """
    return has_job_id(postings).join(ledger.select("job_id"), "job_id", "left_anti")


def already_sent(postings: DataFrame, ledger: DataFrame) -> DataFrame:
    return has_job_id(postings).join(ledger.select("job_id"), "job_id", "left_semi")


def stable_order(df: DataFrame) -> DataFrame:
    """Acquisition order, for sinks only."""
    return df.orderBy(*schema.ORDER_COLUMNS)
