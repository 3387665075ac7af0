"""Reading a model's reply: JSON recovery, score, reason, verdict."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from stellwerk import vocab
from stellwerk.functions.text import MAYBE_SPACES, strip

_LINE_BREAK = r"\r\n|[\n\x0b\x0c\r\x1c-\x1e\x85\u2028\u2029]"
_FENCE = "```"
_JSON_START = r'^[\[{"\-0-9tfnNI]'


def strict_json(text: Column) -> Column:
    """Parse text that is exactly one JSON value, else null.

    The JSON parser stops after the first value and ignores what follows, so the text is
    parsed once as an object field and once as an array item: no trailing text fits both.
    """
    as_field = F.try_parse_json(F.concat(F.lit('{"v":'), text, F.lit("}")))
    as_item = F.try_parse_json(F.concat(F.lit("["), text, F.lit("]")))
    return F.when(as_item.isNotNull(), F.try_variant_get(as_field, "$.v", "variant"))


def with_reply(rows: DataFrame, raw: str = "raw", out: str = "reply") -> DataFrame:
    """Add the JSON object in a reply: the whole text, else the inside of a code fence, else
    the span from the first to the last brace. Null when there is none.

    Each step is a column that later steps read, so no text is parsed again for every use.
    """
    lines = F.split("_text", _LINE_BREAK)
    inside = strip(F.array_join(F.slice(lines, F.lit(2), F.size(lines) - 2), "\n"))
    is_fenced = F.col("_text").startswith(_FENCE) & (F.size(lines) >= 3)
    whole = F.coalesce("_fenced", "_text")
    braces = F.regexp_extract(whole, r"(?s)(\{.*\})", 1)
    # Only what begins like a JSON value is parsed, and nothing that has just failed.
    likely = lambda name: F.when(F.col(name).rlike(_JSON_START), strict_json(F.col(name)))
    value = F.coalesce(likely("_text"), likely("_fenced"), F.when(braces != whole, strict_json(braces)))
    return (
        rows.withColumn("_text", strip(F.coalesce(raw, F.lit(""))))
        .withColumn("_fenced", F.when(is_fenced, inside))
        .withColumn("_value", value)
        .withColumn(out, F.when(F.schema_of_variant("_value").startswith("OBJECT"), F.col("_value")))
        .drop("_text", "_fenced", "_value")
    )


def clamp_score(number: Column) -> Column:
    """Whole score between 1 and 10; decimals are cut off."""
    return F.floor(F.greatest(F.lit(1.0), F.least(F.lit(10.0), number))).cast("int")


def _score_of(field: Column, kind: Column) -> Column:
    text = F.try_variant_get(field, "$", "string")
    digits = F.regexp_replace(strip(text), "_", "")
    return (
        F.when(field.isNull(), F.lit(1))
        .when(kind.rlike("^(BIGINT|DECIMAL|FLOAT|DOUBLE)"), clamp_score(F.try_variant_get(field, "$", "double")))
        .when(kind == "BOOLEAN", F.lit(1))
        .when(
            (kind == "STRING") & text.rlike(rf"^{MAYBE_SPACES}[+-]?\d+(_\d+)*{MAYBE_SPACES}$"),
            clamp_score(digits.try_cast("double")),
        )
    )


def _reason_of(field: Column, kind: Column) -> Column:
    text = F.try_variant_get(field, "$", "string")
    return (
        F.when(field.isNull(), F.lit(""))
        .when(kind == "VOID", F.lit("None"))
        .when(kind == "BOOLEAN", F.initcap(text))
        .when(kind.rlike("^(OBJECT|ARRAY)"), F.to_json(field))
        .otherwise(strip(text))
    )


def with_score(rows: DataFrame, reply: str = "reply") -> DataFrame:
    """Add a reply object's ``score`` and ``reason``.

    The score is 1 when absent and null when it is not a whole number; a reason that is not
    text is written out.
    """
    got = F.col(reply).isNotNull()
    return (
        rows.withColumns(
            {
                "_score": F.try_variant_get(reply, "$.score", "variant"),
                "_reason": F.try_variant_get(reply, "$.reason", "variant"),
            }
        )
        .withColumns(
            {"_score_kind": F.schema_of_variant("_score"), "_reason_kind": F.schema_of_variant("_reason")}
        )
        .withColumns(
            {
                "score": F.when(got, _score_of(F.col("_score"), F.col("_score_kind"))),
                "reason": F.when(got, _reason_of(F.col("_reason"), F.col("_reason_kind"))),
            }
        )
        .drop("_score", "_reason", "_score_kind", "_reason_kind")
    )


def with_verdict(
    rows: DataFrame, raw: str = "raw", out: str = "verdict", threshold: int = vocab.MATCH_THRESHOLD
) -> DataFrame:
    """Add ``struct(match, score, reason)`` for a reply text; null when it cannot be used."""
    read = with_score(with_reply(rows, raw, "_reply"), "_reply")
    verdict = F.struct(is_match(F.col("score"), threshold).alias("match"), "score", "reason")
    return read.withColumn(out, F.when(F.col("score").isNotNull(), verdict)).drop("_reply", "score", "reason")


def is_match(score: Column, threshold: int = vocab.MATCH_THRESHOLD) -> Column:
    return score >= threshold


def score_bar(score: Column) -> Column:
    return F.concat(F.repeat(F.lit("★"), score), F.repeat(F.lit("☆"), F.lit(10) - score))
