"""What the scorer is sent: profile, system prompt, posting message, request."""

from __future__ import annotations

from string import Formatter

from pyspark.sql import Column, functions as F

from stellwerk import vocab
from stellwerk.functions.text import prompt_truncate


def _or_na(value: Column) -> Column:
    return F.coalesce(value, F.lit("N/A"))


def retarget_profile(profile: Column, country: Column | str) -> Column:
    """Rewrite a profile's country wording for the search country."""
    country = F.lit(country) if isinstance(country, str) else country
    # A backslash or dollar sign in the country must not act as a group reference.
    safe = F.regexp_replace(country, r"([\\$])", r"\\$1")
    for pattern, wording in vocab.PROFILE_REWRITES:
        profile = F.regexp_replace(profile, F.lit(pattern), _fill(wording, country=safe))
    return profile


def _fill(template: str, **values: Column) -> Column:
    """Put columns into the {name} places of a text; doubled braces stand for a brace."""
    parts = []
    for literal, name, _, _ in Formatter().parse(template):
        parts += [F.lit(literal)] + ([values[name]] if name else [])
    return F.concat(*parts)


def system_prompt(profile: Column, country: Column | str, template: str = vocab.SYSTEM_PROMPT) -> Column:
    """The scoring rubric around an (already retargeted) profile."""
    country = F.lit(country) if isinstance(country, str) else country
    return _fill(template, profile=profile, country=country)


def posting_message(
    title: Column,
    company: Column,
    location: Column,
    platform: Column,
    experience: Column,
    description: Column,
) -> Column:
    experience = F.coalesce(F.nullif(experience, F.lit("")), F.lit("N/A"))
    description = F.coalesce(description, F.lit(vocab.NO_DESCRIPTION))
    # The message's labels.
    return F.concat_ws(
        "\n",
        F.concat(F.lit("Job Title: "), _or_na(title)),
        F.concat(F.lit("Company: "), _or_na(company)),
        F.concat(F.lit("Location: "), _or_na(location)),
        F.concat(F.lit("Platform: "), _or_na(platform)),
        F.concat(F.lit("Experience Level (from job board): "), experience),
        F.lit(""),
        F.lit("Job Description:"),
        prompt_truncate(description),
    )


def request_struct(model: Column, system: Column, message: Column) -> Column:
    """One model request, ready for ``to_json`` or for a request table."""
    def turn(role: str, content: Column) -> Column:
        return F.struct(F.lit(role).alias("role"), content.alias("content"))

    return F.struct(
        model.alias("model"),
        F.array(turn("system", system), turn("user", message)).alias("messages"),
        F.struct(F.lit("json_object").alias("type")).alias("response_format"),
        F.lit(vocab.MAX_TOKENS).alias("max_tokens"),
        F.lit(vocab.TEMPERATURE).alias("temperature"),
    )
