"""JSON carried inside pages: JSON-LD blocks and the agency page's state script."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from stellwerk.functions.page_fields import unescape_html
from stellwerk.functions.replies import strict_json
from stellwerk.functions.text import strip

# Where the pages carry their JSON.
_LD_SCRIPT = r"(?is)<script[^>]*type=[\"']application/ld\+json[\"'][^>]*>(.*?)</script>"
_STATE_SCRIPT = r"(?is)<script[^>]*id=[\"']ng-state[\"'][^>]*>(.*?)</script>"
# Up to the first quote with an even number of backslashes before it. Written without a
# repeated group around the text, so a long description needs no deep regex stack.
_LD_DESCRIPTION = r'(?s)"description"\s*:\s*"(.*?(?<!\\)(?:\\\\)*)"'
_LD_DATE = r'"datePosted"\s*:\s*"([^"]+)"'
STATE_TYPE = "struct<jobdetail:struct<stellenangebotsBeschreibung:string,berufserfahrung:string,qualifikationsniveau:string>>"


def ld_scripts(page: Column) -> Column:
    return F.regexp_extract_all(F.coalesce(page, F.lit("")), F.lit(_LD_SCRIPT), F.lit(1))


def _first(values: Column) -> Column:
    return F.coalesce(F.get(F.filter(values, lambda v: v != ""), 0), F.lit(""))


def jsonld_description(page: Column) -> Column:
    """First ``description`` string in any JSON-LD block, with its escapes resolved. Sites
    leave raw line breaks and stray backslashes in it, which are let through."""
    escaped = _first(F.transform(ld_scripts(page), lambda s: F.regexp_extract(s, _LD_DESCRIPTION, 1)))
    lenient = {"allowUnquotedControlChars": "true", "allowBackslashEscapingAnyCharacter": "true"}
    value = F.from_json(F.concat(F.lit('{"d":"'), escaped, F.lit('"}')), "d string", lenient)
    return F.coalesce(strip(value["d"]), F.lit(""))


def jsonld_posting_date(page: Column) -> Column:
    """First ``datePosted`` of an object or of an array's objects; a block that is not
    valid JSON is searched by pattern."""

    def from_script(script: Column) -> Column:
        block = strict_json(strip(script))
        items = F.when(
            F.schema_of_variant(block).startswith("ARRAY"),
            F.try_variant_get(block, "$", "array<variant>"),
        ).otherwise(F.array(block))
        dates = F.transform(
            items, lambda i: F.coalesce(F.try_variant_get(i, "$.datePosted", "string"), F.lit(""))
        )
        return F.when(block.isNull(), F.regexp_extract(script, _LD_DATE, 1)).otherwise(_first(dates))

    return strip(_first(F.transform(ld_scripts(page), from_script)))


def embedded_state(page: Column) -> Column:
    """``struct(description, experience)`` from the state script, null without a description."""
    script = unescape_html(F.regexp_extract(F.coalesce(page, F.lit("")), _STATE_SCRIPT, 1))
    detail = F.from_json(script, STATE_TYPE)["jobdetail"]
    description = strip(detail["stellenangebotsBeschreibung"])
    experience = F.coalesce(
        F.nullif(strip(detail["berufserfahrung"]), F.lit("")),
        strip(detail["qualifikationsniveau"]),
        F.lit(""),
    )
    return F.when(
        F.coalesce(description, F.lit("")) != "",
        F.struct(description.alias("description"), experience.alias("experience")),
    )
