"""The agency board's JSON payloads, read with built-in JSON functions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from stellwerk import schema, vocab
from stellwerk.functions.text import first_filled, strip
from stellwerk.functions.urls import detail_url


def payload_items(payload: Column) -> Column:
    """Listing items; an unreadable payload or a missing list counts as empty."""
    items = F.from_json(payload, schema.LISTING_PAYLOAD)["stellenangebote"]
    return F.coalesce(items, F.array().cast(f"array<{schema.LISTING_ITEM}>"))


def item_location(place: Column) -> Column:
    """"city, country"; only a missing or empty country takes the default."""
    city = F.coalesce(strip(place["ort"]), F.lit(""))
    country = strip(F.coalesce(F.nullif(place["land"], F.lit("")), F.lit(vocab.BA_DEFAULT_LAND)))
    joined = F.array_join(F.filter(F.array(city, country), lambda part: part != ""), ", ")
    return F.coalesce(F.nullif(joined, F.lit("")), F.lit(vocab.BA_DEFAULT_LAND))


def item_card(item: Column) -> Column:
    refnr = first_filled(item["refnr"])
    return F.struct(
        first_filled(item["titel"]).alias("title"),
        first_filled(item["arbeitgeber"]).alias("company"),
        item_location(item["arbeitsort"]).alias("location"),
        F.when(refnr != "", detail_url(refnr)).otherwise(F.lit("")).alias("url"),
        first_filled(item["aktuelleVeroeffentlichungsdatum"], item["eintrittsdatum"]).alias("posting_date"),
        refnr.alias("refnr"),
    )


def payload_cards(payload: Column) -> Column:
    """Cards of a payload that have a title and a reference number."""
    return F.filter(
        F.transform(payload_items(payload), item_card),
        lambda card: (card["title"] != "") & (card["refnr"] != ""),
    )


def read_detail(payload: Column) -> Column:
    """The detail payload as a struct of nulls when it is missing or unreadable."""
    return F.from_json(payload, schema.DETAIL_PAYLOAD)


def detail_fields(payload: Column) -> Column:
    """``struct(description, experience)`` with the payload's own order of preference."""
    detail = read_detail(payload)
    nested = detail["stellenangebot"]
    return F.struct(
        first_filled(
            detail["stellenbeschreibung"],
            detail["beschreibung"],
            nested["stellenbeschreibung"],
            nested["beschreibung"],
        ).alias("description"),
        first_filled(detail["berufserfahrung"], detail["qualifikationsniveau"]).alias("experience"),
    )


def prefer_described(primary: Column, secondary: Column) -> Column:
    """The primary fields, or all of the secondary ones when the primary lacks a description."""
    lacks = F.coalesce(primary["description"], F.lit("")) == ""
    return F.when(lacks, secondary).otherwise(primary)
