"""Captured search and detail pages in, listing cards and detail fields out."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from stellwerk import schema, vocab
from stellwerk.functions import embedded, listing_api, page_fields
from stellwerk.functions.predicates import is_search_link
from stellwerk.functions.text import is_blank, platform_rank
from stellwerk.functions.urls import canonical_url
from stellwerk.session import new_run_dir
from stellwerk.sources.files import materialise

PAGE_KEYS = ["platform", "query_idx", "page_no"]


def read_captures(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(schema.CAPTURES).parquet(path)


def usable_cards(raw: Column, platform: Column, domain: Column) -> Column:
    """Cards as listings: canonical link, default place; only those with a title and a
    link, and on Xing none that leads back to a search."""
    default_location = F.lit("")
    for name, place in vocab.DEFAULT_LOCATION.items():
        default_location = F.when(platform == name, F.lit(place)).otherwise(default_location)

    def listing(card: Column) -> Column:
        location = F.coalesce(F.nullif(card["location"], F.lit("")), default_location)
        return F.struct(
            card["title"].alias("title"),
            card["company"].alias("company"),
            location.alias("location"),
            canonical_url(platform, card["href"], domain).alias("url"),
            card["posted"].alias("posting_date"),
            F.lit("").alias("refnr"),
        )

    def usable(card: Column) -> Column:
        back_to_search = (platform == vocab.XING) & is_search_link(card["url"])
        return (card["title"] != "") & (card["url"] != "") & ~back_to_search

    return F.filter(F.transform(raw, listing), usable)


def html_cards(
    pages: DataFrame, stepstone_domain: str, boards: dict = vocab.CARD_SELECTORS
) -> DataFrame:
    """Add ``cards`` to HTML search pages. Each step is a column of its own, so that later
    steps read it and do not repeat it."""
    platform = F.col("platform")
    raw = pages.withColumn("raw", page_fields.cards_of(platform, F.col("body"), boards))
    raw = raw.withColumn("unreadable", F.col("raw").isNull()).withColumn("raw", F.coalesce("raw", F.array()))
    usable = raw.withColumn("usable", usable_cards(F.col("raw"), platform, F.lit(stepstone_domain)))
    links = usable.withColumn("links", F.transform("usable", lambda card: card["url"]))
    # One board shows a posting's card several times on a page: the first one per link stays.
    first_per_link = F.transform(
        F.array_distinct("links"),
        lambda link: F.element_at("usable", F.array_position("links", link).cast("int")),
    )
    once = F.when(platform == vocab.XING, first_per_link).otherwise(F.col("usable"))
    return links.withColumn("cards", once).drop("raw", "usable", "links")


def parse_search_pages(captures: DataFrame, stepstone_domain: str | None = None) -> DataFrame:
    """One row per search page: its usable cards, how many there were to begin with, whether
    paging ends with it, and whether it could not be read at all.

    The agency's JSON pages never reach Python. A page that can't be read has no cards, but
    doesn't end its query's paging.
    """
    pages = captures.filter(F.col("kind") == "search")
    body, platform = F.col("body"), F.col("platform")
    agency = listing_api.payload_items(body)
    keep = [*PAGE_KEYS, "observed_at"]
    from_json = pages.filter(platform == vocab.BA).select(
        *keep,
        listing_api.payload_cards(body).alias("cards"),
        F.size(agency).alias("listed"),
        (F.size(agency) < vocab.BA_PAGE_SIZE).alias("is_last"),
        F.lit(False).alias("unreadable"),
    )
    from_html = html_cards(pages.filter(platform != vocab.BA), stepstone_domain or "www.stepstone.de").select(
        *keep,
        "cards",
        F.size("cards").alias("listed"),
        ((F.size("cards") == 0) & ~F.col("unreadable")).alias("is_last"),
        "unreadable",
    )
    return from_html.unionByName(from_json)


def explode_cards(pages: DataFrame) -> DataFrame:
    """One row per card, carrying the acquisition order of boards, queries, pages, cards."""
    cards = pages.select(
        *PAGE_KEYS, "observed_at", F.posexplode("cards").alias("card_pos", "card")
    )
    return cards.select(
        *PAGE_KEYS,
        "card_pos",
        platform_rank(F.col("platform")).alias("platform_rank"),
        "observed_at",
        "card.*",
    )


# Places of chosen captures that are sent to tasks at once; more are fetched in several rounds of files.
MOST_PLACES = 1_000_000


def with_place(captures: DataFrame) -> DataFrame | None:
    """Add ``_file`` and ``_row``, where a capture stands, unless it has them; None if its rows have no place in files."""
    if {"_file", "_row"} <= set(captures.columns):
        return captures
    try:
        return captures.select("*", F.col("_metadata.file_path").alias("_file"), F.col("_metadata.row_index").alias("_row"))
    except AnalysisException:
        return None


def stacked(captures: DataFrame, others: DataFrame) -> DataFrame:
    """Both tables' rows, with their places in files where both have them."""
    first, second = with_place(captures), with_place(others.drop("_file", "_row"))
    if first is None or second is None:
        first, second = captures, others
    return first.unionByName(second.select(first.columns))


def latest_details(
    captures: DataFrame, kind: str, wanted: DataFrame | None = None, most_places: int = MOST_PLACES
) -> DataFrame:
    """The latest capture of every detail page, of the wanted (platform, url) pairs if given.

    Captures in files are chosen by time on narrow columns, without their bodies; then the rows at the chosen places
    are read, which sends places to the scans and no body anywhere. Rounds of files keep what is sent within
    ``most_places``, unless one file alone has more. Among captures of the same time a hash of the body decides; only
    the bodies of such captures are exchanged. A capture without a time comes before all others, and a null body may be the chosen one.
    """
    pages = captures.filter(F.col("kind") == kind)
    placed = with_place(pages)
    if placed is None:
        return _latest_by_join(pages, wanted)
    keys = ["platform", "url"]
    narrow = placed.select(*keys, "observed_at", "_file", "_row")
    if wanted is not None:
        narrow = narrow.join(wanted.select(*keys).distinct(), keys, "left_semi")
    times = narrow.groupBy(*(F.col(c).alias(f"_{c}") for c in keys), "observed_at").agg(F.count("*").alias("_times"))
    newest = times.groupBy(*(f"_{c}" for c in keys)).agg(F.max(F.struct("observed_at", "_times")).alias("_newest"))
    same = [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in keys] + [F.col("observed_at").eqNullSafe(F.col("_newest.observed_at"))]
    path = new_run_dir(captures.sparkSession, "places")
    chosen = materialise(narrow.join(newest, same).select(narrow["*"], "_newest._times"), path)
    # One row per file that holds a chosen capture.
    counts = chosen.groupBy("_file").count().orderBy("_file").collect()
    rounds, held = [[]], 0
    for file, count in counts:
        if rounds[-1] and held + count > most_places:
            rounds.append([])
            held = 0
        rounds[-1].append(file)
        held += count

    def fetched(files: list[str]) -> DataFrame:
        places = F.broadcast(chosen.filter(F.col("_file").isin(files)))
        bodies = placed.filter(F.col("_file").isin(files)).select("_file", "_row", "body")
        return bodies.join(places, ["_file", "_row"]).select(*keys, "observed_at", "body", "_times")

    if len(rounds) == 1:
        rows = fetched(rounds[0])
    else:
        for number, files in enumerate(rounds):
            fetched(files).write.parquet(f"{path}-rows/round={number}")
        rows = captures.sparkSession.read.parquet(f"{path}-rows")
    digested = F.max(F.struct(F.xxhash64("body").alias("digest"), "body"))["body"]
    once, several = rows.filter("_times = 1").select(*keys, "observed_at", "body"), rows.filter("_times > 1")
    return several.groupBy(*keys, "observed_at").agg(digested.alias("body")).unionByName(once)


def _latest_by_join(pages: DataFrame, wanted: DataFrame | None) -> DataFrame:
    """For captures that stand in no files. Bodies of the chosen ones are found by a hash join whose small side are
    the keys, so that no body is sorted."""
    keys = ["platform", "url"]
    marked = pages.select(*keys, "observed_at", "body").withColumn("digest", F.xxhash64("body"))
    chosen = marked.groupBy(*keys).agg(F.max(F.struct("observed_at", "digest")).alias("c")).select(*keys, "c.*")
    if wanted is not None:
        chosen = chosen.join(wanted.select(*keys).distinct(), keys)
    parts = [*keys, "observed_at", "digest"]
    same = chosen.select(*(F.col(c).alias(f"chosen_{c}") for c in parts)).hint("shuffle_hash")
    on = [F.col(c).eqNullSafe(F.col(f"chosen_{c}")) for c in parts]
    # The same capture kept several times: all have one body.
    found = marked.join(same, on, "left_semi")
    return found.groupBy(*keys, "observed_at").agg(F.array_min(F.collect_set("body")).alias("body"))


def parse_details(captures: DataFrame, wanted: DataFrame | None = None) -> DataFrame:
    """Detail fields per (platform, url).

    The agency's public page stands in, as a whole, where its API gave no description.
    """
    platform, body = F.col("platform"), F.col("body")
    html = latest_details(captures.filter(platform != vocab.BA), "detail", wanted).select(
        "platform",
        "url",
        page_fields.detail_of(platform, body).alias("fields"),
        F.when(platform == vocab.XING, embedded.jsonld_description(body)).alias("ld_description"),
        F.when(platform == vocab.XING, embedded.jsonld_posting_date(body)).alias("detail_date"),
    )
    board = html.select(
        "platform",
        "url",
        F.when(is_blank(F.col("fields.description")), F.coalesce("ld_description", F.lit("")))
        .otherwise(F.col("fields.description"))
        .alias("description"),
        F.col("fields.experience").alias("experience_level"),
        F.coalesce("detail_date", F.lit("")).alias("detail_date"),
    )
    agency = captures.filter(platform == vocab.BA)
    api = latest_details(agency, "detail", wanted).select(
        "platform", "url", listing_api.detail_fields(body).alias("primary")
    )
    public = latest_details(agency, "detail_public", wanted).select(
        "platform", "url", embedded.embedded_state(body).alias("secondary")
    )
    chosen = listing_api.prefer_described(F.col("primary"), F.col("secondary"))
    joined = api.join(public, ["platform", "url"], "full").select("platform", "url", chosen.alias("d"))
    return board.unionByName(
        joined.select(
            "platform",
            "url",
            F.coalesce("d.description", F.lit("")).alias("description"),
            F.coalesce("d.experience", F.lit("")).alias("experience_level"),
            F.lit("").alias("detail_date"),
        )
    )
