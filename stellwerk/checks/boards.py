"""Queries over sources: captured pages and JSON payloads built from the tables.

Parts become listing cards, 25 to a page; documents become detail pages. What the extractor
gets back must be what went in.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from stellwerk import vocab
from stellwerk.checks.base import POSTINGS_SQL, collapse_sql, postings, query, spread, strip_sql, table
from stellwerk.functions import embedded, listing_api, page_fields
from stellwerk.operators import funnel
from stellwerk.session import new_run_dir
from stellwerk.sources import captures, files, registry

PER_PAGE = 25


def _text(*parts):
    return F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])


def _parts(spark, sf):
    """Parts with their place on a page; small ones have no title and are no usable card."""
    key = F.col("p_partkey")
    return table(spark, sf, "part").select(
        key.cast("string").alias("key"),
        F.when(F.col("p_type") == "SMALL", F.lit("")).otherwise(F.col("p_name")).alias("title"),
        F.col("p_brand").alias("company"),
        F.col("p_type").alias("place"),
        F.lpad((F.col("p_size") % 28 + 1).cast("string"), 2, "0").alias("day"),
        F.floor(key / PER_PAGE).cast("int").alias("page_no"),
        (key % PER_PAGE).cast("int").alias("pos"),
    )


PARTS_SQL = f"""parts AS (
  SELECT CAST(p_partkey AS VARCHAR) AS key, CASE WHEN p_type = 'SMALL' THEN '' ELSE p_name END AS title, p_brand AS company,
         p_type AS place, lpad(CAST(p_size % 28 + 1 AS VARCHAR), 2, '0') AS day,
         CAST(p_partkey // {PER_PAGE} AS INTEGER) AS page_no, CAST(p_partkey % {PER_PAGE} AS INTEGER) AS pos FROM part)"""


def _pages(parts, platform, card, before="<html><body>", after="</body></html>", separator=""):
    """One captured page per 25 parts, spread over the cluster as captured files would be."""
    cards = F.sort_array(F.collect_list(F.struct("pos", card.alias("card"))))
    tasks = parts.sparkSession.sparkContext.defaultParallelism
    return parts.groupBy("page_no").agg(cards.alias("cards")).repartition(tasks).select(
        F.lit(platform).alias("platform"),
        F.lit(0).alias("query_idx"),
        "page_no",
        F.lit("search").alias("kind"),
        _text(before, F.array_join(F.transform("cards", lambda c: c["card"]), separator), after).alias("body"),
        F.lit("2024-01-31 00:00:00").cast("timestamp").alias("observed_at"),
    )


def _cards(pages):
    parsed = captures.explode_cards(captures.parse_search_pages(pages, "www.stepstone.at"))
    return parsed.select("page_no", "card_pos", "title", "company", "location", "url", "posting_date")


def _cards_sql(location, url, date):
    return f"""WITH {PARTS_SQL}
    SELECT page_no, CAST(row_number() OVER (PARTITION BY page_no ORDER BY pos) - 1 AS INTEGER) AS card_pos,
           title, company, {location} AS location, {url} AS url, {date} AS posting_date
    FROM parts WHERE title <> ''"""


@query(
    "cards_linkedin",
    _cards_sql("place || ' & Co'", "'https://www.linkedin.com/jobs/view/' || key", "'2024-01-' || day"),
)
def cards_linkedin(spark, sf):
    card = _text(
        '<li><div class="base-card"><a class="base-card__full-link" href="https://de.linkedin.com/jobs/view/',
        F.col("key"), '?trk=1"></a><h3 class="x base-search-card__title">\n ', F.col("title"),
        '</h3><h4 class="base-search-card__subtitle">', F.col("company"),
        '</h4><span class="job-search-card__location">', F.col("place"),
        ' &amp;   Co</span><time datetime="2024-01-', F.col("day"), '">some days</time></div>',
    )
    pages = _pages(_parts(spark, sf), vocab.LINKEDIN, card, '<ul class="jobs-search__results-list">', "</ul>")
    return _cards(pages)


@query(
    "cards_stepstone",
    _cards_sql(
        "place", "'https://www.stepstone.at/stellenangebot/' || key || '?q=1'",
        "CASE WHEN place = 'LARGE' THEN 'vor ' || day || ' Tagen' ELSE '2024-01-' || day END",
    ),
)
def cards_stepstone(spark, sf):
    date = F.when(F.col("place") == "LARGE", _text('<time>vor ', F.col("day"), " Tagen</time>")).otherwise(
        _text('<time datetime="2024-01-', F.col("day"), '">x</time>')
    )
    card = _text(
        '<article class="res job-4"><h2 data-at="job-item-title">', F.col("title"),
        '</h2><a href="/stellenangebot/', F.col("key"), '?q=1">open</a><span class="my-company">',
        F.col("company"), '</span><div data-at="job-item-location">', F.col("place"), "</div>", date, "</article>",
    )
    return _cards(_pages(_parts(spark, sf), vocab.STEPSTONE, card))


@query(
    "cards_xing",
    _cards_sql(
        "CASE WHEN place = 'LARGE' THEN 'Germany' ELSE place END", "'https://www.xing.com/jobs/x-' || key",
        "CASE WHEN place = 'LARGE' THEN 'Vor ' || day || ' Stunden' ELSE '2024-01-' || day END",
    ),
)
def cards_xing(spark, sf):
    large = F.col("place") == "LARGE"
    where = F.when(large, _text("<span>Vor ", F.col("day"), " Stunden</span>")).otherwise(
        _text('<i class="job-location">', F.col("place"), '</i><time datetime="2024-01-', F.col("day"), '"></time>')
    )
    body = _text("<h2>", F.col("title"), '</h2><p>', F.col("company"), "</p>", where, "</li>")
    link = _text('<li><a href="/jobs/x-', F.col("key"), '?sc=1"></a>')
    # Every card comes twice, and a card that leads back to a search is mixed in.
    card = _text(link, body, link, body, '<li><a href="/jobs/search?k=1">more</a><h2>More</h2></li>')
    return _cards(_pages(_parts(spark, sf), vocab.XING, card, "<ul>", "</ul>"))


_REFNR = "key || '/ü-S'"
_BA_LOCATION = """CASE place WHEN 'LARGE' THEN 'Deutschland' WHEN 'PROMO' THEN 'Österreich'
  WHEN 'ECONOMY' THEN place || ', Deutschland' ELSE place || ', Österreich' END"""


def _payload(parts):
    """Listing payloads. The place varies from missing over city or country only to both."""
    place = F.col("place")
    city = F.when(place == "PROMO", F.lit(" ")).otherwise(place)
    country = F.when(place != "ECONOMY", F.lit("Österreich"))
    where = F.when(place != "LARGE", F.struct(city.alias("ort"), country.alias("land")))
    published = F.when(place != "MEDIUM", _text("2024-01-", F.col("day")))
    item = F.struct(
        _text(F.col("key"), "/ü-S ").alias("refnr"),
        F.col("title").alias("titel"),
        _text(" ", F.col("company")).alias("arbeitgeber"),
        published.alias("aktuelleVeroeffentlichungsdatum"),
        _text("2024-02-", F.col("day")).alias("eintrittsdatum"),
        where.alias("arbeitsort"),
    )
    # Items that are text already are joined into the payload's list.
    return _pages(parts, vocab.BA, F.to_json(item), '{"stellenangebote":[', '],"maxErgebnisse":99}', ",")


@query(
    "cards_ba",
    _cards_sql(
        _BA_LOCATION, f"'https://www.arbeitsagentur.de/jobsuche/jobdetail/' || url_encode({_REFNR})",
        "CASE WHEN place = 'MEDIUM' THEN '2024-02-' ELSE '2024-01-' END || day",
    ),
)
def cards_ba(spark, sf):
    return _cards(_payload(_parts(spark, sf)))


@query(
    "src_listing_json",
    f"""WITH {PARTS_SQL} SELECT page_no, pos, {_REFNR} || ' ' AS refnr, title AS titel, ' ' || company AS arbeitgeber,
      CASE WHEN place NOT IN ('LARGE', 'ECONOMY') THEN 'Österreich' END AS land FROM parts""",
)
def src_listing_json(spark, sf):
    items = F.posexplode(listing_api.payload_items(F.col("body"))).alias("pos", "item")
    rows = _payload(_parts(spark, sf)).select("page_no", items)
    return rows.select(
        "page_no", "pos", "item.refnr", "item.titel", "item.arbeitgeber", F.col("item.arbeitsort.land").alias("land")
    )


@query("src_pages", "SELECT page_id, url, html AS body FROM pages")
def src_pages(spark, sf):
    source = table(spark, sf, "pages").select(
        F.regexp_extract("url", r"https?://([^/]+)", 1).alias("platform"),
        F.lit(0).alias("query_idx"),
        F.col("page_id").cast("int").alias("page_no"),
        F.lit("detail").alias("kind"),
        "url",
        F.col("html").alias("body"),
        F.lit("2024-01-31 00:00:00").cast("timestamp").alias("observed_at"),
    )
    path = new_run_dir(spark, "captures")
    files.write_snapshot(source, path)
    return captures.read_captures(spark, path).select(F.col("page_no").cast("bigint").alias("page_id"), "url", "body")


# --- detail pages -------------------------------------------------------------------------


def _html(text):
    for char, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        text = F.replace(text, F.lit(char), F.lit(entity))
    return text


def _details(spark, sf, platform, body):
    docs = table(spark, sf, "documents")
    page = docs.select("doc_id", "text", "lang", body(F.col("text"), F.col("lang")).alias("body"))
    return page.withColumn("fields", page_fields.detail_of(F.lit(platform), F.col("body")))


@query(
    "detail_description",
    f"""SELECT doc_id, CASE lang WHEN 'fr' THEN '' ELSE {collapse_sql('text')} END AS stop_at_existing,
      CASE lang WHEN 'fr' THEN 'role' ELSE {collapse_sql('text')} END AS stop_at_text FROM documents""",
)
def detail_description(spark, sf):
    """A blank first element ends one board's search and not the other's."""

    def body(text, lang):
        inner = F.when(lang == "fr", F.lit(" <br> ")).otherwise(_html(text))
        return _text(
            "<head><title>t</title></head><main><style>p{}</style><section data-at='job-ad-content' class='job-description'>",
            inner, "</section><script>var x = '<p>';</script><div class='JobDescription'>role</div></main>",
        )

    rows = _details(spark, sf, vocab.STEPSTONE, body)
    other = page_fields.detail_of(F.lit(vocab.XING), F.col("body"))
    return rows.select(
        "doc_id", F.col("fields.description").alias("stop_at_existing"), other["description"].alias("stop_at_text")
    )


@query(
    "detail_experience",
    "SELECT doc_id, CASE lang WHEN 'de' THEN 'Berufserfahrung: ' || source WHEN 'en' THEN source ELSE '' END AS experience FROM documents",
)
def detail_experience(spark, sf):
    docs = spread(table(spark, sf, "documents"), "doc_id")
    source, lang = F.col("source"), F.col("lang")
    linkedin = _text(
        '<ul class="description__job-criteria-list"><li><h3>Employment</h3><span>no</span></li>'
        "<li><h3>Seniority  level</h3><span> ", source, "</span></li></ul>", _html(F.col("text")),
    )
    xing = _text("<main><p>", _html(F.col("text")), "</p><ul><li>x</li><li>Berufserfahrung: <b>", source, "</b></ul></main>")
    platform = F.when(lang == "en", F.lit(vocab.LINKEDIN)).when(lang == "de", F.lit(vocab.XING)).otherwise(F.lit(vocab.STEPSTONE))
    body = F.when(lang == "en", linkedin).when(lang == "de", xing).otherwise(_html(F.col("text")))
    fields = page_fields.detail_of(platform, body)
    return docs.select("doc_id", fields["experience"].alias("experience"))


_BROKEN = "<script type='application/ld+json'>{broken</script>"


def _ld_page(text, lang):
    date = F.when(lang == "es", F.lit("")).otherwise(_text(" 2024-01-", F.length("lang").cast("string")))
    block = F.to_json(F.struct(date.alias("datePosted"), text.alias("description")))
    shaped = (
        F.when(lang == "de", _text('["x", {"a": 1}, ', block, "]"))
        .when(lang == "fr", _text(block, " trailing"))
        .otherwise(block)
    )
    return _text("<html>", _BROKEN, '<script data-x="1" type="application/ld+json">\n', shaped, "\n</script></html>")


@query("jsonld_description", f"SELECT doc_id, {strip_sql('text')} AS description FROM documents")
def jsonld_description(spark, sf):
    docs = spread(table(spark, sf, "documents"), "doc_id")
    page = _ld_page(F.col("text"), F.col("lang"))
    return docs.select("doc_id", embedded.jsonld_description(page).alias("description"))


@query("jsonld_posting_date", "SELECT doc_id, CASE WHEN lang = 'es' THEN '' ELSE '2024-01-2' END AS posted FROM documents")
def jsonld_posting_date(spark, sf):
    docs = spread(table(spark, sf, "documents"), "doc_id")
    page = _ld_page(F.col("text"), F.col("lang"))
    return docs.select("doc_id", embedded.jsonld_posting_date(page).alias("posted"))


@query(
    "embedded_state",
    f"""SELECT doc_id, CASE WHEN lang = 'es' THEN NULL ELSE {strip_sql('text')} END AS description,
      CASE lang WHEN 'es' THEN NULL WHEN 'de' THEN source ELSE 'level' END AS experience FROM documents""",
)
def embedded_state(spark, sf):
    lang = F.col("lang")
    detail = F.struct(
        F.when(lang == "es", F.lit(" ")).otherwise(F.col("text")).alias("stellenangebotsBeschreibung"),
        F.when(lang == "de", F.col("source")).otherwise(F.lit("")).alias("berufserfahrung"),
        F.lit("level").alias("qualifikationsniveau"),
    )
    page = _text('<p></p><SCRIPT id="ng-state" type="x">', _html(F.to_json(F.struct(detail.alias("jobdetail")))), "</SCRIPT>")
    state = embedded.embedded_state(page)
    docs = spread(table(spark, sf, "documents"), "doc_id").withColumn("state", state)
    return docs.select("doc_id", "state.description", "state.experience")


def _detail_payload():
    lang, text = F.col("lang"), F.col("text")
    nested = F.struct(
        F.lit(" ").alias("stellenbeschreibung"), F.when(lang == "fr", text).alias("beschreibung")
    )
    detail = F.struct(
        F.when(lang == "en", text).otherwise(F.lit(" ")).alias("stellenbeschreibung"),
        F.when(lang == "de", text).alias("beschreibung"),
        F.when(lang == "de", F.col("source")).alias("berufserfahrung"),
        F.col("doc_id").alias("qualifikationsniveau"),
        nested.alias("stellenangebot"),
    )
    # Spanish payloads are unreadable.
    return F.when(lang == "es", _text("<html>", text)).otherwise(F.to_json(detail))


@query(
    "src_detail_json",
    """SELECT doc_id, CASE WHEN lang = 'en' THEN text WHEN lang = 'es' THEN NULL ELSE ' ' END AS stellenbeschreibung,
      CASE WHEN lang = 'de' THEN text END AS beschreibung, CASE WHEN lang = 'fr' THEN text END AS nested,
      CASE WHEN lang = 'es' THEN NULL ELSE CAST(doc_id AS VARCHAR) END AS qualifikationsniveau FROM documents""",
)
def src_detail_json(spark, sf):
    docs = table(spark, sf, "documents").withColumn("d", listing_api.read_detail(_detail_payload()))
    nested = F.col("d.stellenangebot.beschreibung").alias("nested")
    return docs.select("doc_id", "d.stellenbeschreibung", "d.beschreibung", nested, "d.qualifikationsniveau")


@query(
    "detail_ba",
    f"""SELECT doc_id, CASE WHEN lang = 'es' THEN '' ELSE {strip_sql('text')} END AS description,
      CASE lang WHEN 'es' THEN '' WHEN 'de' THEN source ELSE CAST(doc_id AS VARCHAR) END AS experience FROM documents""",
)
def detail_ba(spark, sf):
    docs = table(spark, sf, "documents").withColumn("f", listing_api.detail_fields(_detail_payload()))
    return docs.select("doc_id", "f.description", "f.experience")


@query(
    "detail_fallback",
    f"""SELECT doc_id, CASE WHEN lang IN ('es', 'fr') THEN 'page ' || item_id ELSE {strip_sql('text')} END AS description,
      CASE WHEN lang IN ('es', 'fr') THEN 'public' WHEN lang = 'de' THEN source ELSE CAST(doc_id AS VARCHAR) END AS experience
    FROM (SELECT d.*, b.item_id FROM (SELECT *, CASE WHEN lang = 'fr' THEN '' ELSE 'x' END AS m FROM documents) d
          LEFT JOIN benchmark b ON d.doc_id = b.item_id)
    WHERE item_id IS NOT NULL OR lang NOT IN ('es', 'fr')
    UNION ALL
    SELECT doc_id, NULL, NULL FROM documents LEFT JOIN benchmark ON doc_id = item_id WHERE item_id IS NULL AND lang IN ('es', 'fr')""",
)
def detail_fallback(spark, sf):
    """The benchmark items stand in for the public pages of some documents."""
    payload = F.when(F.col("lang") != "fr", _detail_payload())
    docs = table(spark, sf, "documents").withColumn("primary", listing_api.detail_fields(payload))
    public = F.struct(
        _text("page ", F.col("item_id").cast("string")).alias("description"), F.lit("public").alias("experience")
    )
    pages = table(spark, sf, "benchmark").select("item_id", public.alias("secondary"))
    joined = docs.join(pages, docs.doc_id == pages.item_id, "left")
    chosen = listing_api.prefer_described(F.col("primary"), F.col("secondary"))
    return joined.select("doc_id", chosen.alias("c")).select("doc_id", "c.description", "c.experience")


# --- the given web pages as they are --------------------------------------------------------

_NAV_BOARD = {
    "site": {
        "card": ["nav li"],
        "title": [("h2", None), ("a", None)],
        "company": [("[class*='company']", None)],
        "location": [("li:has-text('x')", None)],
        "href": [("a[href*='/']", "href")],
        "posted": [("time", "datetime")],
    }
}
_SITE_BOARD = {"site": {"stop": "exists", "description": ["main", "article"], "experience": ["article > h1"]}}

_NAV_SQL = """SELECT page_id, CAST(generate_subscripts(hits, 1) - 1 AS INTEGER) AS pos, unnest(hits) AS hit
  FROM (SELECT page_id, regexp_extract_all(regexp_extract(html, '(?s)<nav>(.*?)</nav>', 1), '<li>.*?</li>') AS hits FROM pages)"""


def _nav_cards(spark, sf):
    cards = page_fields.cards_of(F.lit("site"), F.col("html"), _NAV_BOARD)
    rows = table(spark, sf, "pages").select("page_id", F.posexplode(cards).alias("pos", "card"))
    return rows.select("page_id", "pos", "card.title", F.col("card.href").alias("url"))


@query(
    "cards_html",
    f"""SELECT page_id, pos, {collapse_sql("regexp_extract(hit, '>([^<]*)</a>', 1)")} AS title,
      regexp_extract(hit, 'href="([^"]*)"', 1) AS url FROM ({_NAV_SQL})""",
)
def cards_html(spark, sf):
    return _nav_cards(spark, sf)


@query(
    "first_url_in_page",
    f"""SELECT page_id, min(pos) AS pos, regexp_extract(hit, 'href="([^"]*)"', 1) AS url FROM ({_NAV_SQL}) GROUP BY ALL""",
)
def first_url_in_page(spark, sf):
    return funnel.first_url_in_page(_nav_cards(spark, sf), ["page_id"], ["pos"]).drop("title")


# Some headings end in an entity cut short of its semicolon; HTML reads "&amp" as "&" too.
_UNESCAPED = "regexp_replace(replace(replace(regexp_replace({}, '<[^>]*>', '', 'g'), '&quot;', '\"'), '&copy;', '©'), '&amp;?', '&', 'g')"
_ARTICLE_SQL = (
    "regexp_replace(regexp_extract(html, '(?s)<article>(.*?)(?:</article>|$)', 1), '</?(?:h1|p|br)>', chr(2), 'g')"
)


_DETAIL_HTML_SQL = f"""SELECT page_id, {collapse_sql(_UNESCAPED.format("regexp_extract(html, '(?s)<h1>(.*?)</h1>', 1)"))} AS heading,
      array_to_string(list_filter(list_transform(string_split({_UNESCAPED.format(_ARTICLE_SQL)}, chr(2)),
        lambda x: {collapse_sql('x')}), lambda x: x <> ''), chr(10)) AS description
    FROM pages"""


def _site_details(pages):
    rows = pages.select("page_id", page_fields.detail_of(F.lit("site"), F.col("html"), _SITE_BOARD).alias("f"))
    return rows.select("page_id", F.col("f.experience").alias("heading"), "f.description")


@query("detail_html", _DETAIL_HTML_SQL)
def detail_html(spark, sf):
    return _site_details(table(spark, sf, "pages"))


@query("detail_html_broken", _DETAIL_HTML_SQL)
def detail_html_broken(spark, sf):
    """Every page with declarations that are none: they are comments and change nothing."""
    broken = F.concat(F.lit("<![foo[y]]><![ x><!ELEMENT y>"), F.col("html"))
    return _site_details(table(spark, sf, "pages").withColumn("html", broken))


# --- snapshots and sources ----------------------------------------------------------------


@query("snapshot_read", f"WITH {POSTINGS_SQL} SELECT job_id, title, url, platform, query_idx FROM postings")
def snapshot_read(spark, sf):
    path = new_run_dir(spark, "snapshot")
    files.write_snapshot(postings(spark, sf), path)
    ddl = "job_id string, title string, url string, platform string, query_idx int"
    return files.read_snapshot(spark, path, ddl)


@query(
    "source_registry",
    f"WITH {POSTINGS_SQL} SELECT doc_id, platform, CASE platform WHEN 'LinkedIn' THEN 0 WHEN 'StepStone' THEN 1 ELSE 3 END AS platform_rank FROM postings WHERE platform <> 'Xing'",
)
def source_registry(spark, sf):
    """Of four sources one fails while it runs; the others are whole and keep their ranks."""

    def board(name):
        return lambda session: postings(session, sf).filter(F.col("platform") == name).select("doc_id", "platform")

    def failing(session):
        return board(vocab.XING)(session).withColumn("platform", F.raise_error(F.lit("page did not load")).cast("string"))

    sources = {
        "linkedin": board(vocab.LINKEDIN), "stepstone": board(vocab.STEPSTONE), "xing": failing, "ba": board(vocab.BA)
    }
    done = registry.materialise_sources(spark, sources, new_run_dir(spark, "sources"))
    return registry.union_platforms(done)
