"""Captured pages and payloads to cards, details and postings."""

import datetime
import gc
import json

import pytest
from pyspark.sql import functions as F

from stellwerk import schema, vocab
from stellwerk.functions import listing_api, page_fields
from stellwerk.functions.page_fields import page_cards, page_detail
from stellwerk.plans import daily_run
from stellwerk.sources import captures

LINKEDIN_PAGE = """
<ul class="a jobs-search__results-list">
<li><div class="base-card"><a class="base-card__full-link" href="https://de.linkedin.com/jobs/view/1?x=2">go</a>
  <h3 class="base-search-card__title">
     Data  Engineer &amp; more </h3><h4 class="base-search-card__subtitle"><a>ACME</a></h4>
  <span class="job-search-card__location">Berlin</span><time datetime="2024-01-31">1 day</time></div>
<li><h3 class="base-search-card__title">No link</h3></li>
<li><a class="base-card__full-link" href="/x"></a><p>No title
</ul>"""


def test_linkedin_cards():
    cards = page_cards(LINKEDIN_PAGE, vocab.CARD_SELECTORS[vocab.LINKEDIN])
    assert len(cards) == 3
    assert cards[0] == {
        "title": "Data Engineer & more", "company": "ACME", "location": "Berlin",
        "href": "https://de.linkedin.com/jobs/view/1?x=2", "posted": "2024-01-31",
    }
    fallback = LINKEDIN_PAGE.replace("jobs-search__results-list", "other")
    assert [c["title"] for c in page_cards(fallback, vocab.CARD_SELECTORS[vocab.LINKEDIN])] == ["Data Engineer & more"]


def test_stepstone_cards_fall_back_level_by_level():
    inner = '<a href="/x/stellenangebot/1"><h2 data-at="job-item-title">T</h2></a><div data-at="job-item-date">heute</div>'
    board = vocab.CARD_SELECTORS[vocab.STEPSTONE]
    for page in (
        f'<article data-at="job-item">{inner}</article><article class="job-x"></article>',
        f'<article class="my-job-x">{inner}</article><li class="ResultList"></li>',
        f'<ol><li class="aResultListb">{inner}</li></ol>',
    ):
        assert page_cards(page, board) == [
            {"title": "T", "company": "", "location": "", "href": "/x/stellenangebot/1", "posted": "heute"}
        ]
    assert page_cards("<div>nothing</div>", board) == []
    assert page_cards(None, board) == []


def test_xing_card_fields_take_the_first_text():
    page = """<article><a href="/jobs/a-1?x"><span data-testid="job-title-x"> </span><h2>Engineer</h2></a>
      <div class="the-company"></div><p>Firm</p><span>Remote, <b>Deutschland</b></span><time>vor 2 Tagen</time></article>
      <div data-testid="a-job-card-b"><a href="/jobs/b">B</a><span>Vor 3 Stunden</span></div>"""
    assert page_cards(page, vocab.CARD_SELECTORS[vocab.XING]) == [
        {"title": "Engineer", "company": "Firm", "location": "Remote, Deutschland", "href": "/jobs/a-1?x", "posted": "vor 2 Tagen"},
        {"title": "B", "company": "", "location": "", "href": "/jobs/b", "posted": "Vor 3 Stunden"},
    ]


@pytest.mark.parametrize(
    "board, page, expected",
    [
        (vocab.LINKEDIN, "<div class='show-more-less-html__markup'>a<p>b</div>", ("a\nb", "")),
        (vocab.LINKEDIN, "<div class='description__text'> </div><div id='job-details'>x</div>", ("", "")),
        (vocab.XING, "<div class='job-description'> </div><main>x<br>y</main>", ("x\ny", "")),
        (vocab.XING, "<li>Berufserfahrung: 2 Jahre<li>other<span>Junior</span>", ("", "Berufserfahrung: 2 Jahre")),
        (vocab.STEPSTONE, "<div class='xjobAdBodyy'>t</div><span class='experience'> </span><li>Experience 1</li>", ("t", "")),
        (
            vocab.LINKEDIN,
            "<ul class='description__job-criteria-list'><li><h3>Berufserfahrung</h3></li>"
            "<li><h3>SENIORITY level</h3><span>Entry</span></li></ul>",
            ("", "Entry"),
        ),
    ],
)
def test_detail_fields(board, page, expected):
    fields = page_detail(page, vocab.DETAIL_SELECTORS[board])
    assert (fields["description"], fields["experience"]) == expected


def test_deeply_nested_page_is_read():
    page = "<main>" + "<div><b>" * 5000 + "deep" + "</b></div>" * 5000 + "</main>"
    assert page_detail(page, vocab.DETAIL_SELECTORS[vocab.XING])["description"] == "deep"


def test_agency_items(spark):
    def item(**fields):
        return {"refnr": "1", "titel": "T", "arbeitgeber": "A", **fields}

    items = [
        item(),
        item(arbeitsort={"ort": " ", "land": "Österreich"}),
        item(arbeitsort={"ort": "Wien", "land": None}),
        item(arbeitsort={"ort": "Wien", "land": " "}),
        item(arbeitsort={"ort": "Wien", "land": "Österreich"}, aktuelleVeroeffentlichungsdatum="2024-01-01"),
        item(eintrittsdatum="2024-02-01", aktuelleVeroeffentlichungsdatum=None),
        item(refnr=" "),
        item(titel=None),
    ]
    payload = json.dumps({"stellenangebote": items, "maxErgebnisse": 9})
    cards = spark.createDataFrame([(payload,)], "body string").select(listing_api.payload_cards(F.col("body")).alias("c")).first().c
    assert [(c.location, c.posting_date) for c in cards] == [
        ("Deutschland", ""), ("Österreich", ""), ("Wien, Deutschland", ""), ("Wien", ""),
        ("Wien, Österreich", "2024-01-01"), ("Deutschland", "2024-02-01"),
    ]
    empty = spark.createDataFrame([("{}",), ("no json",), (None,), ('{"stellenangebote": null}',)], "body string")
    assert {r.n for r in empty.select(F.size(listing_api.payload_items(F.col("body"))).alias("n")).collect()} == {0}


def test_agency_detail_levels(spark):
    cases = {
        '{"stellenbeschreibung": " a ", "beschreibung": "b", "berufserfahrung": "x"}': ("a", "x"),
        '{"stellenbeschreibung": " ", "beschreibung": "b", "qualifikationsniveau": 3}': ("b", "3"),
        '{"stellenangebot": {"stellenbeschreibung": "c"}}': ("c", ""),
        '{"stellenangebot": {"stellenbeschreibung": "", "beschreibung": "d"}}': ("d", ""),
        '{"stellenangebot": {}}': ("", ""),
        "broken": ("", ""),
    }
    rows = spark.createDataFrame([(k,) for k in cases], "p string")
    got = {r.p: tuple(r.f) for r in rows.select("p", listing_api.detail_fields(F.col("p")).alias("f")).collect()}
    assert got == cases


NOW = datetime.datetime(2024, 1, 31, 12)


def _search(platform, page_no, body, query_idx=0):
    return (platform, query_idx, page_no, "search", "", body, NOW)


def _detail(platform, url, body, kind="detail"):
    return (platform, None, None, kind, url, body, NOW)


def _agency(*items):
    return json.dumps({"stellenangebote": list(items)})


def test_acquire_small_run(spark, tmp_path):
    """One run over all boards: paging, funnel, cap, detail rules, identity."""
    base = vocab.BA_DETAIL_PREFIX

    def job(n, **more):
        return {"refnr": f"r{n}", "titel": f"Engineer {n}", "arbeitgeber": "A", "aktuelleVeroeffentlichungsdatum": "heute", **more}

    rows = [
        _search(vocab.LINKEDIN, 1, LINKEDIN_PAGE.replace("2024-01-31", "vor 1 Tag")),
        _search(vocab.LINKEDIN, 2, "<ul></ul>"),
        _search(vocab.LINKEDIN, 3, LINKEDIN_PAGE),
        _detail(vocab.LINKEDIN, "https://www.linkedin.com/jobs/view/1", "<div id='job-details'>Build things all day long.</div>"),
        # the same posting again under another query of the board
        _search(vocab.LINKEDIN, 1, LINKEDIN_PAGE.replace("view/1", "view/9"), query_idx=1),
        # Xing: no date on the card; the detail page has an old one for b
        _search(vocab.XING, 1, "<article><a href='/jobs/a'>A</a></article><article><a href='/jobs/b'>B</a></article>"
                "<article><a href='/jobs/a'>A again</a></article><article><a href='/jobs/search?x'>S</a></article>"),
        _detail(vocab.XING, "https://www.xing.com/jobs/a", "<main>text of a</main><script type='application/ld+json'>{\"datePosted\": \"2024-01-31\"}</script>"),
        _detail(vocab.XING, "https://www.xing.com/jobs/b", "<main>text of b</main><script type='application/ld+json'>{\"datePosted\": \"2023-01-31\"}</script>"),
        # the agency: fewer than 25 items end the paging; 2 and 3 need other sources
        _search(vocab.BA, 1, _agency(job(1), job(2), job(3), job(4, titel="Buchhalter"), job(5, aktuelleVeroeffentlichungsdatum="5 days ago"))),
        _search(vocab.BA, 2, _agency(job(6))),
        _detail(vocab.BA, base + "r1", '{"beschreibung": "one", "berufserfahrung": "junior"}'),
        _detail(vocab.BA, base + "r2", '{"berufserfahrung": "dropped"}'),
        _detail(vocab.BA, base + "r2", "<script id='ng-state'>{\"jobdetail\": {\"stellenangebotsBeschreibung\": \"two\"}}</script>", "detail_public"),
        _detail(vocab.BA, base + "r6", '{"beschreibung": "six"}'),
    ]
    frame = spark.createDataFrame(rows, schema.CAPTURES)
    found = daily_run.acquire(frame, str(tmp_path), pages_per_query=9).collect()
    got = {(r.platform, r.title, r.description, r.experience_level, r.posting_date) for r in found}
    assert got == {
        (vocab.LINKEDIN, "Data Engineer & more", "Build things all day long.", "", "vor 1 Tag"),
        (vocab.XING, "A", "text of a", "", "2024-01-31"),
        (vocab.BA, "Engineer 1", "one", "junior", "heute"),
        (vocab.BA, "Engineer 2", "two", "", "heute"),
    }
    assert {r.summary for r in found if r.platform == vocab.LINKEDIN} == {"Build things all day long."}


def test_first_occurrences_are_found_without_descriptions(spark, tmp_path, monkeypatch):
    items = [{"refnr": str(n), "titel": f"Engineer {n % 3}"} for n in range(25)]
    rows = [_search(vocab.BA, 1, _agency(*items))]
    # The first of a title's postings has no detail page, so the next one stays.
    texts = {n: json.dumps({"beschreibung": f"long text {n} " * 50, "berufserfahrung": str(n)}) for n in range(3, 25)}
    rows += [_detail(vocab.BA, vocab.BA_DETAIL_PREFIX + str(n), text) for n, text in texts.items()]
    seen, choose = [], daily_run.identity.first_per_platform
    monkeypatch.setattr(daily_run.identity, "first_per_platform", lambda df: (seen.append(df), choose(df))[1])
    found = daily_run.acquire(spark.createDataFrame(rows, schema.CAPTURES), str(tmp_path)).collect()
    assert {(r.title, r.description, r.experience_level) for r in found} == {(f"Engineer {n % 3}", ("long text %d " % n * 50).strip(), str(n)) for n in (3, 4, 5)}
    assert max(len(r.description) for r in seen[0].select("description").collect()) < 20


def test_cap_counts_rows_that_are_dropped_later(spark, tmp_path):
    items = [{"refnr": str(n), "titel": f"Engineer {n}"} for n in range(25)]
    rows = [_search(vocab.BA, 1, _agency(*items)), _search(vocab.BA, 2, _agency(*items))]
    rows += [_detail(vocab.BA, f"{vocab.BA_DETAIL_PREFIX}{n}", '{"beschreibung": "x"}') for n in range(10, 25)]
    found = daily_run.acquire(spark.createDataFrame(rows, schema.CAPTURES), str(tmp_path), details_per_query=20).collect()
    assert sorted(int(r.title.split()[1]) for r in found) == list(range(10, 20))


def test_missing_detail_keeps_the_posting_on_most_boards(spark, tmp_path):
    rows = [_search(vocab.LINKEDIN, 1, LINKEDIN_PAGE)]
    found = daily_run.acquire(spark.createDataFrame(rows, schema.CAPTURES), str(tmp_path)).collect()
    assert [(r.description, r.summary) for r in found] == [("", vocab.NO_DESCRIPTION)]


def test_latest_capture_of_a_detail_page_counts(spark):
    page = "<div id='job-details'>{}</div>"
    older, newer = datetime.datetime(2024, 1, 1), datetime.datetime(2024, 1, 2)
    rows = [
        (vocab.LINKEDIN, None, None, "detail", "u", page.format("old"), older),
        (vocab.LINKEDIN, None, None, "detail", "u", page.format("new"), newer),
    ]
    details = captures.parse_details(spark.createDataFrame(rows, schema.CAPTURES)).collect()
    assert [d.description for d in details] == ["new"]


def test_a_broken_declaration_is_a_comment():
    from stellwerk.functions import page_fields

    board = {"description": ["main"], "experience": ["h1"], "stop": "text"}
    for broken in ("<![foo[y]]>", "<![ foo>", "<!ELEMENT x>", "<![CDATA[ x ]]>", "<![if IE]>"):
        assert page_fields.page_detail(f"{broken}<h1>a</h1><main>b</main>", board) == {"description": "b", "experience": "a"}
    assert page_fields.page_detail("<h1>a</h1><main>b</main><![ foo", board)["experience"] == "a"


def test_selectors_are_linear_in_nested_pages():
    import time

    from stellwerk.functions import page_fields

    page = "<div>" * 8000 + "<a href='/jobs/1'>x</a><h2>Title</h2>" + "</div>" * 8000
    board = {
        "card": ["section", "div:has(a[href*='/jobs/']):has-text('title')"],
        "title": [("h2", None)], "company": [("article span", None)], "location": [("div > p", None)],
        "href": [("a[href*='/jobs/']", "href")], "posted": [("time", "datetime")],
    }
    started = time.process_time()
    cards = page_fields.page_cards(page, board)
    assert len(cards) == 8000 and cards[0]["title"] == cards[-1]["title"] == "Title" and cards[7]["href"] == "/jobs/1"
    assert time.process_time() - started < 2


def test_words_are_found_inside_an_element_only():
    from stellwerk.functions import page_fields

    tree = page_fields._PageTree("<p>Full <b>Ti</b>me <i>job</i></p><p>time</p><script>full time</script><p> job </p>").root
    found = lambda selector: [e.tag for e in page_fields.select(tree, selector)]
    assert found("p:has-text('full time')") == ["p"] and found("p:has-text('time job')") == ["p"]
    assert found("i:has-text('job')") == ["i"] and found("b:has-text('time')") == [] and found("script:has-text('full')") == []
    assert len(found("p:has-text('time')")) == 2 and len(found("p:has-text('job')")) == 2


def test_batches_of_a_session_with_defaults_are_bounded(spark):
    keys = {"spark.sql.execution.arrow.maxRecordsPerBatch": "500", "spark.sql.execution.arrow.maxBytesPerBatch": "2m"}
    before = {key: spark.conf.get(key) for key in keys}
    try:
        for build in (page_fields.detail_of, page_fields.cards_of, lambda _, page: page_fields.unescape_html(page)):
            for key in keys:
                spark.conf.unset(key)
            spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "10000")
            spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", "67108864b")
            build(F.lit("x"), F.lit("y"))
            assert {key: spark.conf.get(key) for key in keys} == keys
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "77")
        page_fields.unescape_html(F.lit("y"))
        assert spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == "77"
    finally:
        for key, value in before.items():
            spark.conf.set(key, value)


def test_a_read_page_leaves_nothing_to_the_collector():
    board = vocab.DETAIL_SELECTORS[vocab.XING]
    page = "<main><p>a<b>c</b></p><ul><li>x</li><li>Berufserfahrung: y</li></ul></main>"
    gc.collect()
    gc.disable()
    try:
        read = page_fields.page_detail(page, board)
        page_fields.page_cards(page, vocab.CARD_SELECTORS[vocab.XING])
        left = [o for o in gc.get_objects() if isinstance(o, page_fields._Element)]
    finally:
        gc.enable()
    assert read["description"].startswith("a") and not left
