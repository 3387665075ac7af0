"""Edge rows of the column functions."""

import hashlib
import urllib.parse

import pytest
from pyspark.sql import functions as F

from stellwerk import vocab
from stellwerk.functions import embedded, predicates, prompts, replies, text, urls


def test_strip_knows_every_whitespace_character(evaluate):
    looks_blank = "\u200b\u180e\ufeff\u2060\xad"
    texts = [f"{c}x{c}y{c}" for c in text.WHITESPACE + looks_blank]
    assert evaluate(lambda T: text.strip(T), texts) == [t.strip() for t in texts]


def test_collapse_knows_every_whitespace_character(evaluate):
    looks_blank = "\u200b\u180e\ufeff\u2060\xad"
    texts = [f"{c}x{c}{c}y \n{c}z" for c in text.WHITESPACE + looks_blank] + [None]
    assert evaluate(lambda T: text.collapse(T), texts) == [" ".join(t.split()) if t is not None else None for t in texts]


@pytest.mark.parametrize("title", ["Data Engineer", "\tDATA Engineer\xa0", "İngenieur", "ΟΔΟΣ", "Größe ẞ", ""])
def test_job_id_is_the_hash_of_folded_fields(evaluate, title):
    folded = f"{title.lower().strip()}|acme|berlin"
    got = evaluate(lambda T: text.job_id(T, F.lit(" ACME"), F.lit("Berlin ")), [title])
    assert got == [hashlib.sha256(folded.encode()).hexdigest()]


def test_job_id_depends_on_the_spelling_of_the_place(evaluate):
    ids = evaluate(lambda T: text.job_id(F.lit("a"), F.lit("b"), T), ["Berlin", "Berlin, Deutschland", None, ""])
    assert len(set(ids)) == 3 and ids[2] == ids[3]


def test_summary(evaluate):
    short, enough = "x" * 19 + ".", "x" * 20 + "."
    six = " ".join(f"This is sentence number {n}." for n in range(6))
    long = "a" * 699 + "."
    over = "b" * 700 + "."
    cases = {
        None: vocab.NO_DESCRIPTION,
        "": vocab.NO_DESCRIPTION,
        " \n\t ": vocab.NO_DESCRIPTION,
        short: vocab.NO_DESCRIPTION,
        f"{short} {enough}": enough,
        six: six[: six.index(" This is sentence number 5")],
        "no sentence end in this text": "no sentence end in this text",
        "line one goes on\n\n and on\x1d and on!  Next one is here as well?": (
            "line one goes on and on and on! Next one is here as well?"
        ),
        long: long,
        over: "b" * 697 + "…",
    }
    assert evaluate(lambda T: text.summary(T), list(cases)) == list(cases.values())


def test_prompt_truncate(evaluate):
    note = vocab.TRUNCATION_NOTE
    cases = {
        "a" * 8000: "a" * 8000,
        "a" * 8001: "a" * 8000 + note,
        "a." + "b" * 8000: "a." + note,
        "." + "b\n" * 8000: "." + note,
        "b" * 7999 + "!" + "c": "b" * 7999 + "!" + note,
        "b" * 8000 + "?": "b" * 8000 + note,
        "a. b? c! " + "d" * 8000: "a. b? c!" + note,
        "ü" * 7000 + "." + "ü" * 7000: "ü" * 7000 + "." + note,
    }
    assert evaluate(lambda T: text.prompt_truncate(T), list(cases)) == list(cases.values())


def test_percent_encoding_is_the_path_encoding(evaluate):
    texts = ["C++ Entwickler", "a/b~c*d", "10001-12&=?#", "ü€", "a b+c%"]
    assert evaluate(lambda T: urls.percent_encode(T), texts) == [urllib.parse.quote(t) for t in texts]
    kept = evaluate(lambda T: urls.percent_encode(T, keep_slash=False), texts)
    assert kept == [urllib.parse.quote(t, safe="") for t in texts]


def test_canonical_urls(evaluate):
    def on(board):
        return lambda T: urls.canonical_url(F.lit(board), T, F.lit("www.stepstone.nl"))

    assert evaluate(on(vocab.LINKEDIN), [
        "https://de.linkedin.com/jobs/view/1?x=2", "http://fr.linkedin.com/a", "https://www.linkedin.com/b#c",
        "https://uk2.linkedin.com/d", "", None,
    ]) == [
        "https://www.linkedin.com/jobs/view/1", "https://www.linkedin.com/a", "https://www.linkedin.com/b#c",
        "https://uk2.linkedin.com/d", "", "",
    ]
    assert evaluate(on(vocab.XING), ["/jobs/a?b=1", "https://www.xing.com/jobs/c#d", ""]) == [
        "https://www.xing.com/jobs/a", "https://www.xing.com/jobs/c#d", "",
    ]
    assert evaluate(on(vocab.STEPSTONE), ["/job/1?a=b", "https://x.de/job/2", ""]) == [
        "https://www.stepstone.nl/job/1?a=b", "https://x.de/job/2", "",
    ]


def test_search_urls(evaluate):
    def on(board, domain="", route="", path="", country="Germany", page=2):
        return lambda T: urls.search_url(
            F.lit(board), T, F.lit(page), F.lit(country), F.lit(domain), F.lit(route), F.lit(path)
        )

    query = ["C++  Entwickler"]
    assert evaluate(on(vocab.LINKEDIN, country="United Kingdom"), query) == [
        "https://www.linkedin.com/jobs/search/?keywords=C%2B%2B%20%20Entwickler&location=United%20Kingdom"
        "&f_E=2%2C3&f_TPR=r86400&start=25"
    ]
    assert evaluate(on(vocab.STEPSTONE, "www.stepstone.nl", "vacatures", "in-nederland"), query) == [
        "https://www.stepstone.nl/vacatures/C%2B%2B-Entwickler/in-nederland?sort=2&datePosted=1&page=2"
    ]
    assert evaluate(on(vocab.XING), query) == [
        "https://www.xing.com/jobs/search?keywords=C%2B%2B%20%20Entwickler&location=Germany&page=2"
    ]
    assert evaluate(on(vocab.BA), ["a b~*"]) == [
        "https://rest.arbeitsagentur.de/jobboerse/jobsuche-service/pc/v4/jobs?was=a+b~%2A"
        "&wo=Deutschland&angebotsart=1&veroeffentlichtseit=1&page=2&size=25"
    ]


def test_title_rules(evaluate):
    cases = {
        "Buchhalter": (False, "blocked"),
        "Softwareentwickler Fahrerassistenz": (False, "blocked"),
        "Microcontroller Engineer": (False, "blocked"),
        "Nurse": (True, "ambiguous"),
        "Nurse (m/f)": (False, "blocked"),
        "Marketing Manager DACH": (False, "blocked"),
        "Research Intern": (True, "ambiguous"),
        "Senior Cloud Infrastructure Engineer": (True, "broad+signal"),
        "Autonomy Stack Engineer (m/f/d)": (True, "keyword"),
        "": (True, "ambiguous"),
        None: (True, "ambiguous"),
    }
    relevant = evaluate(lambda T: predicates.title_relevant(T), list(cases))
    tags = evaluate(lambda T: predicates.title_tag(T), list(cases))
    assert list(zip(relevant, tags)) == list(cases.values())
    rescued = lambda T: predicates.title_relevant(T, accept_first=vocab.TITLE_KEYWORDS)
    assert evaluate(rescued, ["Softwareentwickler Fahrerassistenz", "Buchhalter"]) == [True, False]


def test_locations(evaluate):
    germany = {
        "Berlin, Deutschland": True, "Remote – DE": False, "Rio de Janeiro": True, "Hessen": True,
        "MÜNCHEN": True, "": False, None: False, "Hybrid": False,
    }
    assert evaluate(lambda T: predicates.location_germany(T), list(germany)) == list(germany.values())
    assert evaluate(lambda T: predicates.location_target(T, "GERMANY"), list(germany)) == list(germany.values())
    austria = {
        "Vienna, Austria": True, "Sydney, Australia": False, "Hybrid": True, "": True, "　": True,
        "AUSTRIA": True, "Österaustria": False, "Berlin": False, None: True,
    }
    assert evaluate(lambda T: predicates.location_target(T, "Austria"), list(austria)) == list(austria.values())
    kingdom = {"London, United-Kingdom": True, "United  Kingdom": True, "UnitedKingdom": False, "Kingdom": False}
    assert evaluate(lambda T: predicates.location_target(T, " United Kingdom"), list(kingdom)) == list(kingdom.values())
    by_row = lambda T: predicates.location_target(F.lit("Wien (A.B)"), T)
    assert evaluate(by_row, ["A.B", "A.C", "wien"]) == [True, False, True]


def test_freshness(evaluate):
    cases = {
        "2024-01-13T12:00:00Z": (True, "dated"),
        "2024-01-13T11:59:59": (False, "dated"),
        "2024-01-13t13:30:00+0200": (False, "dated"),
        "2024-01-13T13:00:00+01:00": (True, "dated"),
        "2024-1-14": (True, "dated"),
        "2024-01-13": (False, "dated"),
        " 14.1.2024\n": (True, "dated"),
        "15 Jan 2024": (True, "dated"),
        "15  jan\t2024": (True, "dated"),
        "jan 5, 2024": (False, "dated"),
        "31.2.2024": (True, "unknown"),
        "2024-01-01T08:00:00.000Z": (True, "unknown"),
        "2024-01-01T08:00:00z": (True, "unknown"),
        "2024-01-01T24:00:00": (True, "unknown"),
        "vor 2 Tagen": (True, "relative"),
        "3 days ago": (False, "relative"),
        "30+ days ago": (True, "unknown"),
        "": (True, "blank"),
        " \t": (True, "blank"),
        None: (True, "blank"),
    }
    as_of = F.lit("2024-01-15 12:00:00").cast("timestamp")
    fresh = evaluate(lambda T: predicates.posting_fresh(T, as_of), list(cases))
    status = evaluate(lambda T: predicates.age_status(T), list(cases))
    assert dict(zip(cases, zip(fresh, status))) == cases


def test_freshness_does_not_depend_on_the_session_zone(spark, evaluate):
    zone = spark.conf.get("spark.sql.session.timeZone")
    texts = ["2024-01-13T12:00:00", "2024-01-13", "13.1.2024", "13 Jan 2024", "Jan 13, 2024", "2024-01-13T12:00:00Z"]
    try:
        seconds = []
        for name in ("UTC", "Asia/Tokyo"):
            spark.conf.set("spark.sql.session.timeZone", name)
            seconds.append(evaluate(lambda T: F.unix_seconds(predicates.posted_at(T)), texts))
    finally:
        spark.conf.set("spark.sql.session.timeZone", zone)
    assert seconds[0] == seconds[1] and None not in seconds[0]


def test_relative_age(evaluate):
    cases = {
        "heute": 0, " Today ": 0, "heute, 08:00": None, "Just  posted": 0, "gerade eben": 0, "vor 3 Stunden": 3,
        "5 min": 0, "12 hours ago": 12, "8 Std.": 8, "2 days ago": 48, "vor 3 Tagen": 72, "1 Tag": 24, "1 Woche": 168,
        "2 weeks": 336, "30+ days ago": None, "vor 1 Monat": None, "yesterday": None, "9" * 30 + " days": None, "2000000000000000 Stunden": 2 * 10**15,
        None: None,
    }
    assert evaluate(lambda T: predicates.relative_age_hours(T), list(cases)) == list(cases.values())


def test_run_blocking_quota(evaluate):
    cases = {"Limit: Tokens per Day": True, "TPD": True, "free-models-per-day": True, "tokens per minute": False, None: False}
    assert evaluate(lambda T: predicates.run_blocking_quota(T), list(cases)) == list(cases.values())


FAILED = (None, None)


REPLIES = [
    ('{"score": 8, "reason": " good "}', (8, "good")),
    ('```json\n{"score": 8, "reason": "x"}\n```', (8, "x")),
    ('```\r\n{"score": 8,\r\n"reason": "x"}\r\n```', (8, "x")),
    ('```{"score": 8}\n```', (8, "")),
    ('Sure! {"score": 8, "reason": "a {b} c"} Bye.', (8, "a {b} c")),
    ('```json\nSure {"score": 4}\n```', (4, "")),
    ('{"score": 8} trailing', (8, "")),
    ('{"score": 8}}', FAILED),
    ('{"score": 8} {"score": 9}', FAILED),
    ('{"score": 8}, "w": 1', (8, "")),
    ('{"score": 8}]', (8, "")),
    ("", FAILED),
    (None, FAILED),
    ("   ", FAILED),
    ("[]", FAILED),
    ('[{"score": 8}]', FAILED),
    ("8", FAILED),
    ("null", FAILED),
    ("no json", FAILED),
    ("} {", FAILED),
    ("{}", (1, "")),
    ('{"score": 0}', (1, "")),
    ('{"score": 11}', (10, "")),
    ('{"score": -3}', (1, "")),
    ('{"score": 7.9}', (7, "")),
    ('{"score": 6.999}', (6, "")),
    ('{"score": 1e3}', (10, "")),
    ('{"score": 99999999999999999999999}', (10, "")),
    ('{"score": "8"}', (8, "")),
    ('{"score": " +0_8 "}', (8, "")),
    ('{"score": "7.5"}', FAILED),
    ('{"score": "high"}', FAILED),
    ('{"score": true}', (1, "")),
    ('{"score": null}', FAILED),
    ('{"score": [8]}', FAILED),
    ('{"score": {"a": 8}}', FAILED),
    ('{"reason": "r"}', (1, "r")),
    ('{"score": 7, "reason": null}', (7, "None")),
    ('{"score": 7, "reason": true}', (7, "True")),
    ('{"score": 7, "reason": 5}', (7, "5")),
    ('{"score": 7, "reason": "\\u00fcber\\n"}', (7, "über")),
]


def test_reading_replies(spark):
    rows = spark.createDataFrame([(n, raw) for n, (raw, _) in enumerate(REPLIES)], "n int, raw string")
    for row in replies.with_verdict(rows).collect():
        verdict = row.verdict
        got = (verdict.score, verdict.reason) if verdict else FAILED
        assert (row.raw, got) == REPLIES[row.n]
        assert verdict is None or verdict.match == (verdict.score >= 7)


def test_profile_is_retargeted_literally(evaluate):
    profile = ["I am based in Germany.\nfull-time permanent roles in Germany"]
    got = evaluate(lambda T: prompts.retarget_profile(T, "A$1\\B"), profile)
    assert got == ["I am based in A$1\\B.\nfull-time permanent roles in A$1\\B"]


def test_system_prompt_holds_profile_and_braces(evaluate):
    prompt = evaluate(lambda T: prompts.system_prompt(T, "Austria"), ["{profile} 100%"])[0]
    assert "CANDIDATE PROFILE:\n{profile} 100%\n\nYOUR TASK" in prompt
    assert '{\n  "score": <integer 1–10>' in prompt and "clearly tied to Austria" in prompt


def test_posting_message_defaults(spark):
    none = [F.lit(None).cast("string")] * 6
    message = spark.range(1).select(prompts.posting_message(*none)).first()[0]
    assert message == (
        "Job Title: N/A\nCompany: N/A\nLocation: N/A\nPlatform: N/A\n"
        "Experience Level (from job board): N/A\n\nJob Description:\nNo description available."
    )


def test_json_ld(evaluate):
    def page(*scripts):
        return "".join(f'<script type="application/ld+json">{s}</script>' for s in scripts)

    quotes = "\\\\" * 3
    cases = {
        page('{"description": "a \\"b\\" ü \\u00fc"}'): 'a "b" ü ü',
        page("{}", '{"x": {"description" : " deep "}}'): "deep",
        page(f'{{"description": "ends {quotes}", "b": "c"}}'): "ends " + "\\" * 3,
        page('{"description": "' + "line\\n" * 20000 + '"}'): ("line\n" * 20000).strip(),
        page('{"description": "raw\nbreak\tand \\d"}'): "raw\nbreak\tand d",
        page('{"title": "x"}'): "",
        "": "",
        None: "",
    }
    assert evaluate(lambda T: embedded.jsonld_description(T), list(cases)) == list(cases.values())
    dates = {
        page('{"datePosted": " 2024-01-01 "}'): "2024-01-01",
        page('[1, {"a": 2}, {"datePosted": ""}, {"datePosted": "2024-01-02"}]'): "2024-01-02",
        page('{broken "datePosted": "2024-01-03"'): "2024-01-03",
        page('{"a": {"datePosted": "2024-01-04"}}'): "",
        page('{"a": 1}', '{"datePosted": "2024-01-05"}'): "2024-01-05",
        None: "",
    }
    assert evaluate(lambda T: embedded.jsonld_posting_date(T), list(dates)) == list(dates.values())


def test_embedded_state(evaluate):
    def page(body):
        return f"<script id='ng-state' type='x'>{body}</script>"

    fields = embedded.embedded_state
    described = '{&quot;jobdetail&quot;: {"stellenangebotsBeschreibung": " a &amp; b ", "qualifikationsniveau": "x"}}'
    got = evaluate(fields, [page(described), page('{"jobdetail": {"stellenangebotsBeschreibung": " "}}'), page("{"), "", None])
    assert tuple(got[0]) == ("a & b", "x") and got[1:] == [None] * 4
