"""Queries over column functions: text, links, tests, prompts, replies."""

from __future__ import annotations

from pyspark.sql import functions as F

from stellwerk import vocab
from stellwerk.checks.base import (
    POSTINGS_SQL,
    SCORED_SQL,
    any_of_sql,
    collapse_sql,
    postings,
    query,
    quoted,
    scored_postings,
    spread,
    strip_sql,
    table,
)
from stellwerk.functions import predicates, prompts, replies, text, urls
from stellwerk.operators import digest, funnel, scoring

# --- identity, summary, prompt ------------------------------------------------------------


@query("job_id", f"WITH {POSTINGS_SQL} SELECT doc_id, job_id FROM postings")
def job_id(spark, sf):
    return postings(spark, sf).select("doc_id", "job_id")


SUMMARY_SQL = f"""
WITH pieces AS (
  SELECT doc_id, list_filter(string_split(regexp_replace({collapse_sql('text')}, '([.!?]) ', '\\1' || chr(1), 'g'), chr(1)),
                             lambda x: length(x) > 20) AS kept
  FROM documents),
joined AS (SELECT doc_id, array_to_string(kept[1:5], ' ') AS s FROM pieces)
SELECT doc_id, CASE WHEN s = '' THEN 'No description available.'
                    WHEN length(s) > 700 THEN left(s, 697) || '…' ELSE s END AS summary
FROM joined"""


@query("summary", SUMMARY_SQL)
def summary(spark, sf):
    return table(spark, sf, "documents").select("doc_id", text.summary(F.col("text")).alias("summary"))


TRUNCATE_SQL = """CASE WHEN length(text) <= 8000 THEN text
  WHEN regexp_extract(left(text, 8000), '(?s)^(.*[.!?])', 1) = '' THEN left(text, 8000) || chr(10) || '[description truncated]'
  ELSE regexp_extract(left(text, 8000), '(?s)^(.*[.!?])', 1) || chr(10) || '[description truncated]' END"""


@query("prompt_truncate", f"SELECT doc_id, {TRUNCATE_SQL} AS prompt FROM documents")
def prompt_truncate(spark, sf):
    docs = table(spark, sf, "documents")
    return docs.select("doc_id", text.prompt_truncate(F.col("text")).alias("prompt"))


MESSAGE_SQL = f"""concat_ws(chr(10), 'Job Title: ' || title, 'Company: ' || company, 'Location: ' || location,
  'Platform: ' || platform, 'Experience Level (from job board): ' || coalesce(nullif(experience_level, ''), 'N/A'),
  '', 'Job Description:', {TRUNCATE_SQL.replace('text', 'description')})"""


@query("prompt_build", f"WITH {POSTINGS_SQL} SELECT doc_id, {MESSAGE_SQL.replace('[description truncated]', '[description truncated]')} AS message FROM postings")
def prompt_build(spark, sf):
    return scoring.with_message(postings(spark, sf)).select("doc_id", "message")


# The profile's lines that are rewritten, and what they become.
_PROFILE_LINES = (
    "\nGermany only. Remote positions are acceptable if the employer is clearly a German company or the "
    "role is contractually based in Germany.\nLooking for full-time permanent positions in Germany, "
    "full-time permanent roles in Germany, teams based in Germany.\n"
    "Germany only. Remote positions are acceptable if the employer is clearly a German company\n"
    "(German address, German job board, or German language in posting).\n"
    "Roles outside Germany unless remote for a confirmed German employer\n"
    "Roles outside Germany (unless remote for a confirmed German employer)"
)
# The same rewrites, as replacements of fixed text.
_PROFILE_SQL = f"text || {quoted(_PROFILE_LINES)}"
for _found, _wanted in [
    (
        "Germany only. Remote positions are acceptable if the employer is clearly a German company or the role is contractually based in Germany.",
        "@ only. Remote positions are acceptable if the employer is clearly tied to @ or the role is contractually based in @.",
    ),
    ("based in Germany", "based in @"),
    ("full-time permanent positions in Germany", "full-time permanent positions in @"),
    ("full-time permanent roles in Germany", "full-time permanent roles in @"),
    (
        "Germany only. Remote positions are acceptable if the employer is clearly a German company\n(German address, German job board, or German language in posting).",
        "@ only. Remote positions are acceptable if the employer is clearly tied to @.",
    ),
    (
        "Roles outside Germany unless remote for a confirmed German employer",
        "Roles outside @ unless remote for a confirmed @ employer",
    ),
    (
        "Roles outside Germany (unless remote for a confirmed German employer)",
        "Roles outside @ (unless remote for a confirmed @ employer)",
    ),
]:
    _replacement = quoted(_wanted).replace("@", "' || country || '")
    _PROFILE_SQL = f"replace({_PROFILE_SQL}, {quoted(_found)}, {_replacement})"

_COUNTRY_SQL = "SELECT doc_id, text, r_name || ' $1\\' AS country FROM documents JOIN region ON doc_id % 5 = r_regionkey"


def _profiles(spark, sf):
    regions = table(spark, sf, "region")
    docs = table(spark, sf, "documents")
    return docs.join(regions, (docs.doc_id % 5) == regions.r_regionkey).select(
        "doc_id", "text", F.concat("r_name", F.lit(" $1\\")).alias("country")
    )


@query("profile_retarget", f"SELECT doc_id, country, {_PROFILE_SQL} AS profile FROM ({_COUNTRY_SQL})")
def profile_retarget(spark, sf):
    profile = F.concat("text", F.lit(_PROFILE_LINES))
    return _profiles(spark, sf).select(
        "doc_id", "country", prompts.retarget_profile(profile, F.col("country")).alias("profile")
    )


def _template_sql(profile: str, country: str) -> str:
    filled = vocab.SYSTEM_PROMPT.replace("{{", "{").replace("}}", "}")
    return quoted(filled).replace("{profile}", f"' || {profile} || '").replace("{country}", f"' || {country} || '")


@query("system_prompt", f"SELECT doc_id, {_template_sql('text', 'country')} AS system_prompt FROM ({_COUNTRY_SQL})")
def system_prompt(spark, sf):
    prompt = prompts.system_prompt(F.col("text"), F.col("country"))
    return _profiles(spark, sf).select("doc_id", prompt.alias("system_prompt"))


_SHORT_SYSTEM = 'Rate the "posting".'
_MODELS = ["primary", "", "spare", "primary"]


@query(
    "request_build",
    f"""WITH {POSTINGS_SQL}, m AS (SELECT UNNEST(['primary', 'spare']) AS model, UNNEST([0, 1]) AS model_rank),
    messages AS (SELECT job_id, {MESSAGE_SQL} AS message FROM postings)
    SELECT job_id, model_rank, model, CAST(json_object('model', model,
        'messages', json_array(json_object('role', 'system', 'content', {quoted(_SHORT_SYSTEM)}),
                               json_object('role', 'user', 'content', message)),
        'response_format', json_object('type', 'json_object'), 'max_tokens', 800, 'temperature', CAST(0.1 AS DOUBLE)) AS VARCHAR) AS request
    FROM messages, m""",
)
def request_build(spark, sf):
    return scoring.request_table(postings(spark, sf), F.lit(_SHORT_SYSTEM), _MODELS)


# --- links --------------------------------------------------------------------------------

_LANG = r'<html lang="([a-z]+)"'


@query(
    "url_canonical",
    f"""WITH p AS (SELECT page_id, url, regexp_extract(html, '{_LANG}', 1) AS lang FROM pages)
    SELECT page_id, regexp_replace(split_part(url, '?', 1), '^https?://(?:m|blog)\\.', 'https://www.') AS folded,
      CASE lang WHEN 'en' THEN 'https://www.linkedin.com/jobs/view/' || page_id
                WHEN 'de' THEN 'https://www.xing.com/jobs/x-' || page_id
                WHEN 'fr' THEN 'https://www.stepstone.at/stellenangebot/' || page_id || '?u=' || url
                ELSE split_part(url, '?', 1) END AS canonical
    FROM p""",
)
def url_canonical(spark, sf):
    lang, url = F.col("lang"), F.col("url")
    page = F.col("page_id").cast("string")
    href = (
        F.when(lang == "en", F.concat(F.lit("http://fr.linkedin.com/jobs/view/"), page, F.lit("?u="), url))
        .when(lang == "de", F.concat(F.lit("/jobs/x-"), page, F.lit("?u="), url))
        .when(lang == "fr", F.concat(F.lit("/stellenangebot/"), page, F.lit("?u="), url))
        .otherwise(url)
    )
    platform = (
        F.when(lang == "en", F.lit(vocab.LINKEDIN)).when(lang == "fr", F.lit(vocab.STEPSTONE)).otherwise(F.lit(vocab.XING))
    )
    pages = table(spark, sf, "pages").withColumn("lang", F.regexp_extract("html", _LANG, 1))
    return pages.select(
        "page_id",
        urls.fold_subdomain(urls.without_query(url), r"^https?://(?:m|blog)\.", "https://www.").alias("folded"),
        urls.canonical_url(platform, href, F.lit("www.stepstone.at")).alias("canonical"),
    )


@query(
    "detail_url",
    "SELECT p_partkey, 'https://www.arbeitsagentur.de/jobsuche/jobdetail/' || url_encode(p_name || '/~*+' || p_brand || 'ü' || p_partkey) AS url FROM part",
)
def detail_url(spark, sf):
    refnr = F.concat("p_name", F.lit("/~*+"), "p_brand", F.lit("ü"), F.col("p_partkey").cast("string"))
    return table(spark, sf, "part").select("p_partkey", urls.detail_url(refnr).alias("url"))


# --- tests of the funnel ------------------------------------------------------------------

_PART_BLOCKS = ["ring", "bolt"]


@query(
    "title_relevant",
    f"""SELECT p_partkey, NOT {any_of_sql('lower(p_name)', _PART_BLOCKS)} AS relevant,
      {any_of_sql('lower(p_name)', ['red'])} OR NOT {any_of_sql('lower(p_name)', _PART_BLOCKS)} AS relevant_accept_first FROM part""",
)
def title_relevant(spark, sf):
    name = F.col("p_name")
    return table(spark, sf, "part").select(
        "p_partkey",
        predicates.title_relevant(name, _PART_BLOCKS).alias("relevant"),
        predicates.title_relevant(name, _PART_BLOCKS, accept_first=["red"]).alias("relevant_accept_first"),
    )


_ROLES = [
    "Buchhalter", "Microcontroller Engineer", "Data Engineer", "Cloud Architect", "Research Intern",
    "Softwareentwickler Fahrerassistenz", "Nurse (m/f)", "Nurse", "Steuerrecht Analyst", "GPU Specialist",
]
_ROLE_SQL = f"p_name || ' ' || list_extract([{', '.join(quoted(r) for r in _ROLES)}], CAST(p_partkey % 10 + 1 AS INTEGER))"


def _tag_sql(expr):
    return f"""CASE WHEN {any_of_sql(expr, vocab.TITLE_BLOCKS)} THEN 'blocked'
      WHEN {any_of_sql(expr, vocab.TITLE_KEYWORDS)} THEN 'keyword'
      WHEN {any_of_sql(expr, vocab.TITLE_BROAD_TERMS)} AND {any_of_sql(expr, vocab.TITLE_SIGNALS)} THEN 'broad+signal'
      ELSE 'ambiguous' END"""


@query("title_tag", f"SELECT p_partkey, title, {_tag_sql('lower(title)')} AS tag FROM (SELECT p_partkey, {_ROLE_SQL} AS title FROM part)")
def title_tag(spark, sf):
    role = F.element_at(F.array(*[F.lit(r) for r in _ROLES]), (F.col("p_partkey") % 10 + 1).cast("int"))
    titles = table(spark, sf, "part").select("p_partkey", F.concat_ws(" ", "p_name", role).alias("title"))
    return titles.withColumn("tag", predicates.title_tag(F.col("title")))


_PLACES = ["Berlin, Deutschland", "Remote – DE", "Rio de Janeiro", "", "Hessen", "MÜNCHEN", "Wien"]
_PLACE_SQL = f"list_extract([{', '.join(quoted(p) for p in _PLACES)}], CAST(c_custkey % 7 + 1 AS INTEGER))"


@query(
    "location_germany",
    f"SELECT c_custkey, place, {any_of_sql('lower(place)', vocab.GERMANY_KEYWORDS)} AS in_germany FROM (SELECT c_custkey, {_PLACE_SQL} AS place FROM customer)",
)
def location_germany(spark, sf):
    place = F.element_at(F.array(*[F.lit(p) for p in _PLACES]), (F.col("c_custkey") % 7 + 1).cast("int"))
    rows = table(spark, sf, "customer").select("c_custkey", place.alias("place"))
    return rows.withColumn("in_germany", predicates.location_germany(F.col("place")))


@query(
    "location_target",
    f"""WITH c AS (
      SELECT c_custkey, CASE c_mktsegment WHEN 'FURNITURE' THEN 'Hybrid' WHEN 'MACHINERY' THEN '  '
               WHEN 'BUILDING' THEN 'near ' || n_name || ', ' || replace(r_name, ' ', '-')
               ELSE n_name || '0 ' || r_name || 'X' END AS place,
             CASE WHEN n_nationkey % 5 = 0 THEN 'GERMANY' WHEN n_nationkey % 5 = 1 THEN r_name ELSE n_name END AS country
      FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey)
    SELECT c_custkey, place, country,
      CASE WHEN country = 'GERMANY' THEN {any_of_sql('lower(place)', vocab.GERMANY_KEYWORDS)}
           ELSE regexp_matches(lower(place), '\\b' || replace(lower(country), ' ', '\\W+') || '\\b')
                OR contains(lower(place), 'remote') OR contains(lower(place), 'hybrid') OR trim(place) = '' END AS in_target
    FROM c""",
)
def location_target(spark, sf):
    nations = table(spark, sf, "nation").join(
        table(spark, sf, "region"), F.col("n_regionkey") == F.col("r_regionkey")
    )
    segment, nation = F.col("c_mktsegment"), F.col("n_name")
    place = (
        F.when(segment == "FURNITURE", F.lit("Hybrid"))
        .when(segment == "MACHINERY", F.lit("  "))
        .when(segment == "BUILDING", F.concat(F.lit("near "), nation, F.lit(", "), F.replace("r_name", F.lit(" "), F.lit("-"))))
        .otherwise(F.concat(nation, F.lit("0 "), "r_name", F.lit("X")))
    )
    kind = F.col("n_nationkey") % 5
    country = F.when(kind == 0, F.lit("GERMANY")).when(kind == 1, F.col("r_name")).otherwise(nation)
    rows = table(spark, sf, "customer").join(nations, F.col("c_nationkey") == F.col("n_nationkey"))
    rows = rows.select("c_custkey", place.alias("place"), country.alias("country"))
    return rows.withColumn("in_target", predicates.location_target(F.col("place"), F.col("country")))


_DATE_HOURS = 24 * 365
_DATE_SQL = """
WITH d AS (
  SELECT o_orderkey, CAST(o_orderkey % 8 AS INTEGER) AS kind, o_orderdate AS d FROM orders),
t AS (
  SELECT o_orderkey, kind,
    CASE kind WHEN 0 THEN strftime(d, '%Y-%m-%dT%H:%M:%S') || '+0530' WHEN 1 THEN strftime(d, '%Y-%m-%dT%H:%M:%S')
      WHEN 2 THEN strftime(d, '%Y-%m-%d') WHEN 3 THEN strftime(d, '%-d.%-m.%Y') WHEN 4 THEN strftime(d, '%d %b %Y')
      WHEN 5 THEN lower(strftime(d, '%b %-d, %Y')) WHEN 6 THEN strftime(d, '%Y-%m-%dT%H:%M:%S') || '.000Z'
      ELSE '  ' END AS posted,
    CASE kind WHEN 0 THEN d - INTERVAL 330 MINUTE ELSE d END AS instant
  FROM d)
SELECT o_orderkey, posted,
  CASE WHEN kind = 6 THEN 'unknown' WHEN kind = 7 THEN 'blank' ELSE 'dated' END AS status,
  kind >= 6 OR instant >= TIMESTAMP '1999-06-15 12:00:00' - INTERVAL 8760 HOUR AS fresh
FROM t"""


@query("posting_fresh", _DATE_SQL)
def posting_fresh(spark, sf):
    day, kind = F.col("o_orderdate"), F.col("o_orderkey") % 8
    iso = F.date_format(day, "yyyy-MM-dd'T'HH:mm:ss")
    posted = (
        F.when(kind == 0, F.concat(iso, F.lit("+0530")))
        .when(kind == 1, iso)
        .when(kind == 2, F.date_format(day, "yyyy-MM-dd"))
        .when(kind == 3, F.date_format(day, "d.M.yyyy"))
        .when(kind == 4, F.date_format(day, "dd MMM yyyy"))
        .when(kind == 5, F.lower(F.date_format(day, "MMM d, yyyy")))
        .when(kind == 6, F.concat(iso, F.lit(".000Z")))
        .otherwise(F.lit("  "))
    )
    as_of = F.lit("1999-06-15 12:00:00").cast("timestamp")
    rows = table(spark, sf, "orders").select("o_orderkey", posted.alias("posted"))
    return rows.select(
        "o_orderkey",
        "posted",
        predicates.age_status(F.col("posted")).alias("status"),
        predicates.posting_fresh(F.col("posted"), as_of, _DATE_HOURS).alias("fresh"),
    )


# text before and after the number, hours per unit
_AGES = [
    ("Vor ", " Stunden", 1), ("", " days ago", 24), ("", " Wochen", 168), ("", " min", 0),
    ("", "+ days ago", None), ("vor ", " Monat", None), ("seit ", "Tagen", 24),
]
_AGE_TEXT_SQL = "CASE l_linenumber " + " ".join(
    f"WHEN {n} THEN '{a}' || q || '{b}'" for n, (a, b, _) in enumerate(_AGES, 1)) + " END"
_AGE_SQL = "CASE l_linenumber " + " ".join(
    f"WHEN {n} THEN {'NULL' if f is None else f'q * {f}'}" for n, (_, _, f) in enumerate(_AGES, 1)) + " END"


@query(
    "relative_age_hours",
    f"""SELECT l_orderkey, l_linenumber, {_AGE_TEXT_SQL} AS posted, CAST({_AGE_SQL} AS BIGINT) AS hours
    FROM (SELECT *, CAST(l_quantity AS BIGINT) AS q FROM lineitem)""",
)
def relative_age_hours(spark, sf):
    number = F.col("l_quantity").cast("bigint").cast("string")
    posted = F.lit(None).cast("string")
    for line, (before, after, _) in enumerate(_AGES, 1):
        posted = F.when(F.col("l_linenumber") == line, F.concat(F.lit(before), number, F.lit(after))).otherwise(posted)
    rows = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", posted.alias("posted"))
    return rows.withColumn("hours", predicates.relative_age_hours(F.col("posted")))


_BLANKED_SQL = f"""{POSTINGS_SQL},
b AS (SELECT * REPLACE (CASE WHEN location = 'fr' THEN ' ' || chr(9) ELSE description END AS description,
                        CASE WHEN location = 'es' THEN '' ELSE title END AS title,
                        CASE WHEN location = 'de' THEN NULL ELSE url END AS url) FROM postings)"""


def _blanked(spark, sf):
    location = F.col("location")
    return postings(spark, sf).withColumns(
        {
            "description": F.when(location == "fr", F.lit(" \t")).otherwise(F.col("description")),
            "title": F.when(location == "es", F.lit("")).otherwise(F.col("title")),
            "url": F.when(location != "de", F.col("url")),
        }
    )


@query("required_fields", f"WITH {_BLANKED_SQL} SELECT doc_id, location FROM b WHERE title <> '' AND url <> ''")
def required_fields(spark, sf):
    return funnel.required_fields(_blanked(spark, sf), ["title", "url"]).select("doc_id", "location")


@query(
    "nonempty_description",
    f"WITH {_BLANKED_SQL} SELECT doc_id, platform FROM b WHERE platform <> 'BA Jobbörse' OR {strip_sql('description')} <> ''",
)
def nonempty_description(spark, sf):
    return funnel.nonempty_description(_blanked(spark, sf)).select("doc_id", "platform")


@query("exclude_search_links", "SELECT page_id, url FROM pages WHERE NOT contains(url, '/en/')")
def exclude_search_links(spark, sf):
    pages = table(spark, sf, "pages").select("page_id", "url")
    return pages.filter(~predicates.is_search_link(F.col("url"), "/en/"))


@query(
    "late_fresh_check",
    f"""WITH {POSTINGS_SQL}, d AS (
      SELECT doc_id, platform, CASE WHEN location = 'en' THEN posting_date ELSE '' END AS listed,
             'vor ' || (length(description) % 4) || ' Tagen' AS detail_date, length(description) AS n FROM postings)
    SELECT doc_id, platform, CASE WHEN platform = 'Xing' AND listed = '' THEN detail_date ELSE listed END AS posting_date
    FROM d WHERE platform <> 'Xing'
       OR (CASE WHEN listed = '' THEN n % 4 ELSE n % 5 END) * 24 <= 48""",
)
def late_fresh_check(spark, sf):
    days = (F.length("description") % 4).cast("string")
    rows = postings(spark, sf).withColumns(
        {
            "posting_date": F.when(F.col("location") == "en", F.col("posting_date")).otherwise(F.lit("")),
            "detail_date": F.concat(F.lit("vor "), days, F.lit(" Tagen")),
        }
    )
    as_of = F.lit("2024-01-31 00:00:00").cast("timestamp")
    return funnel.late_fresh_check(rows, as_of).select("doc_id", "platform", "posting_date")


@query(
    "location_gate",
    f"WITH {POSTINGS_SQL} SELECT doc_id, platform, platform <> 'LinkedIn' OR location IN ('en', 'fr') AS location_ok FROM postings",
)
def location_gate(spark, sf):
    as_of = F.lit("2024-01-31 00:00:00").cast("timestamp")
    flagged = funnel.funnel_flags(postings(spark, sf), as_of=as_of, blocks=[], germany_keywords=["en", "fr"])
    return flagged.select("doc_id", "platform", "location_ok")


_ERRORS = {
    "error": "Rate limit: tokens per DAY (TPD) reached at ",
    "click": "free-models-per-day exceeded: ",
    "view": "rate limit reached, retry in ",
}
_ERROR_SQL = "CASE event_type " + " ".join(f"WHEN '{k}' THEN {quoted(v)} || props" for k, v in _ERRORS.items()) + " END"


def error_text():
    error = F.lit(None).cast("string")
    for kind, message in _ERRORS.items():
        error = F.when(F.col("event_type") == kind, F.concat(F.lit(message), "props")).otherwise(error)
    return error


@query(
    "run_blocking_quota",
    "SELECT event_id, event_type IN ('error', 'click') AS blocking FROM events",
)
def run_blocking_quota(spark, sf):
    return table(spark, sf, "events").select(
        "event_id", predicates.run_blocking_quota(error_text()).alias("blocking")
    )


# --- replies ------------------------------------------------------------------------------

_K = "regexp_extract(props, '([0-9]+)', 1)"


def reply_text():
    """A reply per event: plain, fenced, inside prose, with trailing text, or broken."""
    kind = F.col("event_type")
    body = F.concat(
        F.lit('{"score": '), F.col("value").cast("string"), F.lit(', "reason": " '), "event_type", F.lit(' \\u00fc "}')
    )
    return (
        F.when(kind == "view", body)
        .when(kind == "click", F.concat(F.lit("```json\n"), body, F.lit("\n```")))
        .when(kind == "purchase", F.concat(F.lit("My verdict: "), body, F.lit(" as {asked")))
        .when(kind == "signup", F.concat(body, F.lit(" "), body))
        .otherwise(F.concat(F.lit("error "), "props"))
    )


# Two objects in a row are no JSON, not even from the first to the last brace.
_REPLY_SCORE = "CAST(floor(greatest(1, least(10, value))) AS INTEGER)"


@query(
    "response_parse",
    f"""SELECT event_id, event_type IN ('view', 'click', 'purchase') OR event_type = 'error' AS parsed,
      CASE WHEN event_type IN ('view', 'click', 'purchase') THEN {_REPLY_SCORE} WHEN event_type = 'error' THEN 1 END AS score,
      CASE WHEN event_type IN ('view', 'click', 'purchase') THEN event_type || ' ü' WHEN event_type = 'error' THEN '' END AS reason
    FROM events""",
)
def response_parse(spark, sf):
    rows = spread(table(spark, sf, "events"), "event_id").select("event_id", reply_text().alias("raw"))
    read = replies.with_score(replies.with_reply(rows))
    return read.select("event_id", F.col("reply").isNotNull().alias("parsed"), "score", "reason")


@query(
    "score_clamp",
    f"""SELECT event_id, CASE event_type WHEN 'view' THEN greatest(1, least(10, CAST({_K} AS INTEGER) - 50))
      WHEN 'click' THEN greatest(1, least(10, CAST({_K} AS INTEGER))) WHEN 'purchase' THEN NULL
      WHEN 'signup' THEN 1 ELSE {_REPLY_SCORE} END AS score FROM events""",
)
def score_clamp(spark, sf):
    kind, k = F.col("event_type"), F.regexp_extract("props", "([0-9]+)", 1)
    shifted = (k.cast("int") - 50).cast("string")
    raw = (
        F.when(kind == "view", F.concat(F.lit('{"score": '), shifted, F.lit("}")))
        .when(kind == "click", F.concat(F.lit('{"score": " '), k, F.lit(' "}')))
        .when(kind == "purchase", F.concat(F.lit('{"score": "'), k, F.lit('.5"}')))
        .when(kind == "signup", F.concat(F.lit('{"grade": '), k, F.lit("}")))
        .otherwise(F.concat(F.lit('{"score": '), F.col("value").cast("string"), F.lit("}")))
    )
    rows = table(spark, sf, "events").select("event_id", raw.alias("raw"))
    return replies.with_score(replies.with_reply(rows)).select("event_id", "score")


@query("match_flag", f"WITH {SCORED_SQL} SELECT doc_id, llm_score, llm_score >= 9 AS match FROM scored")
def match_flag(spark, sf):
    return scored_postings(spark, sf).select(
        "doc_id", "llm_score", replies.is_match(F.col("llm_score"), 9).alias("match")
    )


@query(
    "score_bar",
    f"WITH {SCORED_SQL} SELECT doc_id, repeat('★', llm_score) || repeat('☆', 10 - llm_score) AS bar FROM scored",
)
def score_bar(spark, sf):
    return scored_postings(spark, sf).select("doc_id", replies.score_bar(F.col("llm_score")).alias("bar"))


def _esc(expr):
    for char, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        expr = f"replace({expr}, '{char}', '{entity}')"
    return expr


def plain_entry_sql(n: str) -> str:
    return f"""concat_ws(chr(10), '[' || {n} || ']  ' || title, '  Company   : ' || company, '  Location  : ' || location,
  '  Platform  : ' || platform, '  Experience: ' || experience_level, '  Posted    : ' || posting_date, '  Link      : ' || url, '',
  CASE WHEN llm_score <> 0 THEN '  AI Score  : ' || llm_score || '/10' END,
  CASE WHEN llm_reason <> '' THEN '  AI Verdict: ' || llm_reason END, '', repeat('-', 60), '')"""


_HTML_SQL = f"""concat_ws(chr(10), '<section><h2>' || doc_id || '. ' || {_esc('title')} || '</h2>',
  '<b>AI Score: ' || llm_score || '/10 ' || repeat('★', llm_score) || repeat('☆', 10 - llm_score) || '</b><ul>',
  '<li>Company: ' || company || '</li>', '<li>Location: ' || location || '</li>', '<li>Platform: ' || platform || '</li>',
  '<li>Experience: ' || coalesce(nullif(experience_level, ''), 'N/A') || '</li>', '<li>Posted: ' || posting_date || '</li>', '</ul>',
  CASE WHEN llm_reason <> '' THEN '<blockquote>' || {_esc('llm_reason')} || '</blockquote>' END,
  '<a href="' || url || '">View Job</a></section>')"""


@query(
    "digest_entry",
    f"WITH {SCORED_SQL} SELECT doc_id, {plain_entry_sql('doc_id')} AS plain, {_HTML_SQL} AS html FROM scored",
)
def digest_entry(spark, sf):
    number = F.col("doc_id")
    return scored_postings(spark, sf).select(
        "doc_id", digest.plain_entry(number).alias("plain"), digest.html_entry(number).alias("html")
    )
