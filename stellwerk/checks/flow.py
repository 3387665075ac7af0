"""Queries over joins, first occurrences, counts, scoring, digests, the ledger and runs."""

from __future__ import annotations

from pyspark.sql import Window, functions as F

from stellwerk import schema, vocab
from stellwerk.checks.base import (
    ORACLES,
    LEDGER_SQL,
    POSTINGS_SQL,
    SCORED_SQL,
    any_of_sql,
    as_postings,
    board_of,
    board_sql,
    postings,
    query,
    quoted,
    scored_postings,
    sent_ledger,
    spread,
    strip_sql,
    table,
)
from stellwerk.checks.scalars import error_text, plain_entry_sql, reply_text
from stellwerk.functions.predicates import title_relevant
from stellwerk.functions.replies import is_match, with_reply, with_score
from stellwerk.operators import digest, frontier, funnel, identity, metrics, scoring
from stellwerk.plans import daily_run
from stellwerk.plans.source_check import check_source
from stellwerk.session import new_run_dir
from stellwerk.sources import files, ledger, registry, reports
from stellwerk.sources.captures import read_captures
from stellwerk.streaming.incremental import from_captures, incremental_run


def _as_of():
    return F.lit("2024-01-31 00:00:00").cast("timestamp")


# --- identity and ledger ------------------------------------------------------------------


@query("has_job_id", f"WITH {POSTINGS_SQL} SELECT doc_id FROM postings WHERE location <> 'fr' AND location <> 'de'")
def has_job_id(spark, sf):
    place = F.col("location")
    blanked = F.when(place == "fr", F.lit("")).when(place != "de", F.col("job_id"))
    return identity.has_job_id(postings(spark, sf).withColumn("job_id", blanked)).select("doc_id")


@query("anti_ledger", f"WITH {LEDGER_SQL} SELECT doc_id, job_id FROM postings WHERE job_id NOT IN (SELECT job_id FROM ledger)")
def anti_ledger(spark, sf):
    return identity.anti_ledger(postings(spark, sf), sent_ledger(spark, sf)).select("doc_id", "job_id")


@query("already_sent", f"WITH {LEDGER_SQL} SELECT doc_id, job_id FROM postings WHERE job_id IN (SELECT job_id FROM ledger)")
def already_sent(spark, sf):
    return identity.already_sent(postings(spark, sf), sent_ledger(spark, sf)).select("doc_id", "job_id")


_ORDER = "query_idx, page_no, card_pos"


@query(
    "first_per_platform",
    f"""WITH {POSTINGS_SQL} SELECT doc_id, platform, job_id FROM postings
    QUALIFY row_number() OVER (PARTITION BY platform, job_id ORDER BY {_ORDER}) = 1""",
)
def first_per_platform(spark, sf):
    return identity.first_per_platform(postings(spark, sf)).select("doc_id", "platform", "job_id")


@query(
    "first_global",
    f"""WITH {SCORED_SQL} SELECT doc_id, job_id, platform, llm_score FROM scored WHERE match
    QUALIFY row_number() OVER (PARTITION BY job_id ORDER BY platform_rank, {_ORDER}) = 1""",
)
def first_global(spark, sf):
    matched = scoring.matched_only(scored_postings(spark, sf))
    return identity.first_global(matched).select("doc_id", "job_id", "platform", "llm_score")


@query(
    "ledger_read",
    f"""WITH {LEDGER_SQL} SELECT job_id, max(date_sent) AS date_sent, CAST(0 AS BIGINT) AS before_first_run
    FROM ledger GROUP BY job_id""",
)
def ledger_read(spark, sf):
    """No ledger reads as empty; one that was written reads as the latest record per id."""
    path = new_run_dir(spark, "ledger")
    before = ledger.read_ledger(spark, path).agg(F.count("*").alias("before_first_run"))
    sent_ledger(spark, sf).drop("run_id").write.parquet(f"{path}/run_id=first")
    latest = ledger.latest_records(ledger.read_ledger(spark, path)).select("job_id", "date_sent")
    return latest.withColumn("before_first_run", F.lit(before.first()[0]).cast("bigint"))


@query(
    "ledger_append",
    f"""WITH {LEDGER_SQL}, newer AS (SELECT job_id FROM postings WHERE platform_rank < 2), later AS (SELECT job_id FROM postings WHERE platform_rank >= 2)
    SELECT job_id, max(date_sent) AS date_sent FROM (
      SELECT job_id, date_sent FROM ledger UNION ALL SELECT job_id, TIMESTAMP '2024-02-01 00:00:00' FROM newer
      UNION ALL SELECT job_id, TIMESTAMP '2024-02-02 00:00:00' FROM later) GROUP BY job_id""",
)
def ledger_append(spark, sf):
    """An earlier ledger, then two runs, a pair of boards each. The first is recorded twice: the
    second try replaces it."""
    path = new_run_dir(spark, "ledger")
    sent_ledger(spark, sf).drop("run_id").write.parquet(f"{path}/run_id=first")
    found = postings(spark, sf)
    found = found.unionByName(found.withColumn("job_id", F.lit("")))
    runs = [("second", "platform_rank < 2", "2024-02-01"), ("second", "platform_rank < 2", "2024-02-01"), ("third", "platform_rank >= 2", "2024-02-02")]
    for run_id, boards, day in runs:
        ledger.append_ledger(found.filter(boards), path, run_id, F.lit(f"{day} 00:00:00").cast("timestamp"))
    return ledger.latest_records(ledger.read_ledger(spark, path)).select("job_id", "date_sent")


@query(
    "ledger_lookup",
    f"""WITH {LEDGER_SQL} SELECT job_id, max(date_sent) AS date_sent, (SELECT count(DISTINCT job_id) FROM ledger) AS records
    FROM ledger WHERE job_id IN (SELECT job_id FROM postings) GROUP BY job_id""",
)
def ledger_lookup(spark, sf):
    """Records of all postings that were sent, and the count of the whole ledger."""
    rows = sent_ledger(spark, sf)
    found = ledger.lookup(rows, postings(spark, sf))
    return found.select("job_id", "date_sent", ledger.total_count(rows).scalar().alias("records"))


# --- joins --------------------------------------------------------------------------------


@query(
    "join_detail",
    f"""WITH {POSTINGS_SQL} SELECT doc_id, p.title, coalesce('quality ' || quality, '') AS description,
      CASE WHEN toxic = 1 THEN 'Senior' ELSE '' END AS experience_level
    FROM postings p LEFT JOIN labels USING (doc_id)""",
)
def join_detail(spark, sf):
    listings = postings(spark, sf).withColumn("platform", F.lit(vocab.LINKEDIN)).drop("description", "experience_level")
    details = table(spark, sf, "labels").select(
        F.lit(vocab.LINKEDIN).alias("platform"),
        F.concat(F.lit("https://jobs.example/"), F.col("doc_id").cast("string")).alias("url"),
        F.concat(F.lit("quality "), F.col("quality").cast("string")).alias("description"),
        F.when(F.col("toxic") == 1, F.lit("Senior")).alias("experience_level"),
    )
    joined = funnel.join_detail(listings, details)
    return joined.select("doc_id", "title", "description", "experience_level")


_SEGMENTS = ["AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD"]
_COUNTRIES = ["Germany", "germany", "Austria", "Netherlands", "United Kingdom"]
_SEARCHES_SQL = f"""searches AS (
  SELECT c_custkey, {board_sql(f"coalesce(list_position([{', '.join(quoted(s) for s in _SEGMENTS)}], c_mktsegment) - 1, 0)")} AS platform,
         list_extract([{', '.join(quoted(c) for c in _COUNTRIES)}], CAST(r_regionkey + 1 AS INTEGER)) AS country,
         '  ' || replace(c_name, '#', ' ~* + ') || '/ö ' AS query
  FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey),
rules AS (SELECT * FROM (VALUES {', '.join('(' + ', '.join(quoted(v) for v in row) + ')' for row in vocab.PLATFORM_COUNTRY)})
          AS r(platform, country_key, rule, domain, route, path)),
served AS (SELECT s.*, domain, route, path FROM searches s JOIN rules r ON s.platform = r.platform AND (rule = 'any'
  OR (rule = 'exact' AND country = country_key) OR (rule = 'ignore_case' AND lower(country) = lower(country_key))))"""


def _searches(spark, sf):
    nations = table(spark, sf, "nation").join(table(spark, sf, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    segments = F.array(*[F.lit(s) for s in _SEGMENTS])
    number = F.greatest(F.array_position(segments, F.col("c_mktsegment")) - 1, F.lit(0))
    country = F.element_at(F.array(*[F.lit(c) for c in _COUNTRIES]), F.col("r_regionkey") + 1)
    rows = table(spark, sf, "customer").join(nations, F.col("c_nationkey") == F.col("n_nationkey"))
    return rows.select(
        "c_custkey",
        board_of(number).alias("platform"),
        country.alias("country"),
        F.concat(F.lit("  "), F.replace("c_name", F.lit("#"), F.lit(" ~* + ")), F.lit("/ö ")).alias("query"),
    )


@query("platform_country", f"WITH {_SEARCHES_SQL} SELECT c_custkey, platform, country, domain, route, path FROM served WHERE platform <> 'Xing'")
def platform_country(spark, sf):
    served = frontier.platform_country(_searches(spark, sf), disabled=[vocab.XING])
    return served.select("c_custkey", "platform", "country", "domain", "route", "path")


_QUOTE = "replace(url_encode({}), '%2F', '/')"
_URL_SQL = f"""CASE platform
  WHEN 'LinkedIn' THEN 'https://www.linkedin.com/jobs/search/?keywords=' || {_QUOTE.format('query')} || '&location='
    || {_QUOTE.format('country')} || '&f_E=2%2C3&f_TPR=r86400&start=' || ((page_no - 1) * 25)
  WHEN 'StepStone' THEN 'https://' || domain || '/' || route || '/' || {_QUOTE.format("replace(trim(query), ' ', '-')")}
    || '/' || path || '?sort=2&datePosted=1&page=' || page_no
  WHEN 'Xing' THEN 'https://www.xing.com/jobs/search?keywords=' || {_QUOTE.format('query')} || '&location=Germany&page=' || page_no
  ELSE 'https://rest.arbeitsagentur.de/jobboerse/jobsuche-service/pc/v4/jobs?was=' || replace(url_encode(query), '%20', '+')
    || '&wo=Deutschland&angebotsart=1&veroeffentlichtseit=1&page=' || page_no || '&size=25' END"""


@query(
    "search_url",
    f"WITH {_SEARCHES_SQL} SELECT c_custkey, platform, {_URL_SQL} AS url FROM (SELECT *, 1 AS page_no FROM served)",
)
def search_url(spark, sf):
    served = frontier.platform_country(_searches(spark, sf))
    return frontier.search_frontier(served, pages=1).select("c_custkey", "platform", "url")


@query(
    "search_frontier",
    f"WITH {_SEARCHES_SQL} SELECT c_custkey, platform, country, page_no, {_URL_SQL} AS url FROM (SELECT *, CAST(unnest([1, 2, 3]) AS INTEGER) AS page_no FROM served)",
)
def search_frontier(spark, sf):
    served = frontier.platform_country(_searches(spark, sf))
    return frontier.search_frontier(served, pages=3).select("c_custkey", "platform", "country", "page_no", "url")


# --- model attempts -----------------------------------------------------------------------

_MODEL_ORDER = ["view", "click", "error", "purchase", "signup"]


def _attempts(spark, sf):
    """Events as attempts: a user's day is a job, the event type the model. Errors are quota
    errors of types error and click; started a quarter of an hour before the answer."""
    kind = F.col("event_type")
    rank = F.array_position(F.array(*[F.lit(m) for m in _MODEL_ORDER]), kind).cast("int")
    return table(spark, sf, "events").select(
        "event_id",
        F.date_format("ts", "yyyy-MM").alias("run_id"),
        F.concat_ws("/", F.col("user_id").cast("string"), F.date_format("ts", "yyyy-MM-dd")).alias("job_id"),
        kind.alias("model"),
        rank.alias("model_rank"),
        reply_text().alias("raw"),
        F.when(F.col("value") > 20, error_text()).alias("error"),
        (F.col("ts") - F.expr("INTERVAL 15 MINUTES")).alias("job_started_at"),
        F.col("ts").alias("responded_at"),
    )


_ATTEMPTS_SQL = f"""attempts AS (
  SELECT event_id, strftime(ts, '%Y-%m') AS run_id, user_id || '/' || strftime(ts, '%Y-%m-%d') AS job_id, event_type AS model,
    list_position([{', '.join(quoted(m) for m in _MODEL_ORDER)}], event_type) AS model_rank,
    CASE WHEN value > 20 AND event_type IN ('error', 'click', 'view') THEN 'e' || event_type END AS error,
    ts - INTERVAL 15 MINUTE AS job_started_at, ts AS responded_at,
    CASE WHEN event_type IN ('view', 'click', 'purchase') THEN CAST(floor(greatest(1, least(10, value))) AS INTEGER)
         WHEN event_type = 'error' THEN 1 END AS score
  FROM events),
verdicts AS (
  SELECT job_id, model, score >= 7 AS match, score, CASE WHEN model = 'error' THEN '' ELSE model || ' ü' END AS reason
  FROM attempts WHERE error IS NULL AND score IS NOT NULL
  QUALIFY row_number() OVER (PARTITION BY job_id ORDER BY model_rank, responded_at) = 1)"""


@query(
    "model_disable",
    f"""WITH {_ATTEMPTS_SQL}, blocked AS (SELECT run_id, model, min(responded_at) AS at_ FROM attempts
      WHERE error IN ('eerror', 'eclick') GROUP BY ALL)
    SELECT event_id, a.model FROM attempts a LEFT JOIN blocked b ON a.run_id = b.run_id AND a.model = b.model
    WHERE at_ IS NULL OR job_started_at <= at_""",
)
def model_disable(spark, sf):
    return scoring.drop_disabled_attempts(_attempts(spark, sf)).select("event_id", "model")


@query("first_valid_response", f"WITH {_ATTEMPTS_SQL} SELECT * FROM verdicts")
def first_valid_response(spark, sf):
    return scoring.first_valid_response(_attempts(spark, sf), ["job_id"])


_JOIN_VERDICTS = """(SELECT DISTINCT job_id FROM attempts) LEFT JOIN verdicts USING (job_id)"""


@query(
    "join_responses",
    f"""WITH {_ATTEMPTS_SQL} SELECT job_id, coalesce(match, FALSE) AS match, coalesce(score, 0) AS llm_score,
      CASE WHEN score IS NULL THEN '{vocab.FALLBACK_REASON}' ELSE reason END AS llm_reason FROM {_JOIN_VERDICTS}""",
)
def join_responses(spark, sf):
    attempts = _attempts(spark, sf)
    jobs = attempts.select("job_id").distinct()
    return scoring.join_responses(jobs, scoring.first_valid_response(attempts, ["job_id"]), ["job_id"])


@query(
    "score_fallback",
    f"""WITH {_ATTEMPTS_SQL} SELECT event_id, score IS NOT NULL AND score >= 7 AS match, coalesce(score, 0) AS llm_score,
      CASE WHEN score IS NULL THEN '{vocab.FALLBACK_REASON}' ELSE model END AS llm_reason FROM attempts""",
)
def score_fallback(spark, sf):
    rows = with_score(with_reply(_attempts(spark, sf))).withColumn("match", is_match(F.col("score")))
    rows = rows.select("event_id", "score", F.col("model").alias("reason"), "match")
    return scoring.with_fallback(rows)


@query(
    "ordered_distinct",
    "SELECT user_id, 'a,' || event_type || ',' || role_ AS models FROM (SELECT event_id AS user_id, event_type, CASE WHEN event_type = 'view' THEN 'b' ELSE 'view' END AS role_ FROM events)",
)
def ordered_distinct(spark, sf):
    """Repeats and blanks go, order stays; a disabled model is left out."""
    other = F.when(F.col("event_type") == "view", F.lit("b")).otherwise(F.lit("view"))
    names = F.array(F.lit("a"), F.col("event_type"), F.lit("a"), F.lit("off"), other, F.col("event_type"), F.lit(""))
    models = scoring.ordered_distinct(names, disabled=F.array(F.lit("off")))
    return table(spark, sf, "events").select(F.col("event_id").alias("user_id"), F.array_join(models, ",").alias("models"))


@query("matched_only", f"WITH {SCORED_SQL} SELECT doc_id, llm_score FROM scored WHERE match")
def matched_only(spark, sf):
    return scoring.matched_only(scored_postings(spark, sf)).select("doc_id", "llm_score")


def _length_scorer(message: str) -> dict:
    """A stand-in model: it fails on some messages and scores the others by their length."""
    if len(message) % 7 == 0:
        raise TimeoutError("no answer")
    return {"score": len(message) % 11, "reason": f" {len(message)} characters "}


def _spare_scorer(message: str) -> str:
    return "no idea" if len(message) % 2 else 'Here: {"score": "9"}'


_LENGTH_SQL = f"length(concat_ws(chr(10), 'Job Title: ' || title, 'Company: ' || company, 'Location: ' || location, 'Platform: ' || platform, 'Experience Level (from job board): ' || coalesce(nullif(experience_level, ''), 'N/A'), '', 'Job Description:', description))"


@query(
    "score_with",
    f"""WITH {POSTINGS_SQL}, m AS (SELECT doc_id, {_LENGTH_SQL} AS n FROM (
        SELECT * REPLACE (CASE WHEN length(description) <= 8000 THEN description
          WHEN regexp_extract(left(description, 8000), '(?s)^(.*[.!?])', 1) = '' THEN left(description, 8000) || chr(10) || '[description truncated]'
          ELSE regexp_extract(left(description, 8000), '(?s)^(.*[.!?])', 1) || chr(10) || '[description truncated]' END AS description) FROM postings)),
    s AS (SELECT doc_id, n, CASE WHEN n % 7 <> 0 THEN greatest(1, n % 11) WHEN n % 2 = 0 THEN 9 END AS score FROM m)
    SELECT doc_id, coalesce(score, 0) AS llm_score, coalesce(score >= 7, FALSE) AS match,
      CASE WHEN score IS NULL THEN '{vocab.FALLBACK_REASON}' WHEN n % 7 <> 0 THEN n || ' characters' ELSE '' END AS llm_reason
    FROM s""",
)
def score_with(spark, sf):
    scored = scoring.score_with(spread(postings(spark, sf), "doc_id"), [_length_scorer, _spare_scorer])
    return scored.select("doc_id", "llm_score", "match", "llm_reason")


def _quota_scorer(message):
    """Answers like the length scorer until its quota ends; the first refusal of a message is only for its rate."""
    if len(message) % 5 == 0:
        raise scoring.RateLimited("Limit reached: tokens per day (TPD)")
    return _length_scorer(message)


@query("score_waves", ORACLES["score_with"])
def score_waves(spark, sf):
    """The first scorer runs out of quota half way; the ones behind it answer for it, so that no score is lost."""
    scorers = {"first": _quota_scorer, "second": _length_scorer, "spare": _spare_scorer}
    scored = scoring.score_in_waves(postings(spark, sf), scorers, new_run_dir(spark, "waves"), waves=4)
    return scored.select("doc_id", "llm_score", "match", "llm_reason")


@query("bypass_scoring", f"WITH {POSTINGS_SQL} SELECT doc_id, 0 AS llm_score, TRUE AS match FROM postings")
def bypass_scoring(spark, sf):
    """The scoring stage breaks down while it runs; with the option set every posting passes."""

    def broken(rows):
        return scoring.pass_all(rows).withColumn("llm_reason", F.raise_error(F.lit("scorer gone")).cast("string"))

    scored = scoring.score_or_pass(postings(spark, sf), broken, new_run_dir(spark, "scored"), "pass_all")
    return scored.select("doc_id", "llm_score", "match")


# --- funnel -------------------------------------------------------------------------------


@query(
    "cap_details",
    f"""WITH {POSTINGS_SQL} SELECT doc_id, platform, query_idx FROM postings
    QUALIFY row_number() OVER (PARTITION BY platform, query_idx ORDER BY page_no, card_pos) <= 20""",
)
def cap_details(spark, sf):
    return funnel.cap_details(postings(spark, sf)).select("doc_id", "platform", "query_idx")


@query("page_limit", f"WITH {POSTINGS_SQL} SELECT doc_id, page_no FROM postings WHERE page_no <= 12")
def page_limit(spark, sf):
    return funnel.page_limit(postings(spark, sf), 12).select("doc_id", "page_no")


@query(
    "pagination_stop",
    """WITH p AS (SELECT user_id, CAST(event_id AS INTEGER) AS page_no, event_type = 'error' AND value > 20 AS is_last FROM events)
    SELECT user_id, page_no FROM p
    QUALIFY coalesce(max(CAST(is_last AS INTEGER)) OVER (PARTITION BY user_id ORDER BY page_no
      ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) = 0""",
)
def pagination_stop(spark, sf):
    """Events as the pages of a user's search; larger errors end the paging."""
    pages = table(spark, sf, "events").select(
        "user_id",
        F.col("event_id").cast("int").alias("page_no"),
        ((F.col("event_type") == "error") & (F.col("value") > 20)).alias("is_last"),
    )
    return funnel.pagination_stop(pages, ["user_id"], F.col("is_last")).select("user_id", "page_no")


_BLOCKS = ["ndbleou", "eauouè", "xyz"]
_FLAGGED_SQL = f"""{SCORED_SQL},
flagged AS (SELECT *, platform <> 'LinkedIn' OR location IN ('en', 'fr') AS location_ok,
   length(description) % 5 <= 2 AS date_ok, NOT {any_of_sql('lower(title)', _BLOCKS)} AS title_ok FROM scored),
funnel AS (SELECT platform, query_idx, count(*) AS cards, count(*) FILTER (location_ok) AS loc,
   count(*) FILTER (location_ok AND date_ok) AS date, count(*) FILTER (location_ok AND date_ok AND title_ok) AS title,
   count(*) FILTER (location_ok AND date_ok AND title_ok) AS detail,
   count(*) FILTER (location_ok AND date_ok AND title_ok AND match) AS matched
  FROM flagged GROUP BY platform, query_idx)"""


def _flagged(spark, sf):
    rows = scored_postings(spark, sf)
    return funnel.funnel_flags(rows, as_of=_as_of(), blocks=_BLOCKS, germany_keywords=["en", "fr"])


@query("funnel_by_query", f"WITH {_FLAGGED_SQL} SELECT * FROM funnel")
def funnel_by_query(spark, sf):
    return metrics.funnel_by_query(_flagged(spark, sf).withColumn("detailed", F.lit(True)))


_SUMS = ", ".join(f"CAST(sum({s}) AS BIGINT) AS {s}" for s in metrics.STAGES)


@query(
    "funnel_total",
    f"""WITH {_FLAGGED_SQL} SELECT CASE WHEN grouping(platform) = 1 THEN 'TOTAL' WHEN grouping(query_idx) = 1
      THEN platform || ' TOTAL' ELSE platform END AS platform, query_idx, {_SUMS}
    FROM funnel GROUP BY ROLLUP (platform, query_idx)""",
)
def funnel_total(spark, sf):
    return metrics.funnel_total(funnel_by_query(spark, sf))


@query("unique_matched", f"WITH {SCORED_SQL} SELECT count(DISTINCT job_id) AS unique_matched FROM scored WHERE match")
def unique_matched(spark, sf):
    return metrics.unique_matched(scored_postings(spark, sf))


@query(
    "platform_counts",
    f"""WITH {LEDGER_SQL}, firsts AS (SELECT * FROM postings WHERE NOT {any_of_sql('lower(title)', _BLOCKS)}
      QUALIFY row_number() OVER (PARTITION BY platform, job_id ORDER BY {_ORDER}) = 1)
    SELECT platform, count(*) AS candidates, count(DISTINCT job_id) AS unique_jobs FROM firsts
    WHERE job_id NOT IN (SELECT job_id FROM ledger) GROUP BY platform""",
)
def platform_counts(spark, sf):
    """Relevant postings, first per board, not sent before, counted per board."""
    relevant = postings(spark, sf).filter(title_relevant(F.col("title"), _BLOCKS))
    narrow = relevant.select("job_id", "platform", "query_idx", "page_no", "card_pos")
    fresh = identity.anti_ledger(identity.first_per_platform(narrow), sent_ledger(spark, sf))
    return metrics.platform_counts(fresh)


@query("match_rate", f"WITH {SCORED_SQL} SELECT count(*) FILTER (match) AS matched, count(*) AS evaluated FROM scored")
def match_rate(spark, sf):
    return metrics.match_rate(scored_postings(spark, sf))


@query(
    "run_summary",
    f"""WITH {LEDGER_SQL}, delivered AS (SELECT DISTINCT job_id FROM postings WHERE job_id NOT IN (SELECT job_id FROM ledger))
    SELECT (SELECT count(*) FROM delivered) AS new_jobs, (SELECT count(DISTINCT job_id) FROM ledger) AS ledger_before,
      (SELECT count(*) FROM delivered) + (SELECT count(DISTINCT job_id) FROM ledger) AS ledger_after""",
)
def run_summary(spark, sf):
    sent = sent_ledger(spark, sf)
    fresh = identity.anti_ledger(postings(spark, sf), sent)
    return metrics.run_summary(sent, fresh)


# --- order and union ----------------------------------------------------------------------


@query(
    "union_platforms",
    """SELECT c_custkey AS key, c_name AS name, 0 AS platform_rank, c_mktsegment AS segment FROM customer
    UNION ALL SELECT s_suppkey, s_name, 1, NULL FROM supplier UNION ALL SELECT c_custkey, c_name, 2, c_mktsegment FROM customer""",
)
def union_platforms(spark, sf):
    customers = table(spark, sf, "customer").select(
        F.col("c_custkey").alias("key"), F.col("c_name").alias("name"), F.col("c_mktsegment").alias("segment")
    )
    suppliers = table(spark, sf, "supplier").select(F.col("s_suppkey").alias("key"), F.col("s_name").alias("name"))
    return registry.union_platforms({"a": customers, "b": suppliers, "c": customers})


@query("stable_order", f"WITH {POSTINGS_SQL} SELECT doc_id, platform_rank, query_idx, page_no, card_pos FROM postings")
def stable_order(spark, sf):
    rows = identity.stable_order(postings(spark, sf))
    return rows.select("doc_id", "platform_rank", "query_idx", "page_no", "card_pos")


# --- digests ------------------------------------------------------------------------------

# One digest per language, and one that has no postings.
_NUMBERED_SQL = f"""{SCORED_SQL},
numbered AS (SELECT *, location AS digest_id, row_number() OVER w AS n, count(*) OVER (PARTITION BY location) AS total
  FROM scored WHERE match WINDOW w AS (PARTITION BY location ORDER BY platform_rank, {_ORDER}))"""
_PER_PART = 40


def _numbered(spark, sf):
    matched = scoring.matched_only(scored_postings(spark, sf))
    return digest.digest_number(matched.withColumn("digest_id", F.col("location")))


@query("digest_number", f"WITH {_NUMBERED_SQL} SELECT digest_id, doc_id, n, total FROM numbered")
def digest_number(spark, sf):
    return _numbered(spark, sf).select("digest_id", "doc_id", "n", "total")


_PARTS_SQL = f"""{_NUMBERED_SQL},
parts AS (SELECT digest_id, CAST((n - 1) // {_PER_PART} AS INTEGER) AS part_no, max(n) AS last, max(total) AS total,
    string_agg({plain_entry_sql('n')}, chr(10) ORDER BY n) AS entries FROM numbered GROUP BY ALL),
digests AS (SELECT DISTINCT lang AS digest_id FROM documents UNION ALL SELECT 'none'),
digest AS (SELECT digest_id, coalesce(part_no, 0) AS part_no,
  CASE WHEN part_no IS NULL THEN 'No new relevant jobs found in this cycle.' || chr(10) || chr(10) || 'Date: 2024-01-31'
  ELSE concat_ws(chr(10), CASE WHEN part_no = 0 THEN 'NEW JOBS FOUND  (2024-01-31)' || chr(10) || repeat('=', 60) || chr(10) END, entries,
    CASE WHEN last = total THEN 'Total new jobs: ' || total || chr(10) || chr(10) || '-- Germany job digest --' END) END AS body
  FROM digests LEFT JOIN parts USING (digest_id))"""


def _digest_parts(spark, sf):
    numbered = _numbered(spark, sf)
    wanted = table(spark, sf, "documents").select(F.explode(F.array("lang", F.lit("none"))).alias("digest_id"))
    return digest.digest_assemble(wanted, numbered, F.lit("2024-01-31"), entries_per_part=_PER_PART)


@query("digest_assemble", f"WITH {_PARTS_SQL} SELECT * FROM digest")
def digest_assemble(spark, sf):
    return _digest_parts(spark, sf)


@query(
    "digest_sink",
    f"WITH {_PARTS_SQL} SELECT digest_id, part_no, body, 'Germany AI/Robotics Job Update – 2024-01-31' AS subject FROM digest",
)
def digest_sink(spark, sf):
    path = new_run_dir(spark, "digest")
    reports.write_digest(_digest_parts(spark, sf), path)
    return spark.read.parquet(path).withColumn("subject", digest.subject("Germany", F.lit("2024-01-31")))


@query(
    "report_sink",
    f"""WITH {SCORED_SQL} SELECT job_id, llm_score, (SELECT count(*) FROM scored WHERE match) AS total_matched, 'a, b' AS queries,
      CAST(2 AS BIGINT) AS pages_per_query, TRUE AS filters_applied, '2024-01-31T00:00:00' AS test_run
    FROM scored WHERE match""",
)
def report_sink(spark, sf):
    """The run's one summary row, joined to the postings written beside it."""
    path = new_run_dir(spark, "report")
    matched = scoring.matched_only(scored_postings(spark, sf))
    summary = reports.run_report(matched, ["a", "b"], 2, True, F.lit("2024-01-31T00:00:00"))
    reports.write_report(summary, matched, path)
    jobs = spark.read.schema("job_id string, llm_score int").json(f"{path}/jobs")
    run = spark.read.json(f"{path}/summary").first()
    return jobs.select(
        "job_id",
        "llm_score",
        F.lit(run.total_matched).alias("total_matched"),
        F.lit(", ".join(run.queries)).alias("queries"),
        F.lit(run.pages_per_query).cast("bigint").alias("pages_per_query"),
        F.lit(run.filters_applied).alias("filters_applied"),
        F.lit(run.test_run).alias("test_run"),
    )


# --- whole runs ---------------------------------------------------------------------------


def _text(*parts):
    return F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])


def _escaped(text):
    for char, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        text = F.replace(text, F.lit(char), F.lit(entity))
    return text


# Documents as captures: boards by source, a query for every source and thousand documents,
# each with two search pages; every document's whole text on a detail page. A title comes from
# the whole text, so that ids repeat where texts do.
_CARDS_SQL = """cards AS (
  SELECT doc_id, text, lang, number % 4 AS rank_, CAST(number + 20 * (doc_id // 1000) AS INTEGER) AS query_idx,
    'Engineer ' || sha256(text) AS title, n_chars % 5 AS days, CAST((doc_id // 500) % 2 + 1 AS INTEGER) AS page_no
  FROM (SELECT *, CAST(substr(source, 4) AS INTEGER) AS number FROM documents)),
seen AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_idx, page_no ORDER BY doc_id) - 1 AS INTEGER) AS card_pos,
    count(*) OVER (PARTITION BY query_idx, page_no) AS on_page FROM cards),
short AS (SELECT query_idx, min(page_no) AS end_ FROM seen WHERE rank_ = 3 AND on_page < 25 GROUP BY query_idx),
reached AS (SELECT seen.* FROM seen LEFT JOIN short USING (query_idx) WHERE end_ IS NULL OR page_no <= end_)"""


def _captures(spark, sf):
    number = F.substring("source", 4, 9).cast("int")
    thousand = F.floor(F.col("doc_id") / 1000)
    docs = (
        table(spark, sf, "documents")
        .select(
            F.col("doc_id").cast("string").alias("key"),
            "text",
            "lang",
            (number % 4).alias("rank"),
            (number + 20 * thousand).cast("int").alias("query_idx"),
            F.concat(F.lit("Engineer "), F.sha2("text", 256)).alias("title"),
            (F.col("n_chars") % 5).cast("string").alias("days"),
            (F.floor(F.col("doc_id") / 500) % 2 + 1).cast("int").alias("page_no"),
            F.col("doc_id").alias("pos"),
            F.lit("2024-01-31 00:00:00").cast("timestamp").alias("observed_at"),
        )
        .withColumn("platform", board_of(F.col("rank")))
    )
    key, title, age, rank = F.col("key"), F.col("title"), _text("vor ", F.col("days"), " Tagen"), F.col("rank")
    card = (
        F.when(rank == 0, _text(
            '<li><h3 class="base-search-card__title">', title, '</h3><span class="job-search-card__location">Berlin</span>',
            '<a class="base-card__full-link" href="https://de.linkedin.com/jobs/view/', key, '?x=1"></a><time datetime="', age, '"></time></li>'))
        .when(rank == 1, _text(
            '<article data-at="job-item"><a href="/job/', key, '" data-at="job-item-title">', title,
            '</a><span data-at="job-item-location">Berlin</span><time>', age, "</time></article>"))
        .when(rank == 2, _text(
            '<li><a href="/jobs/', key, '?x=1"><h2>', title, '</h2></a><i class="location">Berlin</i></li>'))
        .otherwise(F.to_json(F.struct(
            key.alias("refnr"), title.alias("titel"), age.alias("aktuelleVeroeffentlichungsdatum"),
            F.struct(F.lit("Berlin").alias("ort"), F.lit(" ").alias("land")).alias("arbeitsort"))))
    )
    opening = F.when(F.col("platform") == vocab.LINKEDIN, F.lit('<ul class="jobs-search__results-list">')).when(
        F.col("platform") == vocab.BA, F.lit('{"stellenangebote":[')).otherwise(F.lit("<ul>"))
    closing = F.when(F.col("platform") == vocab.BA, F.lit("]}")).otherwise(F.lit("</ul>"))
    each = F.transform("cards", lambda c: c["card"])
    joined = F.when(F.col("platform") == vocab.BA, F.array_join(each, ",")).otherwise(F.array_join(each, ""))
    cards = F.sort_array(F.collect_list(F.struct("pos", card.alias("card"))))
    search = docs.groupBy("platform", "query_idx", "page_no", "observed_at").agg(cards.alias("cards")).select(
        "platform", "query_idx", "page_no", F.lit("search").alias("kind"), F.lit("").alias("url"),
        F.concat(opening, joined, closing).alias("body"),
        "observed_at",
    )
    url = (
        F.when(rank == 0, _text("https://www.linkedin.com/jobs/view/", key))
        .when(rank == 1, _text("https://www.stepstone.de/job/", key))
        .when(rank == 2, _text("https://www.xing.com/jobs/", key))
        .otherwise(_text(vocab.BA_DETAIL_PREFIX, key))
    )
    text = _escaped(F.col("text"))
    body = (
        F.when(rank == 0, _text('<div id="job-details">', text, "</div>"))
        .when(rank == 1, _text('<div class="jobAdBody">', text, "</div>"))
        .when(rank == 2, _text("<main>", text, '</main><script type="application/ld+json">',
                               F.to_json(F.struct(age.alias("datePosted"))), "</script>"))
        # Spanish texts come from the agency's public page, German ones are missing.
        .when(F.col("lang") == "es", _text("<script id='ng-state'>", _escaped(F.to_json(F.struct(
            F.struct(F.col("text").alias("stellenangebotsBeschreibung")).alias("jobdetail")))), "</script>"))
        .when(F.col("lang") == "de", F.lit("{}"))
        .otherwise(F.to_json(F.struct(F.col("text").alias("beschreibung"))))
    )
    kind = F.when((rank == 3) & (F.col("lang") == "es"), F.lit("detail_public")).otherwise(F.lit("detail"))
    detail = docs.select(
        "platform", F.lit(None).cast("int").alias("query_idx"), F.lit(None).cast("int").alias("page_no"),
        kind.alias("kind"), url.alias("url"), body.alias("body"), "observed_at",
    )
    # Written as a crawler would leave them: many files, one folder per board and kind.
    path = new_run_dir(spark, "captures")
    tasks = spark.sparkContext.defaultParallelism
    search.unionByName(detail).repartition(tasks).write.partitionBy("platform", "kind").parquet(path)
    return read_captures(spark, path)


_RUN_SQL = f"""{_CARDS_SQL},
capped AS (SELECT * FROM reached WHERE rank_ = 2 OR days <= 2),
kept AS (SELECT * FROM capped WHERE (rank_ <> 2 OR days <= 2) AND NOT (rank_ = 3 AND lang = 'de')),
ids AS (SELECT *, sha256(lower(title) || '||' || 'berlin') AS job_id FROM kept),
run_postings AS (SELECT * FROM ids QUALIFY row_number() OVER (PARTITION BY rank_, job_id ORDER BY query_idx, page_no, card_pos) = 1)"""


@query(
    "acquire_run",
    f"""WITH {_RUN_SQL} SELECT job_id, title, {board_sql('rank_')} AS platform, query_idx, page_no, card_pos,
      'vor ' || days || ' Tagen' AS posting_date, 'Berlin' AS location,
      CASE rank_ WHEN 3 THEN {strip_sql('text')} ELSE {strip_sql("regexp_replace(text, '[ ' || chr(9) || chr(10) || chr(13) || ']+', ' ', 'g')")} END AS description
    FROM run_postings""",
)
def acquire_run(spark, sf):
    """Captures of all four boards to postings."""
    found = daily_run.acquire(_captures(spark, sf), new_run_dir(spark, "run"))
    return found.select(
        "job_id", "title", "platform", "query_idx", "page_no", "card_pos", "posting_date", "location", "description"
    )


def _by_length(rows):
    """A score from the text itself, so that the run needs no model."""
    score = (F.length("description") % 10 + 1).cast("int")
    return rows.withColumns(
        {"llm_score": score, "llm_reason": F.lit("by length"), "match": score >= vocab.MATCH_THRESHOLD}
    )


@query(
    "daily_run",
    f"""WITH {_RUN_SQL}, earlier AS (SELECT sha256('engineer ' || sha256(text) || '||berlin') AS job_id FROM documents JOIN labels USING (doc_id)),
    scored AS (SELECT *, length(CASE rank_ WHEN 3 THEN {strip_sql('text')}
        ELSE {strip_sql("regexp_replace(text, '[ ' || chr(9) || chr(10) || chr(13) || ']+', ' ', 'g')")} END) % 10 + 1 AS score
      FROM run_postings WHERE job_id NOT IN (SELECT job_id FROM earlier)),
    delivered AS (SELECT * FROM scored WHERE score >= 7
      QUALIFY row_number() OVER (PARTITION BY job_id ORDER BY rank_, query_idx, page_no, card_pos) = 1)
    SELECT job_id, {board_sql('rank_')} AS platform, (SELECT count(*) FROM delivered) AS new_jobs,
      (SELECT count(DISTINCT job_id) FROM earlier) AS ledger_before FROM delivered""",
)
def whole_run(spark, sf):
    """Captures to digest and ledger, over a ledger made from the labels."""
    run_dir = new_run_dir(spark, "run")
    path = f"{run_dir}/ledger"
    labelled = table(spark, sf, "documents").join(table(spark, sf, "labels"), "doc_id", "left_semi")
    earlier = labelled.select(
        F.sha2(_text("engineer ", F.sha2("text", 256), "||berlin"), 256).alias("job_id"),
        F.lit("").alias("url"),
        F.lit("").alias("platform"),
    )
    ledger.append_ledger(earlier, path, "earlier", F.lit("2024-01-01 00:00:00").cast("timestamp"))
    found = daily_run.acquire(_captures(spark, sf), run_dir)
    summary = daily_run.deliver(found, _by_length, path, run_dir, "today", _as_of())
    counts = summary.select("new_jobs", "ledger_before")
    sent = ledger.read_ledger(spark, path).filter("run_id = 'today'").select("job_id", "platform")
    run = counts.first()
    return sent.withColumns(
        {"new_jobs": F.lit(run.new_jobs).cast("bigint"), "ledger_before": F.lit(run.ledger_before).cast("bigint")}
    )


@query(
    "incremental_run",
    f"""WITH {POSTINGS_SQL}, drops AS (SELECT *, location = 'en' AS early FROM postings WHERE length(description) % 10 + 1 >= 7),
    firsts AS (SELECT job_id, platform, early FROM drops
      QUALIFY row_number() OVER (PARTITION BY job_id ORDER BY early DESC, platform_rank, {_ORDER}) = 1)
    SELECT job_id, platform, CASE WHEN early THEN 'batch-0000000000' ELSE 'batch-0000000001' END AS batch FROM firsts""",
)
def incremental(spark, sf):
    """Two arrivals of files, three calls: the English postings, then all of them, then
    nothing new. What the first run sent is not sent again."""
    state = new_run_dir(spark, "incremental")
    source = f"{state}/captures"
    rows = postings(spark, sf)
    columns = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema.fields)

    def run():
        return incremental_run(
            spark, source, columns, state, lambda batch, run_dir: batch, _by_length, _as_of()
        )

    rows.filter("location = 'en'").write.parquet(source)
    run()
    rows.write.mode("append").parquet(source)
    run()
    batch = F.regexp_extract("run_id", r"batch-\d+$", 0)
    return ledger.read_ledger(spark, run()).select("job_id", "platform", batch.alias("batch"))


_CHECK_SQL = f"""{_RUN_SQL},
tested AS (SELECT *, rank_ = 2 OR days <= 2 AS date_ok, NOT contains(title, '77') AS title_ok FROM reached),
described AS (SELECT *, CASE WHEN rank_ = 3 AND lang = 'de' THEN '' WHEN rank_ = 3 THEN {strip_sql('text')}
    ELSE {strip_sql("regexp_replace(text, '[ ' || chr(9) || chr(10) || chr(13) || ']+', ' ', 'g')")} END AS description FROM tested)"""


@query(
    "source_check",
    f"""WITH {_CHECK_SQL} SELECT {board_sql('rank_')} AS platform, query_idx, count(*) AS cards, count(*) AS loc,
      count(*) FILTER (date_ok) AS date, count(*) FILTER (date_ok AND title_ok) AS title, count(*) FILTER (date_ok AND title_ok) AS detail,
      count(*) FILTER (date_ok AND title_ok AND length(description) % 10 + 1 >= 7) AS matched
    FROM described GROUP BY rank_, query_idx""",
)
def check_funnel(spark, sf):
    """All boards measured without cap and ledger."""
    counts, _ = check_source(
        _captures(spark, sf), new_run_dir(spark, "check"), _by_length, ["all"], F.lit("2024-01-31T00:00:00"),
        blocks=["77"],
    )
    return counts


@query(
    "source_check_unfiltered",
    f"""WITH {_CHECK_SQL}, hashed AS (SELECT *, sha256(lower(title) || '||berlin') AS job_id FROM described)
    SELECT job_id, {board_sql('rank_')} AS platform, query_idx, page_no, card_pos, length(description) AS chars FROM hashed
    QUALIFY row_number() OVER (PARTITION BY job_id ORDER BY rank_, query_idx, page_no, card_pos) = 1""",
)
def check_unfiltered(spark, sf):
    """Every card as a match: the unique postings."""
    _, unique = check_source(
        _captures(spark, sf), new_run_dir(spark, "check"), _by_length, ["all"], F.lit("2024-01-31T00:00:00"),
        apply_filters=False,
    )
    return unique.select(
        "job_id", "platform", "query_idx", "page_no", "card_pos", F.length("description").cast("bigint").alias("chars")
    )


# --- other countries, broken pages, replays ---------------------------------------------------


@query(
    "country_run",
    f"""WITH {_RUN_SQL}, served AS (SELECT * FROM kept WHERE rank_ IN (0, 1))
    SELECT DISTINCT sha256(lower(title) || '||' || 'berlin') AS job_id, {board_sql('rank_')} AS platform,
      CASE rank_ WHEN 0 THEN 'https://www.linkedin.com' ELSE 'https://www.stepstone.at' END AS site,
      {strip_sql("regexp_replace(text, '[ ' || chr(9) || chr(10) || chr(13) || ']+', ' ', 'g')")} AS description FROM served""",
)
def country_run(spark, sf):
    """Captures taken for Austria: StepStone's links lead to its Austrian site, and the boards that
    do not serve the country are left out."""
    url = F.replace("url", F.lit("www.stepstone.de"), F.lit("www.stepstone.at"))
    # The first test of a place is on Germany; here every card's place is in Austria.
    body = F.replace("body", F.lit(">Berlin<"), F.lit(">Wien, Austria<"))
    captures = _captures(spark, sf).withColumns({"url": url, "body": body})
    found = daily_run.acquire(captures, new_run_dir(spark, "run"), country="Austria")
    named = F.sha2(F.concat(F.lower("title"), F.lit("||berlin")), 256)
    site = F.regexp_extract("url", "^https://[^/]+", 0)
    return found.select(named.alias("job_id"), "platform", site.alias("site"), "description")


@query(
    "digest_html",
    f"""WITH {_NUMBERED_SQL}, digests AS (SELECT DISTINCT lang AS digest_id FROM documents UNION ALL SELECT 'none')
    SELECT d.digest_id, count(n.doc_id) AS entries, coalesce(max(n.total), 0) AS stated,
      'Germany AI/Robotics Job Update – 2024-01-31' AS subject
    FROM digests d LEFT JOIN numbered n ON n.digest_id = d.digest_id GROUP BY d.digest_id""",
)
def digest_html(spark, sf):
    """HTML digests with their subject: entries counted in the bodies, and the total they state."""
    wanted = table(spark, sf, "documents").select(F.explode(F.array("lang", F.lit("none"))).alias("digest_id"))
    parts = digest.digest_assemble(wanted, _numbered(spark, sf), F.lit("2024-01-31"), entries_per_part=_PER_PART, html=True)
    entries = F.size(F.split("body", "<section>")) - 1
    stated = F.regexp_extract("body", r"<p>Total new jobs: (\d+)</p>", 1).try_cast("bigint")
    counted = parts.groupBy("digest_id").agg(
        F.sum(entries).alias("entries"), F.coalesce(F.max(stated), F.lit(0)).alias("stated")
    )
    return counted.withColumn("subject", digest.subject("Germany", F.lit("2024-01-31")))


def _as_cache(documents, path):
    """Documents' postings as indented JSON files, a file for each thousand, in the order of their ids. Each line is
    an entry: rows are dealt and sorted as documents, which hold their text once, and no file becomes a single row. An entry
    shows its text twice, so the files are written compressed."""
    order = ["doc_id", "text", "lang", "source", "n_chars"]
    whole = Window.partitionBy("thousand")
    placed = documents.select(*order, F.floor(F.col("doc_id") / 1000).alias("thousand")).repartition("thousand").withColumns(
        {"place": F.row_number().over(whole.orderBy(*order)), "last": F.count("*").over(whole)}
    )
    rows = as_postings(placed.sortWithinPartitions("thousand", "place"), "thousand", "place", "last")
    names = ["title", "company", "location", "url", "posting_date", "platform", "experience_level", "description", "job_id"]
    fields = [F.concat(F.lit(f'    "{n}": '), F.expr(f"substring(to_json(array({n})), 2, length(to_json(array({n}))) - 2)")) for n in names]
    entry = F.concat(F.lit("  {\n"), F.concat_ws(",\n", *fields), F.lit("\n  }"))
    opening = F.when(F.col("place") == 1, F.lit("[\n")).otherwise(F.lit(""))
    closing = F.when(F.col("place") == F.col("last"), F.lit("\n]")).otherwise(F.lit(","))
    rows.select("thousand", F.concat(opening, entry, closing).alias("value")).write.partitionBy("thousand").text(path, compression="lz4")


@query(
    "cache_replay",
    f"""WITH {POSTINGS_SQL}, matched AS (SELECT * FROM postings WHERE length(description) % 10 + 1 >= 7),
    delivered AS (SELECT * FROM matched QUALIFY row_number() OVER (PARTITION BY job_id ORDER BY platform_rank, doc_id) = 1)
    SELECT job_id, platform, (SELECT count(*) FROM delivered) AS new_jobs FROM delivered""",
)
def cache_replay(spark, sf):
    """A JSON cache of all postings, read back and delivered."""
    run_dir = new_run_dir(spark, "replay")
    _as_cache(table(spark, sf, "documents"), f"{run_dir}/cache")
    found = files.materialise(files.read_scrape_cache(spark, f"{run_dir}/cache"), f"{run_dir}/postings")
    summary = daily_run.deliver(found, _by_length, f"{run_dir}/ledger", run_dir, "today", _as_of())
    sent = ledger.read_ledger(spark, f"{run_dir}/ledger").select("job_id", "platform")
    return sent.withColumn("new_jobs", summary.select("new_jobs").scalar())


@query(
    "incremental_captures",
    f"""WITH {_RUN_SQL}, scored AS (SELECT *, length(CASE rank_ WHEN 3 THEN {strip_sql('text')}
        ELSE {strip_sql("regexp_replace(text, '[ ' || chr(9) || chr(10) || chr(13) || ']+', ' ', 'g')")} END) % 10 + 1 AS score FROM run_postings)
    SELECT job_id, {board_sql('rank_')} AS platform, 'batch-0000000001' AS batch FROM scored WHERE score >= 7
    QUALIFY row_number() OVER (PARTITION BY job_id ORDER BY rank_, query_idx, page_no, card_pos) = 1""",
)
def incremental_captures(spark, sf):
    """Search pages first, their detail pages in the next batch, then nothing new."""
    state = new_run_dir(spark, "incremental")
    source, found = f"{state}/captures", _captures(spark, sf)

    def run():
        return incremental_run(spark, source, schema.CAPTURES, state, from_captures(), _by_length, _as_of())

    found.filter("kind = 'search'").write.parquet(source)
    run()
    found.filter("kind <> 'search'").write.mode("append").parquet(source)
    run()
    batch = F.regexp_extract("run_id", r"batch-\d+$", 0)
    return ledger.read_ledger(spark, run()).select("job_id", "platform", batch.alias("batch"))
