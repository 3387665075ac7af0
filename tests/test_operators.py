"""First occurrences, numbering, digests, scoring, ledger and incremental runs."""

import datetime
import json
import random

import pytest
from pyspark.errors import AnalysisException, SparkRuntimeException
from pyspark.sql import functions as F

from stellwerk import schema, vocab
from stellwerk.operators import digest, frontier, funnel, identity, metrics, numbering, scoring
from stellwerk.plans import daily_run
from stellwerk.sources import files, ledger, registry
from stellwerk.streaming.incremental import incremental_run

NOW = datetime.datetime(2024, 1, 31)


def make_postings(spark, rows):
    """Rows of (job_id, platform, query_idx, page_no, card_pos)."""
    full = [
        (j, f"Title {j}", "C", "L", f"https://x/{j}", "", p, "", "d", "s", vocab.PLATFORM_RANK[p], q, n, c, NOW)
        for j, p, q, n, c in rows
    ]
    return spark.createDataFrame(full, schema.POSTINGS)


def skewed_rows(n=3000):
    """A third of all rows is one posting; the rest are spread over 200."""
    rng = random.Random(7)
    platforms = list(vocab.PLATFORM_RANK)
    rows = []
    for i in range(n):
        job = "hot" if i % 3 == 0 else f"j{rng.randrange(200)}"
        rows.append((job, rng.choice(platforms), rng.randrange(5), i // 25 % 4, i))
    return rows


def in_order(rows):
    return sorted(rows, key=lambda r: (vocab.PLATFORM_RANK[r[1]], r[2], r[3], r[4]))


def first_rows(rows, key):
    seen = {}
    for row in in_order(rows):
        seen.setdefault(key(row), row)
    return sorted(seen.values())


@pytest.mark.parametrize("partitions", [1, 7])
def test_first_occurrences_do_not_depend_on_partitions(spark, partitions):
    rows = skewed_rows()
    frame = make_postings(spark, [*rows, ("", vocab.XING, 0, 0, -1)]).repartition(partitions)
    pick = ["job_id", "platform", "query_idx", "page_no", "card_pos"]
    platform = identity.first_per_platform(frame).select(*pick).collect()
    assert sorted(map(tuple, platform)) == first_rows(rows, lambda r: (r[0], r[1]))
    overall = identity.first_global(frame).select(*pick).collect()
    assert sorted(map(tuple, overall)) == first_rows(rows, lambda r: r[0])


def test_first_global_is_the_first_match(spark):
    """An unmatched earlier row must not hide a matched later one."""
    rows = make_postings(spark, [("a", vocab.LINKEDIN, 0, 0, 0), ("a", vocab.XING, 0, 0, 0)])
    scored = rows.withColumn("match", F.col("platform") == vocab.XING)
    kept = identity.first_global(scoring.matched_only(scored)).collect()
    assert [r.platform for r in kept] == [vocab.XING]


@pytest.mark.parametrize("partitions", [1, 7])
def test_numbers_are_the_positions_in_order(spark, partitions):
    rows = skewed_rows(1000)
    frame = make_postings(spark, rows).withColumn("digest_id", F.when(F.col("job_id") == "hot", "a").otherwise("b"))
    numbered = numbering.number_rows(frame.repartition(partitions), ["digest_id"], schema.ORDER_COLUMNS, "n", "total")
    for name in ("a", "b"):
        mine = [r for r in rows if (r[0] == "hot") == (name == "a")]
        got = numbered.filter(F.col("digest_id") == name).orderBy("n").collect()
        assert [r.n for r in got] == list(range(1, len(mine) + 1))
        assert [(r.platform, r.query_idx, r.page_no, r.card_pos) for r in got] == [r[1:] for r in in_order(mine)]
        assert {r.total for r in got} == {len(mine)}


def test_pagination_stop(spark):
    # query 1: page 1 empty; 2: page 2 short; 3: none
    rows = [(1, 1, 0), (1, 2, 25), (2, 1, 25), (2, 2, 24), (2, 3, 25), (3, 1, 25), (3, 2, 25)]
    pages = spark.createDataFrame(rows, "q int, page_no int, n int")
    kept = funnel.pagination_stop(pages, ["q"], F.col("n") < 25).select("q", "page_no").collect()
    assert sorted(map(tuple, kept)) == [(1, 1), (2, 1), (2, 2), (3, 1), (3, 2)]


def test_funnel_is_cumulative(spark):
    rows = [("A", 0, True, True, False, True, True), ("A", 0, False, True, True, True, True), ("A", 1, True, True, True, True, None)]
    names = "platform string, query_idx int, location_ok boolean, date_ok boolean, title_ok boolean, detailed boolean, match boolean"
    table = metrics.funnel_by_query(spark.createDataFrame(rows, names))
    assert sorted(tuple(r) for r in table.collect()) == [("A", 0, 2, 1, 1, 0, 0, 0), ("A", 1, 1, 1, 1, 1, 1, 0)]
    totals = {(r.platform, r.query_idx): r.cards for r in metrics.funnel_total(table).collect()}
    assert totals == {("A", 0): 2, ("A", 1): 1, ("A TOTAL", None): 3, ("TOTAL", None): 3}


def test_frontier(spark):
    searches = frontier.search_query_table(spark).withColumn("country", F.lit("Netherlands"))
    served = frontier.search_frontier(frontier.platform_country(searches))
    by_board = {r.platform: r["count"] for r in served.groupBy("platform").count().collect()}
    assert by_board == {vocab.LINKEDIN: 44, vocab.STEPSTONE: 40}
    assert {r.route for r in served.filter(F.col("platform") == vocab.STEPSTONE).collect()} == {"vacatures"}
    germany = frontier.platform_country(searches.withColumn("country", F.lit("germany")), disabled=[vocab.BA])
    assert {r.platform for r in germany.collect()} == {vocab.LINKEDIN, vocab.XING}


# --- scoring ------------------------------------------------------------------------------


def make_attempts(spark, rows):
    """Rows of (job, model, rank, raw, error, started minute, answered minute)."""
    minute = lambda m: NOW + datetime.timedelta(minutes=m)
    full = [("run", j, m, k, raw, err, minute(a), minute(b)) for j, m, k, raw, err, a, b in rows]
    return spark.createDataFrame(full, schema.ATTEMPTS)


def test_first_valid_response(spark):
    rows = [
        ("good", "p", 0, '{"score": 9}', None, 0, 1),
        ("good", "s", 1, '{"score": 2}', None, 0, 2),
        ("spare", "p", 0, "no json", None, 0, 1),
        ("spare", "s", 1, '{"score": 8}', None, 0, 2),
        ("retried", "p", 0, None, "rate limit", 0, 1),
        ("retried", "p", 0, '{"score": 7}', None, 0, 2),
        ("bad", "p", 0, "x", None, 0, 1),
        ("bad", "s", 1, '{"score": "x"}', None, 0, 2),
    ]
    attempts = make_attempts(spark, rows)
    verdicts = scoring.first_valid_response(attempts, ["job_id"])
    got = {r.job_id: (r.model, r.score) for r in verdicts.collect()}
    assert got == {"good": ("p", 9), "spare": ("s", 8), "retried": ("p", 7)}
    jobs = attempts.select("job_id").distinct()
    scored = {r.job_id: (r.llm_score, r.match, r.llm_reason) for r in scoring.join_responses(jobs, verdicts, ["job_id"]).collect()}
    assert scored["bad"] == (0, False, vocab.FALLBACK_REASON) and scored["retried"] == (7, True, "")


def test_model_is_disabled_for_later_jobs_only(spark):
    rows = [
        ("a", "p", 0, None, "429: tokens per day", 0, 5),
        ("b", "p", 0, '{"score": 9}', None, 5, 6),
        ("c", "p", 0, '{"score": 9}', None, 6, 7),
        ("c", "s", 1, '{"score": 3}', None, 6, 8),
        ("d", "s", 1, None, "rate limit", 0, 1),
        ("e", "s", 1, '{"score": 3}', None, 9, 9),
    ]
    left = scoring.drop_disabled_attempts(make_attempts(spark, rows)).collect()
    assert sorted((r.job_id, r.model) for r in left) == [("a", "p"), ("b", "p"), ("c", "s"), ("d", "s"), ("e", "s")]


def test_scorers_are_tried_in_order_and_called_once(spark, tmp_path):
    def first(message):
        open(f"{tmp_path}/{abs(hash(message))}-{random.random()}", "w").close()
        if "Title a" in message:
            raise ValueError("down")
        return "no json" if "Title b" in message else {"score": 8, "reason": "ü"}

    def second(message):
        return '{"score": 3}' if "Title a" in message else ""

    rows = make_postings(spark, [(j, vocab.XING, 0, 0, n) for n, j in enumerate("abc")])
    scored = scoring.score_with(rows, [first, second], concurrency=2)
    path = str(tmp_path / "scored")
    got = {r.job_id: (r.llm_score, r.match, r.llm_reason) for r in files.materialise(scoring.matched_only(scored).unionByName(scored.filter("not match")), path).collect()}
    assert got == {"a": (3, False, ""), "b": (0, False, vocab.FALLBACK_REASON), "c": (8, True, "ü")}


def test_broken_scoring_stops_unless_told_to_pass(spark, tmp_path):
    rows = make_postings(spark, [("a", vocab.XING, 0, 0, 0)])
    broken = lambda df: scoring.pass_all(df).withColumn("llm_reason", F.raise_error(F.lit("gone")).cast("string"))
    with pytest.raises(SparkRuntimeException):
        scoring.score_or_pass(rows, broken, str(tmp_path / "a"))
    passed = scoring.score_or_pass(rows, broken, str(tmp_path / "b"), "pass_all").collect()
    assert [(r.job_id, r.match, r.llm_score) for r in passed] == [("a", True, 0)]


# --- digest -------------------------------------------------------------------------------


def scored_rows(spark, n):
    rows = make_postings(spark, [(f"j{i}", vocab.XING, 0, i // 25, i) for i in range(n)])
    return rows.withColumns({"llm_score": F.lit(8), "llm_reason": F.lit("fits"), "digest_id": F.lit("d")})


def test_plain_digest_text(spark):
    rows = scored_rows(spark, 2).withColumn("llm_score", F.when(F.col("job_id") == "j0", 8).otherwise(0))
    wanted = spark.createDataFrame([("d",), ("empty",)], "digest_id string")
    parts = digest.digest_assemble(wanted, digest.digest_number(rows), F.lit("2024-01-31"), "Austria")
    bodies = {r.digest_id: r.body for r in parts.collect()}
    rule = "-" * 60
    assert bodies["d"] == (
        "NEW JOBS FOUND  (2024-01-31)\n" + "=" * 60 + "\n\n"
        "[1]  Title j0\n  Company   : C\n  Location  : L\n  Platform  : Xing\n  Experience: \n  Posted    : \n"
        f"  Link      : https://x/j0\n\n  AI Score  : 8/10\n  AI Verdict: fits\n\n{rule}\n\n"
        "[2]  Title j1\n  Company   : C\n  Location  : L\n  Platform  : Xing\n  Experience: \n  Posted    : \n"
        f"  Link      : https://x/j1\n\n  AI Verdict: fits\n\n{rule}\n\n"
        "Total new jobs: 2\n\n-- Austria job digest --"
    )
    assert bodies["empty"] == "No new relevant jobs found in this cycle.\n\nDate: 2024-01-31"


def test_digest_parts_join_to_the_same_text(spark):
    numbered = digest.digest_number(scored_rows(spark, 57))
    wanted = spark.createDataFrame([("d",)], "digest_id string")
    texts = []
    for size in (500, 10):
        parts = digest.digest_assemble(wanted, numbered, F.lit("2024-01-31"), entries_per_part=size)
        texts.append("\n".join(r.body for r in parts.orderBy("part_no").collect()))
    assert texts[0] == texts[1] and "[57]  Title j" in texts[0]


def test_html_digest_escapes_values(spark):
    rows = scored_rows(spark, 1).withColumns({"title": F.lit("<b>R&D</b>"), "llm_reason": F.lit('"x" < y')})
    wanted = spark.createDataFrame([("d",), ("empty",)], "digest_id string")
    parts = digest.digest_assemble(wanted, digest.digest_number(rows), F.lit("2024-01-31"), html=True)
    bodies = {r.digest_id: r.body for r in parts.collect()}
    assert "1. &lt;b&gt;R&amp;D&lt;/b&gt;" in bodies["d"] and "&quot;x&quot; &lt; y" in bodies["d"]
    assert "★★★★★★★★☆☆" in bodies["d"] and bodies["d"].endswith("</body></html>")
    assert "No new relevant jobs" in bodies["empty"]


# --- files, ledger, sources ---------------------------------------------------------------


def test_ledger_round(spark, tmp_path):
    path = str(tmp_path / "ledger")
    assert ledger.read_ledger(spark, path).count() == 0
    rows = make_postings(spark, [("a", vocab.XING, 0, 0, 0), ("b", vocab.XING, 0, 0, 1), ("", vocab.XING, 0, 0, 2)])
    day = lambda d: F.lit(f"2024-01-{d:02d} 00:00:00").cast("timestamp")
    ledger.append_ledger(rows, path, "r1", day(1))
    ledger.append_ledger(rows.filter("job_id = 'a'"), path, "r2", day(2))
    ledger.append_ledger(rows.filter("job_id = 'a'"), path, "r2", day(2))
    everything = ledger.read_ledger(spark, path)
    assert everything.count() == 3
    latest = {r.job_id: r.date_sent.day for r in ledger.latest_records(everything).collect()}
    assert latest == {"a": 2, "b": 1}
    assert ledger.total_count(everything).first().records == 2
    assert ledger.read_ledger(spark, path, except_run="r1").count() == 1
    assert identity.anti_ledger(rows, everything).count() == 0
    assert identity.already_sent(rows, everything).count() == 2


def test_unreadable_ledger_is_an_error(spark, tmp_path):
    folder = tmp_path / "ledger" / "run_id=x"
    folder.mkdir(parents=True)
    (folder / "part.parquet").write_text("not parquet")
    with pytest.raises(Exception):
        ledger.read_ledger(spark, str(tmp_path / "ledger")).count()


def test_json_ledger_and_cache_import(spark, tmp_path):
    records = {
        f"id{n}": {"job_id": f"id{n}", "url": 'u "quoted" },\n', "platform": "Xing", "date_sent": "2024-01-15T08:32:00"}
        for n in range(500)
    }
    path = tmp_path / "ledger.json"
    path.write_text(json.dumps(records, indent=2, ensure_ascii=False))
    rows = ledger.import_json_ledger(spark, str(path)).collect()
    assert {r.job_id for r in rows} == set(records) and len(rows) == 500
    assert rows[0].date_sent == datetime.datetime(2024, 1, 15, 8, 32) and rows[0].url == 'u "quoted" },\n'
    cache = tmp_path / "cache.json"
    cache.write_text(json.dumps([{"title": "T {x}", "description": "a\n  },\nb", "job_id": "1"}, {"title": "U"}], indent=2))
    got = files.read_scrape_cache(spark, str(cache)).select("title", "description", "job_id").collect()
    assert sorted(map(tuple, got)) == [("T {x}", "a\n  },\nb", "1"), ("U", None, None)]
    for empty in ("{}", "[]"):
        path.write_text(empty)
        assert ledger.import_json_ledger(spark, str(path)).count() == 0
    path.write_text('{\n  "a": {\n    "job_id": broken\n  }\n}')
    with pytest.raises(Exception):
        ledger.import_json_ledger(spark, str(path)).collect()


def test_missing_snapshot_is_an_error(spark, tmp_path):
    with pytest.raises(AnalysisException):
        files.read_snapshot(spark, str(tmp_path / "none"))


def test_failing_source_is_left_out(spark, tmp_path):
    good = lambda s: s.range(3).withColumn("x", F.lit("a"))
    bad = lambda s: s.range(3).withColumn("x", F.raise_error(F.lit("boom")).cast("string"))
    other = lambda s: s.range(2).withColumn("y", F.lit("b"))
    done = registry.materialise_sources(spark, {"good": good, "bad": bad, "other": other}, str(tmp_path))
    union = registry.union_platforms(done)
    assert list(done) == ["good", "other"] and union.count() == 5 and set(union.columns) == {"id", "x", "y", "platform_rank"}


# --- runs ---------------------------------------------------------------------------------


def all_match(rows):
    return rows.withColumns({"llm_score": F.lit(9), "llm_reason": F.lit(""), "match": F.lit(True)})


def test_undelivered_run_leaves_the_ledger_alone(spark, tmp_path):
    rows = make_postings(spark, [("a", vocab.XING, 0, 0, 0)])
    path, sent = str(tmp_path / "ledger"), F.lit(NOW)
    run = lambda send: daily_run.deliver(rows, all_match, path, str(tmp_path / "run"), "r1", sent, send=send)
    run(lambda parts, html: False)
    assert ledger.read_ledger(spark, path).count() == 0
    seen = []
    summary = run(lambda parts, html: seen.extend([parts.first(), html.first()]) or True).first()
    assert (summary.new_jobs, summary.ledger_before, summary.ledger_after) == (1, 0, 1) and "[1]  Title a" in seen[0].body
    assert "<h2>1. Title a</h2>" in seen[1].body and seen[0].subject == seen[1].subject != ""
    # the same run again gives the same ledger; another run has nothing left to send
    assert run(None).first().new_jobs == 1 and ledger.read_ledger(spark, path).count() == 1
    later = daily_run.deliver(rows, all_match, path, str(tmp_path / "run2"), "r2", sent).first()
    assert (later.new_jobs, later.ledger_before, later.ledger_after) == (0, 1, 1)


def test_incremental_run_survives_a_failed_batch(spark, tmp_path):
    source, state = str(tmp_path / "in"), str(tmp_path / "state")
    batch = lambda *jobs: make_postings(spark, [(j, vocab.XING, 0, 0, n) for n, j in enumerate(jobs)])
    sends = []

    def run(fail=False):
        def send(parts, html):
            if fail:
                raise OSError("mail server down")
            sends.append(sorted(line.split()[-1] for line in "\n".join(r.body for r in parts.collect()).split("\n") if line.startswith("[")))
            return True

        return incremental_run(spark, source, schema.POSTINGS, state, lambda df, _: df, all_match, F.lit(NOW), send=send)

    batch("a", "b", "a").write.parquet(source)
    with pytest.raises(Exception):
        run(fail=True)
    path = run()
    batch("b", "c").write.mode("append").parquet(source)
    run()
    run()
    assert sends == [["a", "b"], ["c"]]
    got = sorted((r.job_id, r.run_id[-1]) for r in ledger.read_ledger(spark, path).collect())
    assert got == [("a", "0"), ("b", "0"), ("c", "1")]


def test_new_checkpoint_over_an_old_ledger_keeps_every_row(spark, tmp_path):
    source, state = str(tmp_path / "in"), tmp_path / "state"
    make_postings(spark, [(j, vocab.XING, 0, 0, n) for n, j in enumerate("abc")]).write.parquet(source)
    run = lambda: incremental_run(spark, source, schema.POSTINGS, str(state), lambda df, _: df, all_match, F.lit(NOW))
    path = run()
    (state / "checkpoint").rename(tmp_path / "old-checkpoint")
    make_postings(spark, [("d", vocab.XING, 0, 0, 3)]).write.mode("append").parquet(source)
    run()
    rows = ledger.read_ledger(spark, path).collect()
    assert sorted(r.job_id for r in rows) == ["a", "b", "c", "d"] and len({r.run_id for r in rows}) == 2


def test_no_source_left(spark):
    none = registry.union_platforms({}, spark)
    assert none.count() == 0 and "platform_rank" in none.columns


def test_failed_source_does_not_shift_ranks(spark, tmp_path):
    def broken(session):
        raise OSError("down")

    sources = {"a": broken, "b": lambda session: session.range(2)}
    union = registry.union_platforms(registry.materialise_sources(spark, sources, str(tmp_path)))
    assert {r.platform_rank for r in union.collect()} == {1}


def test_no_limit_means_no_cut():
    assert frontier.served_boards("Austria") == {vocab.LINKEDIN: "www.linkedin.com", vocab.STEPSTONE: "www.stepstone.at"}
    assert set(frontier.served_boards("germany")) == {vocab.LINKEDIN, vocab.XING, vocab.BA}
    assert vocab.XING not in frontier.served_boards("Germany", [vocab.XING])


def test_calls_run_at_once(spark):
    rows = make_postings(spark, [(str(n), vocab.XING, 0, 0, n) for n in range(8)]).coalesce(1)
    assert {r.llm_score for r in scoring.score_with(rows, [make_scorer()], calls_per_task=4).collect()} == {9}


def make_scorer():
    """A scorer that only answers while four calls are under way."""

    def scorer(message):
        import threading

        state = globals().setdefault("_calls", {"barrier": threading.Barrier(4)})
        state["barrier"].wait(timeout=20)
        return {"score": 9, "reason": "r"}

    return scorer


def test_exhausted_models_are_not_asked(spark):
    postings = make_postings(spark, [("a", vocab.XING, 0, 0, 0)])
    gone = spark.createDataFrame([("m1",)], "model string")
    rows = scoring.request_table(postings, F.lit("s"), scoring.model_list(" m1, m2,,m3 "), gone).collect()
    assert sorted((r.model_rank, r.model) for r in rows) == [(1, "m2"), (2, "m3")]


def test_digest_has_no_join(spark):
    rows = make_postings(spark, [("a", vocab.XING, 0, 0, 0)]).transform(all_match)
    for name in (F.lit("d"), F.col("platform")):
        numbered = digest.digest_number(rows.withColumn("digest_id", name))
        parts = digest.digest_assemble(spark.createDataFrame([("d",)], "digest_id string"), numbered, F.lit("x"))
        text = parts._jdf.queryExecution().executedPlan().toString()
        assert "NestedLoop" not in text
        above = text[: text.index("collect_list")]
        assert "Join" not in above
    assert {r.digest_id for r in parts.collect()} == {"d", vocab.XING}
