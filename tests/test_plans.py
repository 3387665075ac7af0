"""What the physical plans must look like."""

import json
import re
from datetime import datetime

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from stellwerk.checks import QUERIES, flow
from stellwerk.operators import funnel, identity, scoring
from stellwerk.sources import captures, files, ledger

SF_DIR = "/root/testdata/sf0.001"
PYTHON = re.compile(r"\b(ArrowEvalPython|BatchEvalPython|MapInPandas|MapInArrow|FlatMapGroups\w*)\b")

# Queries whose operators read HTML, unescape HTML or call a scorer.
USES_PYTHON = {
    "cards_linkedin", "cards_stepstone", "cards_xing", "cards_html", "first_url_in_page", "detail_html",
    "detail_description", "detail_experience", "embedded_state", "score_with", "detail_html_broken",
}
# Queries that write and read back; their plans only show the reading.
WRITES = {
    "src_pages", "snapshot_read", "source_registry", "ledger_read", "ledger_append", "ledger_lookup", "digest_sink",
    "report_sink", "bypass_scoring", "acquire_run", "daily_run", "incremental_run", "source_check",
    "source_check_unfiltered", "country_run", "cache_replay", "incremental_captures", "score_waves",
}


def plan(frame) -> str:
    return frame._jdf.queryExecution().executedPlan().toString()


def lines_of(frame, node: str) -> list[int]:
    return [n for n, line in enumerate(plan(frame).splitlines()) if re.search(rf"\b{node}\b", line)]


@pytest.mark.parametrize("name", sorted(set(QUERIES) - USES_PYTHON - WRITES))
def test_native_queries_stay_in_the_jvm(spark, name):
    text = plan(entry.queries()[name](spark, SF_DIR))
    assert not PYTHON.search(text)
    assert "CartesianProduct" not in text and "BroadcastNestedLoopJoin" not in text


@pytest.mark.parametrize("name", ["cards_linkedin", "cards_stepstone", "cards_xing", "cards_html", "detail_html", "embedded_state"])
def test_a_page_is_parsed_once(spark, name):
    assert len(lines_of(entry.queries()[name](spark, SF_DIR), "ArrowEvalPython")) == 1


@pytest.mark.parametrize("name", ["cap_details", "first_per_platform", "first_global", "first_valid_response"])
def test_groups_are_pruned_before_the_shuffle(spark, name):
    text = plan(entry.queries()[name](spark, SF_DIR))
    final, partial = text.index(", Final"), text.index(", Partial")
    assert final < text.index("Exchange hashpartitioning", final) < partial


def test_ledger_test_runs_below_scoring(spark):
    rows, sent = spark.range(10).selectExpr("cast(id as string) job_id"), spark.range(3).selectExpr("cast(id as string) job_id")
    for name in ("title", "company", "location", "platform", "experience_level", "description"):
        rows = rows.withColumn(name, F.lit("x"))
    scored = scoring.score_with(identity.anti_ledger(rows, sent), [lambda message: {"score": 9}])
    assert max(lines_of(scored, "ArrowEvalPython")) < min(n for n, l in enumerate(plan(scored).splitlines()) if "LeftAnti" in l)


def test_filters_and_columns_reach_the_scan(spark, tmp_path):
    path = str(tmp_path / "postings")
    files.write_snapshot(spark.range(5).selectExpr("cast(id as string) job_id", "'Xing' platform", "'long' description"), path)
    frame = files.read_snapshot(spark, path).filter("platform = 'Xing'").select("job_id")
    scan = plan(frame)
    assert "EqualTo(platform,Xing)" in scan and "ReadSchema: struct<job_id:string,platform:string>" in scan


def test_counting_combines_before_the_shuffle(spark):
    text = plan(entry.queries()["funnel_by_query"](spark, SF_DIR))
    exchange = text.index("Exchange hashpartitioning(platform")
    assert "partial_count" in text[exchange:]


def test_bucketed_ledger_is_not_shuffled(spark, tmp_path):
    rows = spark.range(200).selectExpr(
        "cast(id % 50 as string) job_id", "'u' url", "'Xing' platform", "timestamp_seconds(id) date_sent", "'r' run_id"
    )
    ledger.save_bucketed(rows, "bucketed_ledger", 4, str(tmp_path / "bucketed"))
    postings = spark.range(100).selectExpr("cast(id as string) job_id", "'x' title")
    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        left = identity.anti_ledger(postings, spark.table("bucketed_ledger"))
        assert left.count() == 50
        assert len(lines_of(left, "Exchange")) == 1
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
        spark.sql("DROP TABLE bucketed_ledger")


def test_only_chosen_bodies_are_fetched_and_none_is_sorted(spark):
    rows = spark.range(10).selectExpr(
        "if(id % 2 = 0, 'Xing', 'LinkedIn') platform", "cast(id as string) url", "'detail' kind", "'<main>x</main>' body", "timestamp_seconds(id) observed_at"
    )
    wanted = spark.range(5).selectExpr("if(id % 2 = 0, 'Xing', 'LinkedIn') platform", "cast(id as string) url")
    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        latest = captures.latest_details(rows.unionByName(rows), "detail", wanted)
        text = plan(latest)
        assert "ShuffledHashJoin" in text and not [l for l in text.splitlines() if re.search(r"\bSort \[", l) and "body" in l]
        assert sorted(r.url for r in latest.collect()) == ["0", "1", "2", "3", "4"]
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)


def test_captures_without_time_or_body_are_found(spark, tmp_path):
    schema = "platform string, url string, kind string, observed_at timestamp, body string"
    early, late = datetime(2024, 1, 1), datetime(2024, 1, 2)
    rows = [("Xing", "a", "detail", None, "x"), ("Xing", "b", "detail", late, None), ("Xing", "b", "detail", early, "old"), ("Xing", "c", "detail", None, None)]
    rows += [("Xing", "d", "detail", None, "none"), ("Xing", "d", "detail", early, "timed"), ("Xing", None, "detail", early, "y")]
    frame = spark.createDataFrame(rows + rows, schema)
    found = {(r.url, r.observed_at, r.body) for r in captures.latest_details(frame, "detail").collect()}
    frame.write.parquet(str(tmp_path / "odd"))
    in_files = spark.read.parquet(str(tmp_path / "odd"))
    assert {(r.url, r.observed_at, r.body) for r in captures.latest_details(in_files, "detail").collect()} == found
    assert captures.latest_details(in_files.filter("url = 'no'"), "detail").count() == 0
    assert found == {("a", None, "x"), ("b", late, None), ("c", None, None), ("d", early, "timed"), (None, early, "y")}
    wanted = frame.filter("url IN ('a', 'b')").select("platform", "url")
    assert {(r.url, r.body) for r in captures.latest_details(frame, "detail", wanted).collect()} == {("a", "x"), ("b", None)}


def test_no_body_of_an_unwanted_page_is_exchanged(spark, tmp_path):
    """With default settings: above the scan, bodies only pass the join with the chosen places."""
    rows = spark.range(0, 2000, 1, 4).selectExpr(
        "'Xing' platform", "cast(id % 900 as string) url", "'detail' kind", "0 query_idx", "0 page_no",
        "concat('<main>', id, '</main>') body", "timestamp_seconds(id) observed_at",
    )
    rows.write.parquet(str(tmp_path / "captures"))
    wanted = spark.range(5).selectExpr("'Xing' platform", "cast(id as string) url")
    latest = captures.latest_details(captures.read_captures(spark, str(tmp_path / "captures")), "detail", wanted)
    lines = plan(latest).splitlines()
    join = next(n for n, line in enumerate(lines) if "BroadcastHashJoin" in line)
    below = [line for line in lines[join:] if "Exchange" in line]
    assert below and all("BroadcastExchange" in line for line in below)
    assert {(r.url, r.body) for r in latest.collect()} == {(str(i), f"<main>{i + 1800 if i < 200 else i + 900}</main>") for i in range(5)}
    in_rounds = captures.latest_details(captures.read_captures(spark, str(tmp_path / "captures")), "detail", None, most_places=300)
    assert {(r.url, r.body) for r in in_rounds.collect()} == {(str(i), f"<main>{i + 1800 if i < 200 else i + 900}</main>") for i in range(900)}


def test_only_bodies_of_captures_of_the_same_time_are_exchanged(spark, tmp_path):
    rows = spark.range(0, 2000, 1, 4).selectExpr(
        "'Xing' platform", "cast(id % 900 as string) url", "'detail' kind", "0 query_idx", "0 page_no",
        "concat('<main>', id, '</main>') body", "timestamp_seconds(id) observed_at",
    )
    expected = {(str(i), f"<main>{i + 1800 if i < 200 else i + 900}</main>") for i in range(900)}
    rows.write.parquet(str(tmp_path / "captures"))
    latest = captures.latest_details(captures.read_captures(spark, str(tmp_path / "captures")), "detail")
    assert {(r.url, r.body) for r in latest.collect()} == expected
    final = latest._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    assert "BroadcastExchange" in final and "Exchange hashpartitioning" not in final
    # Captures of the same time: one body for each page, from any of them.
    rows.filter("id >= 1100 and id < 1300").withColumn("body", F.lit("<main>other</main>")).write.mode("append").parquet(str(tmp_path / "captures"))
    again = captures.latest_details(captures.read_captures(spark, str(tmp_path / "captures")), "detail").collect()
    assert len(again) == 900 and {(r.url, r.body) for r in again if r.body != "<main>other</main>"} <= expected
    assert all(200 <= int(r.url) < 400 for r in again if r.body == "<main>other</main>")


@pytest.mark.parametrize("step", ["anti_ledger", "join_detail", "join_responses"])
def test_hot_key_is_split(spark, step):
    """A third of all postings share one id and one link; the join splits their partition."""
    hot = "if(id % 3 = 0, 'hot', cast(id as string))"
    rows = spark.range(0, 200_000, 1, 8).selectExpr(f"{hot} job_id", f"{hot} url", "'Xing' platform", "sha(cast(id as string)) title")
    few = spark.range(0, 1000).selectExpr("cast(id as string) job_id", "cast(id as string) url", "'Xing' platform")
    extra = few.selectExpr("job_id", "url", "platform", "'d' description", "true match", "8 score", "'r' reason")
    settings = {
        "spark.sql.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "400KB",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "200KB",
        "spark.sql.shuffle.partitions": "16",
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "2",
    }
    before = {key: spark.conf.get(key, None) for key in settings}
    try:
        for key, value in settings.items():
            spark.conf.set(key, value)
        frame = {
            "anti_ledger": lambda: identity.anti_ledger(rows, few),
            "join_detail": lambda: funnel.join_detail(
                rows.withColumn("platform", F.expr("if(length(title) = 0, 'x', platform)")),
                extra.select(F.expr("if(length(url) = 0, 'x', platform)").alias("platform"), "url", "description"),
            ),
            "join_responses": lambda: scoring.join_responses(rows, extra, ["job_id"]),
        }[step]()
        assert len(frame.collect()) == 200_000 - (666 if step == "anti_ledger" else 0)
        assert "skew=true" in plan(frame)
    finally:
        for key, value in before.items():
            spark.conf.unset(key) if value is None else spark.conf.set(key, value)


def test_the_first_run_compares_nothing_with_a_missing_ledger(spark, tmp_path):
    rows = spark.createDataFrame([("a", "t"), ("", "u"), (None, "v")], "job_id string, title string")
    first = ledger.read_ledger(spark, f"{tmp_path}/none")
    assert first.schema.simpleString() == "struct<job_id:string,url:string,platform:string,date_sent:timestamp,run_id:string>"
    fresh = identity.anti_ledger(rows, first)
    assert [r.title for r in fresh.collect()] == ["t"]
    assert "Join" not in fresh._jdf.queryExecution().optimizedPlan().toString()


def test_cache_files_hold_a_thousand_entries_in_order(spark, tmp_path):
    rows = [(i, f"text {i}\n\"x\"", "en", "src3", 7) for i in (2001, 5, 1999, 3, 1000, 2, 3)] + [(None, "no id", "de", "src1", None), (7, None, None, None, 1)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint").repartition(3)
    flow._as_cache(docs, f"{tmp_path}/cache")
    written = {}
    for row in spark.read.text(f"{tmp_path}/cache", wholetext=True).collect():
        assert row.thousand not in written
        assert row.value.startswith('[\n  {\n    "title": ') and row.value.endswith("\n  }\n]\n")
        written[row.thousand] = [(e["url"] or "").rsplit("/", 1)[-1] for e in json.loads(row.value)]
    assert written == {0: ["2", "3", "3", "5", "7"], 1: ["1000", "1999"], 2: ["2001"], None: [""]}
    found = files.read_scrape_cache(spark, f"{tmp_path}/cache").orderBy("query_idx", "page_no", "card_pos").collect()
    assert len(found) == len(rows)
    assert [r.description for r in found if r.url and r.url.endswith("/3")] == ['text 3\n"x"'] * 2


def test_stages_with_whole_texts_are_written_small(spark, tmp_path):
    files.write_snapshot(spark.createDataFrame([("a",)], "text string"), f"{tmp_path}/stage")
    assert all(".zstd." in f.name for f in (tmp_path / "stage").glob("*.parquet"))
