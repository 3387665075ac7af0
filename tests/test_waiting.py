"""Search and detail pages of a stream in any order of arrival."""

from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from stellwerk import schema
from stellwerk.operators import scoring
from stellwerk.sources import ledger
from stellwerk.streaming.incremental import FromCaptures, incremental_run

SEEN = datetime(2024, 3, 1, 12)
SEARCH = (
    '<ul class="jobs-search__results-list"><li><h3 class="base-search-card__title">Data Engineer {n}</h3>'
    '<h4 class="base-search-card__subtitle">Firma {n}</h4><span class="job-search-card__location">Berlin, Deutschland</span>'
    '<a class="base-card__full-link" href="https://www.linkedin.com/jobs/view/{n}">x</a><time datetime="2024-03-01">1 hour ago</time></li></ul>'
)


@pytest.fixture
def feed(spark, tmp_path):
    """put(kind, numbers) adds a file of captures; run(hour) is a call at that hour and returns the ids sent so far."""
    state, source = str(tmp_path / "state"), str(tmp_path / "captures")
    sent = {}

    def put(kind, *numbers):
        link = "https://www.linkedin.com/jobs/view/{n}"
        body = (lambda n: SEARCH.format(n=n)) if kind == "search" else (lambda n: f'<div class="show-more-less-html__markup">Text of {n}</div>')
        rows = [("LinkedIn", 0, i + 1 if kind == "search" else None, kind, "" if kind == "search" else link.format(n=n), body(n), SEEN) for i, n in enumerate(numbers)]
        spark.createDataFrame(rows, schema.CAPTURES).coalesce(1).write.mode("append").parquet(source)

    def run(hour, fail=False, **options):
        at = SEEN + timedelta(hours=hour)
        numbers = []

        def score(postings):
            if fail:
                raise RuntimeError("killed")
            numbers.extend((r.title.rsplit(" ", 1)[1], r.description) for r in postings.select("title", "description").collect())
            return scoring.pass_all(postings)

        step = FromCaptures(now=F.lit(at), patience=timedelta(hours=5), keep_early=timedelta(hours=40), **options)
        path = incremental_run(spark, source, schema.CAPTURES, state, step, score, F.lit(at))
        sent.update(numbers)
        rows = ledger.read_ledger(spark, path)
        assert rows.count() == rows.select("job_id").distinct().count() == len(sent)
        return dict(sent)

    put("search")
    return put, run


def test_any_order_of_arrival(feed):
    put, run = feed
    put("detail", 1)
    put("search", 2)
    assert run(0) == {}
    put("search", 1, 3)
    put("detail", 3)
    # The page of 1 came first; 2 still waits.
    assert set(run(1)) == {"1", "3"}
    # Nothing new and not long enough; then nothing new, but overdue.
    assert set(run(2)) == {"1", "3"}
    found = run(6)
    assert set(found) == {"1", "2", "3"} and "Text of 1" in found["1"] and not found["2"]
    # The page of 2 comes too late: it is kept unasked and nothing is sent twice.
    put("detail", 2)
    assert set(run(7)) == {"1", "2", "3"}


def test_waiting_ends_with_the_page_and_outlives_a_killed_run(feed):
    put, run = feed
    put("search", 5, 6)
    assert run(0) == {}
    put("detail", 5)
    with pytest.raises(Exception, match="killed"):
        run(1, fail=True)
    assert set(run(1)) == {"5"}
    with pytest.raises(Exception, match="killed"):
        run(9, fail=True)
    assert set(run(9)) == {"5", "6"}
    # Nothing waits any more.
    assert set(run(30)) == {"5", "6"}


def test_unasked_pages_are_kept_for_a_time(feed):
    put, run = feed
    put("detail", 7, 8)
    assert run(0) == {}
    put("search", 7)
    assert "Text of 7" in run(20)["7"]
    # Too old in a run that doesn't ask for it: gone.
    put("search", 9)
    assert set(run(50)) == {"7"}
    put("search", 8)
    assert set(run(51)) == {"7"}
    found = run(70)
    assert set(found) == {"7", "8", "9"} and not found["8"]
