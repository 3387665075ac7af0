"""Counts committed per ledger run, and the order of a replayed cache of several files."""

import datetime
import json

from pyspark.sql import functions as F

from stellwerk import vocab
from stellwerk.operators import identity, metrics
from stellwerk.plans import daily_run
from stellwerk.sources import files, ledger
from test_operators import all_match, make_postings

NOON = datetime.datetime(2024, 1, 15, 12)


def jobs(spark, ids):
    return make_postings(spark, [(j, vocab.XING, 0, 0, n) for n, j in enumerate(ids)])


def values(summary):
    row = summary.first()
    return row.new_jobs, row.ledger_before, row.ledger_after


def test_summaries_from_counts_agree_with_the_rows(spark, tmp_path):
    path = str(tmp_path / "ledger")
    # "a+b 1" and "007" are ids whose folder names are encoded, or look like numbers.
    runs = [("a+b 1", "abc"), ("007", "bcde"), ("2024-01-31", ""), ("r4", "az"), ("007", "bcdey")]
    for n, (run_id, ids) in enumerate(runs):
        rows = ledger.read_ledger(spark, path, except_run=run_id)
        fresh = identity.anti_ledger(jobs(spark, ids), rows)
        want = values(files.materialise(metrics.run_summary(rows, fresh), str(tmp_path / f"want{n}")))
        assert ledger.run_counts(spark, path, except_run=run_id).filter("new_ids IS NULL").isEmpty()
        assert values(daily_run.deliver(jobs(spark, ids), all_match, path, str(tmp_path / f"run{n}"), run_id, F.lit(NOON))) == want
    counts = {r.run_id: r.new_ids for r in ledger.run_counts(spark, path).collect()}
    assert counts == {"a+b 1": 3, "007": 3, "2024-01-31": 0, "r4": 1}
    assert ledger.read_ledger(spark, path).count() == 7


def test_counts_read_no_ledger_rows(spark, tmp_path):
    path = str(tmp_path / "ledger")
    assert ledger.run_counts(spark, path).count() == 0
    daily_run.deliver(jobs(spark, "abc"), all_match, path, str(tmp_path / "run"), "r1", F.lit(NOON))
    summary = metrics.run_summary_of_counts(ledger.run_counts(spark, path), jobs(spark, "d"))
    plan = summary._jdf.queryExecution().executedPlan().toString()
    scans = [line for line in plan.splitlines() if "FileScan" in line]
    assert scans and not any("job_id" in line.split("Batched")[0] for line in scans)
    assert values(summary) == (1, 3, 4)


def test_runs_without_a_count_are_counted_by_their_rows(spark, tmp_path):
    path = str(tmp_path / "ledger")
    daily_run.deliver(jobs(spark, "abc"), all_match, path, str(tmp_path / "r1"), "r1", F.lit(NOON))
    # Recorded by other means, with an id that r1 holds as well.
    ledger.append_ledger(jobs(spark, "cd"), path, "other", F.lit(NOON))
    assert [r.run_id for r in ledger.run_counts(spark, path).filter("new_ids IS NULL").collect()] == ["other"]
    assert values(daily_run.deliver(jobs(spark, "ae"), all_match, path, str(tmp_path / "r2"), "r2", F.lit(NOON))) == (1, 4, 5)
    # A run whose rows are replaced loses the count of its first try with them.
    ledger.append_ledger(jobs(spark, "ab"), path, "r1", F.lit(NOON))
    assert {r.run_id for r in ledger.run_counts(spark, path).filter("new_ids IS NULL").collect()} == {"other", "r1"}


def test_several_cache_files_keep_their_order(spark, tmp_path):
    folder = tmp_path / "cache"
    folder.mkdir()
    wanted = []
    for name in ("a", "b ü", "c"):
        records = [{"title": f"{name}{i}", "description": "d", "platform": vocab.XING, "job_id": f"{name}{i}"} for i in range(30)]
        records.append({"title": f"again {name}", "description": "d", "platform": vocab.XING, "job_id": "shared"})
        (folder / f"{name}.json").write_text(json.dumps(records, indent=2))
        wanted += [r["title"] for r in records]
    rows = files.read_scrape_cache(spark, str(folder))
    assert [r.title for r in identity.stable_order(rows).collect()] == wanted
    assert identity.first_global(rows).filter("job_id = 'shared'").first().title == "again a"
