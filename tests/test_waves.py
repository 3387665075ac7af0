"""Quotas, retries and pacing of scorers."""

import threading
from pathlib import Path

from pyspark.sql import functions as F

from stellwerk.operators import scoring


def rows(spark, n):
    frame = spark.range(n).selectExpr("cast(id as string) job_id", "concat('Engineer ', id) title", "'c' company", "'l' location", "concat('u', id) url")
    return frame.withColumns({c: F.lit("x") for c in ("platform", "experience_level", "description")})


def test_a_used_up_scorer_is_left_out_of_later_waves(spark, tmp_path):
    calls = str(tmp_path / "calls")
    Path(calls).mkdir()

    def first(message):
        Path(calls, message.split("\n")[0].replace(" ", "_")).touch()
        raise scoring.RateLimited("free-models-per-day")

    scored = scoring.score_in_waves(rows(spark, 400), {"first": first, "second": lambda m: {"score": 9, "reason": "ok"}}, str(tmp_path / "run"), waves=4, tasks=2)
    assert scored.filter("match AND llm_score = 9").count() == 400
    asked = {p.name.rsplit("_", 1)[1] for p in Path(calls).iterdir()}
    waves = spark.read.parquet(str(tmp_path / "run/messages")).select("job_id", "wave").collect()
    assert {r.wave for r in waves if r.job_id in asked} == {0} and len({r.wave for r in waves}) == 4
    # Within the wave, each task stops after the calls that were under way.
    assert len(asked) <= 2 * scoring.CALLS_PER_TASK * 2


def test_a_rate_limit_is_tried_once_more_and_all_used_up_gives_the_fallback(spark, tmp_path):
    said = []

    def scorer(message):
        said.append(message)
        if len(said) < 2:
            raise scoring.RateLimited("requests per minute")
        return "reply"

    assert scoring.ask(scorer, "m", 0, lambda m: None) == ("reply", None) and len(said) == 2
    stubborn = lambda m: (_ for _ in ()).throw(scoring.RateLimited("slow down"))
    assert scoring.ask(stubborn, "m", 0, lambda m: None) == (None, "slow down")

    def over(message):
        raise scoring.RateLimited("TPD")

    scored = scoring.score_in_waves(rows(spark, 30), {"only": over}, str(tmp_path / "run"), waves=2, tasks=2, retry_seconds=0)
    assert scored.filter("NOT match AND llm_score = 0").count() == 30
    assert scoring.score_in_waves(rows(spark, 0), {"only": over}, str(tmp_path / "none"), waves=2, tasks=2).count() == 0


def test_pace_holds_over_several_tasks():
    """Three tasks with a third of 30 calls a minute each, by a clock that only sleeping moves."""
    made = []
    for task in range(3):
        clock, lock = [0.0], threading.Lock()

        def sleep(seconds, clock=clock):
            clock[0] += seconds

        pace = scoring.Pace(30 / 3, lambda clock=clock: clock[0], sleep)
        for _ in range(25):
            pace.wait()
            with lock:
                made.append(clock[0])
    for begin in range(0, 120, 10):
        assert sum(begin <= at < begin + 60 for at in made) <= 30
    tokens = scoring.Pace(12_000, lambda: 0.0, made.append)
    tokens.wait(2000)
    tokens.wait(2000)
    assert made[-1] == 10.0
