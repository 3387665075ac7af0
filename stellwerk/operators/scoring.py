"""Scores: requests out, replies in, fallback, or a scorer called in place."""

from __future__ import annotations

import json
import logging
import threading
import time
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from stellwerk import vocab
from stellwerk.functions.predicates import run_blocking_quota
from stellwerk.functions.prompts import posting_message, request_struct
from stellwerk.functions.replies import with_verdict
from stellwerk.operators.identity import first_by
from stellwerk.sources.files import materialise

log = logging.getLogger("stellwerk")

CALLS_PER_TASK = 6


def ordered_distinct(names: Column, disabled: Column | None = None) -> Column:
    """Model names in their order, without repeats, blanks and disabled ones."""
    kept = F.array_distinct(F.filter(names, lambda name: F.coalesce(name, F.lit("")) != ""))
    return kept if disabled is None else F.array_except(kept, disabled)


def with_message(postings: DataFrame) -> DataFrame:
    fields = ["title", "company", "location", "platform", "experience_level", "description"]
    return postings.withColumn("message", posting_message(*[F.col(f) for f in fields]))


def model_list(text: str | None) -> list[str]:
    """The names of a comma list, without blanks."""
    return [name.strip() for name in (text or "").split(",") if name.strip()]


def exhausted_models(attempts: DataFrame) -> DataFrame:
    """``model`` names that ran out of quota in these attempts: few rows."""
    return attempts.filter(run_blocking_quota(F.col("error"))).select("model").distinct()


def request_table(
    postings: DataFrame, system: Column, models: list[str] = vocab.MODELS, exhausted: DataFrame | None = None
) -> DataFrame:
    """One request per posting and model, for a scorer outside Spark.

    Models in ``exhausted`` (``exhausted_models``) are not asked; ranks stay those of the list.
    """
    names = postings.sparkSession.range(1).select(
        F.posexplode(ordered_distinct(F.array(*[F.lit(m) for m in models]))).alias("model_rank", "model")
    )
    if exhausted is not None:
        names = names.join(exhausted, "model", "left_anti")
    # The list of models is a constant of the run's configuration.
    asked = names.agg(F.array_sort(F.collect_list(F.struct("model_rank", "model"))).alias("asked"))
    return with_message(postings).select(
        "job_id", F.explode(asked.scalar()).alias("m"), "message"
    ).select("job_id", "m.model_rank", "m.model", "message").select(
        "job_id",
        "model_rank",
        "model",
        F.to_json(request_struct(F.col("model"), system, F.col("message"))).alias("request"),
    )


def drop_disabled_attempts(attempts: DataFrame) -> DataFrame:
    """Leave out attempts of jobs that began after their model had run out of quota.

    A job fixes its model list when it begins, so attempts already under way still count.
    The quota errors are aggregated per run and model first: few rows, joined back.
    """
    blocked = (
        attempts.filter(run_blocking_quota(F.col("error")))
        .groupBy("run_id", "model")
        .agg(F.min("responded_at").alias("_blocked_at"))
    )
    usable = F.col("_blocked_at").isNull() | (F.col("job_started_at") <= F.col("_blocked_at"))
    return attempts.join(blocked, ["run_id", "model"], "left").filter(usable).drop("_blocked_at")


def first_valid_response(
    attempts: DataFrame,
    keys: list[str],
    threshold: int = vocab.MATCH_THRESHOLD,
    order: list[str] = ["model_rank", "responded_at"],
) -> DataFrame:
    """Per job the verdict of the first model, in order, whose reply can be read.

    Unreadable replies sort last and are dropped after the choice. Filtering them out before
    it would push the test below the parsing steps and parse every reply again for it.
    """
    answered = attempts.filter(F.coalesce("error", F.lit("")) == "")
    read = with_verdict(answered, "raw", "verdict", threshold)
    rows = read.select(*keys, *order, "model", "verdict")
    first = first_by(rows, keys, [F.col("verdict").isNull(), *order])
    return first.filter(F.col("verdict").isNotNull()).select(*keys, "model", "verdict.*")


def with_fallback(rows: DataFrame, score: str = "score", reason: str = "reason") -> DataFrame:
    """No readable reply: no match, score 0 and a fixed reason."""
    failed = F.col(score).isNull()
    return rows.withColumns(
        {
            "llm_score": F.coalesce(score, F.lit(0)),
            "llm_reason": F.when(failed, F.lit(vocab.FALLBACK_REASON)).otherwise(F.col(reason)),
            "match": F.coalesce("match", F.lit(False)),
        }
    ).drop(score, reason)


def join_responses(postings: DataFrame, verdicts: DataFrame, keys: list[str]) -> DataFrame:
    """Attach each posting's verdict, or the fallback when it has none.

    Join verdicts that were written: read from a table, their side is a plain shuffle and a
    hot id's postings can be split.
    """
    return with_fallback(postings.join(verdicts.select(*keys, "match", "score", "reason"), keys, "left"))


def matched_only(scored: DataFrame) -> DataFrame:
    return scored.filter("match")


def _caller(scorer: Callable[[str], str | dict], at_once: int):
    @F.pandas_udf("string")
    def call(messages: pd.Series) -> pd.Series:
        errors = []

        def one(message):
            if message is None:
                return None
            try:
                reply = scorer(message)
            except Exception as error:
                errors.append(error)
                return None
            return json.dumps(reply, ensure_ascii=False) if isinstance(reply, dict) else reply

        with ThreadPoolExecutor(at_once) as pool:
            answers = pd.Series(list(pool.map(one, messages)), dtype=object)
        if errors:
            log.warning("scorer failed on %d of %d; first: %r", len(errors), len(answers), errors[0])
        return answers

    # A scorer may answer differently each time, so its calls must not be repeated.
    return call.asNondeterministic()


def score_with(
    postings: DataFrame,
    scorers: list[Callable[[str], str | dict]],
    threshold: int = vocab.MATCH_THRESHOLD,
    concurrency: int | None = None,
    calls_per_task: int = CALLS_PER_TASK,
) -> DataFrame:
    """Score postings with plain Python callables, tried in order until one gives a readable
    reply. Write the result before using it twice.

    A task makes ``calls_per_task`` calls at once, so scorers must allow calls from several
    threads. ``concurrency`` sets the number of tasks; without it the current partitions are used.
    """
    rows = with_message(postings)
    if concurrency:
        rows = rows.repartition(concurrency)
    rows = rows.withColumn("verdict", F.lit(None).cast("struct<match:boolean,score:int,reason:string>"))
    for scorer in scorers:
        open_message = F.when(F.col("verdict").isNull(), F.col("message"))
        rows = with_verdict(rows.withColumn("raw", _caller(scorer, calls_per_task)(open_message)), "raw", "_new", threshold)
        rows = rows.withColumn("verdict", F.coalesce("verdict", "_new")).drop("_new", "raw")
    return with_fallback(rows.select(*postings.columns, "verdict.*"))


class RateLimited(Exception):
    """Raised by a scorer that was refused for its rate or quota; the message says which."""


class Pace:
    """Calls spread evenly over time: each waits until its share of a minute has passed."""

    def __init__(self, per_minute: float, clock: Callable[[], float] = time.monotonic, sleep: Callable[[float], None] = time.sleep):
        self._seconds, self._clock, self._sleep = 60 / per_minute, clock, sleep
        self._next, self._lock = float("-inf"), threading.Lock()

    def wait(self, amount: float = 1) -> None:
        with self._lock:
            now = self._clock()
            start = max(now, self._next)
            self._next = start + amount * self._seconds
        if start > now:
            self._sleep(start - now)


def ask(scorer: Callable[[str], str | dict], message: str, retry_seconds: float, before_call: Callable[[str], None]) -> tuple[str | None, str | None]:
    """(reply, error) of one message, with one retry after a rate limit that isn't a quota for the whole run."""
    for last in (False, True):
        before_call(message)
        try:
            reply = scorer(message)
            return (json.dumps(reply, ensure_ascii=False) if isinstance(reply, dict) else reply), None
        except RateLimited as error:
            if last or any(marker in str(error).lower() for marker in vocab.RUN_BLOCKING_MARKERS):
                return None, f"{error}"
            time.sleep(retry_seconds)
        except Exception as error:
            return None, f"{type(error).__name__}: {error}"
    return None, None


def _wave_caller(scorer, at_once: int, retry_seconds: float, requests: float | None, tokens: float | None, chars_per_token: float):
    held: list = []

    @F.pandas_udf("struct<raw:string,error:string>")
    def call(messages: pd.Series) -> pd.DataFrame:
        if not held:
            # One pace for all batches of a task.
            held.append([Pace(requests) if requests else None, Pace(tokens) if tokens else None])

        def before_call(message: str) -> None:
            if held[0][0]:
                held[0][0].wait()
            if held[0][1]:
                held[0][1].wait(len(message) / chars_per_token)

        used_up = threading.Event()

        def one(message):
            if message is None or used_up.is_set():
                return None, None
            raw, error = ask(scorer, message, retry_seconds, before_call)
            if error and any(marker in error.lower() for marker in vocab.RUN_BLOCKING_MARKERS):
                used_up.set()
            return raw, error

        with ThreadPoolExecutor(at_once) as pool:
            return pd.DataFrame(list(pool.map(one, messages)), columns=["raw", "error"], dtype=object)

    return call.asNondeterministic()


def score_in_waves(
    postings: DataFrame,
    scorers: dict[str, Callable[[str], str | dict]],
    run_dir: str,
    waves: int = 8,
    tasks: int = 8,
    threshold: int = vocab.MATCH_THRESHOLD,
    calls_per_task: int = CALLS_PER_TASK,
    retry_seconds: float = 5.0,
    requests_per_minute: float | None = None,
    tokens_per_minute: float | None = None,
    chars_per_token: float = 4.0,
) -> DataFrame:
    """Score postings with named scorers, tried in order, in ``waves`` that are written one after the other.

    A scorer that raises ``RateLimited`` is asked once more; if its quota for the run is used up, its name is taken out for the
    next waves, and the rest of the batch goes to the next scorer at once. So after such an answer only tasks of the same
    wave still ask it. The rates hold for each scorer over all ``tasks`` of a wave, which share them evenly. Every posting
    is in exactly one wave; one without a readable reply gets the fallback.
    """
    parts = [F.xxhash64(*[F.col(c).cast("string") for c in ("title", "company", "location", "url")])]
    rows = materialise(with_message(postings).withColumn("wave", F.pmod(parts[0], F.lit(waves)).cast("int")), f"{run_dir}/messages")
    left, written = dict(scorers), None
    for number in range(waves):
        wave = rows.filter(F.col("wave") == number).repartition(tasks)
        wave = wave.withColumns({"verdict": F.lit(None).cast("struct<match:boolean,score:int,reason:string>"), "spent": F.array().cast("array<string>")})
        for name, scorer in left.items():
            rates = [rate / tasks if rate else None for rate in (requests_per_minute, tokens_per_minute)]
            caller = _wave_caller(scorer, calls_per_task, retry_seconds, *rates, chars_per_token)
            wave = wave.withColumn("answer", caller(F.when(F.col("verdict").isNull(), F.col("message"))))
            over = run_blocking_quota(F.col("answer.error"))
            wave = wave.withColumn("spent", F.when(over, F.array_append("spent", F.lit(name))).otherwise(F.col("spent")))
            wave = with_verdict(wave.withColumn("raw", F.col("answer.raw")), "raw", "_new", threshold)
            wave = wave.withColumn("verdict", F.coalesce("verdict", "_new")).drop("_new", "raw", "answer")
        done = materialise(wave, f"{run_dir}/wave-{number}")
        # At most a name for each scorer.
        for row in done.select(F.explode("spent").alias("name")).distinct().collect():
            log.warning("scorer %s is used up after wave %d", row.name, number)
            left.pop(row.name, None)
        written = done if written is None else written.unionByName(done)
    return with_fallback(written.select(*postings.columns, "verdict.*"))


def pass_all(postings: DataFrame) -> DataFrame:
    """Every posting counts as a match, unscored."""
    return postings.withColumns(
        {"llm_score": F.lit(0), "llm_reason": F.lit(""), "match": F.lit(True)}
    )


def score_or_pass(
    postings: DataFrame,
    score: Callable[[DataFrame], DataFrame],
    path: str,
    on_score_error: str = "fail",
) -> DataFrame:
    """Run and write the scoring stage. With ``pass_all`` a stage that crashes lets every
    posting through; the default lets the error stop the run."""
    try:
        return materialise(score(postings), path)
    except Exception:
        if on_score_error != "pass_all":
            raise
        log.exception("scoring failed; all postings pass")
        return materialise(pass_all(postings), path)

