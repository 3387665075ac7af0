"""Scheduled runs as an incremental stream: take what is new, deliver it once."""

from __future__ import annotations

from collections.abc import Callable
from datetime import timedelta

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from stellwerk import schema
from stellwerk.plans.daily_run import acquire, deliver
from stellwerk.sources.files import path_missing

_LOG = "seq bigint, run_id string, path string"


class FromCaptures:
    """``to_postings`` for a stream of captures; ``options`` go to ``acquire``.

    Search and detail pages may arrive in any order. A candidate without its detail page waits: it goes on when
    the page comes, or without it in the first later run after ``patience``, also if that run has no new files. A
    detail page that no candidate asks for is kept for ``keep_early``.

    What waits is written with each run. A log of runs, appended to once a run is delivered, says whose state is the
    current one; a run that is repeated reads the state before its own.
    """

    def __init__(
        self, patience: timedelta = timedelta(0), keep_early: timedelta = timedelta(days=14), now: Column | None = None, **options
    ):
        self.patience, self.keep_early, self.options = patience, keep_early, options
        self.now = F.current_timestamp() if now is None else now

    def _state(self, spark: SparkSession, run_dir: str) -> tuple[int, str | None]:
        """(number, folder) of the state before this run; (-1, None) before the first one."""
        state_dir, run_id = self._names(run_dir)
        try:
            log = spark.read.schema(_LOG).parquet(f"{state_dir}/pending-log")
        except AnalysisException as error:
            if not path_missing(error):
                raise
            return -1, None
        # One row per run.
        last = log.filter(F.col("run_id") != run_id).agg(F.max(F.struct("seq", "path")).alias("m")).first().m
        return (-1, None) if last is None else tuple(last)

    @staticmethod
    def _names(run_dir: str) -> tuple[str, str]:
        state_dir, _, run_id = run_dir.rsplit("/", 2)
        return state_dir, run_id

    def __call__(self, batch: DataFrame, run_dir: str) -> DataFrame:
        spark = batch.sparkSession
        _, before = self._state(spark, run_dir)
        read = lambda name: None if before is None else spark.read.parquet(f"{before}/{name}")
        return acquire(
            batch, run_dir, wait=True, waited=read("waiting"), early=read("early"), now=self.now, patience=self.patience,
            keep_early=self.keep_early, **self.options,
        )

    def commit(self, spark: SparkSession, run_dir: str) -> None:
        """Make what this run left behind the current state."""
        state_dir, run_id = self._names(run_dir)
        number, _ = self._state(spark, run_dir)
        spark.createDataFrame([(number + 1, run_id, run_dir)], _LOG).coalesce(1).write.mode("append").parquet(f"{state_dir}/pending-log")

    def overdue(self, spark: SparkSession, state_dir: str, stream: str) -> str | None:
        """The id of the run that is due without new files; None if no candidate has waited long enough."""
        number, before = self._state(spark, f"{state_dir}/runs/-")
        if before is None:
            return None
        due = F.coalesce(F.col("waiting_since") <= self.now - F.lit(self.patience), F.lit(True))
        waiting = spark.read.parquet(f"{before}/waiting").filter(due)
        return f"{stream}-overdue-{number:010d}" if waiting.limit(1).count() else None


def from_captures(**options) -> FromCaptures:
    return FromCaptures(**options)


def stream_id(spark: SparkSession, checkpoint: str) -> str:
    """The id a checkpoint gave its stream when it was made."""
    return spark.read.schema("id string").json(f"{checkpoint}/metadata").first()["id"]


def incremental_run(
    spark: SparkSession,
    source_dir: str,
    source_schema: str,
    state_dir: str,
    to_postings: Callable[[DataFrame, str], DataFrame],
    score: Callable[[DataFrame], DataFrame],
    sent_at: Column,
    country: str = "Germany",
    send: Callable[[DataFrame], bool] | None = None,
) -> str:
    """Process the files that arrived since the last call, then stop. Returns the ledger path.

    The stream's checkpoint knows which files were taken; the ledger is the only other state
    and never expires. A batch that is repeated after a failure finds its ledger rows under
    its own id, ignores them and writes them again, so nothing is lost or sent as new twice.
    That id holds the stream's id, which the checkpoint keeps over restarts: a new checkpoint
    over an old ledger counts its batches from 0 again, but under another id, and what the
    earlier stream sent stays sent.
    All new files form one batch, since a query's pages must not be split over batches.

    ``to_postings`` may keep a state of its own (``FromCaptures``): it is committed after each delivery, and
    a call without new files delivers what is overdue in it.
    """
    ledger, checkpoint = f"{state_dir}/ledger", f"{state_dir}/checkpoint"
    keeps_state = isinstance(to_postings, FromCaptures)
    handled = []

    def run(rows: DataFrame, run_id: str) -> None:
        run_dir = f"{state_dir}/runs/{run_id}"
        postings = to_postings(rows, run_dir)
        deliver(postings, score, ledger, run_dir, run_id, sent_at, country, send)
        if keeps_state:
            to_postings.commit(rows.sparkSession, run_dir)

    def handle(batch: DataFrame, batch_id: int) -> None:
        handled.append(batch_id)
        run(batch, f"{stream_id(spark, checkpoint)}-batch-{batch_id:010d}")

    files = spark.readStream.schema(source_schema).parquet(source_dir)
    if keeps_state:
        # Places in files, by which detail pages are fetched.
        files = files.select("*", F.col("_metadata.file_path").alias("_file"), F.col("_metadata.row_index").alias("_row"))
    stream = (
        files.writeStream.foreachBatch(handle)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
    stream.awaitTermination()
    if keeps_state and not handled:
        run_id = to_postings.overdue(spark, state_dir, stream_id(spark, checkpoint))
        if run_id is not None:
            run(spark.createDataFrame([], f"{schema.CAPTURES}, _file string, _row bigint"), run_id)
    return ledger
