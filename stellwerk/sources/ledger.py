"""The ledger of delivered postings: one parquet folder, one subfolder per run."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from stellwerk import schema
from stellwerk.sources.files import path_missing, read_indented_json


_COUNT = "_count"


def read_ledger(spark: SparkSession, path: str, except_run: str | None = None) -> DataFrame:
    """All ledger rows; no ledger yet means none. An unreadable ledger is an error, since
    taking it for empty would deliver everything again.

    A run that is repeated leaves out the rows its first try wrote.
    """
    try:
        rows = spark.read.schema(schema.LEDGER).parquet(path)
    except AnalysisException as error:
        if not path_missing(error):
            raise
        # A table the planner knows to be empty: nothing is shuffled to be compared with it.
        rows = spark.range(0).select(F.from_json(F.lit("{}"), schema.LEDGER).alias("r")).select("r.*").filter(F.lit(False))
    return rows if except_run is None else rows.filter(F.col("run_id") != except_run)


def latest_records(ledger: DataFrame) -> DataFrame:
    """One record per posting: the latest delivery."""
    newest = F.max(F.struct("date_sent", "run_id", "url", "platform")).alias("r")
    return ledger.groupBy("job_id").agg(newest).select(
        "job_id", "r.url", "r.platform", "r.date_sent"
    )


def ledger_rows(postings: DataFrame, sent_at: Column) -> DataFrame:
    """Ledger rows of delivered postings; postings without an id are left out."""
    return postings.filter(F.coalesce("job_id", F.lit("")) != "").select(
        "job_id",
        F.coalesce("url", F.lit("")).alias("url"),
        F.coalesce("platform", F.lit("")).alias("platform"),
        sent_at.alias("date_sent"),
    )


def append_ledger(postings: DataFrame, path: str, run_id: str, sent_at: Column, counted: bool = False) -> None:
    """Record a run's deliveries. Each run owns a subfolder, so a repeated run replaces its
    rows and never doubles them.

    ``counted`` says that the postings hold each id once and none that another run delivered. Their
    number is then committed beside the rows, after them: replacing a run's rows takes its count away
    first, so a count never stands beside rows it wasn't taken from.
    """
    folder = f"{path}/run_id={run_id}"
    ledger_rows(postings, sent_at).write.mode("overwrite").parquet(folder)
    if counted:
        written = postings.sparkSession.read.schema("job_id string").parquet(folder)
        written.agg(F.count("*").alias("new_ids")).write.parquet(f"{folder}/{_COUNT}")


def run_counts(spark: SparkSession, path: str, except_run: str | None = None) -> DataFrame:
    """``run_id, new_ids`` of each run in the ledger; ``new_ids`` is null where a run has no committed
    count. Folders are listed and counts read, no ledger rows."""
    name = F.regexp_extract("_metadata.file_path", rf"/run_id=([^/]+)(?:/{_COUNT})?/[^/]+$", 1)
    run = F.url_decode(F.replace(name, F.lit("+"), F.lit("%2B"))).alias("run_id")
    try:
        files = spark.read.format("binaryFile").option("pathGlobFilter", "*.parquet").load(path)
        runs = files.select(run).distinct()
    except AnalysisException as error:
        if not path_missing(error):
            raise
        runs = spark.createDataFrame([], "run_id string")
    try:
        counts = spark.read.schema("new_ids bigint").parquet(f"{path}/run_id=*/{_COUNT}").select(run, "new_ids")
    except AnalysisException as error:
        if not path_missing(error):
            raise
        counts = spark.createDataFrame([], "run_id string, new_ids bigint")
    found = runs.join(counts, "run_id", "left")
    return found if except_run is None else found.filter(F.col("run_id") != except_run)


def save_bucketed(ledger: DataFrame, table: str, buckets: int, path: str | None = None) -> None:
    """Store the latest records as a table bucketed by id. A ledger read from it joins without
    being shuffled, which pays once it outgrows a run's postings by far. The postings' side
    should then hold an id only a few times, as ``first_per_platform`` leaves it."""
    writer = latest_records(ledger).write.mode("overwrite").bucketBy(buckets, "job_id").sortBy("job_id")
    (writer.option("path", path) if path else writer).saveAsTable(table)


def lookup(ledger: DataFrame, asked: DataFrame) -> DataFrame:
    """The records of the asked-for ``job_id`` values that were delivered."""
    wanted = asked.select("job_id").distinct()
    return latest_records(ledger.join(wanted, "job_id", "left_semi"))


def total_count(ledger: DataFrame) -> DataFrame:
    return ledger.agg(F.count_distinct("job_id").alias("records"))


def import_json_ledger(spark: SparkSession, path: str) -> DataFrame:
    """Rows of a JSON ledger file, for moving an existing one into the table."""
    records = read_indented_json(spark, path, schema.LEDGER_RECORD)
    return records.withColumn("date_sent", F.to_timestamp("date_sent"))
