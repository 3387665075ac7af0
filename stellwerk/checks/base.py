"""Registry of the driver's queries and of the SQL each is compared with.

The driver's tables hold no postings, so every query feeds its operator from whole tables
through a stand-in: ``postings`` are the documents, pages of listings are built from parts.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from stellwerk import vocab
from stellwerk.functions.text import WHITESPACE, job_id

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

# Whitespace class and strip, as DuckDB writes them.
WS_SQL = r"[\t-\r\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"


def strip_sql(expr: str) -> str:
    return f"trim({expr}, '{WHITESPACE}')"


def collapse_sql(expr: str) -> str:
    return strip_sql(f"regexp_replace({expr}, '{WS_SQL}+', ' ', 'g')")


def quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def any_of_sql(expr: str, words: list[str]) -> str:
    return "(" + " OR ".join(f"contains({expr}, {quoted(w)})" for w in words) + ")"


def query(name: str, sql: str | None = None):
    def register(build):
        QUERIES[name] = build
        if sql is not None:
            ORACLES[name] = sql
        return build

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame, key: str) -> DataFrame:
    """A small file is one row group, hence one task; deal its rows out before costly steps."""
    return df.repartition(df.sparkSession.sparkContext.defaultParallelism, key)


BOARDS = list(vocab.PLATFORM_RANK)


def board_of(number):
    """Board name for a board number, as a column."""
    names = F.array(*[F.lit(name) for name in BOARDS])
    return F.element_at(names, (number + 1).cast("int"))


def board_sql(number: str) -> str:
    return f"list_extract([{', '.join(quoted(b) for b in BOARDS)}], CAST({number} + 1 AS INTEGER))"


def postings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as postings. Copies of a text share an id and differ in board and place."""
    return as_postings(table(spark, sf_dir, "documents"))


def as_postings(documents: DataFrame, *more: str) -> DataFrame:
    number = F.substring("source", 4, 9).cast("int")
    rows = documents.select(
        "doc_id",
        *more,
        F.col("text").alias("title"),
        F.concat(F.lit("Example "), "lang").alias("company"),
        F.col("lang").alias("location"),
        F.concat(F.lit("https://jobs.example/"), F.col("doc_id").cast("string")).alias("url"),
        F.concat(F.lit("vor "), (F.col("n_chars") % 5).cast("string"), F.lit(" Tagen")).alias("posting_date"),
        board_of(number % 4).alias("platform"),
        F.when(F.col("lang") == "en", F.lit("Entry")).otherwise(F.lit("")).alias("experience_level"),
        F.col("text").alias("description"),
        (number % 4).alias("platform_rank"),
        number.alias("query_idx"),
        (F.floor(F.col("doc_id") / 25) + 1).cast("int").alias("page_no"),
        (F.col("doc_id") % 25).cast("int").alias("card_pos"),
    )
    return rows.withColumn("job_id", job_id(F.col("title"), F.col("company"), F.col("location")))


POSTINGS_SQL = f"""
postings AS (
  SELECT *, sha256({strip_sql('lower(title)')} || '|' || {strip_sql('lower(company)')} || '|'
                   || {strip_sql('lower(location)')}) AS job_id
  FROM (
    SELECT doc_id, text AS title, 'Example ' || lang AS company, lang AS location,
           'https://jobs.example/' || doc_id AS url,
           'vor ' || (n_chars % 5) || ' Tagen' AS posting_date,
           {board_sql('CAST(substr(source, 4) AS INTEGER) % 4')} AS platform,
           CASE WHEN lang = 'en' THEN 'Entry' ELSE '' END AS experience_level,
           text AS description,
           CAST(substr(source, 4) AS INTEGER) % 4 AS platform_rank,
           CAST(substr(source, 4) AS INTEGER) AS query_idx,
           CAST(doc_id // 25 + 1 AS INTEGER) AS page_no,
           CAST(doc_id % 25 AS INTEGER) AS card_pos
    FROM documents
  )
)"""

# Postings with a score from the labels table: labelled good ones match.
SCORE_SQL = "CASE WHEN quality IS NULL THEN 0 WHEN quality = 1 THEN 8 + toxic ELSE 3 END"


def scored_postings(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = table(spark, sf_dir, "labels")
    score = F.when(F.col("quality").isNull(), 0).when(F.col("quality") == 1, F.col("toxic") + 8).otherwise(3)
    return (
        postings(spark, sf_dir)
        .join(labels, "doc_id", "left")
        .withColumn("llm_score", score)
        .withColumn("llm_reason", F.when(F.col("quality").isNull(), F.lit("")).otherwise(F.lit("labelled <ok> & \"checked\"")))
        .withColumn("match", F.col("llm_score") >= vocab.MATCH_THRESHOLD)
        .drop("quality", "toxic")
    )


SCORED_SQL = f"""{POSTINGS_SQL},
scored AS (
  SELECT *, llm_score >= 7 AS match FROM (
    SELECT p.*, {SCORE_SQL} AS llm_score,
           CASE WHEN quality IS NULL THEN '' ELSE 'labelled <ok> & "checked"' END AS llm_reason
    FROM postings p LEFT JOIN labels l USING (doc_id)
  )
)"""


def sent_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A ledger: postings labelled poor, each recorded once per label."""
    poor = table(spark, sf_dir, "labels").filter("quality = 0")
    # Joined first, so that only labelled texts are hashed.
    labelled = table(spark, sf_dir, "documents").join(poor, "doc_id")
    return as_postings(labelled, "toxic").select(
        "job_id",
        "url",
        "platform",
        F.timestamp_add("DAY", F.col("toxic"), F.lit("2024-01-01 00:00:00").cast("timestamp")).alias("date_sent"),
        F.lit("earlier").alias("run_id"),
    )


LEDGER_SQL = f"""{POSTINGS_SQL},
ledger AS (
  SELECT job_id, url, platform, TIMESTAMP '2024-01-01 00:00:00' + to_days(toxic) AS date_sent
  FROM postings JOIN labels USING (doc_id) WHERE quality = 0
)"""
