"""Numbered digests. A digest is a table of text parts; its parts in order are its body."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from stellwerk import schema
from stellwerk.functions.replies import score_bar
from stellwerk.operators.numbering import number_rows

ENTRIES_PER_PART = 500

# The plain digest's layout.
_FIELDS = [
    ("  Company   : ", "company"),
    ("  Location  : ", "location"),
    ("  Platform  : ", "platform"),
    ("  Experience: ", "experience_level"),
    ("  Posted    : ", "posting_date"),
    ("  Link      : ", "url"),
]
_NOTHING = "No new relevant jobs found in this cycle."


def subject(country: str, date: Column) -> Column:
    # Fixed value: the subject's wording.
    return F.concat(F.lit(f"{country} AI/Robotics Job Update – "), date)


def plain_entry(number: Column) -> Column:
    """One posting's block of the plain digest. The score line is left out at score 0."""
    score, reason = F.coalesce("llm_score", F.lit(0)), F.coalesce("llm_reason", F.lit(""))

    def value(name: str) -> Column:
        return F.coalesce(name, F.lit("N/A"))

    return F.concat_ws(
        "\n",
        F.concat(F.lit("["), number.cast("string"), F.lit("]  "), value("title")),
        *[F.concat(F.lit(label), value(name)) for label, name in _FIELDS],
        F.lit(""),
        F.when(score != 0, F.concat(F.lit("  AI Score  : "), score.cast("string"), F.lit("/10"))),
        F.when(reason != "", F.concat(F.lit("  AI Verdict: "), reason)),
        F.lit(""),
        F.lit("-" * 60),
        F.lit(""),
    )


def escape_html(text: Column) -> Column:
    for char, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        text = F.replace(text, F.lit(char), F.lit(entity))
    return text


def html_entry(number: Column) -> Column:
    """One posting's block of the HTML digest, with all values escaped."""
    score, reason = F.coalesce("llm_score", F.lit(0)), F.coalesce("llm_reason", F.lit(""))

    def value(name: str) -> Column:
        return escape_html(F.coalesce(F.nullif(F.col(name), F.lit("")), F.lit("N/A")))

    def row(label: str, name: str) -> Column:
        return F.concat(F.lit(f"<li>{label}: "), value(name), F.lit("</li>"))

    return F.concat_ws(
        "\n",
        F.concat(F.lit("<section><h2>"), number.cast("string"), F.lit(". "), value("title"), F.lit("</h2>")),
        F.concat(F.lit("<b>AI Score: "), score.cast("string"), F.lit("/10 "), score_bar(score), F.lit("</b><ul>")),
        row("Company", "company"),
        row("Location", "location"),
        row("Platform", "platform"),
        row("Experience", "experience_level"),
        row("Posted", "posting_date"),
        F.lit("</ul>"),
        F.when(reason != "", F.concat(F.lit("<blockquote>"), escape_html(reason), F.lit("</blockquote>"))),
        F.concat(F.lit('<a href="'), escape_html(F.coalesce("url", F.lit("#"))), F.lit('">View Job</a></section>')),
    )


def digest_number(postings: DataFrame, group: list[str] = ["digest_id"]) -> DataFrame:
    """Position of each posting in its digest, in acquisition order, and the digest's size."""
    return number_rows(postings, group, schema.ORDER_COLUMNS, "n", "total")


def _plain_frame(date: Column, label: str) -> tuple[Column, Column, Column]:
    """Head, foot and the text of a digest without postings."""
    head = F.concat(F.lit("NEW JOBS FOUND  ("), date, F.lit(")\n" + "=" * 60 + "\n"))
    foot = F.concat(F.lit("Total new jobs: "), F.col("total").cast("string"), F.lit(f"\n\n-- {label} --"))
    empty = F.concat(F.lit(f"{_NOTHING}\n\nDate: "), date)
    return head, foot, empty


def _html_frame(date: Column, label: str, country: str) -> tuple[Column, Column, Column]:
    safe_label, title = escape_html(F.lit(label)), escape_html(F.lit(country))
    end = F.concat(F.lit("<footer>"), safe_label, F.lit(" &bull; "), date, F.lit("</footer></body></html>"))
    head = F.concat(F.lit("<html><body><h1>"), title, F.lit(" Job Update &ndash; "), date, F.lit("</h1>"))
    foot = F.concat(F.lit("<p>Total new jobs: "), F.col("total").cast("string"), F.lit("</p>\n"), end)
    empty = F.concat(head, F.lit(f"\n<p>{_NOTHING}</p>\n"), end)
    return head, foot, empty


def digest_assemble(
    digests: DataFrame,
    numbered: DataFrame,
    date: Column,
    country: str = "Germany",
    entries_per_part: int = ENTRIES_PER_PART,
    html: bool = False,
    label: str | None = None,
) -> DataFrame:
    """Digest text as ``(digest_id, part_no, body)``.

    Parts joined by line breaks are the digest; the first carries the head, the last the
    foot. A part holds a bounded number of entries, so a digest of any length is assembled
    without gathering it in one row. ``digests`` names digests that are wanted even without
    postings, and then say so; ``label`` is the signature in the foot.
    """
    label = label or f"{country} job digest"
    head, foot, empty = _html_frame(date, label, country) if html else _plain_frame(date, label)
    entry = (html_entry if html else plain_entry)(F.col("n"))
    parts = (
        numbered.select(
            "digest_id",
            "n",
            "total",
            F.floor((F.col("n") - 1) / entries_per_part).cast("int").alias("part_no"),
            entry.alias("entry"),
        )
        .groupBy("digest_id", "part_no")
        .agg(
            F.max("total").alias("total"),
            F.max("n").alias("last"),
            F.sort_array(F.collect_list(F.struct("n", "entry"))).alias("entries"),
        )
    )
    text = F.array_join(F.transform("entries", lambda e: e["entry"]), "\n")
    bodies = parts.select(
        "digest_id",
        "part_no",
        F.concat_ws(
            "\n",
            F.when(F.col("part_no") == 0, head),
            text,
            F.when(F.col("last") == F.col("total"), foot),
        ).alias("body"),
    )
    # Digests without postings, found on their ids alone; no join touches a body.
    marks = digests.select("digest_id", F.lit(False).alias("filled")).unionByName(
        numbered.filter("n = 1").select("digest_id", F.lit(True).alias("filled"))
    )
    unfilled = marks.groupBy("digest_id").agg(F.max("filled").alias("filled")).filter("NOT filled")
    return bodies.unionByName(unfilled.select("digest_id", F.lit(0).alias("part_no"), empty.alias("body")))
