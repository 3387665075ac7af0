"""Time the headline queries; prints one JSON line.

Environment: BENCH_SF_DIR (default /root/testdata/sf0.1), BENCH_CPUS (default 8).
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

from stellwerk.checks import QUERIES
from stellwerk.session import build_session

HEADLINE = [
    # text and links
    "job_id", "summary", "prompt_truncate", "prompt_build", "request_build", "url_canonical",
    # funnel tests
    "title_tag", "location_target", "posting_fresh", "relative_age_hours",
    # pages and payloads
    "cards_linkedin", "cards_stepstone", "cards_xing", "cards_ba", "detail_description",
    "jsonld_description", "embedded_state", "detail_html",
    # identity, joins, counts
    "first_per_platform", "first_global", "anti_ledger", "join_detail", "cap_details", "pagination_stop",
    "funnel_by_query", "funnel_total", "platform_counts",
    # scoring and digests
    "response_parse", "first_valid_response", "model_disable", "score_with", "digest_assemble",
    # whole runs
    "daily_run", "incremental_run",
]


def timed(spark, sf_dir: str, name: str) -> float:
    """Seconds; the median of three for queries that take less than five."""
    runs = []
    while not runs or (len(runs) < 3 and max(runs) < 5):
        started = time.perf_counter()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        runs.append(time.perf_counter() - started)
    return round(statistics.median(runs), 3)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = build_session(
        "bench", f"local[{cpus}]", **{"spark.sql.shuffle.partitions": cpus, "spark.driver.memory": "8g"}
    )
    # Sources and stages that are meant to fail would otherwise fill the log.
    spark.sparkContext.setLogLevel("OFF")
    QUERIES["job_id"](spark, sf_dir).limit(1).collect()

    seconds = {}
    for name in HEADLINE:
        seconds[name] = timed(spark, sf_dir, name)
        print(f"{name:24s} {seconds[name]:8.3f}", file=sys.stderr, flush=True)
    spark.stop()
    scale = os.path.basename(sf_dir.rstrip("/")).removeprefix("sf")
    print(
        json.dumps(
            {
                "metric": "headline_queries_total",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": float(scale) if scale.replace(".", "", 1).isdigit() else scale,
            }
        )
    )


if __name__ == "__main__":
    main()
