"""Session builder and the shared work folder."""

from __future__ import annotations

import ctypes
import tempfile
import uuid

import pyarrow as pa
from pyspark.sql import SparkSession

# Applied only when the caller builds a session here; a cluster's own settings are left alone
# by passing its session straight to the operators.
_DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    # Pages can be large: Arrow batches are bounded by bytes, and never change while jobs run.
    "spark.sql.execution.arrow.maxBytesPerBatch": "16m",
    "spark.sql.execution.arrow.maxRecordsPerBatch": "500",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


# Spark's own values allow 10,000 rows or 64 MB in a batch, of which a worker holds several copies while it reads pages.
_PAGE_BATCHES = {
    "spark.sql.execution.arrow.maxRecordsPerBatch": ("10000", "500"),
    "spark.sql.execution.arrow.maxBytesPerBatch": ("67108864b", "2m"),
}


def bound_page_batches(spark: SparkSession | None) -> None:
    """Lower the Arrow batch sizes of a session that reads pages in Python, where they are still Spark's defaults. They stay
    so, since plans read them when they run; no result depends on them."""
    if spark is None:
        return
    for key, (default, bound) in _PAGE_BATCHES.items():
        if spark.conf.get(key) == default:
            spark.conf.set(key, bound)


def release_memory() -> None:
    """Give freed memory back to the system: workers live on, and each stage would keep the most it ever held."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def build_session(app: str = "stellwerk", master: str | None = None, **conf: str) -> SparkSession:
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in {**_DEFAULTS, **conf}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor can see: ``spark.checkpoint.dir`` where the cluster names one.

    Only a local session without that setting (tests) gets a folder of its own.
    """
    context = spark.sparkContext
    configured = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not configured:
        if context.master != "local" and not context.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder all executors share")
        context.setCheckpointDir(tempfile.mkdtemp(prefix="stellwerk-"))
        configured = context.getCheckpointDir()
    return configured.rstrip("/")


def new_run_dir(spark: SparkSession, label: str) -> str:
    """A fresh path under the shared folder; nothing is created or deleted here."""
    return f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
