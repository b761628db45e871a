"""Session helpers: reliable lineage cuts and broadcast limits."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Largest table (rows x 8-byte cells) we turn into a broadcast value. Larger inputs take the chunked path.
BROADCAST_BYTES = 64 * 1024 * 1024
# Most rows of a keyed join side that is broadcast after counting.
SMALL_ROWS = 200_000


def local_session(cores: str = "8", partitions: int = 8, app: str = "specframe") -> SparkSession:
    """A session for tests and the bench; on a cluster the caller's session is used as it is."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "12g")
        .getOrCreate()
    )


def checkpoint_folder(spark: SparkSession) -> str:
    """The shared folder for cut lineage and staged tables: the session's ``spark.checkpoint.dir``.

    Without one, a single-machine session (``local``, as in tests) gets a temporary folder; on a cluster that is an
    error, because executors would write to disks that no other executor sees.
    """
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        configured = spark.conf.get("spark.checkpoint.dir", None)
        if configured is None and not re.match(r"local(\[[^\]]*\])?$", context.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        context.setCheckpointDir(configured or tempfile.mkdtemp(prefix="spark-ckpt-"))
    return context.getCheckpointDir()


def durable(df: DataFrame) -> DataFrame:
    """Cut lineage through the shared checkpoint folder, so the rows survive executor loss."""
    checkpoint_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def small_side(df: DataFrame, limit: int | None = None) -> DataFrame:
    """A join side that is meant to be small: stored, counted, and broadcast only up to ``limit`` rows; else joined as it is.

    Beyond the limit the join shuffles, and the adaptive planner splits its hot keys; the rows are the same.
    """
    stored = durable(df)
    return F.broadcast(stored) if stored.count() <= (SMALL_ROWS if limit is None else limit) else stored


def stage_path(spark: SparkSession, name: str) -> str:
    """A new path for a staged table in the shared folder."""
    return f"{checkpoint_folder(spark)}/{name}-{uuid.uuid4().hex}"
