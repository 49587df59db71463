"""Session defaults and the shared scratch folder."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def local_session(cores: int | str = 8, **conf: str) -> SparkSession:
    """A local session for tests and benchmarks; clusters bring their own."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("buildlens")
        .config("spark.sql.shuffle.partitions", str(cores) if cores != "*" else "8")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "12g")
    )
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_folder(spark: SparkSession) -> str:
    """The folder that the cluster shares for checkpoints.

    Only a local session that names no such folder (a test) gets a temporary
    one; on a cluster executors would write to disks of their own.
    """
    context = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named and not context.getCheckpointDir() and not re.match(r"local(\[|$)", context.master):
        raise ValueError("spark.checkpoint.dir must name a folder that the cluster shares")
    if not context.getCheckpointDir():
        context.setCheckpointDir(named or tempfile.mkdtemp(prefix="buildlens-"))
    return named or context.getCheckpointDir()


def scratch_folder(spark: SparkSession, label: str) -> str:
    """A fresh path below the shared folder."""
    return f"{shared_folder(spark).rstrip('/')}/buildlens/{label}-{uuid.uuid4().hex}"


def checkpointed(df: DataFrame) -> DataFrame:
    """The frame, written to the shared folder and read from there ever after."""
    shared_folder(df.sparkSession)
    return df.checkpoint()


def stored(df: DataFrame, label: str, **options: str) -> DataFrame:
    """The frame, written to the shared folder; its size is known to the plans that read it."""
    path = scratch_folder(df.sparkSession, label)
    df.write.options(**options).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: Small row groups, so that many tasks share a file and a filter skips most of it.
SMALL_GROUPS = {"parquet.block.size": str(8 << 20)}

#: Whether a finished query's shuffle files go at once.
CLEANUP = ("spark.sql.shuffleDependency.fileCleanup.enabled",
           "spark.sql.classic.shuffleDependency.fileCleanup.enabled")


@contextmanager
def shuffles_removed(spark: SparkSession) -> Iterator[None]:
    """Within it, shuffle files of finished jobs go at once, not when the driver collects garbage.

    For steps whose results are written or checkpointed: nothing reads their
    shuffles again, and a large table's would fill the executors' disks.
    """
    before = {k: spark.conf.get(k, None) for k in CLEANUP}
    try:
        for key in CLEANUP:
            spark.conf.set(key, "true")
        yield
    finally:
        for key, value in before.items():
            spark.conf.unset(key) if value is None else spark.conf.set(key, value)
