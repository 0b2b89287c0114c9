"""A session for local use, on a cluster the caller brings its own; and tables kept between jobs."""

from __future__ import annotations

import os
import re
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


#: Rows and bytes of an Arrow batch; a longer row is a batch of its own.
BATCH_ROWS, BATCH_BYTES = 2000, 4 << 20


def session(cores: str = "*", partitions: int | None = None) -> SparkSession:
    n = partitions or (os.cpu_count() or 4)
    return (
        SparkSession.builder.master(f"local[{cores}]").appName("tessera").config("spark.sql.shuffle.partitions", n).config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").config("spark.driver.memory", "6g").getOrCreate()
    )


def kept(df: DataFrame) -> DataFrame:
    """df, computed once and kept in the folder that all executors share; its lineage ends there.

    The folder is the session's ``spark.checkpoint.dir``; only where that is unset and Spark runs in one process a
    temporary one is made. A cluster must name a folder that all executors share.
    """
    spark = df.sparkSession
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder and not re.fullmatch(r"local(\[.*\])?", context.master):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        context.setCheckpointDir(folder or tempfile.mkdtemp(prefix="tessera-checkpoint-"))
    return df.checkpoint(eager=True)


def bounded_batches(spark: SparkSession) -> None:
    """Let Arrow batches end at BATCH_ROWS rows or BATCH_BYTES bytes, where the session's limits are larger: JVM and Python worker hold a batch each, whatever the input's size."""
    for key, most in (("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS), ("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)):
        have = spark.conf.get(key, None)
        if have is None or not have.isdigit() or not 0 < int(have) <= most:
            spark.conf.set(key, str(most))


def spread(scan: DataFrame) -> DataFrame:
    """A scan over as many tasks as there are cores, where the files are read by fewer: one row group is one task, however much is done with its rows.

    Tables of more splits than cores stay as they are. For plans without a shuffle, as their partitions are asked for.
    """
    cores = scan.sparkSession.sparkContext.defaultParallelism
    return scan if scan.rdd.getNumPartitions() > cores else scan.repartition(cores)


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder for a table that a run keeps, beside the session's checkpoints, where all executors reach it."""
    kept(spark.range(0))  # sees to it that there is a checkpoint folder
    return f"{spark.sparkContext.getCheckpointDir()}/{name}-{uuid.uuid4().hex[:12]}"


LIVE, BACKGROUND = "live", "background"


@contextmanager
def lane(spark: SparkSession, name: str = BACKGROUND, group: str = "scan") -> Iterator[None]:
    """Jobs started inside run in one of two lanes, in a group that cancel_background() can end.

    With ``spark.scheduler.mode`` FAIR, and the live pool given a larger weight in the allocation file, live jobs don't
    wait for a scan that is under way; with FIFO the lane only names the group.
    """
    context = spark.sparkContext
    before = context.getLocalProperty("spark.scheduler.pool")
    context.setLocalProperty("spark.scheduler.pool", name)
    context.setJobGroup(f"{name}:{group}", f"{name} {group}", interruptOnCancel=True)
    try:
        yield
    finally:
        context.setLocalProperty("spark.scheduler.pool", before)
        context.setLocalProperty("spark.jobGroup.id", None)


def cancel_background(spark: SparkSession, group: str = "scan") -> None:
    """Drop the background jobs of a group; live ones go on."""
    spark.sparkContext.cancelJobGroup(f"{BACKGROUND}:{group}")
