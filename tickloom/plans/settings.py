"""Sizes that decide between the plain and the split form of a plan.

Each is read from the Spark session, so a job can change it with
``spark.conf.set`` and a test can force the split form on a few rows.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator, Mapping
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

# Most rows of one key that a single window task should sort.
ROWS_PER_BLOCK = ("spark.tickloom.rowsPerBlock", 2_000_000)
# Most rows of a side table that may be broadcast.
BROADCAST_ROWS = ("spark.tickloom.broadcastRows", 100_000)
# Most bytes of a side table, as JSON text, that may be broadcast.
BROADCAST_BYTES = ("spark.tickloom.broadcastBytes", 64_000_000)
# Most rows of a narrow block or slice table that may be broadcast (some 150 bytes each).
BROADCAST_SLICES = ("spark.tickloom.broadcastSlices", 1_000_000)
# Most rows of one join key that a single join task should hold.
ROWS_PER_JOIN_KEY = ("spark.tickloom.rowsPerJoinKey", 2_000_000)


def size_setting(spark: SparkSession, setting: tuple[str, int]) -> int:
    name, default = setting
    return int(spark.conf.get(name, str(default)))


@contextmanager
def session_settings(spark: SparkSession, values: Mapping[str, str]) -> Iterator[None]:
    """Session settings for the plans that are made inside the block; the session's own come back after it."""
    before = {name: spark.conf.get(name, None) for name in values}
    for name, value in values.items():
        spark.conf.set(name, value)
    try:
        yield
    finally:
        for name, value in before.items():
            if value is None:
                spark.conf.unset(name)
            else:
                spark.conf.set(name, value)


def shared_folder(spark: SparkSession) -> str:
    """The cluster's checkpoint folder; a scratch one only for local runs."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder
    sc = spark.sparkContext
    folder = sc.getCheckpointDir()
    if folder:
        return folder
    if not sc.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder every executor can reach")
    folder = tempfile.mkdtemp(prefix="tickloom-")
    sc.setCheckpointDir(folder)
    return folder


def settle(df: DataFrame) -> DataFrame:
    """Checkpoint a small frame that several parts of a plan read."""
    spark = df.sparkSession
    folder = shared_folder(spark)
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(folder)
    return df.checkpoint(eager=True)


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared folder, grouped by application for clean-up."""
    app = spark.sparkContext.applicationId
    return f"{shared_folder(spark)}/tickloom/{app}/{name}-{uuid.uuid4().hex}"


def settle_table(df: DataFrame, name: str) -> DataFrame:
    """Write a wide frame as parquet and read it back, so later scans prune columns."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def remove_scratch(spark: SparkSession) -> None:
    """Delete what this application has written for its own use; call it when no result is read any more."""
    app = spark._jvm.org.apache.hadoop.fs.Path(f"{shared_folder(spark)}/tickloom/{spark.sparkContext.applicationId}")
    app.getFileSystem(spark._jsc.hadoopConfiguration()).delete(app, True)
