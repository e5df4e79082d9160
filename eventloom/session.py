"""Session defaults and the shared scratch folder."""

from __future__ import annotations

import atexit
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import SparkSession

#: Stored tables are mostly hex digits, which take half the space in this form.
COMPRESSION = "zstd"


def build_session(app: str = "eventloom", **overrides: str) -> SparkSession:
    """A session with the settings the jobs are written for; callers may pass their own instead."""
    settings = {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.parquet.filterPushdown": "true",
        **overrides,
    }
    builder = SparkSession.builder.appName(app)
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


@contextmanager
def unsorted_writes(spark: SparkSession, folders: int) -> Iterator[None]:
    """Writes in here keep up to ``folders`` partition folders open in a task and do not sort rows by folder.

    Spark sorts the rest of a task's rows if more turn up.
    """
    key = "spark.sql.maxConcurrentOutputFileWriters"
    before = spark.conf.get(key, None)
    spark.conf.set(key, str(folders))
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(key)
        else:
            spark.conf.set(key, before)


#: Shuffle files of a write go with its end, and not when the driver happens to collect its garbage.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def shuffles_dropped(spark: SparkSession) -> Iterator[None]:
    """Jobs in here give up their shuffle files when they end; none may read those of another."""
    before = spark.conf.get(CLEANUP, "false")
    spark.conf.set(CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.set(CLEANUP, before)


_to_release: set[str] = set()


def delete_path(spark: SparkSession, path: str) -> None:
    """Deletes a file or folder of any file system Spark reads; a missing one is fine."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


def release_scratch(spark: SparkSession) -> None:
    """Deletes every scratch table of this application; frames that read one end with it."""
    delete_path(spark, _scratch_folder(spark))


def _release_at_exit(spark: SparkSession) -> None:
    try:
        release_scratch(spark)
    except Exception:  # the JVM may be gone before Python ends
        pass


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path below the folder that every executor shares.

    The cluster names that folder in ``spark.checkpoint.dir``. A local session
    without one gets a temporary folder; a cluster without one is an error. What is
    written there belongs to the application and goes with its end, if not before.
    """
    folder = _scratch_folder(spark)
    if folder not in _to_release:
        _to_release.add(folder)
        atexit.register(_release_at_exit, spark)
    return f"{folder}/{name}-{uuid.uuid4().hex}"


def _scratch_folder(spark: SparkSession) -> str:
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="eventloom-"))
        base = spark.sparkContext.getCheckpointDir()
    return f"{base.rstrip('/')}/eventloom-{spark.sparkContext.applicationId}"
