"""What the training-data operators share: table reads, scratch tables, Arrow rows."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import zipfile
from collections.abc import Callable, Iterator
from pathlib import Path
from typing import TypeVar
from weakref import WeakKeyDictionary

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

import eventloom
from eventloom.session import delete_path, scratch_path, shuffles_dropped

T = TypeVar("T")
_shipped: set[str] = set()
BATCH_BOUNDS = {
    "spark.sql.execution.arrow.maxRecordsPerBatch": ("10000", "1000"),
    "spark.sql.execution.arrow.maxBytesPerBatch": ("67108864b", "8m"),
}


def prepare(spark: SparkSession) -> None:
    """Gets a session ready for the operators.

    Arrow batches of long texts are kept small: each is held by the executor and by its Python
    worker at once, and the defaults allow 10,000 rows and 64 MB. Other bounds that a
    session has set stay.
    """
    for name, (default, bound) in BATCH_BOUNDS.items():
        if spark.conf.get(name, default) == default:
            spark.conf.set(name, bound)
    ship(spark)


def ship(spark: SparkSession) -> None:
    """Sends this package to the executors through Spark, once per application, so that they need no copy of it."""
    application = spark.sparkContext.applicationId
    if application in _shipped:
        return
    _shipped.add(application)
    root = Path(eventloom.__file__).parent
    # Spark's file server hands the archive out as long as the driver lives.
    folder = tempfile.mkdtemp(prefix="eventloom-package-")
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    archive = f"{folder}/eventloom_package.zip"
    with zipfile.ZipFile(archive, "w") as out:
        for file in sorted(root.rglob("*.py")):
            out.write(file, f"{root.name}/{file.relative_to(root)}")
    spark.sparkContext.addPyFile(archive)


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    prepare(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def written(df: DataFrame, name: str) -> DataFrame:
    """The same rows, read back from a table in the folder that all executors share.

    Cuts the lineage, so a lost executor costs a re-read and not a recomputation. The
    shuffle files of the write are given up with its end; nothing reads them again. The
    table stays until ``discard`` or the end of the application.
    """
    spark = df.sparkSession
    prepare(spark)
    path = scratch_path(spark, name)
    with shuffles_dropped(spark):
        df.write.parquet(path)
    table = spark.read.schema(df.schema).parquet(path)
    _scratch[table] = path
    return table


_scratch: WeakKeyDictionary[DataFrame, str] = WeakKeyDictionary()


def discard(*tables: DataFrame) -> None:
    """Deletes scratch tables that ``written`` gave back and that nothing reads any more."""
    for table in tables:
        path = _scratch.pop(table, None)
        if path:
            delete_path(table.sparkSession, path)


_helper: dict[object, object] = {}


def one_helper(key: object, make: Callable[[], T]) -> T:
    """An object that a worker process keeps between batches and tasks; a new key lets go of the old one.

    Worker processes serve one operator after another, so what one remembers must not pile
    up beside what the next one does.
    """
    if key not in _helper:
        _helper.clear()
        _helper[key] = make()
    return _helper[key]


def no_helper() -> None:
    _helper.clear()


def rows(batches: Iterator[pa.RecordBatch], *columns: str) -> Iterator[tuple]:
    """The rows of Arrow batches as plain tuples, a few at a time."""
    for batch in batches:
        for start in range(0, batch.num_rows, 512):
            part = batch.slice(start, 512)
            yield from zip(*(part.column(c).to_pylist() for c in columns))
