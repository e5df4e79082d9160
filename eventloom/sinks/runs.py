"""Runs of a job inside a folder of tables, and the manifest that says which of them count.

A run writes into folders of its own and adds its entries to the manifest last, so a
run that broke off leaves nothing that a reader takes. A table's later run replaces
what earlier ones hold of the blocks in its range: wholly covered runs are deleted,
of the others only the blocks outside are read. Runs without a range add rows.
"""

from __future__ import annotations

import uuid
from collections.abc import Mapping
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from eventloom.session import delete_path

MANIFEST = "run-manifest"
# An entry says that a run holds a table (``run``), what a partition of it holds (``zone``), or that
# the table was emptied before that run (``drop``).
ENTRY = (
    "number bigint, run string, kind string, table string, first bigint, last bigint, "
    "block_bucket bigint, min_block bigint, max_block bigint, rows bigint"
)
RUN = "run"


@dataclass(frozen=True)
class Run:
    """A run as a table sees it: its folder name, its blocks, and which of them still count (None: all rows)."""

    number: int
    run: str
    first: int | None
    last: int | None
    valid: tuple[tuple[int, int], ...] | None = None

    def predicate(self) -> Column | None:
        """Which rows count, or None if all do."""
        if self.valid is None or self.valid == ((self.first, self.last),):
            return None
        parts = [F.col("block_number").between(a, b) for a, b in self.valid]
        found = F.lit(False)
        for part in parts:
            found = found | part
        return found


def without(spans: tuple[tuple[int, int], ...], first: int, last: int) -> tuple[tuple[int, int], ...]:
    """Spans of blocks less those from ``first`` to ``last``."""
    left = []
    for a, b in spans:
        left += [(x, y) for x, y in ((a, min(b, first - 1)), (max(a, last + 1), b)) if x <= y]
    return tuple(left)


def entries(spark: SparkSession, directory: str) -> DataFrame:
    """The manifest of a folder; empty if no run ever finished there."""
    path = f"{directory.rstrip('/')}/{MANIFEST}"
    return spark.read.schema(ENTRY).parquet(path) if exists(spark, path) else spark.createDataFrame([], ENTRY)


def live_runs(spark: SparkSession, directory: str) -> dict[str, list[Run]]:
    """Per table, the runs that hold rows which still count, oldest first.

    The driver looks at one small entry a run and table, and at no data.
    """
    listed = entries(spark, directory).where("kind <> 'zone'").collect()
    listed.sort(key=lambda e: (e.number, e.kind), reverse=True)
    tables: dict[str, list[Run]] = {}
    later: dict[str, list[tuple[int, int]]] = {}
    dropped: set[str] = set()
    for e in listed:
        if e.table in dropped:
            continue
        if e.kind == "drop":
            dropped.add(e.table)
            continue
        run = Run(e.number, e.run, e.first, e.last)
        if e.first is not None:
            valid = ((e.first, e.last),) if e.first <= e.last else ()
            for a, b in later.setdefault(e.table, []):
                valid = without(valid, a, b)
            later[e.table].append((e.first, e.last))
            run = replace(run, valid=valid)
        if run.valid != () and e.rows != 0:
            tables.setdefault(e.table, []).insert(0, run)
    return tables


class RunFolders:
    """What the sinks share: a run is begun, tables are written into it, and it is committed."""

    directory: str
    drop: bool
    _open: Run | None = None
    _tables: tuple[str, ...] = ()

    def path(self, table: str) -> str:
        return f"{self.directory.rstrip('/')}/{table}"

    def run_path(self, table: str, run: str) -> str:
        return f"{self.path(table)}/{RUN}={run}"

    def prepare(self, spark: SparkSession, tables: Mapping[str, T.StructType]) -> None:
        """Creates the folder; with ``drop`` the tables start empty, those of other jobs stay."""
        number = self._next(spark)
        lines = [(number, "", "drop", t, None, None, None, None, None, None) for t in tables] if self.drop else []
        self._add(spark, lines)
        for table in tables if self.drop else []:
            delete_path(spark, self.path(table))

    def begin(self, spark: SparkSession, tables: Mapping[str, object] | list[str], span: tuple[int, int] | None = None) -> None:
        """Starts a run over ``tables`` and a range of blocks; without a range it adds rows."""
        number = self._next(spark)
        first, last = span or (None, None)
        self._open = Run(number, f"{number:08d}-{uuid.uuid4().hex[:8]}", first, last)
        self._tables = tuple(tables)

    def write(self, table: str, df: DataFrame) -> None:
        """Writes a table of the open run; outside of a run, as a run of its own that adds rows."""
        spark = df.sparkSession
        alone = self._open is None
        if alone:
            self.begin(spark, [table])
        self.store(table, df, self.run_path(table, self._open.run))
        if alone:
            self.commit(spark)

    def commit(self, spark: SparkSession) -> None:
        """Lists the run in the manifest, then deletes what it replaces."""
        run, before = self._open, live_runs(spark, self.directory)
        lines = []
        for table in self._tables:
            zones = self.zones_of(spark, table, run)
            rows = sum(z[-1] for z in zones) if zones is not None else None
            lines.append((run.number, run.run, "run", table, run.first, run.last, None, None, None, rows))
            lines += [(run.number, run.run, "zone", table, run.first, run.last, *z) for z in zones or ()]
        self.finish(spark, run, self._tables)
        self._add(spark, lines)
        self._open = None
        after = live_runs(spark, self.directory)
        for table, runs in before.items():
            kept = {r.run for r in after.get(table, [])}
            for old in runs:
                if old.run not in kept:
                    delete_path(spark, self.run_path(table, old.run))

    def store(self, table: str, df: DataFrame, path: str) -> None:
        raise NotImplementedError

    def zones_of(self, spark: SparkSession, table: str, run: Run) -> list[tuple] | None:
        """(bucket, lowest block, highest block, rows) of the table's partitions, if the sink keeps them."""
        return None

    def finish(self, spark: SparkSession, run: Run, tables: tuple[str, ...]) -> None:
        """What a sink keeps beside the tables of a run."""

    def live(self, spark: SparkSession, table: str) -> list[Run]:
        return live_runs(spark, self.directory).get(table, [])

    def _next(self, spark: SparkSession) -> int:
        return (entries(spark, self.directory).agg(F.max("number")).first()[0] or 0) + 1

    def _add(self, spark: SparkSession, lines: list[tuple]) -> None:
        added = spark.createDataFrame(lines, ENTRY).coalesce(1)
        added.write.mode("append").parquet(f"{self.directory.rstrip('/')}/{MANIFEST}")


def exists(spark: SparkSession, path: str) -> bool:
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark._jsc.hadoopConfiguration()).exists(target)
