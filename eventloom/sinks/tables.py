"""Where decoded tables go: Parquet, CSV and document folders."""

from __future__ import annotations

import logging
from collections.abc import Callable, Sequence
from contextlib import nullcontext
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, DataFrameWriter, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from eventloom.config import (
    BLOCK_BUCKET, BLOCK_LOG_INDEX, BUCKET_BLOCKS, NATIVE_COLUMNS, NATIVE_TABLE, TX_LOG_INDEX, ConfigError, JobConfig,
)
from eventloom.plans.documents import to_documents
from eventloom.session import COMPRESSION, unsorted_writes
from eventloom.sinks.runs import RUN, Run, RunFolders, entries, exists, live_runs
from eventloom.sources.csv import read_event_csv

log = logging.getLogger(__name__)

# Columns whose values are spread over all blocks: files sorted by block cannot be
# skipped by their value range, so row groups carry a bloom filter for them.
SCATTERED_COLUMNS = ("tx_hash", "topic1", "topic2")


def native_schema() -> T.StructType:
    return T.StructType([T.StructField(n, t) for n, t in NATIVE_COLUMNS.items()])


def configured_tables(config: JobConfig) -> dict[str, T.StructType]:
    tables = config.table_schemas()
    if config.native_transfers:
        tables[NATIVE_TABLE] = native_schema()
    return tables


# Buckets of ordered rows that a task keeps open: it reads few stretches of blocks.
OPEN_BUCKETS = 4


def _bucket() -> Column:
    return F.floor(F.col("block_number") / BUCKET_BLOCKS)


def by_block(df: DataFrame) -> DataFrame:
    """Rows gathered by block bucket and sorted by block, for tight file statistics.

    Rebalancing splits a bucket that is too large for one task and merges small
    ones, so a hot bucket or block does not make a hot writer.
    """
    bucketed = df.withColumn("block_bucket", _bucket())
    order = [c for c in ("block_number", "transaction_index", "log_index") if c in df.columns]
    return bucketed.hint("rebalance", "block_bucket").sortWithinPartitions("block_bucket", *order)


@dataclass
class ParquetSink(RunFolders):
    """A folder of Parquet files per table, partitioned by run and block bucket.

    The manifest keeps the lowest and highest block of every partition, and an index beside the
    tables says which buckets hold a transaction hash. ``ordered`` says that rows arrive in stretches of
    blocks, as from stored receipts; they are then written as they come instead of gathered by block first.
    """

    directory: str
    drop: bool = False
    name: str = "parquet"
    ordered: bool = False

    def store(self, table: str, df: DataFrame, path: str) -> None:
        spark = df.sparkSession
        rows = df.withColumn(BLOCK_BUCKET, _bucket()) if self.ordered else by_block(df)
        writer = rows.write.mode("append").partitionBy(BLOCK_BUCKET).option("compression", COMPRESSION)
        for c in SCATTERED_COLUMNS:
            if c in df.columns:
                writer = writer.option(f"parquet.bloom.filter.enabled#{c}", "true")
        writer = writer.option("parquet.bloom.filter.adaptive.enabled", "true")
        with unsorted_writes(spark, OPEN_BUCKETS) if self.ordered else nullcontext():
            writer.parquet(path)

    def zones_of(self, spark: SparkSession, table: str, run: Run) -> list[tuple]:
        path = self.run_path(table, run.run)
        if not exists(spark, path):
            return []
        return [tuple(r) for r in block_boundaries(_run_rows(spark, path, "block_number bigint"), rows=True).collect()]

    def finish(self, spark: SparkSession, run: Run, tables: Sequence[str]) -> None:
        paths = [self.run_path(t, run.run) for t in tables if t != NATIVE_TABLE]
        frames = [_run_rows(spark, p, "tx_hash string") for p in paths if exists(spark, p)]
        if frames:
            hashes = reduce(DataFrame.unionByName, frames).where("tx_hash IS NOT NULL")
            _indexed(hashes).write.mode("append").partitionBy(INDEX_FOLDER).parquet(self.run_path(HASH_INDEX, run.run))

    def read(
        self, spark: SparkSession, table: str, schema: T.StructType, live: dict[str, list[Run]] | None = None
    ) -> DataFrame:
        """The stored table; the position in the block is null where the chain tables lack it.

        A caller that reads several tables looks at the manifest once (``live_runs``).
        """
        stored = T.StructType(schema.fields + [T.StructField(BLOCK_BUCKET, T.LongType())])
        if table != NATIVE_TABLE:
            stored = stored.add(TX_LOG_INDEX, T.LongType()).add(BLOCK_LOG_INDEX, T.LongType())
        return _live_rows(
            self.live(spark, table) if live is None else live.get(table, []),
            lambda runs: self._read_runs(spark, table, runs, stored),
            spark.createDataFrame([], stored),
        )

    def _read_runs(self, spark: SparkSession, table: str, runs: Sequence[str], schema: T.StructType | str) -> DataFrame:
        reader = spark.read.schema(schema).option("basePath", self.path(table))
        return reader.parquet(*[self.run_path(table, r) for r in runs]).drop(RUN)

    def zones(self, spark: SparkSession, tables: Sequence[str]) -> DataFrame:
        """table, block_bucket, min_block, max_block and rows of what the tables hold now.

        Comes from the manifest alone. Only for a run that a later one replaces in part are its
        partitions counted again, over the blocks that are left.
        """
        listed = entries(spark, self.directory).where("kind = 'zone'")
        runs = live_runs(spark, self.directory)
        live = [(t, r) for t in tables for r in runs.get(t, [])]
        whole = [(t, r.run) for t, r in live if r.predicate() is None]
        kept = spark.createDataFrame(whole, "table string, run string")
        parts = [listed.join(F.broadcast(kept), ["table", "run"], "left_semi").select(*ZONE)]
        for table, run in live:
            if run.predicate() is not None:
                left = _run_rows(spark, self.run_path(table, run.run), "block_number bigint").where(run.predicate())
                parts.append(block_boundaries(left, rows=True).select(F.lit(table).alias("table"), *ZONE[1:]))
        return reduce(DataFrame.unionByName, parts)

    def buckets_of(self, spark: SparkSession, tx_hash: str) -> list[int]:
        """The block buckets that may hold a transaction, from the index alone."""
        digits = tx_hash.lower().removeprefix("0x")
        runs = {r.run for t, runs in live_runs(spark, self.directory).items() if t != NATIVE_TABLE for r in runs}
        indexed = [r for r in sorted(runs) if exists(spark, self.run_path(HASH_INDEX, r))]
        if not indexed:
            return []
        index = self._read_runs(spark, HASH_INDEX, indexed, INDEX)
        start = digits[:INDEX_DIGITS]
        found = index.where((F.col(INDEX_FOLDER) == start[:2]) & (F.col("prefix") == start))
        return sorted(r[0] for r in found.select(BLOCK_BUCKET).distinct().collect())


ZONE = ["table", BLOCK_BUCKET, "min_block", "max_block", "rows"]
# The hash index: the first digits of a transaction hash and the buckets with such a transaction.
HASH_INDEX = "tx-hash-index"
INDEX_FOLDER = "start"
INDEX_DIGITS = 8
INDEX = f"prefix string, {BLOCK_BUCKET} bigint, {INDEX_FOLDER} string"


def _indexed(hashes: DataFrame) -> DataFrame:
    prefix = F.lower(F.substring("tx_hash", 3, INDEX_DIGITS))
    rows = hashes.select(prefix.alias("prefix"), BLOCK_BUCKET, F.substring(prefix, 1, 2).alias(INDEX_FOLDER)).distinct()
    return rows.hint("rebalance", INDEX_FOLDER).sortWithinPartitions(INDEX_FOLDER, "prefix")


def _run_rows(spark: SparkSession, path: str, column: str) -> DataFrame:
    """One column of a run's table, and the bucket its folder tells."""
    return spark.read.schema(f"{column}, {BLOCK_BUCKET} bigint").parquet(path)


def _live_rows(runs: Sequence[Run], read: Callable[[list[str]], DataFrame], empty: DataFrame) -> DataFrame:
    """The rows of runs that count: one read of all whole ones, one of each that was replaced in part."""
    whole = [r.run for r in runs if r.predicate() is None]
    frames = [read(whole)] if whole else []
    frames += [read([r.run]).where(r.predicate()) for r in runs if r.predicate() is not None]
    return reduce(DataFrame.unionByName, frames) if frames else empty


def event_tables_at(spark: SparkSession, config: JobConfig, directory: str) -> dict[str, DataFrame]:
    """The stored event tables of a job."""
    sink, live = ParquetSink(directory), live_runs(spark, directory)
    return {table: sink.read(spark, table, schema, live) for table, schema in config.table_schemas().items()}


def _coded(writer: DataFrameWriter, codec: str) -> DataFrameWriter:
    return writer.option("compression", codec) if codec else writer


@dataclass
class CsvSink(RunFolders):
    """A folder of CSV files with header per table, one folder a run; compressed where ``codec`` names one."""

    directory: str
    drop: bool = False
    name: str = "csv"
    codec: str = ""

    def store(self, table: str, df: DataFrame, path: str) -> None:
        _coded(df.write.mode("append"), self.codec).option("header", True).csv(path)

    def read(self, spark: SparkSession, table: str, schema: T.StructType) -> DataFrame:
        return _live_rows(
            [r for r in self.live(spark, table) if exists(spark, self.run_path(table, r.run))],
            lambda runs: read_event_csv(spark, [self.run_path(table, r) for r in runs], schema),
            spark.createDataFrame([], schema),
        )


@dataclass
class DocumentSink(RunFolders):
    """A folder of newline-delimited JSON per table, one folder a run, ready for a search index to ingest."""

    directory: str
    prefix: str
    drop: bool = False
    integers: Callable[[str], set[str]] = field(default=lambda table: set())
    name: str = "documents"
    codec: str = ""

    def path(self, table: str) -> str:
        return f"{self.directory.rstrip('/')}/{self.prefix}-{table}"

    def store(self, table: str, df: DataFrame, path: str) -> None:
        _coded(to_documents(df, self.integers(table)).write.mode("append"), self.codec).text(path)

    def read(self, spark: SparkSession, table: str) -> DataFrame:
        """The documents that count, one JSON text a row."""
        number = F.get_json_object("document", "$.block_number").cast("bigint").alias("block_number")
        runs = [r for r in self.live(spark, table) if exists(spark, self.run_path(table, r.run))]
        return _live_rows(
            runs,
            lambda names: spark.read.text([self.run_path(table, r) for r in names])
            .select(F.col("value").alias("document"))
            .select("document", number),
            spark.createDataFrame([], "document string, block_number bigint"),
        ).select("document")


Sink = ParquetSink | CsvSink | DocumentSink
SinkFactory = Callable[[JobConfig], Sink | None]


def _parquet(config: JobConfig) -> Sink | None:
    return config.parquet and ParquetSink(config.parquet.directory, config.parquet.drop)


def _documents(config: JobConfig) -> Sink | None:
    spec = config.documents
    return spec and DocumentSink(
        spec.directory, spec.prefix, spec.recreate, config.integer_columns, codec=config.compression
    )


def _csv(config: JobConfig) -> Sink | None:
    return CsvSink(config.csv, codec=config.compression) if config.csv else None


SINK_FACTORIES: list[SinkFactory] = [_parquet, _csv, _documents]


def open_sinks(
    spark: SparkSession, config: JobConfig, factories: list[SinkFactory] | None = None
) -> list[Sink]:
    """Every sink the job asks for. One that cannot be prepared is skipped; none at all is an error."""
    sinks = []
    for factory in SINK_FACTORIES if factories is None else factories:
        try:
            sink = factory(config)
            if sink is None:
                continue
            sink.prepare(spark, configured_tables(config))
        except Exception as e:
            log.warning("sink skipped: %s", e)
            continue
        sinks.append(sink)
    if not sinks:
        raise ConfigError("no sink configured")
    return sinks


def block_boundaries(tables: DataFrame, rows: bool = False) -> DataFrame:
    """Lowest and highest block of every bucket of a table, and its rows if asked for."""
    bucket = F.floor(F.col("block_number") / BUCKET_BLOCKS).alias("block_bucket")
    counted = [F.count("*").alias("rows")] if rows else []
    return tables.groupBy(bucket).agg(
        F.min("block_number").alias("min_block"), F.max("block_number").alias("max_block"), *counted
    )
