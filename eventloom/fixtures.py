"""Chain tables derived from the TPC-H-like test tables.

One block per order date, one transaction per order, one log per line item:
days without orders are block gaps, line 7 has one topic too few and line 6 half
a word of data. Each derived table is written once per session to the scratch
folder, the way a chain is stored, and then read like any chain table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from eventloom.config import BLOCK_BUCKET, AbiInput, AbiItem, ContractMapping, JobConfig
from eventloom.functions.bloom import bloom_of_bits
from eventloom.functions.keccak import bloom_bits_column
from eventloom.operators.decode import decode
from eventloom.operators.running import running_totals
from eventloom.plans.logs import union_logs
from eventloom.session import COMPRESSION, delete_path, scratch_path, shuffles_dropped
from eventloom.sinks.tables import ParquetSink, configured_tables, event_tables_at
from eventloom.sources.chain import (
    TX_ID_SPAN, by_place, raw_logs, read_receipts, store_receipts, tx_ordinals,
)

LOGS_PER_ROW = 1024
# Orders of more logs than that whose keys may be broadcast.
FEW_ORDERS = 100_000
# Blocks of a partition of the stored receipts.
RECEIPT_BLOCKS = 256
EPOCH_SECONDS = 788918400
CONTRACTS = {"A": "0x" + "aa" * 20, "N": "0x" + "bb" * 20, "R": "0x" + "cc" * 20}
AA, BB, CC = CONTRACTS.values()
LINE_ORDER = [
    "l_linenumber",
    "l_partkey",
    "l_suppkey",
    "l_extendedprice",
    "l_returnflag",
    "l_linestatus",
]
ORDER_FIELDS = ["o_custkey", "o_orderstatus", "o_orderpriority", "o_totalprice"]


def _item(name: str, *inputs: tuple[str, str, bool]) -> AbiItem:
    return AbiItem(name, tuple(AbiInput(n, t, i) for n, t, i in inputs))


TRANSFER = _item("Transfer", ("from", "address", True), ("to", "address", True), ("value", "uint256", False))
APPROVAL = _item(
    "Approval", ("owner", "address", True), ("spender", "address", True), ("value", "uint256", False)
)
ALL_EVENTS = ContractMapping((TRANSFER, APPROVAL))

# One order is one log of this event, with a word for every kind of ABI value.
SETTLED = _item(
    "Settled",
    ("ref", "bytes32", False),
    ("customer", "address", True),
    ("urgent", "bool", False),
    ("tier", "uint8", False),
    ("day", "uint16", False),
    ("cents32", "uint32", False),
    ("scaled64", "uint64", False),
    ("scaled128", "uint128", False),
    ("scaled256", "uint256", False),
    ("delta8", "int8", False),
    ("delta16", "int16", False),
    ("delta32", "int32", False),
    ("delta64", "int64", False),
    ("delta128", "int128", False),
    ("delta256", "int256", False),
    ("memo", "bytes", False),
    ("label", "string", False),
    ("kind", "uint24", False),
    ("order", "uint64", True),
)

_written: dict[tuple[str, str, str], str] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _stored(spark: SparkSession, sf_dir: str, name: str, build) -> str:
    """Path of a derived table, built on first use in this application."""
    key = (spark.sparkContext.applicationId, sf_dir, name)
    if key not in _written:
        path = scratch_path(spark, name)
        with shuffles_dropped(spark):
            build(path)
        _written[key] = path
    return _written[key]


def _word(number: Column) -> Column:
    return F.lpad(F.lower(F.hex(number)), 64, "0")


def _log_of(line: Column) -> Column:
    flag, status = line["l_returnflag"], line["l_linestatus"]
    cents = F.round(line["l_extendedprice"] * 100).cast("bigint")
    contract = F.when(flag == "A", AA).when(flag == "N", BB).otherwise(CC)
    topics = F.array(
        F.when(status == "O", TRANSFER.topic0).otherwise(APPROVAL.topic0),
        F.concat(F.lit("0x"), _word(line["l_suppkey"])),
        F.when(line["l_linenumber"] != 7, F.concat(F.lit("0x"), _word(line["l_partkey"]))),
    )
    value = F.lpad(F.concat(F.lower(F.hex(cents)), F.lit("0" * 15)), 64, "0")
    data = F.when(line["l_linenumber"] == 6, F.lit("0" * 32)).otherwise(value)
    return F.struct(
        contract.alias("address"),
        F.array_compact(topics).alias("topics"),
        F.concat(F.lit("0x"), data).alias("data"),
    )


def _sorted_lines(spark: SparkSession, sf_dir: str, orders: DataFrame | None = None) -> DataFrame:
    """Line items (of the given orders) sorted into runs of about equal size, each row tagged with its run.

    Range partitioning on every ordering column, with the row's place in the input
    to part equal copies, cuts any order into several runs if it is large. Written
    out, the tags hold for good.
    """

    def build(path: str) -> None:
        lines = (
            table(spark, sf_dir, "lineitem")
            .select("l_orderkey", *LINE_ORDER)
            .withColumn("copy", F.monotonically_increasing_id())
        )
        if orders is not None:
            lines = lines.join(orders, "l_orderkey", "left_semi")
        order = ["l_orderkey", *LINE_ORDER, "copy"]
        (
            lines.repartitionByRange(*order)
            .sortWithinPartitions(*order)
            .withColumn("run", F.spark_partition_id())
            .write.parquet(path)
        )

    return spark.read.parquet(_stored(spark, sf_dir, "lines" if orders is None else "some-lines", build))


def numbered_lines(spark: SparkSession, sf_dir: str, orders: DataFrame | None = None) -> DataFrame:
    """Line items (of the given orders) with their position in the order: place in the run plus earlier runs."""
    lines = _sorted_lines(spark, sf_dir, orders)
    inside = Window.partitionBy("l_orderkey", "run").orderBy(*LINE_ORDER, "copy")
    across = Window.partitionBy("l_orderkey").orderBy("run").rowsBetween(Window.unboundedPreceding, -1)
    starts = (
        lines.groupBy("l_orderkey", "run")
        .agg(F.count("*").alias("n"))
        .select("l_orderkey", "run", F.sum("n").over(across).alias("start"))
    )
    return (
        lines.withColumn("place", F.row_number().over(inside) - 1)
        .join(starts, ["l_orderkey", "run"])
        .withColumn("position", (F.coalesce("start", F.lit(0)) + F.col("place")).cast("bigint"))
        .drop("run", "copy", "place", "start")
    )


def block_number(date: str = "o_orderdate") -> Column:
    return F.datediff(F.col(date), F.lit("1995-01-01").cast("date")).cast("bigint")


def block_hash(number: Column) -> Column:
    return F.concat(F.lit("0x"), F.sha2(F.concat(F.lit("block:"), number.cast("string")), 256))


def tx_hash(order: Column) -> Column:
    return F.concat(F.lit("0x"), F.sha2(F.concat(F.lit("tx:"), order.cast("string")), 256))


def transactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as transactions: block_number, tx_id and the paid amount."""
    return _orders(spark, sf_dir).select("block_number", "tx_id", *_tx_texts())


def _orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders with their block and transaction id, as numbers."""
    orders = table(spark, sf_dir, "orders")
    return orders.select(
        block_number().alias("block_number"), F.col("o_orderkey").alias("tx_id"), *ORDER_FIELDS
    )


def _tx_texts() -> list[Column]:
    """The texts of a transaction, from the numbers of its order."""
    return [
        tx_hash(F.col("tx_id")).alias("tx_hash"),
        F.concat(F.lit("0x"), F.lpad(F.lower(F.hex("o_custkey")), 40, "0")).alias("from"),
        F.when(F.col("o_orderstatus") != "P", AA).alias("to"),
        F.when(
            F.col("o_orderpriority") == "1-URGENT",
            F.round(F.col("o_totalprice") * 100).cast("bigint").cast("string"),
        )
        .otherwise("0")
        .alias("value"),
    ]


def _placed_transactions(spark: SparkSession, sf_dir: str, counts: DataFrame) -> DataFrame:
    """Orders as numbers, with ``n_logs`` and their places in the block."""
    orders = _orders(spark, sf_dir).join(counts, "tx_id", "left")
    return running_totals(
        orders.withColumn("n_logs", F.coalesce("n_logs", F.lit(0))),
        group=["block_number"],
        order=["tx_id"],
        bucket=F.floor(F.col("tx_id") / TX_ID_SPAN),
        values={"transaction_index": F.lit(1), "block_log_start": F.col("n_logs")},
    )


def _rows_of_lines(spark: SparkSession, sf_dir: str, logs_per_row: int) -> DataFrame:
    """Transactions as numbers, a row per ``part`` of ``logs_per_row`` lines, which are in order in ``lines``.

    An order of up to ``LOGS_PER_ROW`` lines is gathered whole; the lines of larger ones are numbered
    in sorted runs, so that none meets in one task.
    """
    lines = table(spark, sf_dir, "lineitem").where("l_orderkey IS NOT NULL")
    counts = lines.groupBy(F.col("l_orderkey").alias("tx_id")).agg(F.count("*").alias("n_logs"))
    txs = _placed_transactions(spark, sf_dir, counts)
    large = counts.where(F.col("n_logs") > LOGS_PER_ROW).select(F.col("tx_id").alias("l_orderkey"))
    n_large = large.count()
    large = F.broadcast(large) if n_large <= FEW_ORDERS else large
    lines = lines.select("l_orderkey", F.struct(*LINE_ORDER).alias("line"))
    if n_large:
        lines = lines.join(large, "l_orderkey", "left_anti")
    # Shuffled as they are, lines are gathered once, and not in front of the shuffle too.
    gathered = (
        lines.repartition("l_orderkey")
        .groupBy(F.col("l_orderkey").alias("tx_id"))
        .agg(F.array_sort(F.collect_list("line")).alias("lines"))
    )
    rows = txs.where(F.col("n_logs") <= LOGS_PER_ROW).join(gathered.hint("merge"), "tx_id", "left")
    none = F.array().cast(gathered.schema["lines"].dataType)
    starts = F.sequence(F.lit(0), F.greatest(F.size("lines"), F.lit(1)) - 1, F.lit(logs_per_row))
    slices = F.transform(starts, lambda n: F.slice("lines", n + 1, logs_per_row))
    rows = rows.withColumn("lines", F.coalesce("lines", none)).select(*txs.columns, F.posexplode(slices).alias("part", "lines"))
    rows = rows.withColumn("part", F.col("part").cast("bigint"))
    if not n_large:
        return rows
    placed = (
        numbered_lines(spark, sf_dir, large)
        .select(
            F.col("l_orderkey").alias("tx_id"),
            F.floor(F.col("position") / logs_per_row).alias("part"),
            F.struct("position", F.struct(*LINE_ORDER).alias("line")).alias("at"),
        )
        .groupBy("tx_id", "part")
        .agg(F.transform(F.array_sort(F.collect_list("at")), lambda at: at["line"]).alias("lines"))
    )
    more = txs.where(F.col("n_logs") > LOGS_PER_ROW).join(placed.hint("merge"), "tx_id")
    return rows.unionByName(more)


def _build_receipts(spark: SparkSession, sf_dir: str, path: str, logs_per_row: int) -> None:
    """Only numbers are shuffled and sorted; a receipt is spelt out when it is written.

    The gathered rows are kept before they are sorted, so that the shuffles that made them are gone by then.
    """
    rows = _rows_of_lines(spark, sf_dir, logs_per_row)
    gathered = scratch_path(spark, "gathered-lines")
    rows.write.option("compression", COMPRESSION).parquet(gathered)
    rows = spark.read.schema(rows.schema).parquet(gathered).withColumn("first_log", F.col("part") * logs_per_row)
    receipts = by_place(rows, RECEIPT_BLOCKS).select(
        "block_number",
        "transaction_index",
        *_tx_texts(),
        F.transform("lines", _log_of).alias("logs"),
        "block_log_start",
        "first_log",
        (F.col("n_logs") <= logs_per_row).alias("whole"),
        BLOCK_BUCKET,
    )
    store_receipts(receipts, path)
    delete_path(spark, gathered)


def receipts(spark: SparkSession, sf_dir: str, logs_per_row: int = LOGS_PER_ROW) -> DataFrame:
    """Receipts, as a chain stores them; transactions of many logs are spread over several rows."""
    path = _stored(
        spark,
        sf_dir,
        f"receipts-{logs_per_row}",
        lambda p: _build_receipts(spark, sf_dir, p, logs_per_row),
    )
    return read_receipts(spark, path, RECEIPT_BLOCKS)


def plain_headers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Headers without blooms. They are stored, so that a join knows how few they are."""
    number = F.col("block_number")

    def build(path: str) -> None:
        numbers = table(spark, sf_dir, "orders").select(block_number().alias("block_number")).distinct()
        numbers.select(
            "block_number",
            block_hash(number).alias("block_hash"),
            (F.lit(EPOCH_SECONDS).cast("bigint") + number * 86400).alias("timestamp"),
        ).write.parquet(path)

    return spark.read.parquet(_stored(spark, sf_dir, "plain-headers", build))


def _build_headers(spark: SparkSession, sf_dir: str, path: str) -> None:
    """Only bits are shuffled, each at most once a block and task; a batch hashes its distinct items once."""
    items = raw_logs(receipts(spark, sf_dir)).select(
        "block_number", F.explode(F.concat(F.array("address"), "topics")).alias("item")
    )
    bits = items.select("block_number", F.explode(bloom_bits_column(F.col("item"))).alias("bit")).distinct()
    blooms = bits.groupBy("block_number").agg(bloom_of_bits(F.col("bit")).alias("logs_bloom"))
    empty = F.lit(bytearray(256))
    (
        plain_headers(spark, sf_dir)
        .join(blooms, "block_number", "left")
        .withColumn("logs_bloom", F.coalesce("logs_bloom", empty))
        .repartitionByRange("block_number")
        .sortWithinPartitions("block_number")
        .write.parquet(path)
    )


def headers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(
        _stored(spark, sf_dir, "headers", lambda p: _build_headers(spark, sf_dir, p))
    )


def event_folder(spark: SparkSession, sf_dir: str) -> str:
    """The folder of the Transfer and Approval tables of all contracts."""
    config = JobConfig(mappings=(ALL_EVENTS,), from_block=0)

    def build(path: str) -> None:
        sink = ParquetSink(path, ordered=True)
        sink.prepare(spark, configured_tables(config))
        tables = decode(receipts(spark, sf_dir), plain_headers(spark, sf_dir), config.events())
        sink.begin(spark, tables)
        for name, df in tables.items():
            sink.write(name, df)
        sink.commit(spark)

    return _stored(spark, sf_dir, "events", build)


def event_sink(spark: SparkSession, sf_dir: str) -> ParquetSink:
    return ParquetSink(event_folder(spark, sf_dir))


def event_table_frames(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    """The Transfer and Approval tables of all contracts, stored by the job itself."""
    return event_tables_at(spark, JobConfig(mappings=(ALL_EVENTS,), from_block=0), event_folder(spark, sf_dir))


def logs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return union_logs(event_table_frames(spark, sf_dir))


def _settled_data() -> Column:
    cents = F.round(F.col("o_totalprice") * 100).cast("bigint")
    key, customer = F.col("tx_id"), F.col("o_custkey")
    # Centred on zero, so about half of the signed values are negative.
    delta = cents - 25_000_000

    def signed(number: Column, shift: int = 0) -> Column:
        """Two's complement word of number * 16^shift."""
        fill = F.when(number < 0, F.lit("f")).otherwise(F.lit("0"))
        digits = F.concat(F.lpad(F.lower(F.hex(number)), 16, "0"), F.lit("0" * shift))
        return F.concat(F.repeat(fill, F.lit(64 - 16 - shift)), digits)

    def scaled(number: Column, shift: int) -> Column:
        return F.lpad(F.concat(F.lower(F.hex(number)), F.lit("0" * shift)), 64, "0")

    words = [
        F.sha2(F.concat(F.lit("ref:"), key.cast("string")), 256),
        _word((F.col("o_orderpriority") == "1-URGENT").cast("bigint") * 2),
        _word(F.substring("o_orderpriority", 1, 1).cast("bigint")),
        _word(F.col("block_number")),
        _word(cents),
        scaled(cents, 9),
        scaled(cents, 25),
        scaled(cents, 57),
        signed(delta % 128),
        signed(delta % 32768),
        signed(delta),
        signed(delta, 9),
        signed(delta, 20),
        signed(delta, 40),
        _word(customer % 7),
        _word(customer % 5),
        _word(customer),
    ]
    return F.concat(F.lit("0x"), *words)


def _build_settled(spark: SparkSession, sf_dir: str, path: str) -> None:
    """Ordinals and order come from numbers; the words of a log are spelt out behind the last shuffle."""
    log = F.struct(
        F.lit(AA).alias("address"),
        F.array(
            F.lit(SETTLED.topic0),
            F.concat(F.lit("0x"), _word(F.col("o_custkey"))),
            F.concat(F.lit("0x"), _word(F.col("tx_id"))),
        ).alias("topics"),
        _settled_data().alias("data"),
    )
    order = ["block_number", "transaction_index"]
    rows = tx_ordinals(_orders(spark, sf_dir)).repartitionByRange(*order).sortWithinPartitions(*order)
    rows.select(
        *order,
        tx_hash(F.col("tx_id")).alias("tx_hash"),
        F.concat(F.lit("0x"), F.lpad(F.lower(F.hex("o_custkey")), 40, "0")).alias("from"),
        F.lit(AA).alias("to"),
        F.lit("0").alias("value"),
        F.array(log).alias("logs"),
    ).write.option("compression", COMPRESSION).parquet(path)


def settled_receipts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every order as a transaction with one Settled log."""
    return spark.read.parquet(
        _stored(spark, sf_dir, "settled", lambda p: _build_settled(spark, sf_dir, p))
    )
