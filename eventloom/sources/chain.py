"""Scans over the chain tables: headers and receipts.

headers : block_number BIGINT, block_hash STRING, timestamp BIGINT, logs_bloom BINARY
receipts: block_number BIGINT, transaction_index BIGINT, tx_hash STRING, from STRING,
          to STRING, value STRING, logs ARRAY<STRUCT<address, topics ARRAY<STRING>, data>>

Receipts may also carry ``block_log_start`` (position in its block of the first
log of the transaction). A transaction with very many logs may be spread over
several rows, each with ``first_log`` (position in its transaction of the first
log of the row) and ``whole`` (false for such rows). Stored receipts are partitioned by
``block_bucket``, stretches of blocks whose length the column's metadata tells.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from eventloom.config import BLOCK_BUCKET
from eventloom.operators.running import running_totals
from eventloom.session import COMPRESSION

TX_ID_SPAN = 1 << 16
# Blocks of a partition of stored receipts.
CHAIN_BUCKET_BLOCKS = 10_000
# Blocks of one built-in bitmap.
STRETCH_BLOCKS = 1 << 15


def read_headers(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def write_receipts(receipts: DataFrame, path: str, blocks: int = CHAIN_BUCKET_BLOCKS) -> None:
    """Stores receipts sorted by block and partitioned by stretches of blocks, so that block lookups prune folders."""
    store_receipts(by_place(receipts, blocks), path)


def by_place(receipts: DataFrame, blocks: int = CHAIN_BUCKET_BLOCKS) -> DataFrame:
    """Receipts, or numbers that they can be told from, in the order in which they are stored."""
    order = [c for c in ("block_number", "transaction_index", "first_log") if c in receipts.columns]
    placed = receipts.withColumn(BLOCK_BUCKET, F.floor(F.col("block_number") / blocks))
    return placed.repartitionByRange(*order).sortWithinPartitions(BLOCK_BUCKET, *order)


def store_receipts(placed: DataFrame, path: str) -> None:
    """Writes receipts that are in the order of ``by_place``; no row is moved or sorted again."""
    placed.write.option("compression", COMPRESSION).partitionBy(BLOCK_BUCKET).parquet(path)


def read_receipts(spark: SparkSession, path: str, blocks: int = CHAIN_BUCKET_BLOCKS) -> DataFrame:
    """Receipts from a folder; ``blocks`` is the length of its partitions, where it has some."""
    stored = spark.read.parquet(path)
    return stored.withMetadata(BLOCK_BUCKET, {"blocks": blocks}) if BLOCK_BUCKET in stored.columns else stored


def bucket_blocks(receipts: DataFrame) -> int:
    return receipts.schema[BLOCK_BUCKET].metadata.get("blocks", CHAIN_BUCKET_BLOCKS)


def in_block_range(df: DataFrame, first: int, last: int | None = None) -> DataFrame:
    """Rows of the inclusive block range; plain comparisons, so they reach the scan and its partitions."""
    number = F.col("block_number")
    rows = df.where(number >= first if last is None else number.between(first, last))
    if "blocks" not in (df.schema[BLOCK_BUCKET].metadata if BLOCK_BUCKET in df.columns else {}):
        return rows
    bucket, width = F.col(BLOCK_BUCKET), bucket_blocks(df)
    return rows.where(bucket >= first // width if last is None else bucket.between(first // width, last // width))


def best_block(headers: DataFrame) -> DataFrame:
    return headers.agg(F.max("block_number").alias("best_block"))


def last_contiguous_block(headers: DataFrame, first: int) -> DataFrame:
    """The last block before the first gap at or after ``first``.

    ``first - 1`` if that is missing. The blocks present become one bitmap per 32,768 of them, so the
    only shuffle carries a bit a block, combined before it, and the search for the gap looks at one
    short row per stretch.
    """
    place = F.col("block_number") - F.lit(first - 1)
    stretches = (
        headers.where(F.col("block_number") >= first)
        .select(F.bitmap_bucket_number(place).alias("stretch"), F.bitmap_bit_position(place).alias("bit"))
        .groupBy("stretch")
        .agg(F.bitmap_construct_agg("bit").alias("bits"))
        .select("stretch", (F.bitmap_count("bits") == STRETCH_BLOCKS).alias("full"), _leading_ones("bits").alias("ones"))
    )
    follower = F.lead("stretch").over(Window.orderBy("stretch"))
    start = F.lit(first - 1) + (F.col("stretch") - 1) * STRETCH_BLOCKS
    end = F.when(~F.col("full"), start + F.col("ones")).when(
        F.coalesce(follower != F.col("stretch") + 1, F.lit(True)), start + STRETCH_BLOCKS
    )
    ends = stretches.select("stretch", end.alias("end"))
    begun = F.coalesce(F.min("stretch"), F.lit(0)) == 1
    return ends.agg(F.when(begun, F.min("end")).otherwise(first - 1).alias("last_block"))


def _leading_ones(bits: str) -> Column:
    """How many bits of a bitmap are set before the first unset one, from its lowest on."""
    digits = F.hex(bits)
    whole = F.floor((F.length(digits) - F.length(F.ltrim(digits, F.lit("F")))) / 2)
    byte = F.conv(F.substring(digits, whole.cast("int") * 2 + 1, F.lit(2)), 16, 10).cast("int")
    low = F.bit_count(byte.bitwiseAND(F.bitwise_not(byte + 1)))
    return whole * 8 + F.coalesce(low, F.lit(0))


def contiguous_prefix(headers: DataFrame, first: int) -> DataFrame:
    """Headers from ``first`` up to the first missing block."""
    last = last_contiguous_block(headers, first).scalar()
    return headers.where((F.col("block_number") >= first) & (F.col("block_number") <= last))


def resolve_range(headers: DataFrame, first: int, last: int | None) -> tuple[int, int]:
    """The block range of a job as two numbers, so that both scans can prune by them."""
    if last is None:
        last = best_block(headers).first()[0]
        if last is None:
            return first, first - 1
    end = last_contiguous_block(in_block_range(headers, first, last), first).first()[0]
    return first, min(last, end)


def raw_logs(receipts: DataFrame) -> DataFrame:
    """One row per log, with its position in the transaction."""
    first = F.col("first_log") if "first_log" in receipts.columns else F.lit(0).cast("bigint")
    logs = receipts.select(
        "block_number", "transaction_index", "tx_hash", first.alias("first_log"), F.posexplode("logs")
    )
    return logs.select(
        "block_number",
        "transaction_index",
        "tx_hash",
        (F.col("first_log") + F.col("pos")).alias("log_position"),
        F.col("col.address").alias("address"),
        F.col("col.topics").alias("topics"),
        F.col("col.data").alias("data"),
    )


def flatten_topics(logs: DataFrame) -> DataFrame:
    """topics array -> topic0..topic3 (null when absent); data -> hex text, 0x when empty."""
    data = F.col("data")
    if dict(logs.dtypes)["data"] == "binary":
        data = F.concat(F.lit("0x"), F.lower(F.hex(data)))
    return logs.select(
        *[c for c in logs.columns if c not in ("topics", "data")],
        *[F.get("topics", F.lit(i)).alias(f"topic{i}") for i in range(4)],
        F.coalesce(data, F.lit("0x")).alias("data"),
    )


def tx_ordinals(transactions: DataFrame, tx_id: str = "tx_id") -> DataFrame:
    """Adds the 0-based position of every transaction in its block.

    Ids are unique, so one span of ids bounds what a single task ranks, however
    many transactions a block has.
    """
    return running_totals(
        transactions,
        group=["block_number"],
        order=[tx_id],
        bucket=F.floor(F.col(tx_id) / TX_ID_SPAN),
        values={"transaction_index": F.lit(1)},
    )


def enrich_blocks(receipts: DataFrame, headers: DataFrame) -> DataFrame:
    """Receipts with the hash and time of their block.

    No broadcast hint: headers grow with the chain, so the size decides.
    """
    return receipts.join(
        headers.select("block_number", "block_hash", "timestamp"), "block_number"
    )
