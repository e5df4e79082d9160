"""Block summaries and transaction receipts rebuilt from the logs.

A block or transaction can have any number of logs, so an answer is a sequence
of pages of bounded size: page 0 of nearly every block and transaction is all
there is. Nothing is cut off.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from eventloom.config import BLOCK_BUCKET, BUCKET_BLOCKS, TX_LOG_INDEX
from eventloom.functions.text import hex_quantity, packed_hex, spelt_hex
from eventloom.operators.filters import LATEST_TAGS, highest_block
from eventloom.plans.logs import MAX_BLOCK_LOGS, MAX_RECEIPT_LOGS, answer_log, valid_logs

ZERO_HASH = "0x" + "0" * 64
ZERO_ADDRESS = "0x" + "0" * 40
EMPTY_BLOOM = "0x" + "0" * 512

# Block fields that the logs do not determine.
BLOCK_CONSTANTS = {
    "parentHash": ZERO_HASH,
    "nonce": "0x0000000000000000",
    "sha3Uncles": "0x1dcc4de8dec75d7aab85b567b6ccd41ad312451b948a7413f0a142fd40d49347",
    "logsBloom": EMPTY_BLOOM,
    "transactionsRoot": "0x56e81f171bcc55a6ff8345e692c0f86e5b48e01b996cadc001622fb5e363b421",
    "stateRoot": ZERO_HASH,
    "receiptsRoot": "0x56e81f171bcc55a6ff8345e692c0f86e5b48e01b996cadc001622fb5e363b421",
    "miner": ZERO_ADDRESS,
    "difficulty": "0x0",
    "totalDifficulty": "0x0",
    "extraData": "0x",
    "size": "0x0",
    "gasLimit": "0x1c9c380",
    "gasUsed": "0x0",
    "baseFeePerGas": "0x0",
    "mixHash": ZERO_HASH,
}

# Receipt fields that the logs do not determine.
RECEIPT_CONSTANTS = {
    "from": ZERO_ADDRESS,
    "cumulativeGasUsed": "0x0",
    "gasUsed": "0x0",
    "contractAddress": None,
    "logsBloom": EMPTY_BLOOM,
    "status": "0x1",
    "effectiveGasPrice": "0x0",
    "type": "0x0",
}


def _constants(values: dict[str, str | None]) -> list[Column]:
    return [F.lit(v).cast("string").alias(k) for k, v in values.items()]


def latest_block(zones: DataFrame) -> DataFrame:
    """The highest block of the stored tables, from the zones that their sink keeps."""
    return zones.agg(F.max("max_block").alias("latest_block"))


def event_counts(logs: DataFrame) -> DataFrame:
    return logs.groupBy("event").agg(F.count("*").alias("records"))


def block_tx_hashes(logs: DataFrame) -> DataFrame:
    """Sorted distinct transaction hashes of every block, in pages.

    The distinct step combines before its shuffle, so many logs per block or
    transaction cost little; a page spans 10,000 transaction positions.
    """
    page = F.floor(F.col("transaction_index") / MAX_BLOCK_LOGS).alias("page")
    seen = logs.select("block_number", "block_hash", "timestamp", page, "tx_hash").distinct()
    return seen.groupBy("block_number", "page").agg(
        F.min("block_hash").alias("block_hash"),
        F.min("timestamp").alias("timestamp"),
        F.sort_array(F.collect_set("tx_hash")).alias("transactions"),
    )


def blocks_from_logs(logs: DataFrame) -> DataFrame:
    """A summary of every block that has logs; blocks without logs have none."""
    return block_tx_hashes(logs).select(
        "block_number",
        "page",
        hex_quantity(F.col("block_number")).alias("number"),
        F.coalesce("block_hash", F.lit(ZERO_HASH)).alias("hash"),
        hex_quantity(F.coalesce("timestamp", F.lit(0))).alias("timestamp"),
        "transactions",
        F.array().cast("array<string>").alias("uncles"),
        *_constants(BLOCK_CONSTANTS),
    )


def get_block(logs: DataFrame, block: int | str = "latest", zones: DataFrame | None = None) -> DataFrame:
    """The summary of one block; no row when the block has no logs.

    With the ``zones`` of stored tables the latest block is looked up there and not in the logs.
    """
    number = F.col("block_number")
    if isinstance(block, str) and block.startswith("0x"):
        block = int(block, 16)
    if block == "earliest":
        block = 0
    if block == "latest":
        highest = highest_block(logs) if zones is None else latest_block(zones).scalar()
        chosen = logs.where(number == highest)
        if zones is not None and BLOCK_BUCKET in logs.columns:
            chosen = chosen.where(F.col(BLOCK_BUCKET) == F.floor(highest / BUCKET_BLOCKS))
    elif isinstance(block, int):
        chosen = logs.where(number == block)
        if BLOCK_BUCKET in logs.columns:
            chosen = chosen.where(F.col(BLOCK_BUCKET) == block // BUCKET_BLOCKS)
    elif block in LATEST_TAGS:
        raise ValueError(f"unsupported block tag: {block}")
    else:
        raise ValueError(f"not a block: {block!r}")
    return blocks_from_logs(chosen)


def _short_id() -> Column:
    """The beginning of a row id, which is a hash; 64 bits of it order the few hits that are alike otherwise."""
    return F.when(F.col("indexed_id").rlike(r"^[0-9a-f]{64}\z"), F.substring("indexed_id", 1, 16)).otherwise(F.col("indexed_id"))


def receipts_from_logs(logs: DataFrame) -> DataFrame:
    """A receipt for every transaction that has hits, one row per page of 1,000 logs of the transaction.

    A page goes by the position among all logs of the transaction, where the logs tell it, so
    events of any number share one page of bounded size. The fields come from the first hit of the
    page, malformed or not, ``to`` is its contract where it is the first log of its event; only
    well-formed hits are listed. A page without any well-formed hit has an empty list. Hits without a
    transaction hash have no receipt. Hits travel as bytes and numbers; texts are spelt out behind the shuffle.
    """
    place = F.coalesce(TX_LOG_INDEX, "log_index") if TX_LOG_INDEX in logs.columns else F.col("log_index")
    page = F.floor(place / MAX_RECEIPT_LOGS)
    order = [F.col("log_index"), *[F.col("event") for c in logs.columns if c == "event"]]
    order += [_short_id().alias("id") for c in logs.columns if c == "indexed_id"]
    valid = F.col("is_valid")
    rows = valid_logs(logs, keep=True).where("tx_hash IS NOT NULL").select(
        packed_hex(F.lower("tx_hash")).alias("tx_hash"),
        F.coalesce(page, F.lit(0)).alias("page"),
        F.struct(
            *order,
            "transaction_index",
            packed_hex(F.lower("block_hash")).alias("block_hash"),
            "block_number",
            packed_hex(F.lower("contract_address")).alias("contract_address"),
            F.when(valid, F.transform("topics", packed_hex)).alias("topics"),
            F.when(valid, packed_hex(F.col("data"))).alias("data"),
        ).alias("hit"),
    )
    # Shuffled as they are, hits are gathered once, and not sorted by transaction in front of the shuffle too.
    gathered = rows.repartition("tx_hash", "page").groupBy("tx_hash", "page")
    pages = gathered.agg(F.array_sort(F.collect_list("hit")).alias("hits")).select(
        spelt_hex(F.col("tx_hash")).alias("tx_hash"), "page", "hits", F.col("hits")[0].alias("first")
    )

    def spelt(hit: Column) -> Column:
        texts = {c: spelt_hex(hit[c]) for c in ("contract_address", "data", "block_hash")}
        texts |= {"tx_hash": F.col("tx_hash"), "topics": F.transform(hit["topics"], spelt_hex)}
        return answer_log(lambda c: texts[c] if c in texts else hit[c])

    first = {c: F.col("first")[c] for c in ("log_index", "transaction_index", "block_hash", "block_number", "contract_address")}
    return pages.select(
        F.col("tx_hash").alias("transactionHash"),
        "page",
        hex_quantity(first["transaction_index"]).alias("transactionIndex"),
        spelt_hex(first["block_hash"]).alias("blockHash"),
        hex_quantity(first["block_number"]).alias("blockNumber"),
        F.when(F.coalesce(first["log_index"], F.lit(0)) == 0, spelt_hex(first["contract_address"])).alias("to"),
        F.transform(F.filter("hits", lambda hit: hit["data"].isNotNull()), spelt).alias("logs"),
        *_constants(RECEIPT_CONSTANTS),
    )


def get_receipt(logs: DataFrame, tx_hash: str, buckets: Sequence[int] | None = None) -> DataFrame:
    """The receipt of one transaction; no row when it has no logs.

    ``buckets`` are the block buckets that may hold it, as the hash index of stored tables tells.
    """
    wanted = logs.where(F.col("tx_hash") == tx_hash.lower())
    if buckets is not None:
        wanted = wanted.where(F.col(BLOCK_BUCKET).isin(*buckets) if buckets else F.lit(False))
    return receipts_from_logs(wanted)
