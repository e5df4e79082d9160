"""Which blocks may hold which events, told from header blooms before any log is read.

The headers are gated once, into a small table of admitted blocks with the events
whose gate is open. Few admitted blocks are broadcast whole and join the receipts
directly, pruning the partitions of stored receipts as they do. Many become one
bitmap per stretch of blocks, an eighth of a byte a block, so that receipts of
closed blocks leave without a shuffle however long the chain is.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from eventloom.config import BLOCK_BUCKET, AbiItem, ContractMapping
from eventloom.functions.bloom import BLOOM_BYTES, any_in_bloom, bloom_has
from eventloom.functions.keccak import bloom_bits_of
from eventloom.session import scratch_path
from eventloom.sources.chain import bucket_blocks

Event = tuple[int, ContractMapping, AbiItem]

#: Addresses of a mapping that are spelt out in a plan; longer lists are looked up in tables.
SPELT_ADDRESSES = 200
#: Bytes of a table of admitted blocks, or of bitmaps, that may be broadcast.
BROADCAST_BYTES = 64 << 20
#: Bytes of an admitted block with hash and time, and of each of its open events.
BLOCK_BYTES, GATE_BYTES = 160, 4
MAP_BYTES = 4096
#: Bit triples that are tried at once on the blocks not admitted yet.
TRIPLES = 256


def is_long(mapping: ContractMapping) -> bool:
    return len(mapping.addresses) > SPELT_ADDRESSES


def address_table(spark: SparkSession, lists: Sequence[tuple[Sequence[str], int]]) -> DataFrame:
    """address and mapping of long address lists, each pair once."""
    pairs = sorted({(address, number) for addresses, number in lists for address in addresses})
    columns = [pa.array([p[0] for p in pairs], pa.string()), pa.array([p[1] for p in pairs], pa.int32())]
    return spark.createDataFrame(pa.table(columns, ["address", "mapping"]))


def any_address_in_bloom(bloom: Column, addresses: Sequence[str]) -> Column:
    """Whether a bloom may hold any of a long list of addresses, on Arrow batches.

    The bits of all addresses come from one batch of hashes; a block leaves the search with the
    first address it admits.
    """
    triples = bloom_bits_of(addresses)

    @F.arrow_udf("boolean")
    def admits(blooms: pa.Array) -> pa.Array:
        found = np.zeros(len(blooms), bool)
        usable = [i for i, b in enumerate(blooms.to_pylist()) if b is not None and len(b) == BLOOM_BYTES]
        if usable:
            raw = np.frombuffer(b"".join(blooms[i].as_py() for i in usable), np.uint8).reshape(-1, BLOOM_BYTES)
            # Bit 0 is the lowest one of the last byte.
            bits = np.unpackbits(raw[:, ::-1], axis=1, bitorder="little")
            left = np.arange(len(usable))
            for start in range(0, len(triples), TRIPLES):
                one, two, three = triples[start : start + TRIPLES].T
                open_here = bits[left]
                hit = (open_here[:, one] & open_here[:, two] & open_here[:, three]).any(axis=1)
                found[np.array(usable)[left[hit]]] = True
                left = left[~hit]
                if not len(left):
                    break
        return pa.array(found)

    return admits(bloom)


def gates_of(events: Sequence[Event], bloom: str = "logs_bloom") -> Column:
    """The keys of the events whose gate the bloom opens: a contract of the mapping and the event's signature."""
    contracts: dict[tuple[str, ...], Column] = {}
    keys = []
    for key, mapping, item in events:
        known = mapping.addresses
        if known not in contracts:
            if is_long(mapping):
                contracts[known] = any_address_in_bloom(F.col(bloom), known)
            else:
                contracts[known] = F.expr(any_in_bloom(bloom, known)) if known else F.lit(True)
        # The signature is tested first: it is cheap and closes most gates.
        keys.append(F.when(F.expr(bloom_has(bloom, item.topic0)) & contracts[known], F.lit(key)))
    return F.array_compact(F.array(*keys)) if keys else F.array().cast("array<int>")


def gated_headers(headers: DataFrame, events: Sequence[Event]) -> DataFrame:
    """The admitted blocks with hash, time and the keys of their open events in ``gates``."""
    gated = headers.select("block_number", "block_hash", "timestamp", gates_of(events).alias("gates"))
    return gated.where(F.size("gates") > 0)


def stored_gates(headers: DataFrame, events: Sequence[Event], path: str | None = None) -> DataFrame:
    """The admitted blocks, found by one scan of the headers and read back from a scratch table."""
    spark = headers.sparkSession
    path = path or scratch_path(spark, "gates")
    gated = gated_headers(headers, events)
    gated.write.parquet(path)
    return spark.read.schema(gated.schema).parquet(path)


def _with_bucket(blocks: DataFrame, receipts: DataFrame) -> tuple[DataFrame, list[str]]:
    """Blocks with the partition of stored receipts they fall in, and the columns to join by."""
    if BLOCK_BUCKET not in receipts.columns:
        return blocks, ["block_number"]
    kind = receipts.schema[BLOCK_BUCKET].dataType
    bucket = F.floor(F.col("block_number") / bucket_blocks(receipts)).cast(kind)
    return blocks.withColumn(BLOCK_BUCKET, bucket), [BLOCK_BUCKET, "block_number"]


def admitted(receipts: DataFrame, gated: DataFrame, events: Sequence[Event]) -> tuple[DataFrame, bool]:
    """Receipts of admitted blocks, and whether they already carry hash, time and gates of their block.

    A column of the gate side has to appear in whatever looks at logs next: Spark would move a
    test of receipt columns alone below the join, in front of the gate.
    """
    blocks = gated.count()
    if blocks * (BLOCK_BYTES + GATE_BYTES * len(events)) <= BROADCAST_BYTES:
        # The comparison marks this side as selective, so that it prunes partitions.
        side, keys = _with_bucket(gated.where(F.size("gates") > 0), receipts)
        return receipts.join(F.broadcast(side), keys), True
    side, keys = _with_bucket(gated, receipts)
    place = {"map_number": F.bitmap_bucket_number("block_number"), "map_place": F.bitmap_bit_position("block_number")}
    group = [*keys[:-1], "map_number"]
    maps = side.withColumns(place).groupBy(*group).agg(F.bitmap_construct_agg("map_place").alias("open_blocks"))
    if _stretches(gated) * MAP_BYTES <= BROADCAST_BYTES:
        maps = F.broadcast(maps)
    return receipts.withColumns(place).join(maps, group), False


def _stretches(gated: DataFrame) -> int:
    """Upper bound of the number of bitmaps, from the lowest and highest admitted block."""
    low, high = gated.agg(F.min("block_number"), F.max("block_number")).first()
    return 0 if low is None else 2 * ((high - low) // (MAP_BYTES * 8) + 2)


#: Whether the block of a receipt is admitted, where the receipts joined bitmaps.
MAPPED = "(CAST(conv(hex(substring(open_blocks, CAST(map_place DIV 8 AS INT) + 1, 1)), 16, 10) AS INT) & (1 << CAST(map_place % 8 AS INT))) <> 0"
