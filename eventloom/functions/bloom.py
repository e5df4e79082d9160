"""Tests against the 2048-bit log bloom of a block header, as Spark SQL predicates."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from eventloom.config import AbiItem, ContractMapping
from eventloom.functions.keccak import bloom_bits

BLOOM_BYTES = 256


def bloom_has(bloom: str, item: str) -> str:
    """Whether a block may hold an address or topic; the position of a topic does not matter."""
    tests = []
    for bit in bloom_bits(item):
        byte = f"CAST(conv(hex(substring({bloom}, {BLOOM_BYTES - bit // 8}, 1)), 16, 10) AS INT)"
        tests.append(f"({byte} & {1 << bit % 8}) <> 0")
    return f"coalesce({' AND '.join(tests)}, false)"


def any_in_bloom(bloom: str, items: Sequence[str]) -> str:
    return f"({' OR '.join(bloom_has(bloom, i) for i in items) or 'false'})"


def mapping_gate(mapping: ContractMapping, bloom: str = "logs_bloom") -> str:
    """Whether a block may hold any log a mapping wants."""
    topics = any_in_bloom(bloom, [i.topic0 for i in mapping.items])
    if not mapping.addresses:
        return topics
    return f"({any_in_bloom(bloom, mapping.addresses)} AND {topics})"


def event_gate(mapping: ContractMapping, item: AbiItem, bloom: str = "logs_bloom") -> str:
    """Whether a block may hold one event of a mapping."""
    return f"({mapping_gate(mapping, bloom)} AND {bloom_has(bloom, item.topic0)})"


def bloom_of_bits(bit: Column) -> Column:
    """Aggregate: the bloom with every given bit set.

    The built-in bitmap numbers bits upward from its first byte, a header bloom
    downward from its last, hence the mirrored byte.
    """
    mirrored = (F.lit(BLOOM_BYTES - 1) - F.floor(bit / 8)) * 8 + bit % 8
    return F.substring(F.bitmap_construct_agg(mirrored.cast("bigint")), 1, BLOOM_BYTES)
