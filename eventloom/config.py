"""The job file: which blocks, which contracts, which events, which sinks."""

from __future__ import annotations

import json
import re
from dataclasses import dataclass
from typing import Any

from pyspark.sql import types as T

from eventloom.functions.keccak import keccak256

# Keys of the job file.
KEY_SOURCE = "rethDBLocation"
KEY_CSV = "csvLocation"
KEY_NATIVE = "ethTransfers"
KEY_THRESHOLD = "csvSyncThreshold"
KEY_FROM = "fromBlockNumber"
KEY_TO = "toBlockNumber"
KEY_PARQUET = "parquet"
KEY_DOCUMENTS = "quickwit"
KEY_MAPPINGS = "eventMappings"
KEY_ADDRESSES = "filterByContractAddresses"
KEY_ITEMS = "decodeAbiItems"
KEY_PATTERN = "rethRegexMatch"
KEY_COMPRESSION = "textCompression"

# Defaults of the job file.
DEFAULT_THRESHOLD = 10000
DEFAULT_BATCH = 1000

# Codecs of CSV and document files; plain text without one.
TEXT_CODECS = ("", "gzip", "bzip2", "deflate")

# Columns every event table carries around its ABI inputs.
LEADING_COLUMNS = {
    "indexed_id": T.StringType(),
    "contract_address": T.StringType(),
    "log_index": T.LongType(),
    "transaction_index": T.LongType(),
    "topic0": T.StringType(),
    "topic1": T.StringType(),
    "topic2": T.StringType(),
    "topic3": T.StringType(),
    "data": T.StringType(),
}
TRAILING_COLUMNS = {
    "tx_hash": T.StringType(),
    "block_number": T.LongType(),
    "block_hash": T.StringType(),
    "timestamp": T.LongType(),
}
# Positions of a log among all logs of its transaction and, where receipts tell, of its block.
TX_LOG_INDEX = "tx_log_index"
BLOCK_LOG_INDEX = "block_log_index"
# Stored event tables are partitioned by stretches of so many blocks.
BLOCK_BUCKET = "block_bucket"
BUCKET_BLOCKS = 100_000
NATIVE_TABLE = "eth_transfer"
NATIVE_COLUMNS = {
    "from": T.StringType(),
    "to": T.StringType(),
    "value": T.StringType(),
    "block_number": T.LongType(),
    "block_hash": T.StringType(),
    "timestamp": T.LongType(),
}

# ABI integer types that are decoded as numbers.
INTEGER_TYPES = {
    f"{sign}{bits}": (sign == "int", bits)
    for sign in ("uint", "int")
    for bits in (8, 16, 32, 64, 128, 256)
}


class ConfigError(ValueError):
    """The job file asks for something that cannot be planned."""


def spark_type(abi_type: str) -> T.DataType:
    """Column type that holds every value of an ABI type without loss."""
    if abi_type not in INTEGER_TYPES:
        return T.StringType()
    signed, bits = INTEGER_TYPES[abi_type]
    if bits > 64:
        return T.StringType()
    if bits == 64 and not signed:
        return T.DecimalType(20, 0)
    return T.LongType()


def is_declared_integer(abi_type: str) -> bool:
    """Whether documents carry the value as a JSON number when it fits one."""
    return abi_type in INTEGER_TYPES and INTEGER_TYPES[abi_type][1] < 256


@dataclass(frozen=True)
class AbiInput:
    name: str
    type: str
    indexed: bool
    pattern: str | None = None

    @classmethod
    def parse(cls, raw: dict[str, Any]) -> AbiInput:
        _require(raw, "indexed", "internalType", "name", "type")
        return cls(raw["name"], raw["type"], bool(raw["indexed"]), raw.get(KEY_PATTERN))


@dataclass(frozen=True)
class AbiItem:
    name: str
    inputs: tuple[AbiInput, ...]

    @classmethod
    def parse(cls, raw: dict[str, Any]) -> AbiItem:
        _require(raw, "name", "inputs")
        return cls(raw["name"], tuple(AbiInput.parse(i) for i in raw["inputs"]))

    @property
    def signature(self) -> str:
        return f"{self.name}({','.join(i.type for i in self.inputs)})"

    @property
    def topic0(self) -> str:
        return "0x" + keccak256(self.signature.encode()).hex()

    @property
    def table(self) -> str:
        return self.name.lower()

    @property
    def indexed(self) -> list[AbiInput]:
        return [i for i in self.inputs if i.indexed]

    @property
    def plain(self) -> list[AbiInput]:
        return [i for i in self.inputs if not i.indexed]

    @property
    def columns(self) -> list[AbiInput]:
        """Inputs in table order: indexed ones first, each group in ABI order."""
        return self.indexed + self.plain

    def schema(self) -> T.StructType:
        fields = dict(LEADING_COLUMNS)
        for i in self.columns:
            if i.name in fields or i.name in TRAILING_COLUMNS or i.name in (TX_LOG_INDEX, BLOCK_LOG_INDEX):
                raise ConfigError(f"{self.signature}: input {i.name!r} collides with another column")
            fields[i.name] = spark_type(i.type)
        return T.StructType([T.StructField(n, t) for n, t in {**fields, **TRAILING_COLUMNS}.items()])


@dataclass(frozen=True)
class ContractMapping:
    items: tuple[AbiItem, ...]
    addresses: tuple[str, ...] = ()

    @classmethod
    def parse(cls, raw: dict[str, Any]) -> ContractMapping:
        _require(raw, KEY_ITEMS)
        addresses = tuple(str(a).lower() for a in raw.get(KEY_ADDRESSES) or ())
        for a in addresses:
            if not re.fullmatch(r"0x[0-9a-f]{40}", a):
                raise ConfigError(f"not a contract address: {a!r}")
        return cls(tuple(AbiItem.parse(i) for i in raw[KEY_ITEMS]), addresses)


@dataclass(frozen=True)
class ParquetSpec:
    directory: str
    drop: bool

    @classmethod
    def parse(cls, raw: dict[str, Any]) -> ParquetSpec:
        _require(raw, "dataDirectory", "dropTableBeforeSync")
        return cls(raw["dataDirectory"], bool(raw["dropTableBeforeSync"]))


@dataclass(frozen=True)
class DocumentSpec:
    directory: str
    prefix: str
    endpoint: str
    batch_size: int = DEFAULT_BATCH
    recreate: bool = False

    @classmethod
    def parse(cls, raw: dict[str, Any]) -> DocumentSpec:
        _require(raw, "apiEndpoint", "indexPrefix", "dataDirectory")
        return cls(
            raw["dataDirectory"],
            raw["indexPrefix"],
            raw["apiEndpoint"],
            int(raw.get("batchSize", DEFAULT_BATCH)),
            bool(raw.get("recreateIndexes", False)),
        )


@dataclass(frozen=True)
class JobConfig:
    """A parsed job file.

    Batch size and flush threshold are read so that a job file stays valid, but
    Spark's partitions take their place. ``csv`` names a folder of CSV files to deliver to.
    ``compression`` is the codec of CSV and document files, which are plain text without one.
    """

    mappings: tuple[ContractMapping, ...]
    from_block: int = 0
    to_block: int | None = None
    native_transfers: bool = False
    source: str = ""
    csv: str = ""
    csv_threshold: int = DEFAULT_THRESHOLD
    parquet: ParquetSpec | None = None
    documents: DocumentSpec | None = None
    compression: str = ""

    @classmethod
    def parse(cls, raw: dict[str, Any]) -> JobConfig:
        _require(raw, KEY_SOURCE, KEY_CSV, KEY_FROM, KEY_MAPPINGS)
        to_block = raw.get(KEY_TO)
        config = cls(
            mappings=tuple(ContractMapping.parse(m) for m in raw[KEY_MAPPINGS]),
            from_block=int(raw[KEY_FROM]),
            to_block=None if to_block is None else int(to_block),
            native_transfers=bool(raw.get(KEY_NATIVE, False)),
            source=raw[KEY_SOURCE],
            csv=raw[KEY_CSV],
            csv_threshold=int(raw.get(KEY_THRESHOLD, DEFAULT_THRESHOLD)),
            parquet=ParquetSpec.parse(raw[KEY_PARQUET]) if raw.get(KEY_PARQUET) else None,
            documents=DocumentSpec.parse(raw[KEY_DOCUMENTS]) if raw.get(KEY_DOCUMENTS) else None,
            compression=str(raw.get(KEY_COMPRESSION) or ""),
        )
        if config.compression not in TEXT_CODECS:
            raise ConfigError(f"unknown codec: {config.compression!r}")
        config.table_schemas()
        return config

    @classmethod
    def load(cls, path: str) -> JobConfig:
        with open(path, encoding="utf-8") as f:
            return cls.parse(json.load(f))

    def events(self) -> list[tuple[int, ContractMapping, AbiItem]]:
        """Every (mapping, event) pair with the number that identifies it in a plan."""
        pairs = [(m, item) for m in self.mappings for item in m.items]
        return [(n, m, item) for n, (m, item) in enumerate(pairs)]

    def table_schemas(self) -> dict[str, T.StructType]:
        """Schema per event table; events that share a table share its columns."""
        tables: dict[str, dict[str, T.DataType]] = {}
        for _, _, item in self.events():
            if self.native_transfers and item.table == NATIVE_TABLE:
                raise ConfigError(f"event table {item.table!r} collides with the native transfers")
            known = tables.setdefault(item.table, {})
            for f in item.schema().fields:
                if known.setdefault(f.name, f.dataType) != f.dataType:
                    raise ConfigError(f"table {item.table!r}: column {f.name!r} has two types")
        return {
            table: T.StructType(
                [
                    T.StructField(n, t)
                    for n, t in sorted(cols.items(), key=lambda c: c[0] in TRAILING_COLUMNS)
                ]
            )
            for table, cols in tables.items()
        }

    def integer_columns(self, table: str) -> set[str]:
        """Columns of a table that documents write as numbers."""
        names = {"log_index", "transaction_index", "block_number", TX_LOG_INDEX, BLOCK_LOG_INDEX}
        for _, _, item in self.events():
            if item.table == table:
                names |= {i.name for i in item.inputs if is_declared_integer(i.type)}
        return names


def _require(raw: dict[str, Any], *keys: str) -> None:
    missing = [k for k in keys if k not in raw]
    if missing:
        raise ConfigError(f"missing keys: {', '.join(missing)}")
