import copy
import json

import pytest
from pyspark.sql import types as T

from chains import AA, TRANSFER, item
from eventloom.config import AbiItem, ConfigError, ContractMapping, JobConfig, spark_type


def raw_input(name, kind, indexed, **more):
    return {"name": name, "type": kind, "internalType": kind, "indexed": indexed, **more}


RAW = {
    "rethDBLocation": "./db",
    "csvLocation": "./csv",
    "fromBlockNumber": 0,
    "toBlockNumber": None,
    "quickwit": {"apiEndpoint": "http://localhost", "indexPrefix": "events", "dataDirectory": "./docs"},
    "eventMappings": [
        {
            "filterByContractAddresses": [AA.upper().replace("0X", "0x")],
            "decodeAbiItems": [
                {
                    "anonymous": False,
                    "name": "Transfer",
                    "inputs": [
                        raw_input("from", "address", True),
                        raw_input("to", "address", True),
                        raw_input("value", "uint256", False, rethRegexMatch="^1"),
                    ],
                }
            ],
        }
    ],
}


def test_defaults_and_unknown_keys(tmp_path):
    path = tmp_path / "job.json"
    path.write_text(json.dumps(RAW))
    config = JobConfig.load(str(path))
    assert config.to_block is None and config.csv_threshold == 10000 and not config.native_transfers
    assert config.parquet is None
    assert config.documents.batch_size == 1000 and not config.documents.recreate
    mapping = config.mappings[0]
    assert mapping.addresses == (AA,)
    assert mapping.items[0].topic0 == TRANSFER.topic0
    assert mapping.items[0].inputs[2].pattern == "^1"


@pytest.mark.parametrize("key", ["rethDBLocation", "csvLocation", "fromBlockNumber", "eventMappings"])
def test_required_keys(key):
    with pytest.raises(ConfigError):
        JobConfig.parse({k: v for k, v in RAW.items() if k != key})


def test_internal_type_is_required():
    raw = copy.deepcopy(RAW)
    del raw["eventMappings"][0]["decodeAbiItems"][0]["inputs"][0]["internalType"]
    with pytest.raises(ConfigError):
        JobConfig.parse(raw)


@pytest.mark.parametrize("addresses", [None, []])
def test_no_addresses_means_every_contract(addresses):
    raw = copy.deepcopy(RAW)
    raw["eventMappings"][0]["filterByContractAddresses"] = addresses
    assert JobConfig.parse(raw).mappings[0].addresses == ()


def test_bad_address():
    raw = copy.deepcopy(RAW)
    raw["eventMappings"][0]["filterByContractAddresses"] = ["0x12"]
    with pytest.raises(ConfigError):
        JobConfig.parse(raw)


def test_input_named_like_a_common_column():
    with pytest.raises(ConfigError):
        item("E", ("timestamp", "uint256", False)).schema()


def test_storage_types():
    assert spark_type("uint32") == T.LongType()
    assert spark_type("uint64") == T.DecimalType(20, 0)
    assert spark_type("int64") == T.LongType()
    for kind in ("uint128", "int256", "address", "bool", "uint24"):
        assert spark_type(kind) == T.StringType()


def test_table_columns_put_indexed_inputs_first():
    event = AbiItem("Mixed", tuple(item("x", ("a", "uint8", False), ("b", "address", True)).inputs))
    names = event.schema().fieldNames()
    assert names[:2] == ["indexed_id", "contract_address"]
    assert names[9:11] == ["b", "a"]
    assert names[-4:] == ["tx_hash", "block_number", "block_hash", "timestamp"]


def test_one_table_needs_one_type_per_column():
    a = item("E", ("v", "uint8", False))
    b = item("E", ("v", "uint256", False))
    with pytest.raises(ConfigError):
        JobConfig(mappings=(ContractMapping((a,)), ContractMapping((b,)))).table_schemas()


def test_codec_of_texts():
    assert JobConfig.parse(RAW).compression == "" and JobConfig.parse({**RAW, "textCompression": "gzip"}).compression == "gzip"
    with pytest.raises(ConfigError):
        JobConfig.parse({**RAW, "textCompression": "zip"})
