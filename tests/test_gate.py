"""The gate in front of the logs: both ways to apply it, long address lists, and their plans."""

import random
import time

import pytest

import __spark_entry__ as entry_point
from chains import AA, BB, CC, HEADERS, RECEIPTS, SPLIT, TRANSFER, header, item, rows, transfer, tx
from eventloom import fixtures
from eventloom.config import ContractMapping, JobConfig
from eventloom.functions.keccak import bloom_bits
from eventloom.operators import decode as decoding
from eventloom.operators import gate
from eventloom.operators.decode import decode, stage_events
from eventloom.operators.gate import gated_headers
from eventloom.operators.transfers import native_transfers
from eventloom.queries import EVERY_EVENT, PAIR_EVENTS

OTHER = item("Other", ("v", "uint256", False))
SMALL = entry_point.SMALL
FIELDS = ["event_key", "contract_address", "log_index", "tx_hash", "block_number", "block_hash", "timestamp"]


def bloom_of(items):
    bloom = bytearray(256)
    for i in items:
        for bit in bloom_bits(i):
            bloom[255 - bit // 8] |= 1 << bit % 8
    return bloom


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture(scope="module")
def chain_tables(spark):
    """Blocks whose blooms tell the truth, deny what is there, or are missing."""
    pick = random.Random(5)
    receipts, headers = [], []
    for b in range(60):
        logs = [transfer(pick.choice([AA, BB, CC]), 1, 2, n) for n in range(pick.randint(0, 4))]
        logs += [(pick.choice([AA, CC]), [OTHER.topic0], "0x" + format(b, "064x"))]
        receipts += [tx(b, 0, logs, value=str(b % 3)), tx(b, 1, logs[::-1], value="7")]
        told = {log[0] for log in logs} | {log[1][0] for log in logs}
        headers.append(header(b, None if b % 10 == 9 else bloom_of([] if b % 10 == 3 else told)))
    return spark.createDataFrame(receipts, RECEIPTS), spark.createDataFrame(headers, HEADERS)


MAPPINGS = (ContractMapping((TRANSFER,), (AA, BB)), ContractMapping((TRANSFER, OTHER), (CC, AA)), ContractMapping((OTHER,)))
JOB = JobConfig(mappings=MAPPINGS)


def test_bitmaps_and_broadcast_blocks_agree(spark, chain_tables, monkeypatch):
    receipts, headers = chain_tables
    expected = rows(stage_events(receipts, headers, JOB.events()), *FIELDS)
    sent = rows(native_transfers(receipts, headers, MAPPINGS))
    assert expected and sent
    monkeypatch.setattr(gate, "BROADCAST_BYTES", 0)
    assert rows(stage_events(receipts, headers, JOB.events()), *FIELDS) == expected
    assert rows(native_transfers(receipts, headers, MAPPINGS)) == sent


def test_bitmaps_on_stored_partitions(spark, monkeypatch):
    receipts, headers = fixtures.receipts(spark, SMALL), fixtures.headers(spark, SMALL)
    expected = rows(stage_events(receipts, headers, PAIR_EVENTS), *FIELDS)
    monkeypatch.setattr(gate, "BROADCAST_BYTES", 0)
    assert rows(stage_events(receipts, headers, PAIR_EVENTS), *FIELDS) == expected


def test_address_lists_in_tables_match_spelt_ones(spark, chain_tables, monkeypatch):
    receipts, headers = chain_tables
    plain = headers.drop("logs_bloom")
    expected = [rows(stage_events(receipts, h, JOB.events()), *FIELDS) for h in (headers, plain)]
    sent = [rows(native_transfers(receipts, h, MAPPINGS)) for h in (headers, plain)]
    for limit in (1, 0):
        monkeypatch.setattr(gate, "SPELT_ADDRESSES", limit)
        assert [rows(stage_events(receipts, h, JOB.events()), *FIELDS) for h in (headers, plain)] == expected
        assert [rows(native_transfers(receipts, h, MAPPINGS)) for h in (headers, plain)] == sent
    monkeypatch.setattr(gate, "BROADCAST_BYTES", 0)
    monkeypatch.setattr(decoding, "FEW_ADDRESSES", 0)
    assert rows(stage_events(receipts, headers, JOB.events()), *FIELDS) == expected[0]


def test_listed_logs_are_numbered_over_all_rows_of_a_transaction(spark, monkeypatch):
    logs = [transfer([AA, CC][n % 3 == 2], 1, 2, n) for n in range(50)]
    whole = spark.createDataFrame([(*tx(1, 0, logs), 0, 0, True)], SPLIT)
    parts = [(*tx(1, 0, logs[i : i + 7]), 0, i, False) for i in range(0, 50, 7)]
    headers = spark.createDataFrame([header(1)], HEADERS).drop("logs_bloom")
    events = JobConfig(mappings=(ContractMapping((TRANSFER,), (AA, BB)),)).events()
    expected = rows(stage_events(whole, headers, events), "log_index", "data", "block_log_index")
    assert sorted(r[0] for r in expected) == list(range(34))
    assert rows(stage_events(spark.createDataFrame(parts, SPLIT), headers, events), "log_index", "data", "block_log_index") == expected
    monkeypatch.setattr(gate, "SPELT_ADDRESSES", 1)
    monkeypatch.setattr(decoding, "LOG_STRETCH", 5)
    assert rows(stage_events(spark.createDataFrame(parts, SPLIT), headers, events), "log_index", "data", "block_log_index") == expected


def test_ten_thousand_addresses_plan_fast(spark, chain_tables):
    receipts, headers = chain_tables
    pick = random.Random(1)
    many = tuple("0x" + pick.randbytes(20).hex() for _ in range(10_000))
    found = decode(receipts, headers, JobConfig(mappings=(ContractMapping((TRANSFER, OTHER), (*many, AA)),)).events())
    few = decode(receipts, headers, JobConfig(mappings=(ContractMapping((TRANSFER, OTHER), (AA,)),)).events())
    events = JobConfig(mappings=(ContractMapping((TRANSFER,), many),)).events()
    for make in (lambda: gated_headers(headers, events), lambda: stage_events(receipts, headers.drop("logs_bloom"), events)):
        begun = time.monotonic()
        assert len(plan(make())) < 40_000
        assert time.monotonic() - begun < 2
    for table in ("transfer", "other"):
        fields = ["contract_address", "log_index", "tx_hash", "block_hash"]
        assert rows(found[table], *fields) == rows(few[table], *fields)


def test_an_address_list_admits_what_its_spelt_form_admits(spark):
    pick = random.Random(2)
    known = ["0x" + pick.randbytes(20).hex() for _ in range(700)]
    blooms = [bloom_of(["0x" + pick.randbytes(20).hex() for _ in range(n)]) for n in (0, 1, 30, 150, 400)]
    blooms += [bloom_of([known[600]]), bloom_of([known[3], known[699]]), None, bytearray(5)]
    headers = spark.createDataFrame([header(b, bloom) for b, bloom in enumerate(blooms)], HEADERS)
    found = [r[0] for r in headers.orderBy("block_number").select(gate.any_address_in_bloom(headers.logs_bloom, known)).collect()]

    def admits(bloom):
        return bloom is not None and len(bloom) == 256 and any(
            all(bloom[255 - bit // 8] & 1 << bit % 8 for bit in bloom_bits(a)) for a in known
        )

    assert found == [admits(b) for b in blooms]


def test_no_log_is_looked_at_before_the_gate(spark, monkeypatch):
    """Tests of logs stand above the join with the admitted blocks, which prunes the receipt folders."""
    receipts, headers = fixtures.receipts(spark, SMALL), fixtures.headers(spark, SMALL)
    monkeypatch.setattr(decoding, "FEW_SPLIT_ROWS", 0)
    for limit in (gate.BROADCAST_BYTES, 0):
        monkeypatch.setattr(gate, "BROADCAST_BYTES", limit)
        lines = plan(stage_events(receipts, headers, EVERY_EVENT)).splitlines()
        scan = next(i for i, line in enumerate(lines) if "FileScan" in line and "logs#" in line)
        join = max(i for i, line in enumerate(lines[:scan]) if "Join" in line)
        # A test of logs and gates stands in the join, which looks at it for admitted blocks only.
        assert not any("exists(logs#" in line for line in lines[join + 1 : scan])
        assert any("exists(logs#" in line for line in lines[: join + 1])
        assert not any("logs_bloom" in line for line in lines)
        if limit:
            assert "dynamicpruning" in lines[scan]
