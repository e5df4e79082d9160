import random
from collections import defaultdict

import pytest

from chains import AA, BB, CC, HEADERS, RECEIPTS, SPLIT, TRANSFER, header, item, rows, transfer, tx, word
from eventloom.config import ContractMapping, JobConfig
from eventloom.operators.decode import decode
from eventloom.operators.transfers import ZERO_ADDRESS, native_transfers
from eventloom.plans.sync import bounded
from eventloom.sources import chain

APPROVAL = item("Approval", ("owner", "address", True), ("spender", "address", True), ("value", "uint256", False))


def approval(address, owner, spender, value):
    return (address, [APPROVAL.topic0, "0x" + word(owner), "0x" + word(spender)], "0x" + word(value))


def random_chain(seed, blocks=12, txs=4, most_logs=9):
    random.seed(seed)
    receipts = []
    for b in range(blocks):
        for t in range(random.randrange(txs)):
            logs = []
            for _ in range(random.randrange(most_logs)):
                make = random.choice([transfer, approval])
                address, topics, data = make(random.choice([AA, BB, CC]), random.randrange(9), 3, random.randrange(99))
                fault = random.randrange(8)
                if fault == 0:
                    topics = topics[:2]
                elif fault == 1:
                    data = data[:40]
                logs.append((address, topics, data))
            receipts.append(tx(b, t, logs))
    return receipts


def split_rows(receipts, per_row):
    """The same receipts with at most ``per_row`` logs in a row."""
    out, start = [], defaultdict(int)
    for r in receipts:
        logs, block = r[6], r[0]
        parts = [logs[i : i + per_row] for i in range(0, len(logs), per_row)] or [[]]
        for n, part in enumerate(parts):
            out.append((*r[:6], part, start[block], n * per_row, len(parts) == 1))
        start[block] += len(logs)
    return out


def expected(receipts, mapping, event):
    """(tx_hash, log_index, address, value, position of the log in its block) per decoded log."""
    out, start = [], defaultdict(int)
    for r in receipts:
        n = 0
        for at, (address, topics, data) in enumerate(r[6]):
            if mapping.addresses and address not in mapping.addresses:
                continue
            if topics[0] != event.topic0 or len(topics) != 3 or (len(data) - 2) // 64 != 1:
                continue
            out.append((r[2], n, address, str(int(data[2:66], 16)), start[r[0]] + at))
            n += 1
        start[r[0]] += len(r[6])
    return sorted(out, key=repr)


@pytest.mark.parametrize("per_row", [1, 2, 3, 100])
@pytest.mark.parametrize("addresses", [(), (AA, CC)])
def test_split_transactions_decode_like_whole_ones(spark, per_row, addresses):
    receipts = random_chain(per_row)
    mapping = ContractMapping((TRANSFER, APPROVAL), addresses)
    config = JobConfig(mappings=(mapping,))
    tables = decode(
        spark.createDataFrame(split_rows(receipts, per_row), SPLIT),
        spark.createDataFrame([header(b) for b in range(12)], HEADERS).drop("logs_bloom"),
        config.events(),
    )
    for event in (TRANSFER, APPROVAL):
        found = rows(
            tables[event.table], "tx_hash", "log_index", "contract_address", "value", "block_log_index"
        )
        assert found == expected(receipts, mapping, event)


def test_columns_of_a_decoded_log(spark):
    receipts = spark.createDataFrame(
        [tx(1, 0, [(BB.upper().replace("0X", "0x"), [TRANSFER.topic0, "0x" + word(5), "0x" + word(6)], "0x" + word(7))])],
        RECEIPTS,
    )
    headers = spark.createDataFrame([header(1)], HEADERS).drop("logs_bloom")
    mapping = ContractMapping((TRANSFER,), (BB,))
    (row,) = decode(receipts, headers, [(0, mapping, TRANSFER)])["transfer"].collect()
    again = decode(receipts, headers, [(3, mapping, TRANSFER)])["transfer"].first()
    assert row.indexed_id == again.indexed_id
    assert row.contract_address == BB
    assert (row["from"], row["to"], row["value"]) == ("0x" + format(5, "040x"), "0x" + format(6, "040x"), "7")
    assert (row.topic0, row.topic3, row.data) == (TRANSFER.topic0, None, "0x" + word(7))
    assert (row.block_number, row.timestamp, row.block_hash) == (1, 1_600_000_012, f"0x{1:064x}")


def test_plain_input_before_indexed_one_is_bound_by_name(spark):
    event = item("Odd", ("amount", "uint8", False), ("who", "address", True))
    log = (AA, [event.topic0, "0x" + word(0xABC)], "0x" + word(9))
    receipts = spark.createDataFrame([tx(1, 0, [log])], RECEIPTS)
    headers = spark.createDataFrame([header(1)], HEADERS).drop("logs_bloom")
    (row,) = decode(receipts, headers, [(0, ContractMapping((event,)), event)])["odd"].collect()
    assert row.amount == 9 and row.who == "0x" + format(0xABC, "040x")
    columns = row.asDict().keys()
    assert list(columns).index("who") < list(columns).index("amount")


def test_two_mappings_feed_one_table_and_keep_repeats(spark):
    receipts = spark.createDataFrame(
        [tx(1, 0, [transfer(BB, 1, 1, 1), transfer(AA, 2, 2, 2)])], RECEIPTS
    )
    headers = spark.createDataFrame([header(1)], HEADERS).drop("logs_bloom")
    config = JobConfig(mappings=(ContractMapping((TRANSFER,), (AA,)), ContractMapping((TRANSFER,))))
    table = decode(receipts, headers, config.events())["transfer"]
    assert rows(table, "value", "log_index") == [("1", 0), ("2", 0), ("2", 1)]
    assert table.select("indexed_id").distinct().count() == 3


def test_empty_tables(spark):
    receipts = spark.createDataFrame([], RECEIPTS)
    headers = spark.createDataFrame([], HEADERS)
    config = JobConfig(mappings=(ContractMapping((TRANSFER,)),))
    bound_headers, bound_receipts = bounded(config, headers, receipts)
    assert decode(bound_receipts, bound_headers, config.events())["transfer"].count() == 0


@pytest.mark.parametrize(
    "present, first, last, answer",
    [
        ([0, 1, 2, 5, 6], 0, None, (0, 2)),
        ([0, 1, 2, 5, 6], 5, None, (5, 6)),
        ([0, 1, 2, 5, 6], 3, None, (3, 2)),
        ([0, 1, 2, 5, 6], 1, 1, (1, 1)),
        ([0, 1, 2], 0, 99, (0, 2)),
        ([0, 0, 1, 1], 0, None, (0, 1)),
        ([], 4, None, (4, 3)),
    ],
)
def test_range_ends_at_the_first_gap(spark, present, first, last, answer):
    headers = spark.createDataFrame([header(b) for b in present], HEADERS)
    assert chain.resolve_range(headers, first, last) == answer
    if last is None:
        kept = rows(chain.contiguous_prefix(headers, first).select("block_number").distinct())
        assert [r[0] for r in kept] == list(range(answer[0], answer[1] + 1))


def test_native_transfers(spark):
    receipts = spark.createDataFrame(
        [
            tx(1, 0, [transfer(AA, 1, 1, 1)], value="5"),
            tx(1, 1, [transfer(AA, 1, 1, 1), transfer(BB, 1, 1, 1)], value="6", to=None),
            tx(1, 2, [transfer(CC, 1, 1, 1)], value="7"),
            tx(1, 3, [], value="8"),
            tx(1, 4, [transfer(BB, 1, 1, 1)], value="0"),
            tx(2, 0, [transfer(BB, 1, 1, 1)], value="9"),
        ],
        RECEIPTS,
    )
    headers = spark.createDataFrame([header(1)], HEADERS).drop("logs_bloom")
    both = [ContractMapping((TRANSFER,), (AA,)), ContractMapping((TRANSFER,), (AA, BB))]
    found = rows(native_transfers(receipts, headers, both), "to", "value", "block_number")
    assert found == [(ZERO_ADDRESS, "6", 1), (AA, "5", 1)]
    everything = [ContractMapping((TRANSFER,))]
    assert {r[0] for r in rows(native_transfers(receipts, headers, everything), "value")} == {"5", "6", "7"}


def test_native_transfer_of_a_split_transaction_counts_once(spark):
    whole = [tx(1, 0, [transfer(AA, n, 1, 1) for n in range(5)], value="5")]
    receipts = spark.createDataFrame(split_rows(whole, 2), SPLIT)
    headers = spark.createDataFrame([header(1)], HEADERS).drop("logs_bloom")
    found = native_transfers(receipts, headers, [ContractMapping((TRANSFER,))])
    assert rows(found, "value") == [("5",)]


def test_binary_data_and_missing_data(spark):
    df = spark.createDataFrame(
        [(bytearray(b"\xab\x01"), ["a", "b"]), (bytearray(b""), []), (None, ["a"])],
        "data binary, topics array<string>",
    )
    assert rows(chain.flatten_topics(df), "data", "topic0", "topic1", "topic3") == [
        ("0x", "a", None, None),
        ("0x", None, None, None),
        ("0xab01", "a", "b", None),
    ]
