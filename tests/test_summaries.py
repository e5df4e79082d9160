import pytest

from chains import AA, BB, rows, word
from eventloom.plans import summaries
from test_logs import LOGS, TOPICS


def log(block, index, position, address=AA, event="transfer"):
    h = lambda n: "0x" + word(n)
    return (event, f"{event}{block}-{index}-{position}", address, position, index, TOPICS[0], TOPICS[1], None, None,
            "0x", h(block * 1000 + 999 - index), block, h(block), 1_600_000_000 + block)


DATA = (
    [log(1, t, p) for t in range(5) for p in range(3)]
    + [log(1, 0, 0, BB, "approval"), log(2, 4, 0, BB), log(7, 0, 0)]
)


@pytest.fixture(scope="module")
def logs(spark):
    return spark.createDataFrame(DATA, LOGS).repartition(3).cache()


def test_block_summary(logs):
    (block,) = summaries.get_block(logs, 1).collect()
    assert block.number == "0x1" and block.hash == "0x" + word(1)
    assert block.timestamp == hex(1_600_000_001)
    assert block.transactions == sorted({r[10] for r in DATA if r[11] == 1})
    assert block.uncles == [] and block.gasLimit == "0x1c9c380" and block.page == 0


def test_block_tags(logs):
    assert [r.block_number for r in summaries.get_block(logs, "latest").collect()] == [7]
    assert [r.block_number for r in summaries.get_block(logs, "0x2").collect()] == [2]
    assert summaries.get_block(logs, "earliest").count() == 0
    assert summaries.get_block(logs, 3).count() == 0
    for tag in ("pending", "safe", "finalized", "newest"):
        with pytest.raises(ValueError):
            summaries.get_block(logs, tag)


def test_latest_of_no_logs(logs):
    assert summaries.get_block(logs.where("false"), "latest").count() == 0


def test_large_blocks_continue_on_further_pages(logs, monkeypatch):
    monkeypatch.setattr(summaries, "MAX_BLOCK_LOGS", 2)
    pages = [r for r in summaries.blocks_from_logs(logs).collect() if r.block_number == 1]
    assert sorted(len(p.transactions) for p in pages) == [1, 2, 2]
    assert sorted(h for p in pages for h in p.transactions) == sorted({r[10] for r in DATA if r[11] == 1})


def test_receipt(logs):
    wanted = log(1, 0, 0)[10]
    (receipt,) = summaries.get_receipt(logs, wanted.upper().replace("0X", "0x")).collect()
    # Approval sorts before transfer at the same position, so its contract comes first.
    assert receipt.to == BB
    assert [(l.logIndex, l.address) for l in receipt.logs] == [("0x0", BB), ("0x0", AA), ("0x1", AA), ("0x2", AA)]
    assert receipt.status == "0x1" and receipt.contractAddress is None and receipt["from"] == "0x" + "0" * 40
    assert summaries.get_receipt(logs, TOPICS[0]).count() == 0


def test_large_receipts_continue_on_further_pages(logs, monkeypatch):
    monkeypatch.setattr(summaries, "MAX_RECEIPT_LOGS", 2)
    pages = {
        r.page: r for r in summaries.receipts_from_logs(logs).collect() if r.transactionHash == log(1, 0, 0)[10]
    }
    assert sorted(pages) == [0, 1]
    assert len(pages[0].logs) == 3 and len(pages[1].logs) == 1
    assert pages[0].to == BB and pages[1].to is None
    assert pages[0].blockNumber == pages[1].blockNumber == "0x1"


def test_a_hundred_events_share_pages_of_bounded_size(spark):
    """The position in the transaction makes the page, however many events its logs belong to."""
    lines = [
        (*log(1, 0, n // 100, event=f"event{n % 100:02d}"), n) for n in range(2500)
    ]
    found = summaries.receipts_from_logs(spark.createDataFrame(lines, LOGS + ", tx_log_index bigint")).collect()
    assert sorted((r.page, len(r.logs)) for r in found) == [(0, 1000), (1, 1000), (2, 500)]


def test_counts(logs):
    assert rows(summaries.event_counts(logs)) == [("approval", 1), ("transfer", 17)]


def test_receipt_of_malformed_hits(spark):
    good, bad = log(1, 0, 1), list(log(1, 0, 0, BB))
    bad[9] = "0xabc"
    (receipt,) = summaries.receipts_from_logs(spark.createDataFrame([good, tuple(bad)], LOGS)).collect()
    assert receipt.to == BB and [l.address for l in receipt.logs] == [AA]
    (receipt,) = summaries.receipts_from_logs(spark.createDataFrame([tuple(bad)], LOGS)).collect()
    assert receipt.to == BB and receipt.logs == []


def test_receipts_shuffle_bytes_once_and_sort_nothing_before(spark):
    """Texts of all logs, sorted in front of the shuffle too, took many times the disk of the tables."""
    logs = spark.createDataFrame(DATA, LOGS)
    plan = summaries.receipts_from_logs(logs)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1
    behind, before = plan.split("Exchange")
    assert "ObjectHashAggregate" in behind and "Aggregate" not in before
    assert "unhex" in before


def test_receipts_give_malformed_texts_as_they_are(spark):
    odd = [list(log(1, t, 0)) for t in range(5)]
    for line, text in zip(odd, ("0xABC", "0x", "0xzz", "0xé1", "AB")):
        line[10] = line[12] = text
        line[2] = text
    found = {r.transactionHash: r for r in summaries.receipts_from_logs(spark.createDataFrame(map(tuple, odd), LOGS)).collect()}
    assert sorted(found) == sorted(["0xabc", "0x", "0xzz", "0xé1", "0xab"])
    assert all(r.blockHash == r.to == h and r.logs == [] for h, r in found.items())
