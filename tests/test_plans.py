"""Physical plans: what reaches the scan, what is shuffled, what stays in the JVM."""

import re

import pytest

import __spark_entry__ as entry_point
from eventloom import fixtures
from eventloom.operators.decode import with_hits
from eventloom.operators.filters import LogFilter
from eventloom.plans.logs import get_logs
from eventloom.plans.summaries import get_block, get_receipt
from eventloom.queries import EVERY_EVENT, QUERIES
from eventloom.sources import chain

SMALL = entry_point.SMALL


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture(scope="module")
def logs(spark):
    return fixtures.logs(spark, SMALL)


def test_matching_needs_no_shuffle_and_no_python(spark):
    text = plan(with_hits(fixtures.receipts(spark, SMALL), EVERY_EVENT))
    assert "Exchange" not in text


@pytest.mark.parametrize("name", ["decode_transfers", "decode_int", "multi_mapping", "receipts_from_logs"])
def test_decoding_stays_in_the_jvm(spark, name):
    assert "Python" not in plan(QUERIES[name](spark, SMALL))


def test_one_event_is_one_scan_and_one_join(spark):
    text = plan(QUERIES["decode_transfers"](spark, SMALL))
    # The receipts, the headers, and the rows of spread transactions alone.
    assert text.count("FileScan parquet") == 3
    assert text.count("Not(EqualTo(whole,true))") == 1
    assert "SortMergeJoin" not in text
    # Only the columns the job needs leave the receipts.
    assert not re.search(r"ReadSchema: struct<[^>]*value", text)


def test_block_range_reaches_the_receipt_scan(spark):
    text = plan(chain.in_block_range(fixtures.receipts(spark, SMALL), 200, 300))
    assert "GreaterThanOrEqual(block_number,200)" in text and "LessThanOrEqual(block_number,300)" in text


def test_log_filter_reaches_every_table_scan(logs):
    f = LogFilter.parse({"fromBlock": "0x5", "address": fixtures.AA, "topics": [fixtures.TRANSFER.topic0]})
    text = plan(get_logs(logs, f, 1000))
    assert "TakeOrderedAndProject" in text
    for pushed in (
        "GreaterThanOrEqual(block_number,5)",
        f"EqualTo(contract_address,{fixtures.AA})",
        f"EqualTo(topic0,{fixtures.TRANSFER.topic0})",
    ):
        assert text.count(pushed) == 2, pushed
    assert len(re.findall(r"PartitionFilters: \[[^\]]*block_bucket[^\]]*>= 0", text)) == 2


def test_point_lookups_filter_below_the_grouping(logs):
    assert plan(get_block(logs, 7)).count("EqualTo(block_number,7)") == 2
    wanted = "0x" + "AB" * 32
    assert plan(get_receipt(logs, wanted)).count(f"EqualTo(tx_hash,{wanted.lower()})") == 2


def test_hits_per_filter_are_cut_before_they_are_shuffled(spark):
    text = plan(QUERIES["logs_by_filter_table"](spark, SMALL))
    assert text.count("WindowGroupLimit") == 4
    # One pass over the logs serves every kind of filter.
    assert text.count("Generate explode(array(") == 1


def test_best_block_reads_one_column(spark):
    assert "ReadSchema: struct<block_number:bigint>" in plan(chain.best_block(fixtures.headers(spark, SMALL)))


def test_distinct_hashes_combine_before_the_shuffle(spark):
    text = plan(QUERIES["block_tx_hashes"](spark, SMALL))
    assert re.search(r"Exchange hashpartitioning\(block_number.*\n.*HashAggregate", text)
