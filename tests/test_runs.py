"""Runs that replace earlier ones, in every sink, and what the manifest knows without opening data."""

from hashlib import sha256

import pytest

from chains import AA, BB, HEADERS, RECEIPTS, TRANSFER, header, item, rows, transfer, tx
from eventloom.config import ContractMapping, DocumentSpec, JobConfig, ParquetSpec
from eventloom.plans import summaries
from eventloom.plans.logs import union_logs
from eventloom.plans.sync import sync
from eventloom.session import delete_path, scratch_path
from eventloom.sinks import runs
from eventloom.sinks.runs import without
from eventloom.sinks.tables import CsvSink, DocumentSink, ParquetSink, event_tables_at

OTHER = item("Other", ("v", "uint256", False))
WIDE = 100_000


def chain_of(spark, blocks):
    """Headers of a gapless chain and a transfer in each of the blocks given, with its value."""
    top = max(blocks)
    receipts = [tx(b, 0, [transfer(AA, 1, 2, v)]) for b, v in blocks.items()]
    receipts = [(*r[:2], "0x" + sha256(str(r[0]).encode()).hexdigest(), *r[3:]) for r in receipts]
    headers = spark.range(top + 1).selectExpr(
        "id AS block_number", "concat('0x', lpad(hex(id), 64, '0')) AS block_hash", "id AS timestamp"
    )
    return headers, spark.createDataFrame(receipts, RECEIPTS)


@pytest.fixture()
def job(tmp_path):
    def make(first=0, last=None, drop=False, mappings=(ContractMapping((TRANSFER, OTHER), (AA, BB)),)):
        return JobConfig(
            mappings=mappings,
            from_block=first,
            to_block=last,
            csv=str(tmp_path / "csv"),
            parquet=ParquetSpec(str(tmp_path / "tables"), drop),
            documents=DocumentSpec(str(tmp_path / "docs"), "events", "", recreate=drop),
        )

    return make


def held(spark, config):
    """Block and value of the transfers in every sink, which have to agree."""
    schema = config.table_schemas()["transfer"]
    parquet = rows(ParquetSink(config.parquet.directory).read(spark, "transfer", schema), "block_number", "value")
    csv = rows(CsvSink(config.csv).read(spark, "transfer", schema), "block_number", "value")
    documents = DocumentSink(config.documents.directory, "events").read(spark, "transfer")
    fields = ["CAST(get_json_object(document, '$.block_number') AS BIGINT)", "get_json_object(document, '$.value')"]
    lines = rows(documents.selectExpr(*fields))
    assert parquet == csv == lines
    return dict(parquet)


def test_a_rerun_replaces_rows_buckets_and_tables(spark, job, tmp_path):
    sync(spark, job(), *chain_of(spark, {1: 10, 2: 20, WIDE + 1: 30}))
    assert held(spark, job()) == {1: "10", 2: "20", WIDE + 1: "30"}
    # Fewer rows, and a bucket that became empty: the chain has other receipts now, of the same range.
    headers, receipts = chain_of(spark, {2: 21, WIDE + 1: 0})
    sync(spark, job(), headers, receipts.where("block_number < 100"))
    assert held(spark, job()) == {2: "21"}
    # A table that becomes empty.
    sync(spark, job(), headers, receipts.where("false"))
    assert held(spark, job()) == {}
    # Nothing of a replaced run stays in the folders.
    assert not list((tmp_path / "tables" / "transfer").rglob("part-*"))


def test_a_longer_open_ended_run_replaces_a_shorter_one(spark, job):
    sync(spark, job(), *chain_of(spark, {1: 10, 5: 50}))
    sync(spark, job(), *chain_of(spark, {1: 11, 5: 51, 9: 90}))
    assert held(spark, job()) == {1: "11", 5: "51", 9: "90"}


def test_runs_that_overlap_in_part(spark, job):
    sync(spark, job(0, 5), *chain_of(spark, {1: 10, 4: 40, 9: 90}))
    sync(spark, job(4, 8), *chain_of(spark, {1: 11, 4: 41, 7: 70, 9: 91}))
    assert held(spark, job()) == {1: "10", 4: "41", 7: "70"}
    sync(spark, job(9, 9), *chain_of(spark, {9: 92}))
    sync(spark, job(2, 2), *chain_of(spark, {1: 12, 9: 93}))
    assert held(spark, job()) == {1: "10", 4: "41", 7: "70", 9: "92"}


def test_other_tables_of_a_folder_stay(spark, job):
    sync(spark, job(), *chain_of(spark, {1: 10, 5: 50}))
    others = job(drop=True, mappings=(ContractMapping((OTHER,)),))
    sync(spark, others, *chain_of(spark, {1: 10, 5: 50}))
    assert held(spark, job()) == {1: "10", 5: "50"}
    sync(spark, job(9, 9, drop=True), *chain_of(spark, {9: 90}))
    schema = job().table_schemas()["transfer"]
    assert rows(ParquetSink(job().parquet.directory).read(spark, "transfer", schema), "block_number") == [(9,)]
    assert DocumentSink(job().documents.directory, "events").read(spark, "transfer").count() == 1


def test_a_run_that_broke_off_is_not_read(spark, job):
    sync(spark, job(), *chain_of(spark, {1: 10}))
    sink = ParquetSink(job().parquet.directory)
    sink.begin(spark, ["transfer"], (0, 5))
    stored = sink.read(spark, "transfer", job().table_schemas()["transfer"])
    sink.write("transfer", stored.drop("block_bucket"))
    assert held(spark, job()) == {1: "10"}


def test_zones_and_lookups_open_no_data(spark, job):
    sync(spark, job(0, 6), *chain_of(spark, {1: 10, 6: 60, 7: 0}))
    sync(spark, job(7, WIDE + 9), *chain_of(spark, {8: 80, WIDE + 3: 30, WIDE + 9: 90}))
    config = job()
    sink = ParquetSink(config.parquet.directory)
    zones = sink.zones(spark, ["transfer", "other"])
    assert rows(zones) == [
        ("transfer", 0, 1, 6, 2), ("transfer", 0, 8, 8, 1), ("transfer", 1, WIDE + 3, WIDE + 9, 2)
    ]
    assert all(runs.MANIFEST in f for f in zones.inputFiles())
    assert summaries.latest_block(zones).first()[0] == WIDE + 9
    logs = union_logs(event_tables_at(spark, config, config.parquet.directory))
    (block,) = summaries.get_block(logs, "latest", zones).collect()
    assert block.block_number == WIDE + 9

    hashes = {r.block_number: r.tx_hash for r in logs.select("block_number", "tx_hash").collect()}
    assert sink.buckets_of(spark, hashes[WIDE + 3].upper().replace("0X", "0x")) == [1]
    assert sink.buckets_of(spark, "0x" + "ee" * 32) == []
    found = summaries.get_receipt(logs, hashes[8], sink.buckets_of(spark, hashes[8]))
    assert [r.blockNumber for r in found.collect()] == ["0x8"]
    text = found._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(block_bucket" in text and "(block_bucket" in text
    assert summaries.get_receipt(logs, "0x" + "ee" * 32, []).count() == 0
    # A run that is replaced in part is counted again over what is left of it.
    sync(spark, job(5, 6), *chain_of(spark, {5: 55, 6: 0}))
    assert ("transfer", 0, 1, 1, 1) in rows(sink.zones(spark, ["transfer"]))


def test_spans():
    assert without(((0, 9),), 3, 5) == ((0, 2), (6, 9))
    assert without(((0, 2), (6, 9)), 2, 6) == ((0, 1), (7, 9))
    assert without(((0, 9),), 0, 9) == without((), 1, 2) == ()


def test_scratch_is_released(spark):
    path = scratch_path(spark, "gone")
    spark.range(3).write.parquet(path)
    delete_path(spark, path)
    delete_path(spark, path)
    with pytest.raises(Exception):
        spark.read.parquet(path)
