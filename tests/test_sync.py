import json
from decimal import Decimal

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from chains import AA, BB, CC, HEADERS, RECEIPTS, TRANSFER, header, item, rows, transfer, tx, word
from eventloom.config import NATIVE_TABLE, ConfigError, ContractMapping, DocumentSpec, JobConfig, ParquetSpec
from eventloom.plans.documents import read_back, to_documents
from eventloom.plans.sync import sync
from eventloom.session import scratch_path
from eventloom.plans.logs import union_logs
from eventloom.queries import QUERIES
from eventloom.sinks.tables import (
    CsvSink,
    DocumentSink,
    ParquetSink,
    block_boundaries,
    configured_tables,
    event_tables_at,
    open_sinks,
)
from eventloom.sources.csv import read_event_csv

APPROVAL = item("Approval", ("owner", "address", True), ("spender", "address", True), ("value", "uint256", False))
SIZED = item("Sized", ("a", "uint64", False), ("b", "uint128", False), ("c", "int8", False))


def sized(a, b, c):
    return (CC, [SIZED.topic0], "0x" + word(a) + word(b) + word(c))


@pytest.fixture()
def chain(spark):
    receipts = [
        tx(5, 0, [transfer(AA, 1, 2, 3), transfer(BB, 1, 2, 4)], value="9"),
        tx(6, 0, [sized(2**64 - 1, 2**100, -5), sized(1, 2, 3)]),
        tx(8, 0, [transfer(AA, 1, 2, 5)]),
    ]
    return (
        spark.createDataFrame([header(b) for b in (5, 6, 8)], HEADERS).drop("logs_bloom"),
        spark.createDataFrame(receipts, RECEIPTS),
    )


def job(tmp_path, drop=False, **more):
    return JobConfig(
        mappings=(ContractMapping((TRANSFER, APPROVAL), (AA, BB)), ContractMapping((SIZED,))),
        from_block=5,
        native_transfers=True,
        parquet=ParquetSpec(str(tmp_path / "tables"), drop),
        documents=DocumentSpec(str(tmp_path / "docs"), "events", "http://localhost", recreate=drop),
        **more,
    )


def stored(spark, config, table):
    sink = ParquetSink(config.parquet.directory)
    return sink.read(spark, table, configured_tables(config)[table])


def documents(tmp_path, table):
    lines = []
    for f in sorted((tmp_path / "docs" / f"events-{table}").rglob("part-*")):
        lines += [json.loads(line) for line in f.read_text().splitlines()]
    return lines


def test_whole_job(spark, chain, tmp_path):
    config = job(tmp_path)
    tables = sync(spark, config, *chain)
    # Block 7 is missing, so block 8 is out of range.
    assert rows(tables["transfer"], "value") == [("3",), ("4",)]
    assert counts(tables) == [("approval", 0), (NATIVE_TABLE, 1), ("sized", 2), ("transfer", 2)]
    assert rows(stored(spark, config, "transfer"), "value", "block_bucket") == [("3", 0), ("4", 0)]
    assert rows(stored(spark, config, NATIVE_TABLE), "value") == [("9",)]
    assert stored(spark, config, "approval").count() == 0
    logs = union_logs(event_tables_at(spark, config, config.parquet.directory))
    assert rows(logs, "event", "block_number") == [("sized", 6)] * 2 + [("transfer", 5)] * 2
    assert documents(tmp_path, "approval") == []

    doc = min(documents(tmp_path, "sized"), key=lambda d: d["log_index"])
    # The text of a number that no longer fits one is kept.
    assert (doc["a"], doc["b"], doc["c"]) == (str(2**64 - 1), str(2**100), -5)
    assert doc["timestamp"] == "2020-09-13T12:27:52+00:00"
    assert "topic1" not in doc and doc["log_index"] == 0
    other = max(documents(tmp_path, "sized"), key=lambda d: d["log_index"])
    assert (other["a"], other["b"], other["c"]) == (1, 2, 3)


def test_existing_tables_are_kept_or_dropped(spark, chain, tmp_path):
    sync(spark, job(tmp_path), *chain)
    unrelated = tmp_path / "tables" / "unrelated"
    unrelated.mkdir()
    (unrelated / "keep.txt").write_text("x")
    sync(spark, job(tmp_path), *chain)
    # The same range again replaces its rows.
    assert stored(spark, job(tmp_path), "transfer").count() == 2
    sync(spark, job(tmp_path, drop=True), *chain)
    assert stored(spark, job(tmp_path), "transfer").count() == 2
    assert len(documents(tmp_path, "transfer")) == 2
    assert (unrelated / "keep.txt").read_text() == "x"


def test_a_sink_that_fails_to_open_is_skipped(spark, tmp_path):
    (tmp_path / "tables").write_text("a file, not a folder")
    assert [s.name for s in open_sinks(spark, job(tmp_path))] == ["documents"]


def test_no_sink_is_an_error(spark, chain):
    with pytest.raises(ConfigError):
        sync(spark, JobConfig(mappings=(ContractMapping((TRANSFER,)),)), *chain)


def test_own_sink(spark, chain, tmp_path):
    seen = {}

    class Memory:
        name = "memory"

        def prepare(self, spark, tables):
            seen["tables"] = set(tables)

        def write(self, table, df):
            seen[table] = df.count()

    sinks = open_sinks(spark, job(tmp_path), [lambda config: Memory()])
    sync(spark, job(tmp_path), *chain, sinks=sinks)
    assert seen == {
        "tables": {"transfer", "approval", "sized", NATIVE_TABLE}, "transfer": 2, "sized": 2, NATIVE_TABLE: 1
    }


def test_csv_from_the_job(spark, chain, tmp_path):
    config = job(tmp_path, csv=str(tmp_path / "csv"))
    sync(spark, config, *chain)
    back = read_event_csv(spark, str(tmp_path / "csv" / "transfer"), configured_tables(config)["transfer"])
    assert rows(back, "value", "tx_hash") == rows(stored(spark, config, "transfer"), "value", "tx_hash")


def test_compressed_texts_hold_the_same_rows(spark, tmp_path):
    receipts = [tx(b, 0, [transfer(AA, b, 2, 3), transfer(AA, b, 2, 4)], value="9") for b in range(5, 400)]
    chain = (
        spark.createDataFrame([header(b) for b in range(5, 400)], HEADERS).drop("logs_bloom").coalesce(1),
        spark.createDataFrame(receipts, RECEIPTS).coalesce(1),
    )
    held, size = {}, {}
    for codec in ("", "gzip"):
        config = job(tmp_path / (codec or "plain"), csv=str(tmp_path / (codec or "plain") / "csv"), compression=codec)
        sync(spark, config, *chain)
        csv = CsvSink(config.csv).read(spark, "transfer", configured_tables(config)["transfer"])
        documents = DocumentSink(config.documents.directory, "events").read(spark, "transfer")
        held[codec] = rows(csv), rows(documents)
        folder = tmp_path / (codec or "plain")
        files = [f for part in ("csv/transfer", "docs/events-transfer") for f in (folder / part).rglob("part-*")]
        assert all(f.name.endswith(".gz") == bool(codec) for f in files)
        size[codec] = sum(f.stat().st_size for f in files)
    assert held[""] == held["gzip"] and len(held["gzip"][0]) == len(held["gzip"][1]) == 790
    assert size["gzip"] * 4 < size[""]


def shuffle_bytes(spark):
    """Size of every shuffle file that Spark still keeps."""
    files = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
    found = (files.apply(i) for i in range(files.size()))
    return {f.getPath(): f.length() for f in found if "shuffle_" in f.getName()}


def test_a_delivery_leaves_no_shuffles_of_rows(spark, tmp_path):
    """Orders and line items of its own; neither the chain tables nor the tables delivered leave their shuffles behind."""
    spark.range(2000).selectExpr(
        "id o_orderkey", "id % 50 o_custkey", "'O' o_orderstatus", "CAST(id AS DOUBLE) o_totalprice",
        "date_add(DATE'1995-01-01', CAST(id DIV 100 AS INT)) o_orderdate", "'1-URGENT' o_orderpriority",
    ).write.parquet(f"{tmp_path}/orders.parquet")
    spark.range(8000).selectExpr(
        "id DIV 4 l_orderkey", "id % 97 l_partkey", "id % 13 l_suppkey", "CAST(id % 4 AS INT) l_linenumber",
        "CAST(id AS DOUBLE) l_extendedprice", "'A' l_returnflag", "'O' l_linestatus",
    ).write.parquet(f"{tmp_path}/lineitem.parquet")
    before = shuffle_bytes(spark)
    found = QUERIES["sync_delivery"](spark, str(tmp_path))
    left = sum(size for path, size in shuffle_bytes(spark).items() if path not in before)
    assert left < 64 << 10
    assert {r["sink"]: r["n"] for r in found.groupBy("sink").agg(F.count("*").alias("n")).collect()} == dict.fromkeys(("csv", "documents", "parquet"), 8000)


def test_csv_keeps_types_and_order(spark, tmp_path):
    df = spark.createDataFrame(
        [("7", Decimal(2**70), "", "a,\"b\"\nc", None)], "value string, wide decimal(38,0), empty string, text string, gone string"
    )
    sink = CsvSink(str(tmp_path))
    sink.write("t", df.selectExpr("value", "cast(wide as string) wide", "empty", "replace(text, '\n', ' ') text", "gone"))
    schema = T.StructType().add("wide", T.DecimalType(38, 0)).add("value", T.LongType())
    back = read_event_csv(spark, sink.path("t"), schema)
    assert back.dtypes == [("value", "bigint"), ("wide", "decimal(38,0)"), ("empty", "string"), ("text", "string"), ("gone", "string")]
    (row,) = back.collect()
    assert (row.value, int(row.wide), row.empty, row.text) == (7, 2**70, None, 'a,"b" c')
    # A CSV has one way to write nothing, so an empty text comes back as null.
    assert row.gone is None


def test_csv_with_a_bad_number_fails(spark, tmp_path):
    CsvSink(str(tmp_path)).write("t", spark.createDataFrame([("x",)], "value string"))
    with pytest.raises(Exception):
        read_event_csv(spark, str(tmp_path / "t"), T.StructType().add("value", T.LongType())).collect()


def test_documents_read_back(spark):
    df = spark.createDataFrame(
        [(AA, "x", "+4", "", 1_600_000_000), (BB, None, "3", "0xab", -1)],
        "contract_address string, log_index string, transaction_index string, topic0 string, timestamp bigint",
    )
    back = rows(read_back(to_documents(df)), "log_index", "transaction_index", "topic0", "timestamp")
    assert back == [(0, 3, "0xab", -1), (0, 4, None, 1_600_000_000)]


def test_block_boundaries(spark):
    df = spark.createDataFrame([(n,) for n in (5, 99_999, 100_000, 250_000)], "block_number bigint")
    assert rows(block_boundaries(df)) == [(0, 5, 99_999), (1, 100_000, 100_000), (2, 250_000, 250_000)]
    assert rows(block_boundaries(df.where("false"))) == []


def test_scratch_is_below_the_shared_folder(spark):
    base = spark.conf.get("spark.checkpoint.dir")
    assert scratch_path(spark, "x").startswith(base + "/")
    assert scratch_path(spark, "x") != scratch_path(spark, "x")


def counts(tables):
    return [(table, df.count()) for table, df in sorted(tables.items())]


def test_a_repeated_run_replaces_its_rows(spark, chain, tmp_path):
    for _ in range(2):
        sync(spark, job(tmp_path), *chain)
    assert stored(spark, job(tmp_path), "transfer").count() == 2


def test_csv_files_with_other_headers_are_refused(spark, tmp_path):
    spark.createDataFrame([("1", "2")], "a string, b string").coalesce(1).write.option("header", True).csv(str(tmp_path / "t"))
    spark.createDataFrame([("3", "4")], "b string, a string").coalesce(1).write.mode("append").option("header", True).csv(str(tmp_path / "t"))
    with pytest.raises(Exception):
        read_event_csv(spark, str(tmp_path / "t"), T.StructType().add("a", T.StringType())).collect()
