"""Hot keys: one order, one day and one line item repeated hold a third of the rows each."""

import os
import random
import shutil

import duckdb
import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from eventloom import fixtures
from eventloom.operators import decode
from eventloom.operators.running import running_totals
from eventloom.operators.topk import first_per_group
from eventloom.queries import EVERY_EVENT, ORACLES, QUERIES
from eventloom.sinks.tables import ParquetSink
from eventloom.sources import chain
from pyspark.sql import functions as F

TABLES = "nation region supplier orders lineitem".split()


@pytest.fixture(autouse=True)
def no_coalescing(spark):
    """Keeps small shuffles in several partitions, as large ones are."""
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    yield
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


@pytest.fixture(scope="module")
def skewed(tmp_path_factory):
    from datetime import datetime, timedelta

    random.seed(3)
    path = tmp_path_factory.mktemp("skewed")
    orders, lines = [], []
    for key in range(300):
        day = 3 if key % 3 == 0 else random.randrange(40)
        orders.append((key, random.randrange(50), random.choice("OFP"), random.randrange(100, 10**7) / 100,
                       datetime(1995, 1, 1) + timedelta(days=day), random.choice(["1-URGENT", "5-LOW"])))
    for n in range(1500):
        order = 42 if n % 3 == 0 else random.randrange(300)
        line = [order, random.randrange(200), random.randrange(20), random.randrange(1, 8),
                random.randrange(1000, 10**7) / 100, random.choice("ANR"), random.choice("OF")]
        if n % 3 == 1:
            line = [7, 11, 5, 2, 123.45, "A", "O"]
        lines.append(tuple(line))
    names = ["o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate", "o_orderpriority"]
    pq.write_table(pa.table(dict(zip(names, zip(*orders)))), path / "orders.parquet")
    names = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_extendedprice", "l_returnflag", "l_linestatus"]
    pq.write_table(pa.table(dict(zip(names, zip(*lines)))), path / "lineitem.parquet", row_group_size=200)
    pq.write_table(pa.table({"s_suppkey": list(range(20))}), path / "supplier.parquet")
    pq.write_table(pa.table({"n_nationkey": list(range(5))}), path / "nation.parquet")
    pq.write_table(pa.table({"r_regionkey": list(range(3))}), path / "region.parquet")
    return str(path)


@pytest.mark.parametrize(
    "name",
    ["scan_logs", "decode_transfers", "decode_event", "log_ordinals", "multi_mapping", "native_transfers",
     "block_tx_hashes", "receipts_from_logs", "logs_by_filter_table", "tx_ordinals", "enrich_blocks",
     "txs_with_logs", "sync_transfers"],
)
def test_queries_on_skewed_tables(spark, skewed, monkeypatch, name):
    # Small stored rows make the hot orders span many of them.
    real = fixtures.receipts
    monkeypatch.setattr(fixtures, "receipts", lambda s, d, logs_per_row=8: real(s, d, logs_per_row))
    monkeypatch.setattr(chain, "TX_ID_SPAN", 16)
    db = duckdb.connect()
    for t in TABLES:
        db.execute(f"CREATE VIEW {t} AS SELECT * FROM '{skewed}/{t}.parquet'")
    answer = db.execute(ORACLES[name])
    columns = [c[0] for c in answer.description]
    found = sorted((tuple(r[c] for c in columns) for r in QUERIES[name](spark, skewed).collect()), key=repr)
    assert found == sorted(answer.fetchall(), key=repr)


def test_sorted_runs_cut_hot_orders(spark, skewed):
    spans = (
        fixtures._sorted_lines(spark, skewed).groupBy("l_orderkey").agg(F.count_distinct("run").alias("runs"))
    )
    wide = dict(spans.where("runs > 1").collect())
    # The order of copies is cut as well, although its rows are all the same.
    assert 42 in wide and 7 in wide


def test_running_totals(spark):
    random.seed(1)
    data = [(0 if n % 3 else n % 5, n, random.randrange(9)) for n in range(2000)]
    df = spark.createDataFrame(data, "g bigint, id bigint, v bigint").repartition(4)
    found = running_totals(df, ["g"], ["id"], F.floor(F.col("id") / 50), {"place": F.lit(1), "sum": F.col("v")})
    place, total = {}, {}
    for g, n, v in data:
        place.setdefault(g, 0), total.setdefault(g, 0)
    expected = []
    for g, n, v in sorted(data, key=lambda r: r[1]):
        expected.append((g, n, v, place[g], total[g]))
        place[g] += 1
        total[g] += v
    assert sorted(map(tuple, found.collect())) == sorted(expected)


def test_first_per_group(spark):
    random.seed(2)
    data = [("hot" if n % 3 == 0 else f"g{n % 40}", random.randrange(10**6), n) for n in range(6000)]
    df = spark.createDataFrame(data, "g string, o bigint, id bigint").repartition(5)
    found = first_per_group(df, ["g"], ["o", "id"], 25).collect()
    groups = {}
    for row in sorted(data, key=lambda r: (r[1], r[2])):
        groups.setdefault(row[0], []).append(row)
    assert sorted(map(tuple, found)) == sorted(r for g in groups.values() for r in g[:25])


@pytest.mark.parametrize("name", ["scan_logs", "decode_event", "enrich_blocks"])
def test_orders_beyond_a_row_are_numbered_in_runs(spark, skewed, monkeypatch, tmp_path, name):
    for file in os.listdir(skewed):
        shutil.copyfile(f"{skewed}/{file}", tmp_path / file)
    real = fixtures.receipts
    monkeypatch.setattr(fixtures, "LOGS_PER_ROW", 16)
    monkeypatch.setattr(fixtures, "receipts", lambda s, d, logs_per_row=8: real(s, d, logs_per_row))
    db = duckdb.connect()
    for t in TABLES:
        db.execute(f"CREATE VIEW {t} AS SELECT * FROM '{skewed}/{t}.parquet'")
    answer = db.execute(ORACLES[name])
    columns = [c[0] for c in answer.description]
    found = sorted((tuple(r[c] for c in columns) for r in QUERIES[name](spark, str(tmp_path)).collect()), key=repr)
    assert found == sorted(answer.fetchall(), key=repr)
    assert any(k[1:] == (str(tmp_path), "some-lines") for k in fixtures._written)


def test_settled_logs_need_no_receipts_and_no_blooms(spark, skewed, tmp_path):
    for file in os.listdir(skewed):
        shutil.copyfile(f"{skewed}/{file}", tmp_path / file)
    assert QUERIES["decode_bool"](spark, str(tmp_path)).count() == 300
    assert {k[2] for k in fixtures._written if k[1] == str(tmp_path)} == {"settled", "plain-headers"}


def test_receipts_are_spelt_out_behind_the_last_shuffle(spark, skewed, monkeypatch):
    stored = []
    monkeypatch.setattr(fixtures, "store_receipts", lambda placed, path: stored.append(placed))
    fixtures._build_receipts(spark, skewed, "", 8)
    plan = stored[0]._jdf.queryExecution().optimizedPlan().toString()
    spelt, shuffled = plan.split("RepartitionByExpression", 1)
    assert "sha2" in spelt and "sha2" not in shuffled and "lpad" not in shuffled


def test_rows_in_stretches_of_blocks_are_written_as_they_come(spark, tmp_path):
    rows = spark.range(0, 1000, 1, 5).select(
        F.col("id").alias("block_number"), F.concat(F.lit("0x"), F.sha2(F.col("id").cast("string"), 256)).alias("tx_hash")
    )
    sink = ParquetSink(str(tmp_path), ordered=True)
    sink.write("t", rows)
    files = [f for _, _, names in os.walk(tmp_path / "t") for f in names if f.endswith(".parquet")]
    assert len(files) == 5 and all(".zstd." in f for f in files)
    assert sorted(r[0] for r in sink.read(spark, "t", rows.schema).select("block_number").collect()) == list(range(1000))
    assert spark.conf.get("spark.sql.maxConcurrentOutputFileWriters") == "0"


def test_staged_logs_are_not_sorted_by_event(spark, skewed, monkeypatch):
    seen, real = [], decode.unsorted_writes
    monkeypatch.setattr(decode, "unsorted_writes", lambda s, n: seen.append(n) or real(s, n))
    receipts, headers = fixtures.receipts(spark, skewed), fixtures.plain_headers(spark, skewed)
    staged = decode.staged_once(receipts, headers, EVERY_EVENT, "staged")
    assert seen == [2] and all(".zstd." in f for f in staged.inputFiles())
    plain = decode.stage_events(receipts, headers, EVERY_EVENT)
    columns = ["event_key", "tx_hash", "log_index"]
    assert sorted(map(tuple, staged.select(columns).collect())) == sorted(map(tuple, plain.select(columns).collect()))
