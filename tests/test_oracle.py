"""Every registered query against its SQL on the small test tables."""

import os
import subprocess
import sys

import duckdb
import pytest

import __spark_entry__ as entry_point
from eventloom.queries import ORACLES, QUERIES

SMALL = entry_point.SMALL
TABLES = [
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents",
    "embeddings", "pages", "benchmark", "labels", "conversations",
]

pytestmark = pytest.mark.skipif(not os.path.isdir(SMALL), reason="no test tables")


@pytest.fixture(scope="module")
def db():
    connection = duckdb.connect()
    for t in TABLES:
        connection.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SMALL}/{t}.parquet'")
    return connection


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_sql(spark, db, name):
    answer = db.execute(ORACLES[name])
    columns = sorted(c[0] for c in answer.description)
    at = [[c[0] for c in answer.description].index(c) for c in columns]
    expected = sorted((tuple(r[i] for i in at) for r in answer.fetchall()), key=repr)
    df = QUERIES[name](spark, SMALL)
    assert sorted(df.columns) == columns
    assert sorted((tuple(r[c] for c in columns) for r in df.collect()), key=repr) == expected


def test_every_query_has_sql():
    assert set(QUERIES) == set(ORACLES)


def test_blooms_have_no_false_negatives(spark):
    from pyspark.sql import functions as F

    from eventloom import fixtures
    from eventloom.sources.chain import raw_logs

    logs = raw_logs(fixtures.receipts(spark, SMALL))
    gates = QUERIES["bloom_address"](spark, SMALL)
    for name, address in zip(("aa", "bb", "cc"), (fixtures.AA, fixtures.BB, fixtures.CC)):
        present = logs.where(F.col("address") == address).select("block_number").distinct()
        assert present.join(gates.where(name), "block_number", "left_anti").isEmpty()
    topics = QUERIES["bloom_topic"](spark, SMALL)
    for name, event in (("transfer", fixtures.TRANSFER), ("approval", fixtures.APPROVAL)):
        present = logs.where(F.get("topics", F.lit(0)) == event.topic0).select("block_number").distinct()
        assert present.join(topics.where(name), "block_number", "left_anti").isEmpty()


def test_wide_integers_equal_python(spark):
    found = {r.tx_hash: r for r in QUERIES["decode_wide"](spark, SMALL).collect()}
    orders = duckdb.sql(
        f"""SELECT '0x' || sha256('tx:' || o_orderkey), round(o_totalprice * 100)::BIGINT
        FROM '{SMALL}/orders.parquet'"""
    ).fetchall()
    assert len(found) == len(orders)
    for tx_hash, cents in orders:
        assert int(found[tx_hash].scaled256) == cents * 16**57
        assert int(found[tx_hash].delta256) == (cents - 25_000_000) * 16**40


def test_checksums_equal_lowercase_addresses(spark):
    shown = QUERIES["checksum_address"](spark, SMALL).collect()
    plain = QUERIES["decode_address"](spark, SMALL).collect()
    key = lambda r: (r.tx_hash, r.log_index, r["from"].lower(), r.to.lower())
    assert sorted(map(key, shown)) == sorted(map(key, plain))
    assert any(r.to != r.to.lower() for r in shown)


def test_entry_without_the_training_data_folders():
    """The other queries stay when the subpackage and the pipeline are gone."""
    code = """
import sys
class Gone:
    def find_spec(self, name, path=None, target=None):
        if name.startswith(("eventloom.llm", "corpus_pipeline")):
            raise ModuleNotFoundError(name)
sys.meta_path.insert(0, Gone())
import __spark_entry__ as e
from eventloom.queries import QUERIES, ORACLES
assert set(e.queries()) == set(QUERIES) and set(e.oracle_sql()) == set(ORACLES)
"""
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    subprocess.run([sys.executable, "-c", code], cwd=root, check=True)


def test_entry(spark):
    assert entry_point.entry(spark).count() > 0
    assert set(entry_point.oracle_sql()) <= set(entry_point.queries())
