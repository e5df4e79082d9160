import random

import pytest
from pyspark.sql import functions as F

from chains import AA, BB, CC, rows, word
from eventloom.operators import filters as lf
from eventloom.operators.filters import FILTER_SCHEMA, LogFilter
from eventloom.plans.logs import answer_logs, get_logs, get_logs_by_table, matching_logs, valid_logs

LOGS = (
    "event string, indexed_id string, contract_address string, log_index bigint, transaction_index bigint, "
    "topic0 string, topic1 string, topic2 string, topic3 string, data string, tx_hash string, "
    "block_number bigint, block_hash string, timestamp bigint"
)
TOPICS = ["0x" + word(n) for n in range(6)]


def make_logs(n=3000, blocks=40, hot=True):
    random.seed(5)
    out = []
    for i in range(n):
        # One contract, one block and one topic hold a third of the rows.
        block = 17 if hot and i % 3 == 0 else random.randrange(blocks)
        address = AA if hot and i % 3 == 1 else random.choice([AA, BB, CC])
        topic = TOPICS[0] if hot and i % 3 == 2 else random.choice(TOPICS)
        topics = [topic, random.choice(TOPICS), random.choice([None, *TOPICS[:2]]), None]
        out.append(
            ("e", f"{i:06d}", address, i % 7, i % 11, *topics, "0x", f"0x{i % 500:064x}", block, f"0x{block:064x}", block)
        )
    return out


@pytest.fixture(scope="module")
def data():
    return make_logs()


@pytest.fixture(scope="module")
def logs(spark, data):
    return spark.createDataFrame(data, LOGS).repartition(4).cache()


def hits(data, f, k=None):
    out = []
    top = max(r[11] for r in data)
    low = top if f.from_block == "latest" else f.from_block
    high = None if f.to_block == "latest" else f.to_block
    for r in data:
        if low is not None and r[11] < low or high is not None and r[11] > high:
            continue
        if f.block_hash and r[12] != f.block_hash:
            continue
        if f.addresses and r[2] not in f.addresses:
            continue
        if all(not want or r[5 + n] in want for n, want in enumerate(f.topics)):
            out.append(r)
    out.sort(key=lambda r: (r[11], r[3], r[4], r[0], r[1]))
    return [r[1] for r in out[:k]]


FILTERS = [
    {},
    {"fromBlock": "0x5", "toBlock": "0x14"},
    {"fromBlock": "earliest", "toBlock": "latest"},
    {"fromBlock": "latest"},
    {"fromBlock": "0x5", "toBlock": "finalized"},
    {"toBlock": "pending"},
    {"address": AA.upper().replace("0X", "0x")},
    {"address": [BB, CC], "fromBlock": "0x3"},
    {"address": [], "topics": []},
    {"topics": [TOPICS[0]]},
    {"topics": [None, [TOPICS[1], TOPICS[2]]]},
    {"topics": [TOPICS[0], None, TOPICS[1]], "address": AA},
    {"topics": [None, None, None, TOPICS[1]]},
    {"blockHash": f"0x{17:064x}", "address": [AA, BB]},
    {"blockHash": f"0x{99:064x}"},
]


@pytest.mark.parametrize("raw", FILTERS, ids=str)
def test_filters(logs, data, raw):
    f = LogFilter.parse(raw)
    assert sorted(r[0] for r in rows(matching_logs(logs, f), "indexed_id")) == sorted(hits(data, f))
    assert [r.indexed_id for r in get_logs(logs, f, 1000).collect()] == hits(data, f, 1000)
    assert [r.indexed_id for r in get_logs(logs, f).collect()] == hits(data, f)


def test_bad_filters():
    with pytest.raises(ValueError):
        LogFilter.parse({"blockHash": "0x1", "fromBlock": "0x1"})
    with pytest.raises(ValueError):
        LogFilter.parse({"topics": [None] * 5})
    with pytest.raises(ValueError):
        LogFilter.parse({"fromBlock": "newest"})


def filter_rows(filters):
    return [
        (n, f.from_block, f.to_block, f.block_hash, list(f.addresses), [list(t) for t in f.topics])
        for n, f in enumerate(filters)
    ]


@pytest.mark.parametrize("broadcast_rows", [0, 100_000])
@pytest.mark.parametrize("k, cells, crowd", [(20, 1024, 4), (20, 3, 0), (3, 2, 1), (None, 4, 4)])
def test_filter_table(spark, logs, data, monkeypatch, broadcast_rows, k, cells, crowd):
    """Both joins, with all logs in one cell, and cut into coarse and fine cells."""
    monkeypatch.setattr(lf, "CELLS", cells)
    monkeypatch.setattr(lf, "CROWD", crowd)
    wanted = [f for f in map(LogFilter.parse, FILTERS) if "latest" not in (f.from_block, f.to_block)]
    wanted += [LogFilter(from_block=n, to_block=n + 20) for n in range(-5, 45, 10)]
    wanted += [LogFilter(addresses=(AA, AA, BB)), LogFilter(from_block=9, to_block=3)]
    table = spark.createDataFrame(filter_rows(wanted), FILTER_SCHEMA)
    found = {}
    for r in get_logs_by_table(logs, table, k, broadcast_rows).collect():
        found.setdefault(r.filter_id, []).append(r.indexed_id)
    for n, f in enumerate(wanted):
        assert sorted(found.get(n, [])) == sorted(hits(data, f, k)), f


def test_many_filters_on_one_topic_make_few_matches(spark):
    """Filters that share a frequent topic look only as far as their first hits lie."""
    logs = spark.range(60_000).selectExpr(
        "'e' AS event", "CAST(id AS STRING) AS indexed_id", f"'{AA}' AS contract_address", "id % 7 AS log_index",
        "id % 3 AS transaction_index", f"'{TOPICS[0]}' AS topic0", "CAST(NULL AS STRING) AS topic1",
        "CAST(NULL AS STRING) AS topic2", "CAST(NULL AS STRING) AS topic3", "'0x' AS data", "'0x' AS tx_hash",
        "id DIV 10 AS block_number", "'0x' AS block_hash", "id AS timestamp",
    )
    wanted = [LogFilter(from_block=3 * n, topics=((TOPICS[0],),)) for n in range(1000)]
    table = spark.createDataFrame(filter_rows(wanted), FILTER_SCHEMA)
    matches = lf.match_filter_table(logs, table, 50)
    assert matches.count() <= 1000 * 50 * 4
    found = get_logs_by_table(logs, table, 50).groupBy("filter_id").agg(F.count("*"), F.min("block_number"), F.max("block_number"))
    assert sorted(map(tuple, found.collect())) == [(n, 50, 3 * n, 3 * n + 4) for n in range(1000)]


def test_only_filters_that_may_have_more_hits_are_ranked(spark):
    """Rare values pass as they are; several frequent columns look no further than the block that completes them."""
    logs = spark.range(20_000).selectExpr(
        f"CASE WHEN id % 5 = 0 THEN '{AA}' ELSE 'other' END AS contract_address", f"'{TOPICS[0]}' AS topic0",
        "concat('0x', id % 1000) AS topic1", "CAST(NULL AS STRING) AS topic2", "CAST(NULL AS STRING) AS topic3",
        "id DIV 10 AS block_number", "'0x' AS block_hash", "id AS log_index",
    )
    wanted = [LogFilter(topics=((), (f"0x{n}",))) for n in range(500)]
    wanted.append(LogFilter(addresses=(AA,), topics=((TOPICS[0],),)))
    few, many = lf.match_filter_parts(logs, spark.createDataFrame(filter_rows(wanted), FILTER_SCHEMA), 50)
    assert few.count() == 500 * 20 and few.where("filter_id = 500").isEmpty()
    # Two of ten logs of a block are hits.
    assert many.agg(F.count("*"), F.min("filter_id"), F.max("block_number")).first() == (50, 500, 24)


def test_empty_filter_table(spark, logs):
    table = spark.createDataFrame([], FILTER_SCHEMA)
    assert get_logs_by_table(logs, table).count() == 0


GOOD = ("e", "id", AA[2:].upper(), 1, 2, TOPICS[0], "0xzz", None, "", "0xAB", TOPICS[1], 9, TOPICS[2], 0)


def test_valid_logs_normalise(spark):
    (row,) = valid_logs(spark.createDataFrame([GOOD], LOGS)).collect()
    assert row.topics == [TOPICS[0]]
    assert (row.contract_address, row.data) == (AA, "0xab")


@pytest.mark.parametrize(
    "field, bad",
    [
        ("contract_address", "0x12"),
        ("contract_address", None),
        ("tx_hash", TOPICS[0] + "\n"),
        ("block_hash", ""),
        ("data", "0xabc"),
        ("data", None),
        ("block_number", -1),
        ("log_index", None),
        ("transaction_index", None),
    ],
)
def test_malformed_hits_are_dropped(spark, field, bad):
    hit = spark.createDataFrame([GOOD], LOGS)
    spoiled = hit.withColumn(field, F.lit(bad).cast(dict(hit.dtypes)[field]))
    assert valid_logs(spoiled).count() == 0


def test_answer_shape(spark):
    (row,) = answer_logs(spark.createDataFrame([GOOD], LOGS)).collect()
    assert row.asDict() == {
        "address": AA,
        "topics": [TOPICS[0]],
        "data": "0xab",
        "blockHash": TOPICS[2],
        "blockNumber": "0x9",
        "transactionHash": TOPICS[1],
        "transactionIndex": "0x2",
        "logIndex": "0x1",
        "removed": False,
    }
