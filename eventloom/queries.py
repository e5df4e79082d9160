"""Every registered query: its Spark plan and, where SQL can say it, the same in SQL.

The SQL works from the base columns the chain tables were derived from and never
decodes hex, so encoding and decoding are checked independently.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import replace
from hashlib import sha256

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from eventloom import fixtures as fx
from eventloom.config import (
    BUCKET_BLOCKS, AbiInput, AbiItem, ContractMapping, DocumentSpec, JobConfig, ParquetSpec,
)
from eventloom.functions.bloom import bloom_has, event_gate, mapping_gate
from eventloom.functions.keccak import checksum_address
from eventloom.functions.text import epoch_seconds, hex_quantity, rfc3339
from eventloom.oracle_sql import admitted, bloom_ctes, checksummed, keccak_ctes
from eventloom.operators.decode import Event, decode, stage_events
from eventloom.operators.filters import LogFilter
from eventloom.operators import match
from eventloom.operators.match import address_in, data_arity, event_matches, topic_arity
from eventloom.operators.transfers import native_transfers, txs_with_logs
from eventloom.plans import summaries
from eventloom.plans.documents import document_columns, read_back, to_documents
from eventloom.plans.logs import (
    MAX_LOGS,
    answer_logs,
    get_event_logs,
    get_logs,
    get_logs_by_table,
    matching_logs,
    valid_logs,
)
from eventloom.plans.sync import bounded, sync
from eventloom.session import scratch_path
from eventloom.sinks import tables
from eventloom.sinks.tables import CsvSink, DocumentSink, ParquetSink
from eventloom.sources import chain

AA, BB, CC = fx.AA, fx.BB, fx.CC
TRANSFER, APPROVAL, SETTLED = fx.TRANSFER, fx.APPROVAL, fx.SETTLED
RANGE = (200, 1500)

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def register(run: Query) -> Query:
        QUERIES[name] = run
        if sql is not None:
            ORACLES[name] = sql
        return run

    return register


# ---------------------------------------------------------------- SQL building blocks

TX = f"""
o AS (SELECT *, date_diff('day', DATE '1995-01-01', o_orderdate::DATE) AS block_number FROM orders),
t AS (SELECT o_orderkey, block_number, o_custkey, o_orderstatus, o_orderpriority, o_totalprice,
  row_number() OVER (PARTITION BY block_number ORDER BY o_orderkey) - 1 AS transaction_index,
  '0x' || sha256('tx:' || o_orderkey) AS tx_hash,
  '0x' || sha256('block:' || block_number) AS block_hash,
  {fx.EPOCH_SECONDS} + 86400 * block_number AS timestamp FROM o)"""

LINE_ORDER = ", ".join(fx.LINE_ORDER)

RAW = f"""{TX},
l AS (SELECT *,
  row_number() OVER (PARTITION BY l_orderkey ORDER BY {LINE_ORDER}) - 1 AS log_position,
  '0x' || repeat(CASE l_returnflag WHEN 'A' THEN 'aa' WHEN 'N' THEN 'bb' ELSE 'cc' END, 20) AS address,
  CASE l_linestatus WHEN 'O' THEN '{TRANSFER.topic0}' ELSE '{APPROVAL.topic0}' END AS topic0,
  '0x' || lpad(lower(hex(l_suppkey)), 64, '0') AS topic1,
  CASE WHEN l_linenumber <> 7 THEN '0x' || lpad(lower(hex(l_partkey)), 64, '0') END AS topic2,
  '0x' || CASE WHEN l_linenumber = 6 THEN repeat('0', 32)
    ELSE lpad(lower(hex(round(l_extendedprice * 100)::BIGINT)) || repeat('0', 15), 64, '0') END AS data,
  CASE l_linestatus WHEN 'O' THEN 'transfer' ELSE 'approval' END AS event,
  CASE l_linestatus WHEN 'O' THEN 'Transfer' ELSE 'Approval' END AS name,
  '0x' || lpad(lower(hex(l_suppkey)), 40, '0') AS arg1,
  '0x' || lpad(lower(hex(l_partkey)), 40, '0') AS arg2,
  (round(l_extendedprice * 100)::HUGEINT * 1152921504606846976)::VARCHAR AS amount
  FROM lineitem),
raw AS (SELECT * FROM l JOIN t ON o_orderkey = l_orderkey)"""


def decoded(condition: str = "TRUE") -> str:
    """Rows that pass the drop rules and a condition, numbered within transaction and event."""
    return f"""{RAW},
d AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey, event ORDER BY {LINE_ORDER}) - 1 AS log_index,
  CAST(NULL AS VARCHAR) AS topic3 FROM raw WHERE l_linenumber NOT IN (6, 7) AND ({condition}))"""


LOGS = decoded()
TRANSFERS = decoded("event = 'transfer' AND l_returnflag IN ('A', 'N')")
LOG_FIELDS = (
    "event, address AS contract_address, log_index, transaction_index, topic0, topic1, topic2, topic3, "
    "data, tx_hash, block_number, block_hash, timestamp"
)
LOG_COLUMNS = [
    "event",
    "contract_address",
    "log_index",
    "transaction_index",
    "topic0",
    "topic1",
    "topic2",
    "topic3",
    "data",
    "tx_hash",
    "block_number",
    "block_hash",
    "timestamp",
]

SETTLED_SQL = f"""{TX},
s AS (SELECT *, round(o_totalprice * 100)::BIGINT AS cents,
  round(o_totalprice * 100)::BIGINT - 25000000 AS delta FROM t)"""


# ---------------------------------------------------------------- shared plans

PAIR = ContractMapping((TRANSFER,), (AA, BB))
PAIR_EVENTS: list[Event] = [(0, PAIR, TRANSFER)]
EVERY_EVENT: list[Event] = [(0, fx.ALL_EVENTS, TRANSFER), (1, fx.ALL_EVENTS, APPROVAL)]
SETTLED_MAPPING = ContractMapping((SETTLED,))


def _headers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Headers without their bloom: every block is looked at, and no bloom is built."""
    return fx.plain_headers(spark, sf_dir)


def _transfers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decode(fx.receipts(spark, sf_dir), _headers(spark, sf_dir), PAIR_EVENTS)["transfer"]


def _raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chain.raw_logs(fx.receipts(spark, sf_dir))


def _logs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fx.logs(spark, sf_dir).select("indexed_id", *LOG_COLUMNS)


def _zones(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fx.event_sink(spark, sf_dir).zones(spark, ["transfer", "approval"])


def _settled(*columns: str) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        events = decode(
            fx.settled_receipts(spark, sf_dir), _headers(spark, sf_dir), [(0, SETTLED_MAPPING, SETTLED)]
        )
        return events["settled"].select("tx_hash", *columns)

    return run


def _settled_sql(*columns: str) -> str:
    return f"WITH {SETTLED_SQL} SELECT tx_hash, {', '.join(columns)} FROM s"


# ---------------------------------------------------------------- scans


@query(
    "scan_block_range",
    f"""SELECT DISTINCT block_number, block_hash, timestamp FROM (WITH {TX} SELECT * FROM t)
    WHERE block_number BETWEEN {RANGE[0]} AND {RANGE[1]}""",
)
def scan_block_range(spark, sf_dir):
    return chain.in_block_range(_headers(spark, sf_dir), *RANGE)


@query(
    "scan_transactions",
    f"""WITH {TX} SELECT block_number, transaction_index, tx_hash,
    '0x' || lpad(lower(hex(o_custkey)), 40, '0') AS "from",
    CASE WHEN o_orderstatus <> 'P' THEN '{AA}' END AS "to",
    CASE WHEN o_orderpriority = '1-URGENT' THEN round(o_totalprice * 100)::BIGINT::VARCHAR ELSE '0' END AS value
    FROM t""",
)
def scan_transactions(spark, sf_dir):
    return fx.receipts(spark, sf_dir).select(
        "block_number", "transaction_index", "tx_hash", "from", "to", "value"
    )


@query(
    "scan_logs",
    f"""WITH {RAW} SELECT block_number, transaction_index, tx_hash, log_position, address,
    concat_ws(',', topic0, topic1, topic2) AS topics, data
    FROM raw""",
)
def scan_logs(spark, sf_dir):
    return chain.raw_logs(fx.receipts(spark, sf_dir)).withColumn("topics", F.concat_ws(",", "topics"))


@query("resolve_to_block", f"WITH {TX} SELECT max(block_number) AS best_block FROM t")
def resolve_to_block(spark, sf_dir):
    return chain.best_block(_headers(spark, sf_dir))


@query(
    "contiguous_prefix",
    f"""WITH {TX}, b AS (SELECT DISTINCT block_number, block_hash, timestamp FROM t WHERE block_number >= 0),
    e AS (SELECT min(block_number) AS last FROM b WHERE block_number + 1 NOT IN (SELECT block_number FROM b))
    SELECT b.* FROM b, e WHERE block_number <= last AND EXISTS (SELECT 1 FROM b WHERE block_number = 0)""",
)
def contiguous_prefix(spark, sf_dir):
    return chain.contiguous_prefix(_headers(spark, sf_dir), 0)


@query(
    "csv_roundtrip",
    f"""WITH {TRANSFERS} SELECT address AS contract_address, log_index, transaction_index, topic0, topic1,
    topic2, topic3, data, arg1 AS "from", arg2 AS "to", amount AS value, tx_hash, block_number, block_hash,
    timestamp, (transaction_index)::VARCHAR AS note FROM d""",
)
def csv_roundtrip(spark, sf_dir):
    sink = CsvSink(scratch_path(spark, "csv"))
    rows = _transfers(spark, sf_dir).drop("tx_log_index", "block_log_index")
    # A column the declared schema lacks comes back as text.
    sink.write("transfer", rows.withColumn("note", F.col("transaction_index")))
    return sink.read(spark, "transfer", TRANSFER.schema()).drop("indexed_id")


# ---------------------------------------------------------------- sinks


@query(
    "parquet_roundtrip",
    f"""WITH {TRANSFERS} SELECT address AS contract_address, log_index, transaction_index, topic0, topic1,
    topic2, topic3, data, arg1 AS "from", arg2 AS "to", amount AS value, tx_hash, block_number, block_hash,
    timestamp, block_number // {BUCKET_BLOCKS} AS block_bucket FROM d""",
)
def parquet_roundtrip(spark, sf_dir):
    sink = ParquetSink(scratch_path(spark, "parquet"))
    sink.prepare(spark, {"transfer": TRANSFER.schema()})
    sink.write("transfer", _transfers(spark, sf_dir))
    return sink.read(spark, "transfer", TRANSFER.schema()).drop("indexed_id", "tx_log_index", "block_log_index")


@query(
    "block_boundaries",
    f"""WITH {TRANSFERS} SELECT block_number // {BUCKET_BLOCKS} AS block_bucket,
    min(block_number) AS min_block, max(block_number) AS max_block FROM d GROUP BY 1""",
)
def block_boundaries(spark, sf_dir):
    return tables.block_boundaries(_transfers(spark, sf_dir))


@query(
    "stored_zones",
    f"""WITH {LOGS} SELECT event AS "table", block_number // {BUCKET_BLOCKS} AS block_bucket,
    min(block_number) AS min_block, max(block_number) AS max_block, count(*) AS rows FROM d GROUP BY ALL""",
)
def stored_zones(spark, sf_dir):
    return _zones(spark, sf_dir)


@query(
    "export_documents",
    f"""WITH {TRANSFERS} SELECT address AS contract_address, log_index, transaction_index, topic0, topic1,
    topic2, topic3, data, tx_hash, block_number, block_hash,
    strftime(to_timestamp(timestamp) AT TIME ZONE 'UTC', '%Y-%m-%dT%H:%M:%S+00:00') AS time,
    timestamp FROM d""",
)
def export_documents(spark, sf_dir):
    documents = to_documents(_transfers(spark, sf_dir))
    path = scratch_path(spark, "documents")
    documents.write.text(path)
    stored = spark.read.text(path).withColumnRenamed("value", "document")
    return read_back(stored).withColumn("time", rfc3339(F.col("timestamp")))


# ---------------------------------------------------------------- filters on the chain


@query(
    "bloom_address",
    f"""WITH RECURSIVE {RAW}, {bloom_ctes([AA, BB, CC])} SELECT block_number, {admitted(AA)} AS aa,
    {admitted(BB)} AS bb, {admitted(CC)} AS cc FROM blocks""",
)
def bloom_address(spark, sf_dir):
    contracts = {"aa": AA, "bb": BB, "cc": CC}
    return fx.headers(spark, sf_dir).select(
        "block_number", *[F.expr(bloom_has("logs_bloom", a)).alias(n) for n, a in contracts.items()]
    )


@query(
    "bloom_topic",
    f"""WITH RECURSIVE {RAW}, {bloom_ctes([TRANSFER.topic0, APPROVAL.topic0, SETTLED.topic0])}
    SELECT block_number, {admitted(TRANSFER.topic0)} AS transfer, {admitted(APPROVAL.topic0)} AS approval,
    {admitted(SETTLED.topic0)} AS settled FROM blocks""",
)
def bloom_topic(spark, sf_dir):
    return fx.headers(spark, sf_dir).select(
        "block_number",
        *[F.expr(bloom_has("logs_bloom", i.topic0)).alias(i.table) for i in (TRANSFER, APPROVAL, SETTLED)],
    )


@query(
    "candidate_blocks",
    f"""WITH RECURSIVE {RAW}, {bloom_ctes([AA, BB, TRANSFER.topic0])}
    SELECT block_number, transaction_index, tx_hash FROM t
    WHERE ({admitted(AA)} OR {admitted(BB)}) AND {admitted(TRANSFER.topic0)}""",
)
def candidate_blocks(spark, sf_dir):
    wanted = fx.headers(spark, sf_dir).where(mapping_gate(PAIR))
    return (
        fx.receipts(spark, sf_dir)
        .join(wanted.select("block_number"), "block_number", "left_semi")
        .select("block_number", "transaction_index", "tx_hash")
    )


@query(
    "event_gate",
    f"""WITH RECURSIVE {RAW}, {bloom_ctes([TRANSFER.topic0, APPROVAL.topic0])} SELECT block_number,
    {admitted(TRANSFER.topic0)} AS transfer, {admitted(APPROVAL.topic0)} AS approval FROM blocks""",
)
def event_gates(spark, sf_dir):
    return fx.headers(spark, sf_dir).select(
        "block_number",
        *[F.expr(event_gate(m, item)).alias(item.table) for _, m, item in EVERY_EVENT],
    )


@query(
    "filter_address",
    f"""WITH {RAW} SELECT tx_hash, log_position, address, data FROM raw WHERE l_returnflag IN ('A', 'N')""",
)
def filter_address(spark, sf_dir):
    raw = _raw(spark, sf_dir).where(address_in("address", PAIR.addresses))
    return raw.select("tx_hash", "log_position", "address", "data")


@query(
    "txs_with_logs",
    f"""WITH {RAW} SELECT tx_hash, transaction_index, count(*) AS logs FROM raw
    WHERE l_returnflag IN ('A', 'N') GROUP BY ALL""",
)
def txs_left_with_logs(spark, sf_dir):
    kept = txs_with_logs(fx.receipts(spark, sf_dir), PAIR)
    return kept.groupBy("tx_hash", "transaction_index").agg(F.sum(F.size("logs")).alias("logs"))


@query(
    "match_event",
    f"""WITH {RAW} SELECT tx_hash, log_position, address, topic0, data FROM raw WHERE event = 'transfer'
    AND l_linenumber NOT IN (6, 7)""",
)
def match_event(spark, sf_dir):
    return (
        _raw(spark, sf_dir)
        .where(event_matches(TRANSFER))
        .select("tx_hash", "log_position", "address", F.get("topics", F.lit(0)).alias("topic0"), "data")
    )


@query(
    "topic_arity",
    f"""WITH {RAW} SELECT tx_hash, log_position, concat_ws(',', topic0, topic1, topic2) AS topics
    FROM raw WHERE l_linenumber <> 7""",
)
def topic_arities(spark, sf_dir):
    raw = _raw(spark, sf_dir).where(topic_arity("topics", TRANSFER))
    return raw.select("tx_hash", "log_position", F.concat_ws(",", "topics").alias("topics"))


@query(
    "data_arity",
    f"WITH {RAW} SELECT tx_hash, log_position, data FROM raw WHERE l_linenumber <> 6",
)
def data_arities(spark, sf_dir):
    raw = _raw(spark, sf_dir).where(data_arity("data", TRANSFER))
    return raw.select("tx_hash", "log_position", "data")


@query(
    "regex_filter",
    f"""WITH {decoded("event = 'transfer' AND regexp_matches(arg1, '[05a]$') AND regexp_matches(amount, '^[1-4]')")}
    SELECT address AS contract_address, log_index, arg1 AS "from", arg2 AS "to", amount AS value, tx_hash FROM d""",
)
def regex_filter(spark, sf_dir):
    patterns = {"from": "[05A]$", "value": "^[1-4]"}
    item = AbiItem(
        TRANSFER.name,
        tuple(AbiInput(i.name, i.type, i.indexed, patterns.get(i.name)) for i in TRANSFER.inputs),
    )
    events = decode(
        fx.receipts(spark, sf_dir), _headers(spark, sf_dir), [(0, ContractMapping((item,)), item)]
    )
    return events["transfer"].select("contract_address", "log_index", "from", "to", "value", "tx_hash")


@query(
    "native_transfers",
    f"""WITH {RAW} SELECT '0x' || lpad(lower(hex(o_custkey)), 40, '0') AS "from",
    CASE WHEN o_orderstatus <> 'P' THEN '{AA}' ELSE '0x' || repeat('0', 40) END AS "to",
    round(o_totalprice * 100)::BIGINT::VARCHAR AS value, block_number, block_hash, timestamp
    FROM t WHERE o_orderpriority = '1-URGENT' AND round(o_totalprice * 100) <> 0
    AND o_orderkey IN (SELECT l_orderkey FROM l WHERE l_returnflag IN ('A', 'N'))""",
)
def native(spark, sf_dir):
    return native_transfers(fx.receipts(spark, sf_dir), _headers(spark, sf_dir), [PAIR])


# ---------------------------------------------------------------- filters on the logs


def _log_query(condition: str) -> str:
    return f"WITH {LOGS} SELECT {LOG_FIELDS} FROM d WHERE {condition}"


def _matching(log_filter: LogFilter) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return matching_logs(fx.logs(spark, sf_dir), log_filter).select(*LOG_COLUMNS)

    return run


BLOCK_200 = "0x" + sha256(b"block:200").hexdigest()
TX_1 = "0x" + sha256(b"tx:1").hexdigest()
SUPPLIERS = ["0x" + format(n, "064x") for n in (3, 7, 9)]

query("logs_by_range", _log_query(f"block_number BETWEEN {RANGE[0]} AND {RANGE[1]}"))(
    _matching(LogFilter.parse({"fromBlock": hex(RANGE[0]), "toBlock": hex(RANGE[1])}))
)
query("logs_by_address", _log_query("l_returnflag IN ('A', 'R')"))(
    _matching(LogFilter.parse({"address": [AA.upper().replace("0X", "0x"), CC], "toBlock": "latest"}))
)
query("logs_by_topics", _log_query("event = 'transfer' AND l_suppkey IN (3, 7, 9)"))(
    _matching(LogFilter.parse({"topics": [TRANSFER.topic0, SUPPLIERS, None]}))
)
query("logs_by_block_hash", _log_query("block_hash = '0x' || sha256('block:200')"))(
    _matching(
        LogFilter.parse(
            {"blockHash": BLOCK_200}
        )
    )
)
query("logs_from_latest", _log_query("block_number = (SELECT max(block_number) FROM d)"))(
    _matching(LogFilter.parse({"fromBlock": "latest", "toBlock": "latest"}))
)
query("logs_all", _log_query("TRUE"))(_matching(LogFilter()))
query("logs_union", f"WITH {LOGS} SELECT event, tx_hash, log_index FROM d")(
    lambda spark, sf_dir: _logs(spark, sf_dir).select("event", "tx_hash", "log_index")
)


HIT_ORDER_SQL = "block_number, log_index, transaction_index, event"


@query(
    "get_logs",
    f"""WITH {LOGS} SELECT {LOG_FIELDS} FROM d WHERE block_number >= {RANGE[0]} AND l_returnflag = 'A'
    ORDER BY {HIT_ORDER_SQL} LIMIT 1000""",
)
def get_logs_query(spark, sf_dir):
    request = LogFilter.parse({"fromBlock": hex(RANGE[0]), "address": AA})
    hits = get_logs(fx.logs(spark, sf_dir), request, MAX_LOGS)
    return hits.select(*LOG_COLUMNS)


@query(
    "get_event_logs",
    f"""WITH {LOGS} SELECT address AS contract_address, log_index, transaction_index, arg1 AS owner,
    arg2 AS spender, amount AS value, tx_hash, block_number FROM d WHERE event = 'approval'
    ORDER BY block_number, log_index, transaction_index LIMIT 1000""",
)
def get_event_logs_query(spark, sf_dir):
    hits = get_event_logs(
        fx.event_table_frames(spark, sf_dir), "Approval", LogFilter(), MAX_LOGS
    )
    return hits.select(
        "contract_address",
        "log_index",
        "transaction_index",
        "owner",
        "spender",
        "value",
        "tx_hash",
        "block_number",
    )


def _filter_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A filter per supplier (by topic), per nation and contract (by address), and per region (by range)."""
    suppliers = fx.table(spark, sf_dir, "supplier").select(
        F.col("s_suppkey").cast("bigint").alias("filter_id"),
        F.lit(None).cast("bigint").alias("from_block"),
        F.lit(None).cast("bigint").alias("to_block"),
        F.lit(None).cast("string").alias("block_hash"),
        F.array().cast("array<string>").alias("addresses"),
        F.array(
            F.array().cast("array<string>"),
            F.array(F.concat(F.lit("0x"), F.lpad(F.lower(F.hex("s_suppkey")), 64, "0"))),
        ).alias("topics"),
    )
    nation = F.col("n_nationkey").cast("bigint")
    nations = fx.table(spark, sf_dir, "nation").select(
        (nation + 1_000_000_000).alias("filter_id"),
        (nation * 50).alias("from_block"),
        (nation * 50 + 500).alias("to_block"),
        F.lit(None).cast("string").alias("block_hash"),
        F.array(F.lit(AA), F.lit(CC)).alias("addresses"),
        F.array(F.array(F.lit(TRANSFER.topic0))).alias("topics"),
    )
    region = F.col("r_regionkey").cast("bigint")
    regions = fx.table(spark, sf_dir, "region").select(
        (region + 2_000_000_000).alias("filter_id"),
        (region * 300).alias("from_block"),
        F.lit(None).cast("bigint").alias("to_block"),
        F.lit(None).cast("string").alias("block_hash"),
        F.lit(None).cast("array<string>").alias("addresses"),
        F.lit(None).cast("array<array<string>>").alias("topics"),
    )
    return suppliers.unionByName(nations).unionByName(regions)


@query(
    "logs_by_filter_table",
    f"""WITH {LOGS}, hits AS (
    SELECT s_suppkey::BIGINT AS filter_id, d.* FROM d JOIN supplier ON l_suppkey = s_suppkey
    UNION ALL SELECT n_nationkey::BIGINT + 1000000000, d.* FROM d JOIN nation
      ON block_number BETWEEN n_nationkey * 50 AND n_nationkey * 50 + 500
      WHERE l_returnflag IN ('A', 'R') AND event = 'transfer'
    UNION ALL SELECT r_regionkey::BIGINT + 2000000000, d.* FROM d JOIN region ON block_number >= r_regionkey * 300),
    ranked AS (SELECT *, row_number() OVER (PARTITION BY filter_id ORDER BY {HIT_ORDER_SQL}) AS n FROM hits)
    SELECT filter_id, {LOG_FIELDS} FROM ranked WHERE n <= 1000""",
)
def logs_by_filter_table(spark, sf_dir):
    return get_logs_by_table(_logs(spark, sf_dir), _filter_table(spark, sf_dir), MAX_LOGS).drop("indexed_id")


def _spoiled_hits(logs: DataFrame) -> DataFrame:
    """Hits with fields spoiled by rule: a required one on bb contracts, a topic on cc contracts."""
    bb, cc = F.col("contract_address") == BB, F.col("contract_address") == CC
    return logs.withColumns(
        {
            "tx_hash": F.when(bb & (F.col("event") == "transfer"), F.substring("tx_hash", 1, 40)).otherwise(
                F.col("tx_hash")
            ),
            "block_hash": F.when(~(bb & (F.col("event") == "approval")), F.col("block_hash")),
            "topic1": F.when(cc, F.lit("0xzz")).otherwise(F.col("topic1")),
        }
    )


@query(
    "valid_logs",
    f"""WITH {LOGS} SELECT event, address AS contract_address, log_index, transaction_index,
    CASE WHEN l_returnflag = 'R' THEN topic0 || ',' || topic2
      ELSE topic0 || ',' || topic1 || ',' || topic2 END AS topics,
    data, tx_hash, block_number, block_hash, timestamp FROM d WHERE l_returnflag <> 'N'""",
)
def valid_logs_query(spark, sf_dir):
    hits = _spoiled_hits(_logs(spark, sf_dir).drop("indexed_id"))
    return valid_logs(hits).withColumn("topics", F.concat_ws(",", "topics"))


# ---------------------------------------------------------------- decoding

query(
    "decode_transfers",
    f"""WITH {TRANSFERS} SELECT address AS contract_address, log_index, transaction_index, arg1 AS "from",
    arg2 AS "to", amount AS value, tx_hash, block_number, block_hash, timestamp FROM d""",
)(
    lambda spark, sf_dir: _transfers(spark, sf_dir).select(
        "contract_address",
        "log_index",
        "transaction_index",
        "from",
        "to",
        "value",
        "tx_hash",
        "block_number",
        "block_hash",
        "timestamp",
    )
)


@query(
    "sync_transfers",
    f"""WITH {TRANSFERS},
    b AS (SELECT DISTINCT block_number FROM t WHERE block_number >= 0),
    e AS (SELECT min(block_number) AS last FROM b WHERE block_number + 1 NOT IN (SELECT block_number FROM b))
    SELECT address AS contract_address, log_index, transaction_index, arg1 AS "from", arg2 AS "to",
    amount AS value, tx_hash, block_number FROM d, e WHERE block_number BETWEEN 0 AND last
    AND EXISTS (SELECT 1 FROM b WHERE block_number = 0)""",
)
def sync_transfers(spark, sf_dir):
    """The whole job short of its sinks: range, gap cutoff, blooms, filters, decoding."""
    config = JobConfig(mappings=(PAIR,), from_block=0)
    headers, receipts = bounded(config, fx.headers(spark, sf_dir), fx.receipts(spark, sf_dir))
    return decode(receipts, headers, config.events())["transfer"].select(
        "contract_address",
        "log_index",
        "transaction_index",
        "from",
        "to",
        "value",
        "tx_hash",
        "block_number",
    )


@query(
    "sync_delivery",
    f"""WITH {TRANSFERS},
    b AS (SELECT DISTINCT block_number FROM t WHERE block_number >= 0),
    e AS (SELECT min(block_number) AS last FROM b WHERE block_number + 1 NOT IN (SELECT block_number FROM b)),
    r AS (SELECT tx_hash, log_index, block_number, address AS contract_address, amount AS value FROM d, e
      WHERE block_number BETWEEN 0 AND last AND EXISTS (SELECT 1 FROM b WHERE block_number = 0))
    SELECT sink, r.* FROM r, (VALUES ('csv'), ('documents'), ('parquet')) s(sink)""",
)
def sync_delivery(spark, sf_dir):
    """The whole job through its sinks: a first run over few blocks, then one that replaces it, read back."""
    folder = scratch_path(spark, "delivery")
    config = JobConfig(
        mappings=(PAIR,),
        from_block=0,
        native_transfers=True,
        csv=f"{folder}/csv",
        parquet=ParquetSpec(f"{folder}/tables", False),
        documents=DocumentSpec(f"{folder}/documents", "events", ""),
        compression="gzip",
    )
    chain_tables = fx.headers(spark, sf_dir), fx.receipts(spark, sf_dir)
    sync(spark, replace(config, to_block=20), *chain_tables)
    sync(spark, config, *chain_tables)
    schema = config.table_schemas()["transfer"]
    columns = ["tx_hash", "log_index", "block_number", "contract_address", "value"]
    fields = "tx_hash string, log_index bigint, block_number bigint, contract_address string, value string"
    stored = DocumentSink(config.documents.directory, config.documents.prefix).read(spark, "transfer")
    delivered = {
        "parquet": ParquetSink(config.parquet.directory).read(spark, "transfer", schema),
        "csv": CsvSink(config.csv).read(spark, "transfer", schema),
        "documents": stored.select(F.from_json("document", fields).alias("d")).select("d.*"),
    }
    frames = [rows.select(F.lit(sink).alias("sink"), *columns) for sink, rows in delivered.items()]
    return frames[0].unionByName(frames[1]).unionByName(frames[2])


@query(
    "decode_event",
    f"""WITH {decoded("event = 'approval'")} SELECT address AS contract_address, log_index, transaction_index,
    topic0, topic1, topic2, topic3, data, arg1 AS owner, arg2 AS spender, amount AS value, tx_hash,
    block_number, block_hash, timestamp,
    log_position + start AS block_log_index
    FROM d JOIN (SELECT tx_hash AS h, (sum(n) OVER (PARTITION BY block_number ORDER BY transaction_index) - n)::BIGINT
      AS start FROM (SELECT t.tx_hash, t.block_number, t.transaction_index, count(l_orderkey) AS n
        FROM t LEFT JOIN l ON l_orderkey = o_orderkey GROUP BY ALL)) ON h = tx_hash""",
)
def decode_event(spark, sf_dir):
    mapping = ContractMapping((APPROVAL,))
    events = decode(fx.receipts(spark, sf_dir), _headers(spark, sf_dir), [(0, mapping, APPROVAL)])
    return events["approval"].drop("indexed_id", "tx_log_index")


@query(
    "decode_address",
    f"""WITH {TRANSFERS} SELECT tx_hash, log_index, arg1 AS "from", arg2 AS "to" FROM d""",
)
def decode_address(spark, sf_dir):
    return _transfers(spark, sf_dir).select("tx_hash", "log_index", "from", "to")


@query(
    "checksum_address",
    f"""WITH RECURSIVE {TRANSFERS},
    m AS (SELECT item, lower(hex(substr(item, 3))) AS message FROM (SELECT arg1 AS item FROM d UNION SELECT arg2 FROM d)),
    {keccak_ctes("m")}
    SELECT tx_hash, log_index, {checksummed("arg1", "a.digest")} AS "from", {checksummed("arg2", "b.digest")} AS "to"
    FROM d JOIN digests a ON a.item = arg1 JOIN digests b ON b.item = arg2""",
)
def checksum(spark, sf_dir):
    rows = _transfers(spark, sf_dir)
    return rows.select(
        "tx_hash", "log_index", *[checksum_address(F.col(c)).alias(c) for c in ("from", "to")]
    )


query(
    "decode_bool",
    _settled_sql("CASE WHEN o_orderpriority = '1-URGENT' THEN 'true' ELSE 'false' END AS urgent"),
)(_settled("urgent"))
query(
    "decode_bytes",
    _settled_sql(
        "CASE WHEN o_custkey % 7 = 0 THEN '' ELSE lpad(lower(hex(o_custkey % 7)), 64, '0') END AS memo"
    ),
)(_settled("memo"))
query(
    "decode_string",
    _settled_sql(
        "CASE WHEN o_custkey % 5 = 0 THEN '' ELSE '0x' || lpad(lower(hex(o_custkey % 5)), 64, '0') END AS label"
    ),
)(_settled("label"))
query(
    "decode_uint",
    _settled_sql(
        "o_orderpriority[1:1]::BIGINT AS tier",
        "(block_number % 65536)::BIGINT AS day",
        "cents AS cents32",
        "(cents::HUGEINT * 68719476736)::VARCHAR AS scaled64",
        "(cents::HUGEINT * 1267650600228229401496703205376)::VARCHAR AS scaled128",
    ),
)(
    lambda spark, sf_dir: _settled("tier", "day", "cents32", "scaled64", "scaled128")(
        spark, sf_dir
    ).withColumn("scaled64", F.col("scaled64").cast("string"))
)
query(
    "decode_int",
    _settled_sql(
        "delta % 128 AS delta8",
        "delta % 32768 AS delta16",
        "delta AS delta32",
        "delta * 68719476736 AS delta64",
        "(delta::HUGEINT * 1208925819614629174706176)::VARCHAR AS delta128",
    ),
)(_settled("delta8", "delta16", "delta32", "delta64", "delta128"))


def _product_sql(number: str, power: int) -> str:
    """A 64-bit number times 16^power as text: digits of base 10^18, each product below 2^127."""
    base, rest, limbs = 10**18, 16**power, []
    while rest:
        rest, limb = divmod(rest, base)
        limbs.append(limb)
    carry, digits = "0::HUGEINT", []
    for limb in limbs:
        product = f"(abs({number})::HUGEINT * {limb} + {carry})"
        digits.append(f"lpad(({product} % {base})::VARCHAR, 18, '0')")
        carry = f"({product} // {base})"
    text = " || ".join([f"{carry}::VARCHAR", *reversed(digits)])
    sign = f"CASE WHEN {number} < 0 THEN '-' ELSE '' END"
    return f"{sign} || coalesce(nullif(ltrim({text}, '0'), ''), '0')"


# No SQL type here holds 256 bits, so the SQL multiplies digit by digit.
query(
    "decode_wide",
    _settled_sql(f"{_product_sql('cents', 57)} AS scaled256", f"{_product_sql('delta', 40)} AS delta256"),
)(_settled("scaled256", "delta256"))
query("decode_bytes32", _settled_sql("'0x' || sha256('ref:' || o_orderkey) AS ref"))(_settled("ref"))
query("decode_unknown", _settled_sql("'0x' || lpad(lower(hex(o_custkey)), 64, '0') AS kind"))(
    _settled("kind")
)


@query(
    "decode_indexed",
    _settled_sql(
        "'0x' || lpad(lower(hex(o_custkey)), 40, '0') AS customer", 'o_orderkey::VARCHAR AS "order"'
    ),
)
def decode_indexed(spark, sf_dir):
    rows = _settled("customer", "order")(spark, sf_dir)
    return rows.withColumn("order", F.col("order").cast("string"))


@query(
    "decode_data_words",
    _settled_sql(
        "o_orderpriority[1:1]::BIGINT AS tier",
        "'0x' || sha256('ref:' || o_orderkey) AS ref",
        "'0x' || lpad(lower(hex(o_custkey)), 64, '0') AS kind",
        "CASE WHEN o_orderpriority = '1-URGENT' THEN 'true' ELSE 'false' END AS urgent",
        "delta AS delta32",
    ),
)
def decode_data_words(spark, sf_dir):
    return _settled("tier", "ref", "kind", "urgent", "delta32")(spark, sf_dir)


@query(
    "flatten_topics",
    f"""WITH {RAW} SELECT block_number, transaction_index, tx_hash, log_position, address, topic0, topic1,
    topic2, CAST(NULL AS VARCHAR) AS topic3, data FROM raw""",
)
def flatten_topics(spark, sf_dir):
    # Binary data, as chain tables may store it, comes out as the same hex text.
    raw = _raw(spark, sf_dir).withColumn("data", F.unhex(F.substring("data", 3, 2_000_000_000)))
    return chain.flatten_topics(raw)


@query(
    "row_id",
    f"""WITH {TRANSFERS} SELECT sha256('{TRANSFER.signature}|{AA},{BB}|' || tx_hash || '|' || log_index)
    AS indexed_id, tx_hash, log_index FROM d""",
)
def row_ids(spark, sf_dir):
    return _transfers(spark, sf_dir).select("indexed_id", "tx_hash", "log_index")


@query(
    "typed_documents",
    f"""WITH {LOGS} SELECT event, tx_hash,
    CASE WHEN l_returnflag = 'A' THEN 0 ELSE log_index END AS log_index,
    CASE WHEN l_returnflag = 'N' THEN 0 ELSE transaction_index END AS transaction_index,
    CASE WHEN l_returnflag = 'R' THEN '"b' || block_number || '"' ELSE block_number::VARCHAR END AS block_number
    FROM d""",
)
def typed_documents(spark, sf_dir):
    text = {c: F.col(c).cast("string") for c in ("log_index", "transaction_index", "block_number")}
    at = F.col("contract_address")
    texts = _logs(spark, sf_dir).withColumns(
        {
            "log_index": F.when(at == AA, "x").otherwise(text["log_index"]),
            "transaction_index": F.when(at != BB, text["transaction_index"]),
            "block_number": F.when(at == CC, F.concat(F.lit("b"), text["block_number"])).otherwise(
                text["block_number"]
            ),
        }
    )
    fields = ["event", "tx_hash", "log_index", "transaction_index", "block_number"]
    typed = texts.select(*fields)
    typed = typed.select(*document_columns(typed, ["block_number"]))
    return typed.withColumn("block_number", F.to_json("block_number"))


@query(
    "rfc3339_to_epoch",
    f"""WITH {LOGS} SELECT tx_hash, log_index, event, CASE l_returnflag WHEN 'A' THEN timestamp
    WHEN 'N' THEN timestamp - 7200 ELSE 0 END AS epoch FROM d""",
)
def rfc3339_to_epoch(spark, sf_dir):
    time = rfc3339(F.col("timestamp"))
    text = (
        F.when(F.col("contract_address") == AA, time)
        .when(F.col("contract_address") == BB, F.regexp_replace(time, r"\+00:00", "+02:00"))
        .otherwise(F.substring(time, 1, 10))
    )
    return _logs(spark, sf_dir).select("tx_hash", "log_index", "event", epoch_seconds(text).alias("epoch"))


@query(
    "hex_quantity",
    f"""WITH {LOGS} SELECT event, tx_hash, log_index, '0x' || lower(hex(block_number)) AS block_quantity,
    '0x' || lower(hex(timestamp)) AS time_quantity, '0x' || lower(hex(transaction_index)) AS index_quantity
    FROM d""",
)
def hex_quantities(spark, sf_dir):
    return _logs(spark, sf_dir).select(
        "event",
        "tx_hash",
        "log_index",
        hex_quantity(F.col("block_number")).alias("block_quantity"),
        hex_quantity(F.col("timestamp")).alias("time_quantity"),
        hex_quantity(F.col("transaction_index")).alias("index_quantity"),
    )


@query(
    "rpc_logs",
    f"""WITH {LOGS} SELECT address, topic0 || ',' || topic1 || ',' || topic2 AS topics, data,
    block_hash AS "blockHash", '0x' || lower(hex(block_number)) AS "blockNumber", tx_hash AS "transactionHash",
    '0x' || lower(hex(transaction_index)) AS "transactionIndex", '0x' || lower(hex(log_index)) AS "logIndex",
    FALSE AS removed FROM d""",
)
def rpc_logs(spark, sf_dir):
    return answer_logs(_logs(spark, sf_dir)).withColumn("topics", F.concat_ws(",", "topics"))


# ---------------------------------------------------------------- joins


@query(
    "enrich_blocks",
    f"""WITH {TX}, n AS (SELECT l_orderkey, count(*) AS logs FROM lineitem GROUP BY 1)
    SELECT block_number, transaction_index, tx_hash, coalesce(logs, 0) AS logs, block_hash, timestamp
    FROM t LEFT JOIN n ON l_orderkey = o_orderkey""",
)
def enrich_blocks(spark, sf_dir):
    joined = chain.enrich_blocks(fx.receipts(spark, sf_dir), _headers(spark, sf_dir))
    keys = ["block_number", "transaction_index", "tx_hash", "block_hash", "timestamp"]
    return joined.groupBy(*keys).agg(F.sum(F.size("logs")).alias("logs"))


@query(
    "route_events",
    f"""WITH {RAW} SELECT tx_hash, log_position, event, address FROM raw WHERE l_linenumber NOT IN (6, 7)""",
)
def route_events(spark, sf_dir):
    return match.route_events(_raw(spark, sf_dir), [TRANSFER, APPROVAL]).select(
        "tx_hash", "log_position", "event", "address"
    )


MANY = JobConfig(
    mappings=(
        ContractMapping((TRANSFER,), (AA,)),
        ContractMapping((TRANSFER, APPROVAL), (AA, BB)),
        ContractMapping((SETTLED, APPROVAL)),
    )
)


@query(
    "multi_mapping",
    f"""WITH {RAW}, m AS (
    SELECT *, 0 AS mapping FROM raw WHERE event = 'transfer' AND l_returnflag = 'A'
    UNION ALL SELECT *, 1 FROM raw WHERE l_returnflag IN ('A', 'N')
    UNION ALL SELECT *, 2 FROM raw WHERE event = 'approval')
    SELECT event, address AS contract_address, row_number() OVER (PARTITION BY mapping, event, l_orderkey
      ORDER BY {LINE_ORDER}) - 1 AS log_index, arg1 AS first_arg, arg2 AS second_arg, amount AS value, tx_hash
    FROM m WHERE l_linenumber NOT IN (6, 7)""",
)
def multi_mapping(spark, sf_dir):
    events = decode(fx.receipts(spark, sf_dir), _headers(spark, sf_dir), MANY.events())
    names = {"transfer": ("from", "to"), "approval": ("owner", "spender")}
    frames = [
        events[t].select(
            F.lit(t).alias("event"),
            "contract_address",
            "log_index",
            F.col(a).alias("first_arg"),
            F.col(b).alias("second_arg"),
            "value",
            "tx_hash",
        )
        for t, (a, b) in names.items()
    ]
    return frames[0].unionByName(frames[1])


# ---------------------------------------------------------------- aggregates


@query("event_counts", f"WITH {LOGS} SELECT event, count(*) AS records FROM d GROUP BY 1")
def event_counts(spark, sf_dir):
    return summaries.event_counts(_logs(spark, sf_dir))


BLOCK_FIELDS = """block_number, 0::BIGINT AS page, '0x' || lower(hex(block_number)) AS number,
    min(block_hash) AS hash, '0x' || lower(hex(min(timestamp))) AS timestamp,
    string_agg(DISTINCT tx_hash, ',' ORDER BY tx_hash) AS transactions, '' AS uncles"""
BLOCK_LITERALS = ", ".join(f"'{v}' AS \"{k}\"" for k, v in summaries.BLOCK_CONSTANTS.items())


def _flat_block(blocks: DataFrame) -> DataFrame:
    return blocks.withColumns(
        {"transactions": F.concat_ws(",", "transactions"), "uncles": F.concat_ws(",", "uncles")}
    )


@query(
    "block_tx_hashes",
    f"""WITH {LOGS} SELECT block_number, 0::BIGINT AS page, min(block_hash) AS block_hash,
    min(timestamp) AS timestamp, string_agg(DISTINCT tx_hash, ',' ORDER BY tx_hash) AS transactions
    FROM d GROUP BY block_number""",
)
def block_tx_hashes(spark, sf_dir):
    hashes = summaries.block_tx_hashes(_logs(spark, sf_dir))
    return hashes.withColumn("transactions", F.concat_ws(",", "transactions"))


@query(
    "blocks_from_logs",
    f"WITH {LOGS} SELECT {BLOCK_FIELDS}, {BLOCK_LITERALS} FROM d GROUP BY block_number",
)
def blocks_from_logs(spark, sf_dir):
    return _flat_block(summaries.blocks_from_logs(_logs(spark, sf_dir)))


@query(
    "block_by_number",
    f"""WITH {LOGS} SELECT {BLOCK_FIELDS}, {BLOCK_LITERALS} FROM d
    WHERE block_number = (SELECT max(block_number) FROM d) GROUP BY block_number""",
)
def block_by_number(spark, sf_dir):
    return _flat_block(summaries.get_block(fx.logs(spark, sf_dir), "latest", _zones(spark, sf_dir)))


def _log_json_sql() -> str:
    return """'{"address":"' || address || '","topics":["' || topic0 || '","' || topic1 || '","' || topic2
    || '"],"data":"' || data || '","blockHash":"' || block_hash || '","blockNumber":"0x'
    || lower(hex(block_number)) || '","transactionHash":"' || tx_hash || '","transactionIndex":"0x'
    || lower(hex(transaction_index)) || '","logIndex":"0x' || lower(hex(log_index)) || '","removed":false}'"""


RECEIPT_LITERALS = ", ".join(
    f"{'CAST(NULL AS VARCHAR)' if v is None else repr(v)} AS \"{k}\""
    for k, v in summaries.RECEIPT_CONSTANTS.items()
)
RECEIPT_FIELDS = f"""tx_hash AS "transactionHash", 0::BIGINT AS page,
    '0x' || lower(hex(min(transaction_index))) AS "transactionIndex", min(block_hash) AS "blockHash",
    '0x' || lower(hex(min(block_number))) AS "blockNumber", min_by(address, (log_index, event)) AS "to",
    '[' || string_agg({_log_json_sql()}, ',' ORDER BY log_index, event) || ']' AS logs, {RECEIPT_LITERALS}"""


@query(
    "receipts_from_logs",
    f"WITH {LOGS} SELECT {RECEIPT_FIELDS} FROM d GROUP BY tx_hash",
)
def receipts_from_logs(spark, sf_dir):
    rebuilt = summaries.receipts_from_logs(fx.logs(spark, sf_dir))
    return rebuilt.withColumn("logs", F.to_json("logs"))


@query(
    "receipt_by_hash",
    f"WITH {LOGS} SELECT {RECEIPT_FIELDS} FROM d WHERE tx_hash = '0x' || sha256('tx:1') GROUP BY tx_hash",
)
def receipt_by_hash(spark, sf_dir):
    buckets = fx.event_sink(spark, sf_dir).buckets_of(spark, TX_1)
    return summaries.get_receipt(fx.logs(spark, sf_dir), TX_1, buckets).withColumn("logs", F.to_json("logs"))


@query("latest_block", f"WITH {LOGS} SELECT max(block_number) AS latest_block FROM d")
def latest_block(spark, sf_dir):
    return summaries.latest_block(_zones(spark, sf_dir))


# ---------------------------------------------------------------- ordinals


@query("tx_ordinals", f"WITH {TX} SELECT block_number, o_orderkey AS tx_id, tx_hash, transaction_index FROM t")
def tx_ordinals(spark, sf_dir):
    txs = fx.transactions(spark, sf_dir).select("block_number", "tx_id", "tx_hash")
    return chain.tx_ordinals(txs)


@query(
    "log_ordinals",
    f"""WITH {LOGS} SELECT event, tx_hash, log_index, log_position FROM d""",
)
def log_ordinals(spark, sf_dir):
    """Transactions spread over rows of at most three logs, so ordinals run on across rows."""
    split = fx.receipts(spark, sf_dir, logs_per_row=3)
    starts = split.select("tx_hash", "block_log_start").distinct()
    staged = stage_events(split, _headers(spark, sf_dir), EVERY_EVENT)
    rows = staged.join(starts, "tx_hash")
    return rows.select(
        F.when(F.col("event_key") == 0, "transfer").otherwise("approval").alias("event"),
        "tx_hash",
        "log_index",
        (F.col("block_log_index") - F.col("block_log_start")).alias("log_position"),
    )
