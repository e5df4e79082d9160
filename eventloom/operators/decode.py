"""From receipts to one typed row per decoded log.

Logs are filtered while they are still nested in their transaction, so the
position of a log among the hits of its event costs no shuffle, and only rows
with a hit travel to the header join. Blocks closed by their bloom leave before.
"""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from eventloom.config import BLOCK_LOG_INDEX, INTEGER_TYPES, TX_LOG_INDEX, AbiItem
from eventloom.functions.words import data_word, is_wide, topic_word, wide_steps, wide_text, word_value
from eventloom.operators.gate import MAPPED, Event, address_table, admitted, is_long, stored_gates
from eventloom.operators.match import event_matches, log_matches
from eventloom.operators.running import running_totals
from eventloom.session import COMPRESSION, scratch_path, shuffles_dropped, unsorted_writes

#: Addresses of all long lists together that may be broadcast, and log positions numbered by one task.
FEW_ADDRESSES = 500_000
LOG_STRETCH = 4096
#: Events whose files a task keeps open while it stages logs.
OPEN_EVENTS = 4

STAGED_COLUMNS = [
    "event_key",
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


def with_hits(
    receipts: DataFrame, events: Sequence[Event], carried: Sequence[str] = (), admits: str = "true"
) -> DataFrame:
    """Receipts with at least one wanted log, and the wanted logs of every event in ``hits``.

    ``carried`` columns stay; ``admits`` is a test of the receipt's block that comes before any
    test of a log, with ``{key}`` for the event.
    """
    first = "first_log" if "first_log" in receipts.columns else "0L"
    kept = ["block_number", "transaction_index", "tx_hash", *carried]
    kept += [c for c in ("block_log_start", "first_log", "whole") if c in receipts.columns]

    wanted = " OR ".join(f"({admits.format(key=k)} AND {log_matches('log', m, item)})" for k, m, item in events)
    numbered = f"""transform(logs, (log, i) -> named_struct(
        'address', log.address, 'topics', log.topics, 'data', log.data, 'position', {first} + i))"""
    hits = [
        f"""transform(filter(numbered, log -> {log_matches("log", m, item)}),
            (log, i) -> named_struct('event_key', {key}, 'log_index', CAST(i AS BIGINT), 'log', log))"""
        for key, m, item in events
    ]
    return (
        receipts.where(f"exists(logs, log -> {wanted})")
        .select(*kept, F.expr(numbered).alias("numbered"))
        .select(*kept, F.expr(f"concat({', '.join(hits)})").alias("hits"))
    )


#: Rows of spread transactions whose starts may be broadcast.
FEW_SPLIT_ROWS = 200_000


def with_starts(rows: DataFrame, receipts: DataFrame, events: Sequence[Event]) -> DataFrame:
    """Adds ``starts``: per event, the hits in earlier rows of a transaction that fills several.

    Only rows of such transactions are counted, in a scan that skips the others, and only counts
    go through the window.
    """
    split = receipts.where(~F.col("whole"))
    earlier = Window.partitionBy("tx_hash").orderBy("first_log").rowsBetween(Window.unboundedPreceding, -1)

    def hits_of(key: int) -> Column:
        return F.size(F.filter("hits", lambda hit: hit["event_key"] == key)).cast("bigint")

    counts = with_hits(split, events).select(
        "tx_hash", "first_log", *[hits_of(key).alias(f"n{key}") for key, _, _ in events]
    )
    starts = counts.select(
        "tx_hash",
        "first_log",
        F.map_from_arrays(
            F.array(*[F.lit(key) for key, _, _ in events]),
            F.array(*[F.coalesce(F.sum(f"n{key}").over(earlier), F.lit(0)) for key, _, _ in events]),
        ).alias("starts"),
    )
    if split.count() <= FEW_SPLIT_ROWS:
        starts = F.broadcast(starts)
    return rows.join(starts, ["tx_hash", "first_log"], "left")


def stage_events(receipts: DataFrame, headers: DataFrame, events: Sequence[Event]) -> DataFrame:
    """The matched logs of all events, raw, tagged with their event, with hash and time of their block.

    Headers with a ``logs_bloom`` decide first which blocks may hold which events (see ``gate``), or come
    gated already; headers without admit every block. A mapping of many addresses is matched
    by joins with its address list, the others inside the receipts without a shuffle.
    """
    if "logs_bloom" in headers.columns:
        headers = stored_gates(headers, events)
    spelt = [e for e in events if not is_long(e[1])]
    listed = [e for e in events if is_long(e[1])]
    parts = []
    if spelt:
        parts.append(_staged_spelt(receipts, headers, spelt))
    if listed:
        parts.append(_staged_listed(receipts, headers, listed))
    return reduce(DataFrame.unionByName, parts)


BLOCK_COLUMNS = ["block_hash", "timestamp"]


def _open_receipts(receipts: DataFrame, headers: DataFrame, events: Sequence[Event]) -> tuple[DataFrame, list[str], str]:
    """Receipts of admitted blocks, the block columns they carry already, and the test of an event's gate."""
    if "gates" not in headers.columns:
        return receipts, [], "true"
    rows, joined = admitted(receipts, headers, events)
    return (rows, [*BLOCK_COLUMNS, "gates"], "array_contains(gates, {key})") if joined else (rows, [], MAPPED)


def _with_block(rows: DataFrame, headers: DataFrame, carried: Sequence[str]) -> DataFrame:
    """Rows with a hit with hash, time and gates of their block."""
    return rows if carried else rows.join(headers.drop("logs_bloom"), "block_number")


def _staged_spelt(receipts: DataFrame, headers: DataFrame, events: Sequence[Event]) -> DataFrame:
    open_receipts, carried, admits = _open_receipts(receipts, headers, events)
    rows = with_hits(open_receipts, events, carried, admits)
    spread = "first_log" in receipts.columns
    if spread:
        rows = with_starts(rows, receipts, events)
    joined = _with_block(rows, headers, carried)
    # Every row has a hit, so the outer form drops nothing; unlike the inner one it
    # does not make the optimizer evaluate the hits twice to test for emptiness.
    hits = joined.withColumn("hit", F.explode_outer("hits"))
    key, index = F.col("hit.event_key"), F.col("hit.log_index")
    if spread:
        index = index + F.coalesce(F.col("starts")[key], F.lit(0))
    if "gates" in joined.columns:
        hits = hits.where(F.array_contains("gates", key))
    return _staged_columns(hits, key, index, F.col("hit.log"), "block_log_start" in receipts.columns)


def _staged_listed(receipts: DataFrame, headers: DataFrame, events: Sequence[Event]) -> DataFrame:
    """The same for mappings of many addresses: logs of the events join a table of the addresses.

    Only matching logs are shuffled, to be numbered inside their transaction.
    """
    spark = receipts.sparkSession
    open_receipts, carried, admits = _open_receipts(receipts, headers, events)
    mappings = list(dict.fromkeys(m for _, m, _ in events))
    number = {m: n for n, m in enumerate(mappings)}
    kept = ["block_number", "transaction_index", "tx_hash", *carried]
    kept += [c for c in ("block_log_start", "first_log") if c in receipts.columns]
    first = F.col("first_log") if "first_log" in receipts.columns else F.lit(0)
    wanted = " OR ".join(
        dict.fromkeys(f"({admits.format(key=k)} AND {event_matches(item, 'log.topics', 'log.data')})" for k, _, item in events)
    )
    logs = open_receipts.where(f"exists(logs, log -> {wanted})").select(*kept, F.posexplode("logs").alias("pos", "col"))
    log = F.struct("col.address", "col.topics", "col.data", (first + F.col("pos")).alias("position"))
    fits = [
        F.when((F.col("mapping") == number[m]) & F.expr(event_matches(item, "col.topics", "col.data")), F.lit(key))
        for key, m, item in events
    ]
    listed = address_table(spark, [(m.addresses, number[m]) for m in mappings])
    if sum(len(m.addresses) for m in mappings) <= FEW_ADDRESSES:
        listed = F.broadcast(listed)
    hits = (
        logs.where(F.expr(" OR ".join(dict.fromkeys(event_matches(item, "col.topics", "col.data") for _, _, item in events))))
        .join(listed, F.lower("col.address") == F.col("address"))
        .select(*[c for c in kept if c != "first_log"], log.alias("log"), F.explode(F.array_compact(F.array(*fits))).alias("event_key"))
    )
    numbered = running_totals(
        hits.withColumn("position", F.col("log.position")),
        group=["tx_hash", "event_key"],
        order=["position"],
        bucket=F.floor(F.col("log.position") / LOG_STRETCH),
        values={"log_index": F.lit(1)},
    )
    joined = _with_block(numbered, headers, carried)
    if "gates" in joined.columns:
        joined = joined.where(F.array_contains("gates", F.col("event_key")))
    return _staged_columns(joined, F.col("event_key"), F.col("log_index"), F.col("log"), "block_log_start" in receipts.columns)


def _staged_columns(hits: DataFrame, key: Column, index: Column, log: Column, placed: bool) -> DataFrame:
    columns = {
        "event_key": key,
        "contract_address": F.lower(log["address"]),
        "log_index": index,
        **{f"topic{i}": F.get(log["topics"], F.lit(i)) for i in range(4)},
        "data": F.coalesce(log["data"], F.lit("0x")),
    }
    selected = [columns.get(c, F.col(c)).alias(c) for c in STAGED_COLUMNS]
    selected.append(log["position"].cast("bigint").alias(TX_LOG_INDEX))
    if placed:
        selected.append((F.col("block_log_start") + log["position"]).alias(BLOCK_LOG_INDEX))
    return hits.select(*selected)


def staged_once(receipts: DataFrame, headers: DataFrame, events: Sequence[Event], name: str) -> DataFrame:
    """The matched logs of all events, written to the scratch folder by one scan and read back by event."""
    path = scratch_path(receipts.sparkSession, name)
    staged = stage_events(receipts, headers, events)
    # A task keeps a few events open, so that its logs need no sort by event.
    spark = receipts.sparkSession
    with unsorted_writes(spark, min(len(events), OPEN_EVENTS)), shuffles_dropped(spark):
        staged.write.option("compression", COMPRESSION).partitionBy("event_key").parquet(path)
    return receipts.sparkSession.read.schema(staged.schema).parquet(path)


def row_id(group: Sequence[Event]) -> Column:
    """An id that a repeated or retried run gives again."""
    scopes = [F.when(F.col("event_key") == key, ",".join(m.addresses)) for key, m, _ in group]
    return F.sha2(
        F.concat_ws(
            "|",
            F.lit(group[0][2].signature),
            F.coalesce(*scopes),
            F.col("tx_hash"),
            F.col("log_index").cast("string"),
        ),
        256,
    )


def _words(item: AbiItem) -> dict[str, str]:
    """The word of every input: topics for indexed ones, data words for the others."""
    words = {i.name: topic_word(f"topic{n + 1}") for n, i in enumerate(item.indexed)}
    words.update({i.name: data_word("data", n) for n, i in enumerate(item.plain)})
    return words


def by_item(events: Sequence[Event]) -> list[list[Event]]:
    """Events of different mappings that decode alike, together."""
    groups: dict[AbiItem, list[Event]] = {}
    for event in events:
        groups.setdefault(event[2], []).append(event)
    return list(groups.values())


def event_rows(staged: DataFrame, group: Sequence[Event]) -> DataFrame:
    """The typed table rows of one event, for every mapping that lists it."""
    item = group[0][2]
    item.schema()
    # Words are columns of their own first: decoding looks at a word several times.
    words = {f"_{name}": F.expr(word) for name, word in _words(item).items()}
    last = [c for c in (TX_LOG_INDEX, BLOCK_LOG_INDEX) if c in staged.columns]
    mine = staged.where(F.col("event_key").isin(*[key for key, _, _ in group])).withColumns(words)
    wide = {i.name: INTEGER_TYPES[i.type] for i in item.columns if is_wide(i.type)}
    for step in wide_steps(wide) if wide else []:
        mine = mine.withColumns({name: F.expr(text) for name, text in step.items()})
    values = {name: wide_text(name, *kind) for name, kind in wide.items()}
    return mine.select(
        row_id(group).alias("indexed_id"),
        "contract_address",
        "log_index",
        "transaction_index",
        "topic0",
        "topic1",
        "topic2",
        "topic3",
        "data",
        *[F.expr(values.get(i.name) or word_value(i.type, f"`_{i.name}`")).alias(i.name) for i in item.columns],
        "tx_hash",
        "block_number",
        "block_hash",
        "timestamp",
        *last,
    )


def union_by_table(frames: Iterable[tuple[str, DataFrame]]) -> dict[str, DataFrame]:
    """One frame per table; what several events feed into it is all kept, repeats included."""
    tables: dict[str, DataFrame] = {}
    for table, rows in frames:
        known = tables.get(table)
        tables[table] = rows if known is None else known.unionByName(rows, allowMissingColumns=True)
    return tables


def event_tables(staged: DataFrame, events: Sequence[Event]) -> dict[str, DataFrame]:
    """The event tables over logs that were staged once for all events."""
    return union_by_table((g[0][2].table, event_rows(staged, g)) for g in by_item(events))


def decode(
    receipts: DataFrame, headers: DataFrame, events: Sequence[Event]
) -> dict[str, DataFrame]:
    """The event tables, as plans over the chain tables; only blooms are looked at right away.

    A caller that reads several of the tables stages their logs first (``staged_once``), or scans the
    chain once for each.
    """
    if "logs_bloom" in headers.columns:
        headers = stored_gates(headers, events)
    return union_by_table(
        (group[0][2].table, event_rows(stage_events(receipts, headers, group), group)) for group in by_item(events)
    )
