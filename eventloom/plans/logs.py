"""Answers over decoded logs: one filter, many filters, one event table."""

from __future__ import annotations

from collections.abc import Callable, Mapping
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from eventloom.config import BLOCK_BUCKET, BLOCK_LOG_INDEX, LEADING_COLUMNS, TRAILING_COLUMNS, TX_LOG_INDEX
from eventloom.functions.text import MAX_TEXT, hex_quantity
from eventloom.operators.filters import BROADCAST_ROWS, TOPIC_COLUMNS, LogFilter, match_filter_parts, match_filter_table
from eventloom.operators.topk import first_per_group

# How many hits a request for logs asks for, and how many logs a page of a
# block or of a receipt spans.
MAX_LOGS = 1000
MAX_BLOCK_LOGS = 10000
MAX_RECEIPT_LOGS = 1000

LOG_COLUMNS = [*LEADING_COLUMNS, *TRAILING_COLUMNS]
HIT_ORDER = ["block_number", "log_index", "transaction_index", "event", "indexed_id"]


def union_logs(tables: Mapping[str, DataFrame]) -> DataFrame:
    """All event tables as one log table, without their decoded inputs."""
    frames = []
    for table, df in tables.items():
        extra = [c for c in (TX_LOG_INDEX, BLOCK_LOG_INDEX, BLOCK_BUCKET) if c in df.columns]
        frames.append(df.select(F.lit(table).alias("event"), *LOG_COLUMNS, *extra))
    return reduce(DataFrame.unionByName, frames)


def matching_logs(logs: DataFrame, log_filter: LogFilter) -> DataFrame:
    return logs.where(log_filter.predicate(logs))


def get_logs(logs: DataFrame, log_filter: LogFilter, max_hits: int | None = None) -> DataFrame:
    """The hits of a filter in (block, log index) order: all, or the first ``max_hits``."""
    hits = matching_logs(logs, log_filter)
    ordered = hits.orderBy(*[c for c in HIT_ORDER if c in hits.columns])
    return ordered if max_hits is None else ordered.limit(max_hits)


def get_event_logs(
    tables: Mapping[str, DataFrame], table: str, log_filter: LogFilter, max_hits: int | None = None
) -> DataFrame:
    """The same over one event table; the other tables are not read."""
    return get_logs(tables[table.lower()], log_filter, max_hits)


def get_logs_by_table(
    logs: DataFrame, filters: DataFrame, max_hits: int | None = None, broadcast_rows: int = BROADCAST_ROWS
) -> DataFrame:
    """The hits of every filter of a filter table: all, or the first ``max_hits`` of each."""
    if max_hits is None:
        return match_filter_table(logs, filters, broadcast_rows=broadcast_rows)
    order = [c for c in HIT_ORDER if c in logs.columns]
    few, many = match_filter_parts(logs, filters, max_hits, broadcast_rows)
    # A filter that cannot have more hits than asked for needs no ranking.
    return few.unionByName(first_per_group(many, ["filter_id"], order, max_hits))


def _digits(text: Column) -> Column:
    return F.when(F.substring(text, 1, 2) == "0x", F.substring(text, 3, MAX_TEXT)).otherwise(text)


def _is_hex(text: Column, size: int | None = None) -> Column:
    """Whether a text is hex of so many bytes, with or without 0x; false for null."""
    digits = _digits(text)
    length = F.length(digits)
    fits = length % 2 == 0 if size is None else length == 2 * size
    return F.coalesce(fits & F.unhex(digits).isNotNull(), F.lit(False))


def _hex(text: Column) -> Column:
    return F.concat(F.lit("0x"), F.lower(_digits(text)))


def valid_logs(hits: DataFrame, keep: bool = False) -> DataFrame:
    """Hits with every required field well formed; a malformed topic goes alone.

    Takes the fields as they come from documents and adds ``topics``. ``keep`` keeps the
    malformed hits as well, told apart by ``is_valid``.
    """
    required = (
        _is_hex(F.col("contract_address"), 20)
        & _is_hex(F.col("tx_hash"), 32)
        & _is_hex(F.col("block_hash"), 32)
        & _is_hex(F.col("data"))
        & (F.col("block_number") >= 0)
        & (F.col("transaction_index") >= 0)
        & (F.col("log_index") >= 0)
    )
    topics = F.array_compact(
        F.array(*[F.when(_is_hex(F.col(t), 32), _hex(F.col(t))) for t in TOPIC_COLUMNS])
    )
    others = [c for c in hits.columns if c not in TOPIC_COLUMNS]
    fixed = {c: _hex(F.col(c)).alias(c) for c in ("contract_address", "tx_hash", "block_hash", "data")}
    chosen = [*[fixed.get(c, F.col(c)) for c in others], topics.alias("topics")]
    if keep:
        return hits.select(*chosen, F.coalesce(required, F.lit(False)).alias("is_valid"))
    return hits.where(required).select(*chosen)


def answer_log(fields: Callable[[str], Column] = F.col) -> Column:
    """A valid log, whose ``fields`` are columns unless told otherwise, in the shape of a log answer."""
    return F.struct(
        fields("contract_address").alias("address"),
        fields("topics").alias("topics"),
        fields("data").alias("data"),
        fields("block_hash").alias("blockHash"),
        hex_quantity(fields("block_number")).alias("blockNumber"),
        fields("tx_hash").alias("transactionHash"),
        hex_quantity(fields("transaction_index")).alias("transactionIndex"),
        hex_quantity(fields("log_index")).alias("logIndex"),
        F.lit(False).alias("removed"),
    )


def answer_logs(hits: DataFrame) -> DataFrame:
    """Hits as log answers, malformed ones left out."""
    return valid_logs(hits).select(answer_log().alias("log")).select("log.*")
