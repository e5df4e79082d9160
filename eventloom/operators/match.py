"""Predicates that decide which logs an event table takes.

They are Spark SQL texts over named operands, so that one definition filters log
rows and the logs nested in a receipt alike.
"""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from eventloom.config import AbiItem, ConfigError, ContractMapping, JobConfig
from eventloom.functions.words import data_word, topic_word, word_text


def _literal(text: str) -> str:
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def address_in(address: str, addresses: Sequence[str]) -> str:
    """Contract filter; no addresses means every contract."""
    if not addresses:
        return "true"
    return f"lower({address}) IN ({', '.join(_literal(a.lower()) for a in addresses)})"


def topic_arity(topics: str, item: AbiItem) -> str:
    return f"size({topics}) = {1 + len(item.indexed)}"


def data_arity(data: str, item: AbiItem) -> str:
    """As many whole 32-byte words as plain inputs; a shorter tail is ignored."""
    return f"{data_words(data)} = {len(item.plain)}"


def data_words(data: str) -> str:
    """Whole 32-byte words of hex data; none in null or empty data."""
    return f"floor(greatest(length(coalesce({data}, '0x')) - 2, 0) / 64)"


# POSIX classes, by the characters they hold.
POSIX = {
    "alnum": "0-9A-Za-z", "alpha": "A-Za-z", "ascii": r"\x00-\x7F", "blank": r"\t ", "cntrl": r"\x00-\x1F\x7F",
    "digit": "0-9", "graph": "!-~", "lower": "a-z", "print": " -~", "punct": r"!-/:-@\[-`{-~", "space": r"\t\n\x0B\f\r ",
    "upper": "A-Z", "word": "0-9A-Za-z_", "xdigit": "0-9A-Fa-f",
}
POSIX_CLASS = re.compile(r"\[:(\^?)(\w+):\]")
NAMED_GROUP = re.compile(r"((?:^|[^\\])(?:\\\\)*)\(\?P<")


def java_pattern(pattern: str) -> str:
    """The same match in Java syntax: any case, Unicode classes, ``$`` only at the very end.

    POSIX classes become ranges inside their brackets, named groups lose their ``P``. Class
    operators that Java lacks are refused.
    """
    if re.search(r"\[[^\]]*(--|~~)", pattern):
        raise ValueError(f"class operator without a counterpart: {pattern!r}")
    pattern = POSIX_CLASS.sub(_posix, NAMED_GROUP.sub(r"\1(?<", pattern))
    escapes = len(pattern) - 1 - len(pattern[:-1].rstrip("\\"))
    if pattern.endswith("$") and escapes % 2 == 0:
        pattern = pattern[:-1] + r"\z"
    return "(?iU)" + pattern


def _posix(found: re.Match) -> str:
    if found[2] not in POSIX:
        raise ValueError(f"unknown character class: {found[0]}")
    return f"[^{POSIX[found[2]]}]" if found[1] else POSIX[found[2]]


def patterns_match(topics: str, data: str, item: AbiItem) -> list[str]:
    words = [(i, topic_word(f"get({topics}, {n + 1})")) for n, i in enumerate(item.indexed)]
    words += [(i, data_word(data, n)) for n, i in enumerate(item.plain)]
    return [
        f"{word_text(i.type, word)} RLIKE {_literal(java_pattern(i.pattern))}"
        for i, word in words
        if i.pattern is not None
    ]


def event_matches(item: AbiItem, topics: str = "topics", data: str = "data") -> str:
    """Signature, topic count, data length and value patterns of one event."""
    tests = [
        f"get({topics}, 0) = '{item.topic0}'",
        topic_arity(topics, item),
        data_arity(data, item),
        *patterns_match(topics, data, item),
    ]
    return " AND ".join(f"({t})" for t in tests)


def log_matches(log: str, mapping: ContractMapping, item: AbiItem) -> str:
    """Whether a nested log, named by a lambda variable, belongs to an event of a mapping."""
    event = event_matches(item, f"{log}.topics", f"{log}.data")
    return f"({address_in(f'{log}.address', mapping.addresses)} AND {event})"


def route_events(logs: DataFrame, items: Sequence[AbiItem]) -> DataFrame:
    """Flat logs with the event they belong to, by a hash join on the first topic.

    The event side is the job's own list of events, so it is small by construction.
    """
    events = logs.sparkSession.createDataFrame(
        [(i.topic0, i.table, len(i.indexed), len(i.plain)) for i in items],
        "topic0 string, event string, n_indexed int, n_plain int",
    )
    fits = (F.size("topics") == 1 + F.col("n_indexed")) & (
        F.expr(data_words("data")) == F.col("n_plain")
    )
    return (
        logs.withColumn("topic0", F.get("topics", F.lit(0)))
        .join(events, "topic0")
        .where(fits)
        .drop("n_indexed", "n_plain")
    )


def check_patterns(spark: SparkSession, config: JobConfig) -> None:
    """Rejects a job whose patterns Spark cannot compile."""
    for _, _, item in config.events():
        for i in item.inputs:
            if i.pattern is None:
                continue
            try:
                spark.sql("SELECT '' RLIKE :p", args={"p": java_pattern(i.pattern)}).collect()
            except Exception as e:
                raise ConfigError(f"{item.signature}: bad pattern for {i.name!r}: {i.pattern!r}") from e
