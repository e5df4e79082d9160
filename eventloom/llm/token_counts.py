"""Token counts of a corpus for every context limit, from one exact length histogram.

Documents are encoded once and aggregated by encoded length, which Spark combines before
the shuffle. Everything else comes from suffix sums over the histogram.
"""

from __future__ import annotations

import base64
import functools
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

STRETCH = 4096


@functools.lru_cache(maxsize=1)
def rank_encoding(path: str, pattern: str):
    """A byte-level encoder from a file of ranks, once per worker process."""
    import tiktoken

    with open(path, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    return tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def with_lengths(
    docs: DataFrame, ranks: str, pattern: str, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """doc_id and n_tokens of every whole text. Null and empty texts have no token."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = rank_encoding(ranks, pattern).encode_ordinary
        for batch in batches:
            found = [len(encode(t.as_py() or "")) for t in batch.column("text")]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(found, pa.int64())], ["doc_id", "n_tokens"]
            )

    wanted = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).alias("text"))
    return wanted.mapInArrow(count, "doc_id bigint, n_tokens bigint")


def length_histogram(lengths: DataFrame) -> DataFrame:
    """length and n_docs: the documents of each encoded length."""
    return lengths.groupBy(F.col("n_tokens").alias("length")).agg(F.count("*").alias("n_docs"))


def context_table(histogram: DataFrame) -> DataFrame:
    """A row for each length L that occurs, read as a context limit.

    ``docs_at_least`` and ``tokens_at_least`` are the suffix sums: documents of length L or
    more, and their tokens. ``truncated_tokens`` are the tokens that remain if every
    document is cut at L; ``docs_cut`` those that lose some. ``quantile`` is the share of
    documents of length L or less: the p-quantile is the smallest L with quantile >= p.
    Between two lengths the next larger row's suffix sums hold, so any other limit M is
    answered by that row: total - tokens_at_least + M * docs_at_least. An empty corpus has
    no rows.

    Lengths are summed inside stretches of 4,096 and stretches are summed in turn, so no
    window holds more than one row per stretch or one stretch.
    """
    stretched = histogram.withColumns(
        {"tokens": F.col("length") * F.col("n_docs"), "stretch": F.floor(F.col("length") / STRETCH)}
    )
    later = Window.orderBy(F.desc("stretch")).rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.orderBy("stretch").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)

    def sums(window) -> list:
        return [F.coalesce(F.sum(c).over(window), F.lit(0)) for c in ("n_docs", "tokens")]

    docs_later, tokens_later = sums(later)
    all_docs, all_tokens = sums(everything)
    stretches = (
        stretched.groupBy("stretch")
        .agg(F.sum("n_docs").alias("n_docs"), F.sum("tokens").alias("tokens"))
        .select(
            "stretch", docs_later.alias("docs_later"), tokens_later.alias("tokens_later"),
            all_docs.alias("total_docs"), all_tokens.alias("total_tokens"),
        )
    )
    suffix = (
        Window.partitionBy("stretch").orderBy(F.desc("length"))
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    docs_here, tokens_here = sums(suffix)
    at_least = stretched.withColumns({"docs_here": docs_here, "tokens_here": tokens_here}).join(stretches, "stretch")
    docs, tokens = F.col("docs_here") + F.col("docs_later"), F.col("tokens_here") + F.col("tokens_later")
    longer = docs - F.col("n_docs")
    return at_least.select(
        "length", "n_docs", docs.alias("docs_at_least"), tokens.alias("tokens_at_least"),
        longer.alias("docs_cut"),
        (F.col("total_tokens") - tokens + F.col("length") * docs).alias("truncated_tokens"),
        "total_docs", "total_tokens",
        ((F.col("total_docs") - longer) / F.col("total_docs")).alias("quantile"),
    )
