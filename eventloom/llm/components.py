"""Connected components of a table of links, by alternating stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from eventloom.llm.common import discard, written


def connected_components(links: DataFrame) -> DataFrame:
    """node and label of every node that has a link, as a scratch table: the smallest node it reaches.

    ``links`` has integer columns a and b; loops, repeats and either direction are fine. No
    link gives no row. Each round hangs every node's larger neighbours, then its smaller
    ones, on the smallest neighbour; links end up as stars around the smallest nodes. The
    minimum of a node is combined before the shuffle and joined back, so that the node of a
    giant star is a skewed join, which Spark splits, and never one group in one task.
    """
    now = written(
        links.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(),
        "links",
    )
    mark = _mark(now)
    while True:
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("low"))
        large = (
            both.where("v > u").join(low, "u")
            .select(F.col("v").alias("u"), F.col("low").alias("v")).where("u <> v").distinct()
        )
        least = large.groupBy("u").agg(F.min("v").alias("low"))
        small = large.join(least, "u").select(F.col("v").alias("u"), F.col("low").alias("v")).where("u <> v")
        last, now = now, written(small.unionByName(least.select("u", F.col("low").alias("v"))).distinct(), "links")
        discard(last)
        before, mark = mark, _mark(now)
        if mark == before:
            break
    centres = now.select(F.col("v").alias("node"), F.col("v").alias("label")).distinct()
    labels = written(now.select(F.col("u").alias("node"), F.col("v").alias("label")).unionByName(centres), "labels")
    discard(now)
    return labels


def _mark(links: DataFrame) -> tuple:
    """Changes whenever the links do: two numbers, whatever their count."""
    total = F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))
    return tuple(links.agg(F.count("*"), total).first())
