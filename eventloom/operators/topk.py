"""First k rows per group."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SALTS = 64


def first_per_group(
    df: DataFrame, group: Sequence[str], order: Sequence[Column | str], k: int
) -> DataFrame:
    """The first ``k`` rows of every group in order.

    A group is ranked in salted shares first, so a hot group is spread over many
    tasks and only ``SALTS * k`` of its rows meet in the final ranking. All rows of
    an input partition share a salt, so Spark cuts each partition to ``k`` rows per
    group before it shuffles anything.
    """
    salted = df.withColumn("_salt", F.spark_partition_id() % SALTS)
    share = Window.partitionBy(*group, "_salt").orderBy(*order)
    total = Window.partitionBy(*group).orderBy(*order)
    return (
        salted.withColumn("_rank", F.row_number().over(share))
        .where(F.col("_rank") <= k)
        .withColumn("_rank", F.row_number().over(total))
        .where(F.col("_rank") <= k)
        .drop("_rank", "_salt")
    )
