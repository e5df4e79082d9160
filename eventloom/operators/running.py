"""Running totals that no hot group can overload."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F


def running_totals(
    df: DataFrame,
    group: Sequence[str],
    order: Sequence[str],
    bucket: Column,
    values: Mapping[str, Column],
) -> DataFrame:
    """Adds, per name, the sum of its value over the earlier rows of the group, in order.

    ``bucket`` cuts a group into stretches that follow the order. Rows are summed
    inside a stretch, stretches are summed inside the group, so a task holds one
    stretch of rows or one row per stretch, never a whole group of rows.
    """
    before = (Window.unboundedPreceding, -1)
    inside = Window.partitionBy(*group, "_stretch").orderBy(*order).rowsBetween(*before)
    across = Window.partitionBy(*group).orderBy("_stretch").rowsBetween(*before)

    def earlier(column: str, window: WindowSpec) -> Column:
        return F.coalesce(F.sum(column).over(window), F.lit(0))

    keyed = df.withColumns(
        {"_stretch": bucket, **{f"_{n}": v.cast("bigint") for n, v in values.items()}}
    )
    starts = (
        keyed.groupBy(*group, "_stretch")
        .agg(*[F.sum(f"_{n}").alias(f"_{n}") for n in values])
        .select(*group, "_stretch", *[earlier(f"_{n}", across).alias(f"_start_{n}") for n in values])
    )
    return (
        keyed.withColumns({f"_inside_{n}": earlier(f"_{n}", inside) for n in values})
        .join(starts, [*group, "_stretch"])
        .select(*df.columns, *[(F.col(f"_start_{n}") + F.col(f"_inside_{n}")).alias(n) for n in values])
    )
