"""Exact tie-aware ranks, per key or pooled, at any group size."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from .blocks import join_stats, running


def cumulative_counts(
    df: DataFrame, keys: Sequence[str], value: str, weight: Column | None = None
) -> DataFrame:
    """Distinct values per key with `__n` copies and `__upto` rows at or below the value.

    Copies are combined on the map side, so neither a hot key nor a hot value meets one task.
    """
    copies = F.sum(weight) if weight is not None else F.count(F.lit(1))
    distinct = (
        df.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(copies.alias("__n"))
    )
    return running(distinct, keys, [value], sums={"__upto": F.col("__n")}, split=True)


def attach_ranks(
    df: DataFrame,
    keys: Sequence[str],
    value: str,
    out: str,
    count: str | None = None,
    split: bool = False,
    groups: int | None = None,
    source: DataFrame | None = None,
) -> DataFrame:
    """Append the average rank of `value` inside `keys` (null for null) and optionally its count.

    `groups` is the number of distinct keys, when known.  The split form counts in `source`, the same
    rows where they cost less to read.
    """
    source = df if source is None else source
    x = F.col(value)
    if not split:
        w = Window.partitionBy(*keys).orderBy(x.asc_nulls_last())
        peers = w.rangeBetween(Window.currentRow, Window.currentRow)
        rank = F.rank().over(w) + (F.count(x).over(peers) - 1) / 2
        columns = {out: F.when(x.isNotNull(), rank)}
        if count:
            columns[count] = F.count(x).over(Window.partitionBy(*keys))
        return df.withColumns(columns)
    if not keys:
        pooled = df.withColumn("__pool", F.lit(0))
        return attach_ranks(pooled, ["__pool"], value, out, count, True, 1).drop("__pool")
    counts = cumulative_counts(source, keys, value)
    table = counts.select(
        *keys, value, (F.col("__upto") - (F.col("__n") - 1) / 2).alias(out)
    )
    ranked = join_stats(df, table, [*keys, value])
    if count:
        totals = source.groupBy(*keys).agg(F.count(value).alias(count))
        ranked = join_stats(ranked, totals, keys, groups)
    return ranked
