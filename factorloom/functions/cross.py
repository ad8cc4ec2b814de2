"""Cross-sectional operators over one observation time.

Two equivalent forms.  The window form shuffles rows once by time and is used while the largest
cross-section fits a task.  The joined form never brings a cross-section together: it aggregates
partial statistics per time (or per distinct value) and joins the small result back.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..operators.blocks import join_stats
from ..operators.radix import quantiles
from ..operators.ranks import attach_ranks
from .guards import EPS, finite


def _window(time: str):
    return Window.partitionBy(time)


def _moments(x: Column) -> dict[str, Column]:
    return {
        "mean": F.avg(x),
        "std": F.stddev_samp(x),
        "gross": F.sum(F.abs(x)),
    }


def _from_moments(op: str, x: Column, mean: Column, std: Column, gross: Column) -> Column:
    if op == "cs_demean":
        return finite(x - mean)
    if op == "cs_zscore":
        return finite(F.when(std > EPS, (x - mean) / std))
    return finite(F.when(gross > EPS, x / gross))


def rank_column(x: Column, time: str) -> Column:
    """Average rank divided by the number of ranked values; nulls sort last and stay null."""
    by_value = Window.partitionBy(time).orderBy(x.asc_nulls_last())
    peers = by_value.rangeBetween(Window.currentRow, Window.currentRow)
    rank = F.rank().over(by_value) + (F.count(x).over(peers) - 1) / 2
    return F.when(x.isNotNull(), rank / F.count(x).over(_window(time)))


def windowed(op: str, x: Column, params: tuple, time: str) -> Column:
    w = _window(time)
    if op == "cs_rank":
        return rank_column(x, time)
    mean, std, gross = (c.over(w) for c in _moments(x).values())
    return _from_moments(op, x, mean, std, gross)


def joined(
    df: DataFrame,
    op: str,
    x: str,
    params: tuple,
    time: str,
    out: str,
    times: int | None = None,
    source: DataFrame | None = None,
) -> DataFrame:
    """The same values without a per-time window.

    `x` is an already masked column; `times` is the number of observation times, which bounds the
    per-time statistics.  `source` holds the same rows, with `x` and the times, where statistics may be
    read at a lower cost.
    """
    source = df if source is None else source
    if op == "cs_rank":
        ranked = attach_ranks(df, [time], x, "__rank", count="__n", split=True, groups=times, source=source)
        return ranked.withColumn(out, F.col("__rank") / F.col("__n")).drop("__rank", "__n")
    if op == "cs_winsorize":
        ends = quantiles(source, [time], [x], params)
        wide = ends.select(time, F.col(f"{x}_q").alias("__ends"))
        value = F.least(F.greatest(F.col(x), F.col("__ends")[0]), F.col("__ends")[1])
        return (
            join_stats(df, wide, [time], times)
            .withColumn(out, F.when(F.col(x).isNotNull(), value))
            .drop("__ends")
        )
    stats = source.groupBy(time).agg(*[c.alias(f"__{k}") for k, c in _moments(F.col(x)).items()])
    value = _from_moments(op, F.col(x), F.col("__mean"), F.col("__std"), F.col("__gross"))
    return join_stats(df, stats, [time], times).withColumn(out, value).drop("__mean", "__std", "__gross")
