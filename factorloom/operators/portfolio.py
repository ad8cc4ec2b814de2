"""Returns of portfolios formed from the holdings of the previous observation time."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.guards import flag
from .blocks import broadcast_limit, join_stats, oversized, running


def clock(df: DataFrame, time: str, out: str, bound: int | None = None) -> DataFrame:
    """Distinct times with a dense index, numbered without a global window when there are many."""
    times = df.select(time).where(F.col(time).isNotNull()).distinct()
    if oversized(times, [], bound):
        return running(times, [], [time], sums={out: F.lit(1).cast("long")}, split=True)
    return times.withColumn(out, F.row_number().over(Window.orderBy(time)).cast("long"))


def following(df: DataFrame, time: str, out: str, bound: int | None = None) -> DataFrame:
    """Distinct times paired with the next observed time; the last one is left out."""
    steps = clock(df, time, "__step", bound)
    after = steps.select((F.col("__step") - 1).alias("__step"), F.col(time).alias(out))
    return steps.join(after, "__step").select(time, out)


def _covered(count: Column, observed: Column, mean: Column, coverage: float) -> Column:
    """Mean of the observed members when enough of the held ones are observed."""
    return F.when((count > 0) & (observed >= F.ceil(count * F.lit(float(coverage)))), mean)


def lagged_portfolio(
    df: DataFrame,
    op: str,
    columns: Sequence[str],
    params: tuple,
    identity: Sequence[str],
    time: str,
    eligible: str | None,
    out: str,
    split: bool = False,
    bound: int | None = None,
    times: int | None = None,
) -> DataFrame:
    """One row per time with the equal-weight return of the members held at the previous time.

    `cs_lagged_mean` holds every member; `cs_lagged_spread` holds the top tail of the signal and
    shorts the bottom tail, ties broken by identity.  A holding that disappears counts as missing
    and is never replaced by another member.  `times` is the number of observation times, given
    when cross-sections are oversized.
    """
    returns, member = columns[0], columns[-1]
    held = flag(F.col(member))
    if eligible:
        held = held & flag(F.col(eligible))
    key = [time, *identity]
    pairs = following(df, time, "__next", bound)
    if times is not None and times <= broadcast_limit(df.sparkSession):
        pairs = F.broadcast(pairs)
    if op == "cs_lagged_mean":
        held_rows = df.where(held).select(*key)
        side = F.lit(True)
    else:
        signal = columns[1]
        held_rows = df.where(held & F.col(signal).isNotNull()).select(*key, signal)
        order = [signal, *identity]
        if split:
            ranked = running(held_rows, [time], order, {"__at": F.lit(1).cast("long")}, split=True)
            sizes = held_rows.groupBy(time).agg(F.count(F.lit(1)).alias("__all"))
            ranked = join_stats(ranked, sizes, [time], times)
        else:
            w = Window.partitionBy(time)
            ranked = held_rows.withColumns(
                {
                    "__at": F.row_number().over(w.orderBy(*order)),
                    "__all": F.count(F.lit(1)).over(w),
                }
            )
        tail = F.floor(F.col("__all") * F.lit(float(params[0])))
        high = F.col("__at") > F.col("__all") - tail
        low = F.col("__at") <= tail
        held_rows = ranked.where(high | low).select(*key, high.alias("__high"))
        side = F.col("__high")
    realized = df.select(F.col(time).alias("__next"), *identity, F.col(returns).alias("__ret"))
    matched = (
        held_rows.join(pairs, time)
        .drop(time)
        .join(realized, ["__next", *identity], "left")
        .withColumn("__top", side)
    )

    def average(top: bool) -> Column:
        mine = F.col("__top") == F.lit(top)
        count = F.count_if(mine)
        observed = F.count(F.when(mine, F.col("__ret")))
        mean = F.avg(F.when(mine, F.col("__ret")))
        value = _covered(count, observed, mean, params[-1])
        if op == "cs_lagged_mean":
            value = F.when(count >= int(params[0]), value)
        return value

    value = average(True) if op == "cs_lagged_mean" else average(True) - average(False)
    return matched.groupBy(F.col("__next").alias(time)).agg(value.alias(out))
