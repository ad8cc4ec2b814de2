"""Equity preparation: membership, flags, point-in-time shifts and price adjustment."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from ..operators.asof import asof_join
from ..operators.blocks import DAY_ROWS, join_stats
from ..operators.portfolio import following
from .futures import parse_lifetimes

DAY = ("trading_day", "instrument_id")


def membership_flags(
    membership: DataFrame, universes: Sequence[str], union: str | None = None
) -> DataFrame:
    """One boolean `in_*` column per universe; explicit values keep the pivot a single pass."""
    wide = membership.groupBy(*DAY).pivot("universe", list(universes)).agg(F.count(F.lit(1)))
    flags = {f"in_{u}": F.coalesce(F.col(u) > 0, F.lit(False)) for u in universes}
    result = wide.select(*DAY, *[c.alias(n) for n, c in flags.items()])
    return result.withColumn(f"in_{union}", F.lit(True)) if union else result


def long_flags(wide: DataFrame, name: str, day: str = "trading_day") -> DataFrame:
    """A day x instrument matrix as rows of (day, instrument_id, flag)."""
    columns = [c for c in wide.columns if c != day]
    long = wide.unpivot(day, columns, "instrument_id", name)
    return long.withColumn(day, F.col(day).cast("date"))


def publish_next_day(df: DataFrame, calendar: DataFrame, source: str = "source_day") -> DataFrame:
    """Date each observation on the next trading day; the last day has no publication yet.

    The calendar has one row per day, which bounds the broadcast.
    """
    days = calendar.select(F.col("trading_day").alias(source))
    return df.join(F.broadcast(following(days, source, "available_day", DAY_ROWS)), source)


def adjust_prices(
    bars: DataFrame,
    factors: DataFrame,
    prices: Sequence[str] = ("open", "high", "low", "close"),
    rows: int | None = None,
) -> DataFrame:
    """Cumulative factor in force on each day (1 before the first) and adjusted prices.

    `factors` has (instrument_id, ex_date, adjfactor).
    """
    matched = asof_join(
        bars, factors, ["instrument_id"], "trading_day", "ex_date", ["adjfactor"], rows
    )
    known = matched.withColumn("adjfactor", F.coalesce("adjfactor", F.lit(1.0)))
    return known.withColumns({f"adj_{p}": F.col(p) * F.col("adjfactor") for p in prices})


def close_time(df: DataFrame, hour: int = 15) -> DataFrame:
    """Daily bars stamped at the close, and the exchange suffix of the identifier."""
    stamp = F.col("trading_day").cast("timestamp") + F.make_dt_interval(hours=F.lit(hour))
    return df.withColumns(
        {"timestamp": stamp, "exchange": F.element_at(F.split("instrument_id", r"\."), -1)}
    )


def missing_members(flags: DataFrame, bars: DataFrame) -> DataFrame:
    """Member days without an observation."""
    return flags.select(*DAY).join(bars.select(*DAY), list(DAY), "left_anti")


def classify_missing(missing: DataFrame, instruments: DataFrame) -> DataFrame:
    """Why a member day has no observation; only unresolved ones are a data problem."""
    lifetimes = parse_lifetimes(instruments, ("listed_date", "de_listed_date")).select(
        "instrument_id", "listed_date", "de_listed_date"
    )
    day = F.col("trading_day")
    reason = (
        F.when(day < F.col("listed_date"), "before_listing")
        .when(day >= F.col("de_listed_date"), "on_or_after_delisting")
        .otherwise("unresolved")
    )
    return join_stats(missing, lifetimes, ["instrument_id"]).withColumn("reason", reason)


def missing_summary(classified: DataFrame) -> DataFrame:
    return classified.groupBy("reason").agg(F.count(F.lit(1)).alias("member_days"))
