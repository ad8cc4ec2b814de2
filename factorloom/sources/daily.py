"""Daily reductions of intraday panels that feed the monthly characteristics."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..functions.guards import flag, is_finite

PRODUCT_DAY = ("exchange", "product", "trading_day")


def daily_base(bars: DataFrame) -> DataFrame:
    """Volume-weighted price, complete volume and amount, and the last open interest."""
    price, volume = F.col("adj_vwap"), F.col("volume")
    usable = is_finite(price) & (price > 0) & is_finite(volume) & (volume > 0)
    weight = F.sum(F.when(usable, volume))

    def complete(name: str):
        return F.when(F.bool_and(is_finite(F.col(name))), F.sum(name)).alias(name)

    return bars.groupBy(*PRODUCT_DAY).agg(
        (F.sum(F.when(usable, price * volume)) / weight).alias("price"),
        complete("volume"),
        complete("amount"),
        F.max_by("open_interest", "timestamp").alias("oi"),
    )


def daily_curve(bars: DataFrame) -> DataFrame:
    """Last close and contract of the main and the two far legs; an invalid last bar stays null."""
    columns = []
    for j, suffix in enumerate(("", "_p1", "_p2")):
        close, leg = F.col(f"close{suffix}"), F.col(f"instrument_id{suffix}")
        valid = flag(F.col(f"valid_bar{suffix}")) & (close > 0)
        columns += [
            F.max_by(F.when(valid, close), "timestamp").alias(f"F{j}"),
            F.max_by(F.when(valid, leg), "timestamp").alias(f"leg{j}"),
        ]
    return bars.groupBy(*PRODUCT_DAY).agg(*columns)
