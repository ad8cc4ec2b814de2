"""Forward-return targets, chronological splits and quantile clipping."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass
from datetime import date, timedelta

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.guards import finite, flag, is_finite
from .panel import Panel
from .radix import quantiles


@dataclass(frozen=True)
class DateRange:
    start: date
    end: date

    def __post_init__(self):
        if self.start > self.end:
            raise ValueError("start must not be after end")

    def holds(self, column: str) -> Column:
        return F.col(column).between(F.lit(self.start), F.lit(self.end))


@dataclass(frozen=True)
class Fold:
    """Chronological, disjoint train / val / test periods."""

    name: str
    train: DateRange
    val: DateRange
    test: DateRange

    def __post_init__(self):
        if not self.train.end < self.val.start <= self.val.end < self.test.start:
            raise ValueError("fold periods must be chronological and disjoint")

    def warmup(self) -> DateRange:
        """The calendar year before training, read as rolling history only."""
        first = self.train.start
        leap = first.month == 2 and first.day == 29
        start = date(first.year - 1, first.month, 28 if leap else first.day)
        return DateRange(start, first - timedelta(days=1))


def build_targets(
    panel: Panel,
    price: str,
    horizon: int,
    day: str = "trading_day",
    eligible: str = "target_eligible",
) -> DataFrame:
    """Append `target` = log forward return over `horizon` rows and the day it ends on.

    All rows from now to the horizon must be usable and lie in one segment.
    """
    if horizon < 1:
        raise ValueError("target horizon must be at least one row")

    def forward(d: DataFrame, frames) -> DataFrame:
        x = F.col(price).cast("double")
        usable = is_finite(x) & (x > 0)
        if eligible in d.columns:
            usable = usable & flag(F.col(eligible))
        span = frames.ordered.rowsBetween(0, horizon)
        complete = F.count(F.when(usable, 1)).over(span) == horizon + 1
        future = F.lead(x, horizon).over(frames.ordered)
        return d.withColumns(
            {
                "target": finite(F.when(complete, F.ln(F.when(future > 0, F.try_divide(future, x))))),
                "target_end": F.lead(day, horizon).over(frames.ordered),
            }
        )

    return panel.over_history(0, horizon, forward)


def split_rows(df: DataFrame, period: DateRange, day: str = "trading_day") -> DataFrame:
    """Eligible rows whose signal day and target end both fall inside the period."""
    return df.where(
        flag(F.col("eligible"))
        & period.holds(day)
        & period.holds("target_end")
        & is_finite(F.col("target"))
    )


def clip_bounds(
    df: DataFrame,
    columns: Sequence[str],
    probabilities: Sequence[float] = (0.01, 0.99),
    keys: Sequence[str] = (),
    rows: int | None = None,
) -> DataFrame:
    """Exact quantile bounds of each column over its own finite rows, pooled or per key.

    `rows` is not needed and kept for callers.
    """
    low, high = probabilities
    if not 0 <= low < high <= 1:
        raise ValueError("clip quantiles must satisfy 0 <= low < high <= 1")
    clean = df.select(*keys, *[finite(F.col(c)).alias(c) for c in columns])
    ends = quantiles(clean, list(keys), list(columns), probabilities)
    return ends.select(
        *keys,
        *[F.col(f"{c}_q")[i].alias(f"{c}_{side}") for c in columns for i, side in enumerate(("lower", "upper"))],
    )


def clipped(x: Column, lower: Column, upper: Column) -> Column:
    """Clamp finite values to fitted bounds; null without bounds, null for non-finite."""
    clean = finite(x)
    known = clean.isNotNull() & lower.isNotNull() & upper.isNotNull()
    return F.when(known, F.least(F.greatest(clean, lower), upper))


def apply_clipping(df: DataFrame, bounds: Mapping[str, tuple[float, float] | None]) -> DataFrame:
    """Frozen bounds per column, as fitted on training rows."""
    columns = {}
    for name, ends in bounds.items():
        low, high = ends if ends is not None else (None, None)
        columns[name] = clipped(
            F.col(name), F.lit(low).cast("double"), F.lit(high).cast("double")
        )
    return df.withColumns(columns)
