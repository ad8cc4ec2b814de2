"""Calendar-month reductions of daily panels and their publication in the next month."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.guards import finite, is_finite
from .blocks import DAY_ROWS, join_stats, running
from .panel import Panel, PanelSpec
from .portfolio import clock

PRODUCT = ("exchange", "product")
REDUCERS = ("last", "sum", "sum_squares", "count", "mean", "max", "compound")


@dataclass(frozen=True)
class Reduction:
    """One monthly output: `op` over the finite values of `source`.

    All but `last` need `min_count` finite values and a `coverage` share of observed days.
    """

    name: str
    source: str
    op: str
    coverage: float = 1.0
    min_count: int = 1

    def __post_init__(self):
        if self.op not in REDUCERS:
            raise ValueError(f"unknown monthly reduction {self.op}")
        if not 0 < self.coverage <= 1 or self.min_count < 1:
            raise ValueError("invalid coverage or minimum count")

    def column(self, day: str) -> Column:
        if self.op == "last":
            return F.max_by(self.source, day).alias(self.name)
        raw = F.col(self.source).cast("double")
        x = F.when(is_finite(raw), raw)
        n = F.count(x)
        value = {
            "sum": F.sum(x),
            "sum_squares": F.sum(x * x),
            "count": n.cast("double"),
            "mean": F.avg(x),
            "max": F.max(x),
            "compound": F.product(x + 1) - 1,
        }[self.op]
        enough = (n >= self.min_count) & (n >= F.ceil(F.count(F.lit(1)) * F.lit(self.coverage)))
        return finite(F.when(enough, value)).alias(self.name)


def calendar_months(
    df: DataFrame,
    rules: Sequence[Reduction],
    keys: Sequence[str] = PRODUCT,
    day: str = "trading_day",
) -> DataFrame:
    """One row per key and calendar month between its first and last day, absent months included."""
    if len({r.name for r in rules}) != len(rules):
        raise ValueError("duplicate monthly output name")
    monthly = df.groupBy(*keys, F.trunc(day, "month").alias("month")).agg(
        *[r.column(day) for r in rules]
    )
    step = F.expr("interval 1 month")
    grid = monthly.groupBy(*keys).agg(
        F.explode(F.sequence(F.min("month"), F.max("month"), step)).alias("month")
    )
    return join_stats(grid, monthly, [*keys, "month"])


def align_monthly(
    features: DataFrame,
    monthly: DataFrame,
    fields: Sequence[str],
    keys: Sequence[str] = PRODUCT,
    day: str = "trading_day",
) -> DataFrame:
    """Values of exactly the previous calendar month; nothing is carried further."""
    side = monthly.select(*keys, F.add_months("month", 1).alias("__month"), *fields)
    staged = features.withColumn("__month", F.trunc(day, "month"))
    return join_stats(staged, side, [*keys, "__month"]).drop("__month")


def observed_segments(
    df: DataFrame,
    calendar: DataFrame,
    leg: str | None = None,
    keys: Sequence[str] = PRODUCT,
    day: str = "trading_day",
    out: str = "product_segment_id",
    rows: int | None = None,
) -> DataFrame:
    """Daily history that restarts after a skipped calendar day or a change of `leg`."""
    index = clock(calendar.select(day), day, "__day", DAY_ROWS)
    staged = join_stats(df, index, [day], DAY_ROWS)
    panel = Panel(staged, PanelSpec(identity=tuple(keys), time=day), rows)

    def breaks(d: DataFrame, frames) -> DataFrame:
        w = frames.ordered
        new = F.coalesce(F.col("__day") - F.lag("__day").over(w) != 1, F.lit(True))
        if leg:
            new = new | F.coalesce(F.col(leg) != F.lag(leg).over(w), F.lit(True))
        return d.withColumn("__break", new.cast("long"))

    marked = panel.over_history(1, 0, breaks)
    numbered = running(marked, keys, [day], {out: F.col("__break")}, split=panel.long_histories)
    return numbered.drop("__break", "__day")
