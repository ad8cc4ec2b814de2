"""Trailing-window operators as Column functions over a `Frames` handle, for short windows.

Every operator needs all n rows of its window to be non-null and returns null otherwise.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, Window, WindowSpec, functions as F

from .guards import EPS, finite, guarded_corr, ratio


@dataclass(frozen=True)
class Frames:
    """Partition and order of one panel; hands out the frames an operator needs.

    `row` names the materialised row number inside the partition.
    """

    keys: tuple[str, ...]
    order: tuple[str, ...]
    row: str = "__row"

    @property
    def ordered(self) -> WindowSpec:
        return Window.partitionBy(*self.keys).orderBy(*self.order)

    def last(self, n: int) -> WindowSpec:
        return self.ordered.rowsBetween(-(n - 1), 0)

    @property
    def number(self) -> Column:
        return F.row_number().over(self.ordered).cast("long")

    def full(self, x: Column, n: int, value: Column) -> Column:
        """`value` where the last n rows exist and are non-null.

        The newest missing row is a running maximum, so the test costs the same for any n.
        """
        upto = self.ordered.rowsBetween(Window.unboundedPreceding, 0)
        missing = F.max(F.when(x.isNull(), F.col(self.row))).over(upto)
        return F.when(F.col(self.row) - F.coalesce(missing, F.lit(0)) >= n, value)


def obs_lag(x: Column, n: int, f: Frames) -> Column:
    return F.lag(x, n).over(f.ordered)


def delay(x: Column, n: int, f: Frames) -> Column:
    return f.full(x, n + 1, obs_lag(x, n, f))


def delta(x: Column, n: int, f: Frames) -> Column:
    return finite(f.full(x, n + 1, x - obs_lag(x, n, f)))


def change(x: Column, n: int, f: Frames) -> Column:
    """Relative change over n rows."""
    return finite(f.full(x, n + 1, ratio(x, obs_lag(x, n, f)) - 1))


def ts_sum(x: Column, n: int, f: Frames) -> Column:
    return finite(f.full(x, n, F.sum(x).over(f.last(n))))


def ts_mean(x: Column, n: int, f: Frames) -> Column:
    return finite(f.full(x, n, F.avg(x).over(f.last(n))))


def ts_min(x: Column, n: int, f: Frames) -> Column:
    return f.full(x, n, F.min(x).over(f.last(n)))


def ts_max(x: Column, n: int, f: Frames) -> Column:
    return f.full(x, n, F.max(x).over(f.last(n)))


def ts_std(x: Column, n: int, f: Frames) -> Column:
    return finite(f.full(x, n, F.stddev_samp(x).over(f.last(n))))


def ts_var(x: Column, n: int, f: Frames) -> Column:
    return finite(f.full(x, n, F.var_samp(x).over(f.last(n))))


def ts_quantile(x: Column, n: int, q: float, f: Frames) -> Column:
    return f.full(x, n, F.percentile(x, F.lit(float(q))).over(f.last(n)))


def ts_median(x: Column, n: int, f: Frames) -> Column:
    return ts_quantile(x, n, 0.5, f)


def ts_winsorize(x: Column, n: int, low: float, high: float, f: Frames) -> Column:
    ends = F.percentile(x, F.array(F.lit(float(low)), F.lit(float(high)))).over(f.last(n))
    return f.full(x, n, F.least(F.greatest(x, ends[0]), ends[1]))


def ts_rank(x: Column, n: int, f: Frames) -> Column:
    """Average rank of the current value inside its window, divided by n."""
    values = F.collect_list(x).over(f.last(n))
    score = F.aggregate(
        values,
        F.lit(0.5),
        lambda acc, v: acc + F.when(v < x, 1.0).when(v == x, 0.5).otherwise(0.0),
    )
    return f.full(x, n, score / n)


def _moment(x: Column, n: int, f: Frames, function) -> Column:
    """Spark's population skewness / kurtosis, null where the window does not vary."""
    w = f.last(n)
    return f.full(x, n, F.when(F.min(x).over(w) < F.max(x).over(w), function(x).over(w)))


def ts_skew_pop(x: Column, n: int, f: Frames) -> Column:
    return finite(_moment(x, n, f, F.skewness))


def ts_kurt_pop(x: Column, n: int, f: Frames) -> Column:
    return finite(_moment(x, n, f, F.kurtosis))


def _spread(x: Column, n: int, f: Frames) -> Column:
    return F.stddev_samp(x).over(f.last(n)) > EPS


def ts_skew(x: Column, n: int, f: Frames) -> Column:
    factor = (n * (n - 1)) ** 0.5 / (n - 2)
    return finite(F.when(_spread(x, n, f), _moment(x, n, f, F.skewness) * factor))


def ts_kurt(x: Column, n: int, f: Frames) -> Column:
    scale = (n - 1) / ((n - 2) * (n - 3))
    return finite(F.when(_spread(x, n, f), (_moment(x, n, f, F.kurtosis) * (n + 1) + 6) * scale))


def ts_linear_decay(x: Column, n: int, f: Frames) -> Column:
    """Weights 1..n from oldest to newest, from two window sums and a row index."""
    r = F.col(f.row).cast("double")
    weighted = F.sum(r * x).over(f.last(n)) - (r - n) * F.sum(x).over(f.last(n))
    return finite(f.full(x, n, weighted / (n * (n + 1) / 2)))


def ts_zscore(x: Column, n: int, f: Frames) -> Column:
    w = f.last(n)
    std = F.stddev_samp(x).over(w)
    return finite(f.full(x, n, F.when(std > EPS, (x - F.avg(x).over(w)) / std)))


def _joint(x: Column, y: Column) -> tuple[Column, Column]:
    known = x.isNotNull() & y.isNotNull()
    return F.when(known, x), F.when(known, y)


def ts_corr(x: Column, y: Column, n: int, f: Frames) -> Column:
    a, b = _joint(x, y)
    w = f.last(n)
    varies = (F.min(a).over(w) < F.max(a).over(w)) & (F.min(b).over(w) < F.max(b).over(w))
    r = guarded_corr(
        F.covar_pop(a, b).over(w), F.stddev_pop(a).over(w), F.stddev_pop(b).over(w), varies
    )
    return f.full(a, n, r)


def ts_cov(x: Column, y: Column, n: int, f: Frames) -> Column:
    a, b = _joint(x, y)
    return finite(f.full(a, n, F.covar_samp(a, b).over(f.last(n))))


def ts_count(c: Column, n: int, f: Frames) -> Column:
    hits = c.cast("double")
    return f.full(hits, n, F.sum(hits).over(f.last(n)))


def ts_rate(c: Column, n: int, f: Frames) -> Column:
    return ts_count(c, n, f) / n


def ts_any(c: Column, n: int, f: Frames) -> Column:
    return ts_count(c, n, f) > 0


def ts_all(c: Column, n: int, f: Frames) -> Column:
    return ts_count(c, n, f) == n


def ts_prod(x: Column, n: int, f: Frames) -> Column:
    return finite(f.full(x, n, F.product(x).over(f.last(n))))


def _bars_since(score: Column, x: Column, n: int, f: Frames) -> Column:
    best = F.max(F.struct(score.alias("v"), F.col(f.row).alias("r"))).over(f.last(n))
    return f.full(x, n, (F.col(f.row) - best["r"]).cast("double"))


def ts_argmin(x: Column, n: int, f: Frames) -> Column:
    return _bars_since(-x, x, n, f)


def ts_argmax(x: Column, n: int, f: Frames) -> Column:
    return _bars_since(x, x, n, f)
