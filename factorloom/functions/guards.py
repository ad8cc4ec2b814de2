"""Missing-value and numeric rules shared by every operator.

A factor value is either a finite double or null.  SQL three-valued logic, NaN ordering and
partial window frames all differ from that, so each rule has one helper here.
"""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# Smallest usable denominator and the shortest legal windows.
EPS = 1e-12
MIN_WINDOW = {
    "ts_std": 2,
    "ts_var": 2,
    "ts_zscore": 2,
    "ts_corr": 2,
    "ts_cov": 2,
    "ts_rankcorr": 2,
    "ts_skew": 3,
    "ts_kurt": 4,
    "ts_skew_pop": 3,
    "ts_kurt_pop": 4,
    "ts_resid_std3": 5,
}

_INF = float("inf")


def finite(c: Column) -> Column:
    """Null unless finite.  NaN sorts above infinity in Spark, so one comparison covers both."""
    return F.when(F.abs(c) < F.lit(_INF), c)


def is_finite(c: Column) -> Column:
    return F.coalesce(F.abs(c) < F.lit(_INF), F.lit(False))


def flag(c: Column) -> Column:
    """A condition in which unknown counts as false."""
    return F.coalesce(c.cast("boolean"), F.lit(False))


def ratio(a: Column, b: Column) -> Column:
    """a / b, null when the denominator is (almost) zero; safe under ANSI arithmetic."""
    return F.when(F.abs(b) > F.lit(EPS), a / b)


def guarded_corr(cov: Column, sx: Column, sy: Column, varies: Column) -> Column:
    """Pearson from moments; null for constant inputs, clipped against round-off."""
    r = F.try_divide(cov, sx * sy)
    return F.when(varies & (F.abs(r) < F.lit(_INF)), F.greatest(F.lit(-1.0), F.least(F.lit(1.0), r)))


def corr_agg(x: str, y: str) -> Column:
    """Grouped Pearson over jointly non-null rows, as a single aggregate expression."""
    both = F.col(x).isNotNull() & F.col(y).isNotNull()
    a, b = F.when(both, F.col(x)), F.when(both, F.col(y))
    varies = (F.min(a) < F.max(a)) & (F.min(b) < F.max(b))
    return guarded_corr(F.covar_pop(a, b), F.stddev_pop(a), F.stddev_pop(b), varies)
