"""26 monthly commodity-futures characteristics from daily product panels.

Daily features reset on gaps of the observed calendar (and, for curve returns, on a change of the
contract).  Months are calendar months; a value becomes usable in the following month.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..functions import feature as fx
from ..functions.feature import Feature
from ..operators.blocks import frozen, join_stats
from ..operators.monthly import PRODUCT, Reduction, calendar_months, observed_segments
from ..operators.panel import Panel, PanelSpec

YEAR = 12
DAILY_WINDOW = 250
# Share of a month's days, and of a portfolio's members, that must be observed.
COVERAGE = 0.8

BASE_REDUCTIONS = (
    Reduction("P", "price", "last"),
    Reduction("V", "volume", "sum"),
    Reduction("OI", "oi", "last"),
    Reduction("R", "r", "compound"),
    Reduction("r_max", "r", "max"),
    Reduction("r_sum", "r", "sum"),
    Reduction("r_squares", "r", "sum_squares"),
    Reduction("r_count", "r", "count"),
    Reduction("liquidity", "daily_liquidity", "mean", COVERAGE, 2),
    Reduction("std_last", "daily_std", "last"),
    Reduction("skew_last", "daily_skew", "last"),
    Reduction("kurt_last", "daily_kurt", "last"),
    Reduction("vov_last", "daily_vov", "last"),
)
CURVE_REDUCTIONS = (
    Reduction("F0", "F0", "last"),
    Reduction("F1", "F1", "last"),
    Reduction("F2", "F2", "last"),
    Reduction("C0", "r0", "compound", COVERAGE, 2),
    Reduction("C1", "r1", "compound", COVERAGE, 2),
)


def daily_spec(segment: str | None = "product_segment_id") -> PanelSpec:
    return PanelSpec(identity=PRODUCT, time="trading_day", segment=segment)


def daily_features() -> dict[str, Feature]:
    r = fx.change(fx.field("price"), 1)
    std = fx.ts_std(r, DAILY_WINDOW)
    amount = fx.field("amount")
    traded = fx.if_then_else(amount > 0, amount, fx.const(0.0) / 0.0)
    return {
        "r": r,
        "daily_std": std,
        "daily_skew": fx.ts_skew_pop(r, DAILY_WINDOW),
        "daily_kurt": fx.ts_kurt_pop(r, DAILY_WINDOW),
        "daily_vov": fx.ts_std(std, DAILY_WINDOW),
        "daily_liquidity": traded / fx.absolute(r),
    }


def _compound(name: str, months: int) -> Feature:
    return fx.ts_prod(fx.field(name) + 1, months) - 1


def _against_history(name: str) -> Feature:
    """Relative to the mean of the previous twelve months, the current one excluded."""
    x = fx.field(name)
    return x / fx.obs_lag(fx.ts_mean(x, YEAR), 1) - 1


def monthly_features() -> dict[str, Feature]:
    """All characteristics that need only their own product."""
    price, r = fx.field("P"), fx.field("R")
    days = fx.ts_sum(fx.field("r_count"), YEAR)
    total = fx.ts_sum(fx.field("r_sum"), YEAR)
    squares = fx.ts_sum(fx.field("r_squares"), YEAR)
    variance = (squares - total * total / days) / (days - 1)
    basis = fx.field("F0") / fx.field("F1")
    rbasis = basis / (fx.field("F1") / fx.field("F2"))
    bmom = _compound("C0", YEAR) - _compound("C1", YEAR)
    basis12, rbasis12, bmom12 = (fx.ts_mean(x, YEAR) for x in (basis, rbasis, bmom))
    return {
        "mom1": r,
        "mom12": _compound("R", YEAR),
        "val36": _compound("R", 36),
        "val60": _compound("R", 60),
        "seasonality": fx.obs_lag(r, 11),
        "dOI": fx.delta(fx.field("OI"), 1),
        "atv": _against_history("V"),
        "dmaOI": _against_history("OI"),
        "val": price / fx.obs_lag(fx.ts_mean(price, 13), 42),
        "cv": variance / (total / days),
        "iliq": fx.const(1.0) / fx.field("liquidity"),
        "max": fx.field("r_max"),
        "skew": fx.field("skew_last"),
        "kurt": fx.field("kurt_last"),
        "var": fx.field("std_last"),
        "vov": fx.field("vov_last"),
        "basis": basis,
        "rbasis": rbasis,
        "bmom": bmom,
        "basis12": basis12,
        "rbasis12": rbasis12,
        "bmom12": bmom12,
        "l2basis12": fx.obs_lag(basis12, 2),
        "l2bmom12": fx.obs_lag(bmom12, 2),
        "l2rbasis": fx.obs_lag(rbasis, 2),
    }


def residual_volatility() -> Feature:
    """Deviation of 12-month regression residuals on three lagged-portfolio returns."""
    r = fx.field("R")
    member = fx.both(fx.is_finite(fx.field("P")), fx.is_finite(r))
    own = monthly_features()
    market = fx.cs_lagged_mean(r, member, 4, COVERAGE)
    basis = fx.cs_lagged_spread(r, own["basis"], member, 0.25, COVERAGE)
    momentum = fx.cs_lagged_spread(r, own["mom12"], member, 0.25, COVERAGE)
    return fx.ts_resid_std3(r, market, basis, momentum, YEAR)


NAMES = (*monthly_features(), "ivolaBGR")


def monthly_base(base: DataFrame, curve: DataFrame, rows: int | None = None) -> DataFrame:
    """Monthly reductions of both daily panels on the base panel's month grid.

    The daily panels feed the calendar, the segments and the reductions, so they are written once.
    """
    base, curve = frozen(base), frozen(curve)
    calendar = base.select("trading_day").union(curve.select("trading_day")).distinct()
    spec = daily_spec()
    daily = Panel(observed_segments(base, calendar, rows=rows), spec, rows)
    months = calendar_months(daily.with_features(daily_features()), BASE_REDUCTIONS)
    legs = curve
    for j in (0, 1):
        # Each leg restarts on its own contract changes, so it has its own segments.
        out = f"__segment{j}"
        legs = observed_segments(legs, calendar, f"leg{j}", out=out, rows=rows)
        panel = Panel(legs, daily_spec(out), rows)
        legs = panel.with_features({f"r{j}": fx.change(fx.field(f"F{j}"), 1)})
    return join_stats(months, calendar_months(legs, CURVE_REDUCTIONS), [*PRODUCT, "month"])


def monthly_characteristics(
    base: DataFrame, curve: DataFrame, rows: int | None = None
) -> DataFrame:
    """One row per (exchange, product, month) with the 26 characteristics."""
    spec = PanelSpec(identity=PRODUCT, time="month")
    months = Panel(monthly_base(base, curve, rows), spec, rows)
    features = {**monthly_features(), "ivolaBGR": residual_volatility()}
    values = months.with_features({f"__{n}": f for n, f in features.items()})
    return values.select(*PRODUCT, "month", *[F.col(f"__{n}").alias(n) for n in NAMES])
