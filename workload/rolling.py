"""Rolling operators over the daily supplier panel (and the event stream of each user)."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from factorloom.functions import feature as fx
from factorloom.operators.panel import Panel, PanelSpec

from .base import HISTORY, KEY, q6, query, rounded, rows_of, table, trade_panel, trade_sql

X, Y = fx.field("x"), fx.field("y")


def _run(spark, sf, features):
    return rounded(trade_panel(spark, sf).with_features(features), KEY, list(features))


def _window(n: int) -> str:
    return f"({HISTORY} ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)"


def _full(expr: str, n: int, x: str = "x", w: str = "w") -> str:
    return f"CASE WHEN count({x}) OVER {w} = {n} THEN {expr} END"


def _sql(columns: dict[str, str], n: int, extra: str = "", source: str = "trade") -> str:
    chosen = ",\n  ".join(q6(e, name) for name, e in columns.items())
    return f"""WITH {trade_sql()}{extra}
SELECT instrument_id, trading_day, {chosen}
FROM {source} WINDOW o AS ({HISTORY}), w AS {_window(n)}, w1 AS {_window(n + 1)}"""


@query(
    "ts_lags",
    _sql(
        {
            "obs_lag_": "lag(x, 3) OVER o",
            "delay_": _full("lag(x, 3) OVER o", 4, w="w1"),
            "delta_": _full("x - lag(x, 3) OVER o", 4, w="w1"),
            "change_": _full("x / lag(x, 3) OVER o - 1", 4, w="w1"),
        },
        3,
    ),
)
def ts_lags(spark, sf):
    return _run(
        spark,
        sf,
        {
            "obs_lag_": fx.obs_lag(X, 3),
            "delay_": fx.delay(X, 3),
            "delta_": fx.delta(X, 3),
            "change_": fx.change(X, 3),
        },
    )


@query(
    "ts_sums",
    _sql(
        {
            "sum_": _full("sum(x) OVER w", 10),
            "mean_": _full("avg(x) OVER w", 10),
            "min_": _full("min(x) OVER w", 10),
            "max_": _full("max(x) OVER w", 10),
        },
        10,
    ),
)
def ts_sums(spark, sf):
    return _run(
        spark,
        sf,
        {"sum_": fx.ts_sum(X, 10), "mean_": fx.ts_mean(X, 10), "min_": fx.ts_min(X, 10), "max_": fx.ts_max(X, 10)},
    )


@query(
    "ts_moments",
    _sql(
        {
            "std_": _full("stddev_samp(x) OVER w", 12),
            "var_": _full("var_samp(x) OVER w", 12),
            "skew_": _full("CASE WHEN stddev_samp(x) OVER w > 1e-12 THEN skewness(x) OVER w END", 12),
            "kurt_": _full("CASE WHEN stddev_samp(x) OVER w > 1e-12 THEN kurtosis(x) OVER w END", 12),
            "skew_pop": _full(
                "CASE WHEN stddev_samp(x) OVER w > 1e-12 THEN skewness(x) OVER w END", 12
            )
            + " * 10 / sqrt(132)",
            "kurt_pop": _full(
                "CASE WHEN stddev_samp(x) OVER w > 1e-12 THEN kurtosis_pop(x) OVER w END", 12
            ),
        },
        12,
    ),
)
def ts_moments(spark, sf):
    return _run(
        spark,
        sf,
        {
            "std_": fx.ts_std(X, 12),
            "var_": fx.ts_var(X, 12),
            "skew_": fx.ts_skew(X, 12),
            "kurt_": fx.ts_kurt(X, 12),
            "skew_pop": fx.ts_skew_pop(X, 12),
            "kurt_pop": fx.ts_kurt_pop(X, 12),
        },
    )


@query(
    "ts_quantiles",
    _sql(
        {
            "median_": _full("quantile_cont(x, 0.5) OVER w", 9),
            "quantile_": _full("quantile_cont(x, 0.2) OVER w", 9),
            "winsorize_": _full(
                "least(greatest(x, quantile_cont(x, 0.1) OVER w), quantile_cont(x, 0.9) OVER w)", 9
            ),
        },
        9,
    ),
)
def ts_quantiles(spark, sf):
    return _run(
        spark,
        sf,
        {
            "median_": fx.ts_median(X, 9),
            "quantile_": fx.ts_quantile(X, 9, 0.2),
            "winsorize_": fx.ts_winsorize(X, 9, 0.1, 0.9),
        },
    )


@query(
    "ts_rank_decay",
    _sql(
        {
            "rank_": _full(
                "(len(list_filter(list(x) OVER w, lambda v: v < x)) + (len(list_filter(list(x) OVER w, lambda v: v = x)) + 1) / 2) / 8",
                8,
            ),
            "decay_": _full("sum(x * (i % 1000000)) OVER w - (i - 8) * sum(x) OVER w", 8) + " / 36",
            "zscore_": _full(
                "CASE WHEN stddev_samp(x) OVER w > 1e-12 THEN (x - avg(x) OVER w) / stddev_samp(x) OVER w END", 8
            ),
        },
        8,
        extra=f", p AS (SELECT *, row_number() OVER ({HISTORY}) AS i FROM trade)",
        source="p",
    ),
)
def ts_rank_decay(spark, sf):
    return _run(
        spark,
        sf,
        {"rank_": fx.ts_rank(X, 8), "decay_": fx.ts_linear_decay(X, 8), "zscore_": fx.ts_zscore(X, 8)},
    )


@query(
    "ts_pairs",
    _sql(
        {
            "corr_": _full(
                "CASE WHEN min(x) OVER w < max(x) OVER w AND min(yx) OVER w < max(yx) OVER w "
                "THEN least(1, greatest(-1, corr(x, yx) OVER w)) END",
                10,
            ),
            "cov_": _full("covar_samp(x, yx) OVER w", 10),
        },
        10,
        extra=", p AS (SELECT *, CASE WHEN x IS NOT NULL THEN y END AS yx FROM trade)",
        source="p",
    ),
)
def ts_pairs(spark, sf):
    return _run(spark, sf, {"corr_": fx.ts_corr(X, Y, 10), "cov_": fx.ts_cov(X, Y, 10)})


@query(
    "ts_conditions",
    _sql(
        {
            "count_": _full("sum(c) OVER w", 6, "c"),
            "rate_": _full("sum(c) OVER w", 6, "c") + " / 6",
            "any_": "CASE WHEN " + _full("sum(c) OVER w", 6, "c") + " > 0 THEN 1 WHEN count(c) OVER w = 6 THEN 0 END",
            "all_": "CASE WHEN " + _full("sum(c) OVER w", 6, "c") + " = 6 THEN 1 WHEN count(c) OVER w = 6 THEN 0 END",
        },
        6,
        extra=", p AS (SELECT *, CASE WHEN x > 2 THEN 1 WHEN x <= 2 THEN 0 END AS c FROM trade)",
        source="p",
    ),
)
def ts_conditions(spark, sf):
    high = X > 2
    return _run(
        spark,
        sf,
        {
            "count_": fx.ts_count(high, 6),
            "rate_": fx.ts_rate(high, 6),
            "any_": fx.if_then_else(fx.ts_any(high, 6), 1, 0),
            "all_": fx.if_then_else(fx.ts_all(high, 6), 1, 0),
        },
    )


@query(
    "ts_products_extremes",
    f"""WITH {trade_sql()},
p AS (SELECT *, row_number() OVER ({HISTORY}) AS i FROM trade),
a AS (SELECT *, min(x) OVER w AS lo, max(x) OVER w AS hi, product(x / 2) OVER w AS prod, count(x) OVER w AS n
  FROM p WINDOW w AS {_window(5)}),
b AS (SELECT a.instrument_id, a.trading_day, a.i, any_value(a.n) AS n, any_value(a.prod) AS prod,
    max(CASE WHEN p.x = a.lo THEN p.i END) AS at_lo, max(CASE WHEN p.x = a.hi THEN p.i END) AS at_hi
  FROM a JOIN p ON a.instrument_id = p.instrument_id AND p.i BETWEEN a.i - 4 AND a.i
  GROUP BY a.instrument_id, a.trading_day, a.i)
SELECT instrument_id, trading_day, {q6("CASE WHEN n = 5 THEN prod END", "prod_")},
  {q6("CASE WHEN n = 5 THEN i - at_lo END", "argmin_")}, {q6("CASE WHEN n = 5 THEN i - at_hi END", "argmax_")}
FROM b""",
)
def ts_products_extremes(spark, sf):
    return _run(
        spark,
        sf,
        {"prod_": fx.ts_prod(X / 2, 5), "argmin_": fx.ts_argmin(X, 5), "argmax_": fx.ts_argmax(X, 5)},
    )


@query(
    "ts_rank_correlation",
    f"""WITH {trade_sql()},
p AS (SELECT *, row_number() OVER ({HISTORY}) AS i FROM trade),
j AS (SELECT a.instrument_id, a.trading_day, a.i, b.x, b.y FROM p a
  JOIN p b ON a.instrument_id = b.instrument_id AND b.i BETWEEN a.i - 5 AND a.i),
r AS (SELECT *, rank() OVER (g ORDER BY x) + (count(*) OVER (g, x) - 1) / 2.0 AS rx,
    rank() OVER (g ORDER BY y) + (count(*) OVER (g, y) - 1) / 2.0 AS ry FROM j)
SELECT instrument_id, trading_day,
  {q6("CASE WHEN count(x) = 6 AND min(rx) < max(rx) AND min(ry) < max(ry) THEN corr(rx, ry) END", "rankcorr_")}
FROM r GROUP BY instrument_id, trading_day""".replace("(g ORDER BY", "(PARTITION BY instrument_id, i ORDER BY")
    .replace("OVER (g, x)", "OVER (PARTITION BY instrument_id, i, x)")
    .replace("OVER (g, y)", "OVER (PARTITION BY instrument_id, i, y)"),
)
def ts_rank_correlation(spark, sf):
    return _run(spark, sf, {"rankcorr_": fx.ts_rankcorr(X, Y, 6)})


def _residual_sql(n: int) -> str:
    """Every window's rows joined to its last one, and each regressor made orthogonal to those before it."""
    over = "OVER (PARTITION BY key)"

    def without(names: tuple[str, ...], base: str) -> str:
        """Take from each column its part along `base`."""
        return ", ".join(f"{x} - {base} * sum({x} * {base}) {over} / nullif(sum({base} * {base}) {over}, 0) AS {x}" for x in names)

    return f"""WITH {trade_sql()},
p AS (SELECT *, row_number() OVER ({HISTORY}) AS i FROM trade),
j AS (SELECT e.instrument_id, e.trading_day, e.exchange || '/' || e.instrument_id || '/' || e.i AS key, s.x AS v, s.y AS a, s.low / 1000 AS b, (s.high - s.low) / 1000 AS c
  FROM p e JOIN p s ON e.exchange = s.exchange AND e.instrument_id = s.instrument_id AND s.i BETWEEN e.i - {n - 1} AND e.i),
d AS (SELECT instrument_id, trading_day, key, count(v) {over} AS k, {", ".join(f"{x} - avg({x}) {over} AS {x}" for x in "vabc")} FROM j),
q0 AS (SELECT *, sum(a * a) {over} AS ta, sum(b * b) {over} AS tb, sum(c * c) {over} AS tc FROM d WHERE k = {n}),
q1 AS (SELECT * REPLACE ({without(("v", "b", "c"), "a")}) FROM q0),
q2 AS (SELECT * REPLACE ({without(("v", "c"), "b")}) FROM q1),
q3 AS (SELECT * REPLACE ({without(("v",), "c")}), sum(b * b) {over} AS rb, sum(c * c) {over} AS rc FROM q2),
f AS (SELECT instrument_id, trading_day, sqrt(sum(v * v) / {n - 1}) AS resid FROM q3
  WHERE ta > 0 AND rb > 1e-20 * tb AND rc > 1e-20 * tc GROUP BY instrument_id, trading_day)
SELECT instrument_id, trading_day, {q6("resid", "resid_")} FROM trade LEFT JOIN f USING (instrument_id, trading_day)"""


@query("ts_residual_std", _residual_sql(12))
def ts_residual_std(spark, sf):
    spread = (fx.field("high") - fx.field("low")) / 1000
    low = fx.field("low") / 1000
    return _run(spark, sf, {"resid_": fx.ts_resid_std3(X, Y, low, spread, 12)})


@query(
    "ts_nested",
    f"""WITH {trade_sql()},
a AS (SELECT *, {_full("CASE WHEN stddev_samp(x) OVER w > 1e-12 THEN (x - avg(x) OVER w) / stddev_samp(x) OVER w END", 5)} AS z
  FROM trade WINDOW w AS {_window(5)}),
b AS (SELECT *, {_full("avg(z) OVER w", 4, "z")} AS m FROM a WINDOW w AS {_window(4)})
SELECT instrument_id, trading_day, {q6("m", "mean_of_z")}, {q6("CASE WHEN count(m) OVER w = 3 THEN m - lag(m, 2) OVER o END", "drift")}
FROM b WINDOW o AS ({HISTORY}), w AS {_window(3)}""",
)
def ts_nested(spark, sf):
    smooth = fx.ts_mean(fx.ts_zscore(X, 5), 4)
    return _run(spark, sf, {"mean_of_z": smooth, "drift": fx.delta(smooth, 2)})


@query(
    "ts_long_window",
    f"""WITH e AS (SELECT event_type, event_id, ts, ln(value + 1) AS v FROM events)
SELECT event_id, {q6("CASE WHEN count(v) OVER w = 600 THEN avg(v) OVER w END", "mean_")},
  {q6("CASE WHEN count(v) OVER w = 600 THEN sum(CASE WHEN v > 2.5 THEN 1 ELSE 0 END) OVER w END", "count_")}
FROM e WINDOW w AS (PARTITION BY event_type ORDER BY ts, event_id ROWS BETWEEN 599 PRECEDING AND CURRENT ROW)""",
)
def ts_long_window(spark, sf):
    """Windows beyond the frame limit use differenced running sums."""
    events = table(spark, sf, "events").select("event_type", "event_id", "ts", F.ln(F.col("value") + 1).alias("v"))
    spec = PanelSpec(identity=("event_type",), time="ts", ties=("event_id",))
    panel = Panel(events, spec, rows_of(spark, sf, "events"))
    v = fx.field("v")
    wide = panel.with_features({"mean_": fx.ts_mean(v, 600), "count_": fx.ts_count(v > 2.5, 600)})
    return rounded(wide, ["event_id"], ["mean_", "count_"])


_LONG = 250


@query(
    "ts_sums_long",
    f"""WITH e AS (SELECT *, ln(value + 1) AS v, row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) AS i FROM events)
SELECT event_id, {q6(f"CASE WHEN count(v) OVER w = {_LONG} THEN sum(v) OVER w END", "sum_")}, {q6(f"CASE WHEN count(v) OVER w = {_LONG} THEN avg(v) OVER w END", "mean_")},
  {q6(f"CASE WHEN count(v) OVER w = {_LONG} THEN min(v) OVER w END", "min_")}, {q6(f"CASE WHEN count(v) OVER w = {_LONG} THEN max(v) OVER w END", "max_")},
  {q6(f"CASE WHEN count(v) OVER w = {_LONG} THEN sum(v * i) OVER w / {_LONG * (_LONG + 1) / 2} - sum(v) OVER w * (i - {_LONG}) / {_LONG * (_LONG + 1) / 2} END", "decay_")},
  CASE WHEN count(v) OVER w = {_LONG} THEN CAST(max(CASE WHEN v > 5 THEN 1 ELSE 0 END) OVER w AS DOUBLE) END AS any_
FROM e WINDOW w AS (PARTITION BY event_type ORDER BY ts, event_id ROWS BETWEEN {_LONG - 1} PRECEDING AND CURRENT ROW)""",
)
def ts_sums_long(spark, sf):
    """Sums, extremes and weighted sums over 250 rows, in passes whose cost does not depend on it."""
    events = table(spark, sf, "events").select("event_type", "event_id", "ts", F.ln(F.col("value") + 1).alias("v"))
    spec = PanelSpec(identity=("event_type",), time="ts", ties=("event_id",))
    panel = Panel(events, spec, rows_of(spark, sf, "events"))
    v = fx.field("v")
    wide = panel.with_features(
        {
            "sum_": fx.ts_sum(v, _LONG),
            "mean_": fx.ts_mean(v, _LONG),
            "min_": fx.ts_min(v, _LONG),
            "max_": fx.ts_max(v, _LONG),
            "decay_": fx.ts_linear_decay(v, _LONG),
            "any_": fx.ts_any(v > 5, _LONG),
        }
    )
    wide = wide.withColumn("any_", F.col("any_").cast("int"))
    return rounded(wide, ["event_id"], ["sum_", "mean_", "min_", "max_", "decay_", "any_"])


def _range_over_mean(x: np.ndarray) -> np.ndarray:
    return (x.max(axis=1) - x.min(axis=1)) / x.mean(axis=1)


@query(
    "custom_rolling_kernel",
    f"""WITH e AS (SELECT *, ln(value + 1) AS v FROM events)
SELECT event_id, {q6("CASE WHEN count(v) OVER w = 7 THEN (max(v) OVER w - min(v) OVER w) / avg(v) OVER w END", "spread_")}
FROM e WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 6 PRECEDING AND CURRENT ROW)""",
)
def custom_rolling_kernel(spark, sf):
    events = table(spark, sf, "events").select("user_id", "event_id", "ts", F.ln(F.col("value") + 1).alias("v"))
    spec = PanelSpec(identity=("user_id",), time="ts", ties=("event_id",))
    panel = Panel(events, spec, rows_of(spark, sf, "events"))
    wide = panel.with_features({"spread_": fx.ts_apply(_range_over_mean, [fx.field("v")], 7)})
    return rounded(wide, ["event_id"], ["spread_"])


def _trend_sql(n: int) -> str:
    """The trend from its definition: every window's bars joined to their last one."""
    key = "exchange, instrument_id, trading_day"
    return f"""WITH {trade_sql("month")},
o AS (SELECT *, row_number() OVER (PARTITION BY exchange, instrument_id ORDER BY trading_day) AS i FROM trade),
w AS (SELECT e.exchange, e.instrument_id, e.trading_day, s.i - e.i + {n} AS age, ln(s.price) AS v, s.volume AS q
  FROM o AS e JOIN o AS s ON s.exchange = e.exchange AND s.instrument_id = e.instrument_id AND s.i BETWEEN e.i - {n - 1} AND e.i WHERE e.i >= {n}),
m AS (SELECT *, median(v) OVER (PARTITION BY {key}) AS middle FROM w),
d AS (SELECT *, median(abs(v - middle)) OVER (PARTITION BY {key}) AS mad FROM m),
c AS (SELECT *, greatest(-3 * 1.4826 * mad, least(3 * 1.4826 * mad, v - middle)) AS z, q * age AS h FROM d),
f AS (SELECT {key}, min(mad) AS mad, max(q) AS top, sum(h) AS s, sum(h * age) / sum(h) AS ma, sum(h * z) / sum(h) AS mz FROM c GROUP BY ALL),
g AS (SELECT {key}, any_value(f.mad) AS mad, any_value(top) AS top, sum(h * (age - ma) ** 2) / any_value(s) AS vt,
  sum(h * (age - ma) * (z - mz)) / any_value(s) AS cv, sum(h * (z - mz) ** 2) / any_value(s) AS vz FROM c JOIN f USING ({key}) GROUP BY ALL),
t AS (SELECT {key}, cv / vt / sqrt(vz - cv * cv / vt) AS trend FROM g WHERE mad > 1e-12 AND top > 1e-12 AND vz - cv * cv / vt > 1e-24),
j AS (SELECT trade.*, trend, CASE WHEN eligible THEN trend END AS own FROM trade LEFT JOIN t USING ({key})),
r AS (SELECT *, rank() OVER (PARTITION BY trading_day ORDER BY own NULLS LAST) + (count(*) OVER (PARTITION BY trading_day, own) - 1) / 2 AS p,
  count(own) OVER (PARTITION BY trading_day) AS k FROM j)
SELECT instrument_id, trading_day, {q6("trend", "trend")}, {q6("CASE WHEN own IS NOT NULL THEN p / k END", "rank_")} FROM r"""


@query("robust_trend_rank", _trend_sql(8))
def robust_trend_rank(spark, sf):
    """Custom rolling kernel followed by a cross-sectional rank."""
    trend = fx.robust_trend(fx.log(fx.field("price")), fx.field("volume"), 8)
    return rounded(
        trade_panel(spark, sf, "month").with_features({"trend": trend, "rank_": fx.cs_rank(trend)}),
        KEY,
        ["trend", "rank_"],
    )
