"""Cross-sectional operators and lagged portfolios over the monthly supplier panel."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from factorloom.functions import feature as fx

from .base import HISTORY, KEY, q6, query, rounded, trade_panel, trade_sql

X = fx.field("x")
RETURN = fx.change(fx.field("price"), 1)

# Values of eligible rows only; the rest stay out of every cross-section.
MASKED = "m AS (SELECT *, CASE WHEN eligible THEN x END AS e FROM trade)"


def _run(spark, sf, features, unit="day"):
    panel = trade_panel(spark, sf, unit)
    # Large cross-sections are written on the way, so only what the features read goes along.
    read = sorted(frozenset().union(*(f.fields() for f in features.values())))
    panel = panel.with_df(panel.df.select("exchange", *KEY, "eligible", *read))
    return rounded(panel.with_features(features), KEY, list(features))


@query(
    "cs_rank",
    f"""WITH {trade_sql()}, {MASKED},
r AS (SELECT *, rank() OVER (PARTITION BY trading_day ORDER BY e NULLS LAST) AS k,
  count(*) OVER (PARTITION BY trading_day, e) AS same, count(e) OVER (PARTITION BY trading_day) AS n FROM m)
SELECT instrument_id, trading_day, {q6("CASE WHEN e IS NOT NULL THEN (k + (same - 1) / 2) / n END", "rank_")} FROM r""",
)
def cs_rank(spark, sf):
    return _run(spark, sf, {"rank_": fx.cs_rank(X)})


@query(
    "cs_scaling",
    f"""WITH {trade_sql()}, {MASKED}
SELECT instrument_id, trading_day, {q6("e - avg(e) OVER d", "demean_")},
  {q6("CASE WHEN stddev_samp(e) OVER d > 1e-12 THEN (e - avg(e) OVER d) / stddev_samp(e) OVER d END", "zscore_")},
  {q6("CASE WHEN sum(abs(e)) OVER d > 1e-12 THEN e / sum(abs(e)) OVER d END", "scale_")}
FROM m WINDOW d AS (PARTITION BY trading_day)""",
)
def cs_scaling(spark, sf):
    return _run(
        spark,
        sf,
        {"demean_": fx.cs_demean(X), "zscore_": fx.cs_zscore(X), "scale_": fx.cs_scale(X)},
    )


@query(
    "cs_winsorize",
    f"""WITH {trade_sql()}, {MASKED},
b AS (SELECT trading_day, quantile_cont(e, 0.1) AS lo, quantile_cont(e, 0.9) AS hi FROM m GROUP BY 1)
SELECT instrument_id, trading_day, {q6("CASE WHEN e IS NOT NULL THEN least(greatest(e, lo), hi) END", "winsorize_")}
FROM m JOIN b USING (trading_day)""",
)
def cs_winsorize(spark, sf):
    return _run(spark, sf, {"winsorize_": fx.cs_winsorize(X, 0.1, 0.9)})


LAGGED = f"""{trade_sql("month")},
r AS (SELECT *, CASE WHEN count(price) OVER w = 2 THEN price / lag(price) OVER o - 1 END AS ret
  FROM trade WINDOW o AS ({HISTORY}), w AS ({HISTORY} ROWS BETWEEN 1 PRECEDING AND CURRENT ROW)),
t AS (SELECT trading_day, lead(trading_day) OVER (ORDER BY trading_day) AS next_day
  FROM (SELECT DISTINCT trading_day FROM r)),
h AS (SELECT t.next_day, r.exchange, r.instrument_id, r.x FROM r JOIN t USING (trading_day)
  WHERE r.eligible AND r.volume > 100 AND t.next_day IS NOT NULL)"""


@query(
    "cs_lagged_mean",
    f"""WITH {LAGGED},
s AS (SELECT h.next_day, count(*) AS n, count(r.ret) AS seen, avg(r.ret) AS mean
  FROM h LEFT JOIN r ON r.trading_day = h.next_day AND r.exchange = h.exchange AND r.instrument_id = h.instrument_id
  GROUP BY 1)
SELECT r.instrument_id, r.trading_day, {q6("CASE WHEN n >= 4 AND seen >= ceil(n * 0.8) THEN mean END", "market")}
FROM r LEFT JOIN s ON r.trading_day = s.next_day""",
)
def cs_lagged_mean(spark, sf):
    member = fx.field("volume") > 100
    return _run(spark, sf, {"market": fx.cs_lagged_mean(RETURN, member, 4, 0.8)}, "month")


@query(
    "cs_lagged_spread",
    f"""WITH {LAGGED},
k AS (SELECT *, row_number() OVER (PARTITION BY next_day ORDER BY x, exchange, instrument_id) AS pos,
  count(*) OVER (PARTITION BY next_day) AS n FROM h WHERE x IS NOT NULL),
s AS (SELECT k.next_day, any_value(floor(n * 0.25)) AS tail,
    count(r.ret) FILTER (WHERE pos <= floor(n * 0.25)) AS low_seen, avg(r.ret) FILTER (WHERE pos <= floor(n * 0.25)) AS low,
    count(r.ret) FILTER (WHERE pos > n - floor(n * 0.25)) AS high_seen, avg(r.ret) FILTER (WHERE pos > n - floor(n * 0.25)) AS high
  FROM k LEFT JOIN r ON r.trading_day = k.next_day AND r.exchange = k.exchange AND r.instrument_id = k.instrument_id
  GROUP BY 1)
SELECT r.instrument_id, r.trading_day,
  {q6("CASE WHEN tail > 0 AND low_seen >= ceil(tail * 0.8) AND high_seen >= ceil(tail * 0.8) THEN s.high - s.low END", "spread")}
FROM r LEFT JOIN s ON r.trading_day = s.next_day""",
)
def cs_lagged_spread(spark, sf):
    member = fx.field("volume") > 100
    return _run(spark, sf, {"spread": fx.cs_lagged_spread(RETURN, X, member, 0.25, 0.8)}, "month")


@query(
    "cs_of_ts",
    f"""WITH {trade_sql("month")},
a AS (SELECT *, CASE WHEN count(x) OVER w = 3 THEN avg(x) OVER w END AS m FROM trade
  WINDOW w AS ({HISTORY} ROWS BETWEEN 2 PRECEDING AND CURRENT ROW)),
b AS (SELECT *, CASE WHEN eligible THEN m END AS e FROM a),
c AS (SELECT *, e - avg(e) OVER (PARTITION BY trading_day) AS d FROM b)
SELECT instrument_id, trading_day, {q6("CASE WHEN count(d) OVER w = 3 THEN sum(d) OVER w END", "value")}
FROM c WINDOW w AS ({HISTORY} ROWS BETWEEN 2 PRECEDING AND CURRENT ROW)""",
)
def cs_of_ts(spark, sf):
    """History inside a cross-section inside history."""
    inner = fx.cs_demean(fx.ts_mean(X, 3))
    return _run(spark, sf, {"value": fx.ts_sum(inner, 3)}, "month")


def _share_of_gross(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    weight = x * y
    return weight / np.abs(weight).sum()


@query(
    "custom_cross_kernel",
    f"""WITH {trade_sql("month")}, w AS (SELECT *, CASE WHEN eligible THEN x * y END AS p FROM trade)
SELECT instrument_id, trading_day, {q6("p / sum(abs(p)) OVER (PARTITION BY trading_day)", "share")} FROM w""",
)
def custom_cross_kernel(spark, sf):
    return _run(spark, sf, {"share": fx.cs_apply(_share_of_gross, [X, fx.field("y")])}, "month")


@query(
    "custom_cross_reduction",
    f"""WITH {trade_sql("month")}, w AS (SELECT *, CASE WHEN eligible THEN x * y END AS p FROM trade)
SELECT instrument_id, trading_day, {q6("p / sum(abs(p)) OVER (PARTITION BY trading_day)", "share")} FROM w""",
)
def custom_cross_reduction(spark, sf):
    """The same kernel in parts: no task needs a whole cross-section."""
    share = fx.Reduction(
        partial=lambda x, y: np.array([np.abs(x * y).sum()]),
        merge=lambda states: states.sum(axis=0),
        finish=lambda state, x, y: x * y / state[0],
    )
    return _run(spark, sf, {"share": fx.cs_reduce(share, [X, fx.field("y")])}, "month")
