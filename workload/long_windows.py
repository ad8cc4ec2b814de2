"""Rolling operators over windows of 250 events, by the structures whose cost does not follow the window."""

from __future__ import annotations

from pyspark.sql import functions as F

from factorloom.functions import feature as fx
from factorloom.operators.panel import Panel, PanelSpec

from .base import q6, query, rounded, rows_of, table

N = 250
V, U = fx.field("v"), fx.field("u")
# Two series without large common parts; every 900th event lacks the second one.
EVENTS = """e AS (SELECT event_id, event_type, ts, ln(value + 1) AS v,
    CASE WHEN event_id % 900 <> 5 THEN sqrt(value) + CAST(user_id % 97 AS DOUBLE) / 50 END AS u,
    row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) AS i FROM events)"""
FRAME = f"(PARTITION BY event_type ORDER BY ts, event_id ROWS BETWEEN {N - 1} PRECEDING AND CURRENT ROW)"


def _panel(spark, sf) -> Panel:
    value = F.col("value")
    second = F.sqrt(value) + (F.col("user_id") % 97).cast("double") / 50
    events = table(spark, sf, "events").select(
        "event_type", "event_id", "ts", F.ln(value + 1).alias("v"), F.when(F.col("event_id") % 900 != 5, second).alias("u")
    )
    return Panel(events, PanelSpec(identity=("event_type",), time="ts", ties=("event_id",)), rows_of(spark, sf, "events"))


def _run(spark, sf, features):
    return rounded(_panel(spark, sf).with_features(features), ["event_id"], list(features))


def _sql(columns: dict[str, str], known: str = "v", extra: str = "") -> str:
    chosen = ",\n  ".join(q6(f"CASE WHEN count({known}) OVER w = {N} THEN {sql} END", name) for name, sql in columns.items())
    return f"WITH {EVENTS}{extra} SELECT event_id, {chosen} FROM e WINDOW w AS {FRAME}"


@query(
    "ts_moments_long",
    _sql(
        {
            "std_": "stddev_samp(v) OVER w",
            "var_": "var_samp(v) OVER w",
            "zscore_": "(v - avg(v) OVER w) / stddev_samp(v) OVER w",
            "skew_": "skewness(v) OVER w",
            "kurt_": "kurtosis(v) OVER w",
            "skew_pop": f"skewness(v) OVER w * {N - 2} / sqrt({N} * {N - 1})",
            "kurt_pop": "kurtosis_pop(v) OVER w",
        }
    ),
)
def ts_moments_long(spark, sf):
    return _run(
        spark,
        sf,
        {
            "std_": fx.ts_std(V, N),
            "var_": fx.ts_var(V, N),
            "zscore_": fx.ts_zscore(V, N),
            "skew_": fx.ts_skew(V, N),
            "kurt_": fx.ts_kurt(V, N),
            "skew_pop": fx.ts_skew_pop(V, N),
            "kurt_pop": fx.ts_kurt_pop(V, N),
        },
    )


@query("ts_pairs_long", _sql({"corr_": "corr(v, u) OVER w", "cov_": "covar_samp(v, u) OVER w"}, "u"))
def ts_pairs_long(spark, sf):
    return _run(spark, sf, {"corr_": fx.ts_corr(V, U, N), "cov_": fx.ts_cov(V, U, N)})


@query(
    "ts_quantiles_long",
    _sql(
        {
            "median_": "quantile_cont(v, 0.5) OVER w",
            "quantile_": "quantile_cont(v, 0.2) OVER w",
            "winsorize_": "least(greatest(v, quantile_cont(v, 0.1) OVER w), quantile_cont(v, 0.9) OVER w)",
            "rank_": f"(len(list_filter(list(v) OVER w, lambda x: x < v)) + (len(list_filter(list(v) OVER w, lambda x: x = v)) + 1) / 2) / {N}",
        }
    ),
)
def ts_quantiles_long(spark, sf):
    return _run(
        spark,
        sf,
        {
            "median_": fx.ts_median(V, N),
            "quantile_": fx.ts_quantile(V, N, 0.2),
            "winsorize_": fx.ts_winsorize(V, N, 0.1, 0.9),
            "rank_": fx.ts_rank(V, N),
        },
    )


@query(
    "ts_products_extremes_long",
    f"""WITH {EVENTS},
a AS (SELECT *, min(v) OVER w AS lo, max(v) OVER w AS hi, exp(sum(ln(1 + (v - 2) / 100)) OVER w) AS prod, count(v) OVER w AS n FROM e WINDOW w AS {FRAME}),
b AS (SELECT a.event_id, a.i, a.n, any_value(a.prod) AS prod, max(CASE WHEN e.v = a.lo THEN e.i END) AS at_lo, max(CASE WHEN e.v = a.hi THEN e.i END) AS at_hi
  FROM a JOIN e ON a.event_type = e.event_type AND e.i BETWEEN a.i - {N - 1} AND a.i GROUP BY a.event_id, a.i, a.n)
SELECT event_id, {q6(f"CASE WHEN n = {N} THEN prod END", "prod_")}, {q6(f"CASE WHEN n = {N} THEN i - at_lo END", "argmin_")},
  {q6(f"CASE WHEN n = {N} THEN i - at_hi END", "argmax_")} FROM b""",
)
def ts_products_extremes_long(spark, sf):
    growth = 1 + (V - 2) / 100
    return _run(spark, sf, {"prod_": fx.ts_prod(growth, N), "argmin_": fx.ts_argmin(V, N), "argmax_": fx.ts_argmax(V, N)})


@query(
    "ts_rank_correlation_long",
    f"""WITH {EVENTS},
j AS (SELECT a.event_id, b.v, b.u FROM e a JOIN e b ON a.event_type = b.event_type AND b.i BETWEEN a.i - {N - 1} AND a.i),
r AS (SELECT *, rank() OVER (PARTITION BY event_id ORDER BY v) + (count(*) OVER (PARTITION BY event_id, v) - 1) / 2.0 AS rv,
    rank() OVER (PARTITION BY event_id ORDER BY u) + (count(*) OVER (PARTITION BY event_id, u) - 1) / 2.0 AS ru FROM j)
SELECT event_id, {q6(f"CASE WHEN count(u) = {N} AND min(rv) < max(rv) AND min(ru) < max(ru) THEN corr(rv, ru) END", "rankcorr_")}
FROM r GROUP BY event_id""",
)
def ts_rank_correlation_long(spark, sf):
    return _run(spark, sf, {"rankcorr_": fx.ts_rankcorr(V, U, N)})
