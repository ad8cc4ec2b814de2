"""Readable fields, warm-up history, a table written and read back, and the operators' short names."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from factorloom.functions import feature as fx
from factorloom.functions.guards import is_finite
from factorloom.operators.blocks import shared_folder
from factorloom.sources import scan

from .base import FOLD, KEY, q6, query, r6, rounded, trade, trade_panel, trade_sql
from .rolling import X, _full, _window

_FIELDS = ("high", "low", "volume", "amount", "trades", "price", "x", "y")


@query(
    "panel_fields",
    f"WITH {trade_sql()} "
    + " UNION ALL ".join(f"SELECT '{n}' AS field, count({n}) AS finite_rows, {q6(f'min({n})', 'low')}, {q6(f'max({n})', 'high')} FROM trade" for n in _FIELDS),
)
def panel_fields(spark, sf):
    """The columns that may be read as features, from the schema, and what they hold."""
    panel = trade(spark, sf)
    names = scan.feature_fields(panel.schema)
    facts = [
        F.struct(
            F.lit(n).alias("field"),
            F.count_if(is_finite(F.col(n))).alias("finite_rows"),
            r6(F.min(n)).alias("low"),
            r6(F.max(n)).alias("high"),
        ).alias(f"__{n}")
        for n in names
    ]
    return panel.agg(*facts).select(F.inline(F.array(*[F.col(f"__{n}") for n in names])))


@query(
    "warmup_rows",
    f"""WITH {trade_sql()} SELECT exchange, count(*) AS rows, min(trading_day) AS first_day, max(trading_day) AS last_day FROM trade
WHERE trading_day >= DATE '{FOLD.train.start}' - INTERVAL 1 YEAR AND trading_day < DATE '{FOLD.train.start}' GROUP BY 1""",
)
def warmup_rows(spark, sf):
    """The calendar year before training, kept as rolling history."""
    history = trade(spark, sf).where(FOLD.warmup().holds("trading_day"))
    return history.groupBy("exchange").agg(
        F.count(F.lit(1)).alias("rows"), F.min("trading_day").alias("first_day"), F.max("trading_day").alias("last_day")
    )


@query(
    "compact_round_trip",
    f"""WITH {trade_sql()} SELECT exchange, instrument_id, trading_day, {q6("amount", "amount")}, {q6("volume", "volume")} FROM trade""",
)
def compact_round_trip(spark, sf):
    """Bars written as one ordered table, checked against their keys, and read back as a panel."""
    path = f"{shared_folder(spark)}/{uuid.uuid4().hex}"
    scan.compact(trade(spark, sf), path, ("trading_day", "exchange", "instrument_id"))
    back = scan.scan_panel(spark, path, pattern="*.parquet")
    return rounded(back, ["exchange", "instrument_id", "trading_day"], ["amount", "volume"])


@query(
    "operator_aliases",
    f"""WITH {trade_sql()}, s AS (SELECT *, CASE WHEN eligible THEN x END AS own, stddev_samp(x) OVER w AS d FROM trade WINDOW w AS {_window(5)}),
r AS (SELECT *, (rank() OVER (PARTITION BY trading_day ORDER BY own NULLS LAST) + (count(*) OVER (PARTITION BY trading_day, own) - 1) / 2)
  / count(own) OVER (PARTITION BY trading_day) AS k FROM s)
SELECT instrument_id, trading_day, {q6(_full("avg(x) OVER w", 5), "mean_")}, {q6(_full("d", 5), "std_")},
  {q6(_full("CASE WHEN d > 1e-12 THEN (x - avg(x) OVER w) / d END", 5), "zscore_")},
  {q6("CASE WHEN own IS NOT NULL THEN k END", "csrank_")}, {q6("CASE WHEN own IS NOT NULL THEN k END", "rank_")}
FROM r WINDOW w AS {_window(5)}""",
)
def operator_aliases(spark, sf):
    features = {
        "mean_": fx.mean(X, 5),
        "std_": fx.std(X, 5),
        "zscore_": fx.zscore(X, 5),
        "csrank_": fx.csrank(X),
        "rank_": fx.rank(X),
    }
    return rounded(trade_panel(spark, sf).with_features(features), KEY, list(features))
