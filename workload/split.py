"""Registered queries once more on the side that groups above the row limit take.

The row limit is set low while a query's plan is made, so that its histories, cross-sections and
groups are evaluated in blocks with carries and joined statistics.  The SQL is the same.
"""

from __future__ import annotations

from factorloom.operators.blocks import LIMIT_CONF

from .base import ORACLE, QUERIES, query

ROWS = 200

OPERATORS = (
    "cs_rank",
    "cs_scaling",
    "cs_winsorize",
    "cs_lagged_mean",
    "cs_lagged_spread",
    "pooled_ranks",
    "clip_bounds",
    "asof_events",
    "segments",
    "ts_sums",
    "ts_quantiles",
    "forward_targets",
    "rank_turnover",
    "pairwise_spearman",
    "ic_by_month",
    "lag_diagnostics",
    "daily_ic",
    "paired_products",
    "discovery_curve",
    "band_status",
)


def _register(name: str) -> None:
    def run(spark, sf):
        before = spark.conf.get(LIMIT_CONF, None)
        spark.conf.set(LIMIT_CONF, str(ROWS))
        try:
            return QUERIES[name](spark, sf)
        finally:
            spark.conf.unset(LIMIT_CONF) if before is None else spark.conf.set(LIMIT_CONF, before)

    query(f"{name}_split", ORACLE[name])(run)


for _name in OPERATORS:
    _register(_name)
