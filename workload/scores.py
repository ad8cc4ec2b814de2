"""Targets, clipping and factor scoring on the monthly supplier panel."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from factorloom.functions import feature as fx
from factorloom.operators import scoring, targets
from factorloom.operators.blocks import frozen, group_limit
from factorloom.operators.panel import Panel
from factorloom.operators.ranks import attach_ranks
from factorloom.operators.wide import measured, wide_ic

from .base import FOLD, HISTORY, KEY, q6, query, r6, rounded, rows_of, table, trade_panel, trade_sql

FACTORS = {
    "momentum": fx.change(fx.field("price"), 1),
    "stretch": fx.ts_zscore(fx.field("x"), 6),
    "size": fx.cs_rank(fx.field("volume")),
}
NAMES = list(FACTORS)
STOCKS, FUTURES = scoring.CROSS_SECTIONAL, "time_series_weighted_pearson_ic"


def target_panel(spark, sf) -> Panel:
    """The monthly panel with one-month forward targets."""
    panel = trade_panel(spark, sf, "month")
    if panel.rows > group_limit(spark):
        # Sizes are measured then, and every reader would sum the lines again: the months are written once.
        panel = panel.with_df(frozen(panel.df))
    usable = F.col("volume").cast("long") % 17 != 0
    panel = panel.with_df(panel.df.withColumn("target_eligible", usable))
    return panel.with_df(targets.build_targets(panel, "price", 1))


def scored_panel(spark, sf) -> Panel:
    panel = target_panel(spark, sf)
    return panel.with_df(panel.with_features(FACTORS))


TARGETS = f"""{trade_sql("month")},
tg AS (SELECT *, CASE WHEN count(*) FILTER (WHERE CAST(volume AS BIGINT) % 17 <> 0) OVER w = 2
    THEN ln(lead(price) OVER o / price) END AS target, lead(trading_day) OVER o AS target_end
  FROM trade WINDOW o AS ({HISTORY}), w AS ({HISTORY} ROWS BETWEEN CURRENT ROW AND 1 FOLLOWING))"""
SCORED = f"""{TARGETS},
f0 AS (SELECT *, CASE WHEN count(price) OVER w2 = 2 THEN price / lag(price) OVER o - 1 END AS momentum,
    CASE WHEN count(x) OVER w6 = 6 AND stddev_samp(x) OVER w6 > 1e-12 THEN (x - avg(x) OVER w6) / stddev_samp(x) OVER w6 END AS stretch,
    CASE WHEN eligible THEN volume END AS ev
  FROM tg WINDOW o AS ({HISTORY}), w2 AS ({HISTORY} ROWS BETWEEN 1 PRECEDING AND CURRENT ROW),
    w6 AS ({HISTORY} ROWS BETWEEN 5 PRECEDING AND CURRENT ROW)),
f AS (SELECT *, CASE WHEN ev IS NOT NULL THEN (rank() OVER (PARTITION BY trading_day ORDER BY ev NULLS LAST)
    + (count(*) OVER (PARTITION BY trading_day, ev) - 1) / 2) / count(ev) OVER (PARTITION BY trading_day) END AS size FROM f0),
l AS (SELECT * FROM (SELECT *, CASE
    WHEN trading_day BETWEEN DATE '{FOLD.train.start}' AND DATE '{FOLD.train.end}' AND target_end BETWEEN DATE '{FOLD.train.start}' AND DATE '{FOLD.train.end}' THEN 'train'
    WHEN trading_day BETWEEN DATE '{FOLD.val.start}' AND DATE '{FOLD.val.end}' AND target_end BETWEEN DATE '{FOLD.val.start}' AND DATE '{FOLD.val.end}' THEN 'val'
    WHEN trading_day BETWEEN DATE '{FOLD.test.start}' AND DATE '{FOLD.test.end}' AND target_end BETWEEN DATE '{FOLD.test.start}' AND DATE '{FOLD.test.end}' THEN 'test'
    END AS split FROM f WHERE eligible AND target IS NOT NULL) WHERE split IS NOT NULL),
long AS ({" UNION ALL ".join(f"SELECT '{n}' AS factor, split, trading_day, product, instrument_id, {n} AS value, target FROM l" for n in NAMES)}),
bounds AS (SELECT factor, quantile_cont(value, 0.01) AS lo, quantile_cont(value, 0.99) AS hi FROM long WHERE split = 'train' GROUP BY 1),
tb AS (SELECT quantile_cont(target, 0.01) AS lo, quantile_cont(target, 0.99) AS hi FROM l WHERE split = 'train'),
clipped AS (SELECT factor, split, trading_day, product, instrument_id,
    CASE WHEN value IS NOT NULL AND b.lo IS NOT NULL THEN least(greatest(value, b.lo), b.hi) END AS value, least(greatest(target, tb.lo), tb.hi) AS target
  FROM long JOIN bounds b USING (factor), tb)"""


def ranked_sql(source: str, by: str, name: str) -> str:
    return f"""{name}r AS (SELECT *, rank() OVER (PARTITION BY {by} ORDER BY value) + (count(*) OVER (PARTITION BY {by}, value) - 1) / 2 AS rx,
    rank() OVER (PARTITION BY {by} ORDER BY target) + (count(*) OVER (PARTITION BY {by}, target) - 1) / 2 AS ry
  FROM {source} WHERE value IS NOT NULL),
{name} AS (SELECT {by}, count(*) AS n, corr(value, target) AS pearson, corr(rx, ry) AS spearman
  FROM {name}r GROUP BY {by} HAVING count(*) >= 5 AND min(value) < max(value) AND min(target) < max(target))"""


WEIGHTS = "pw AS (" + " UNION ALL ".join(
    f"""SELECT '{s}' AS split, product, sqrt(sum(amount)) AS weight FROM tg
  WHERE eligible AND trading_day BETWEEN DATE '{getattr(FOLD, s).start}' AND DATE '{getattr(FOLD, s).end}' GROUP BY product HAVING sum(amount) > 0"""
    for s in ("train", "val", "test")
) + ")"


@query(
    "forward_targets",
    f"WITH {TARGETS} SELECT instrument_id, trading_day, target_end, {q6('target', 'target')} FROM tg",
)
def forward_targets(spark, sf):
    return rounded(target_panel(spark, sf).df, [*KEY, "target_end"], ["target"])


@query("split_rows", f"WITH {SCORED} SELECT instrument_id, trading_day, target_end, {q6('target', 'target')} FROM l WHERE split = 'train'")
def split_rows(spark, sf):
    rows = targets.split_rows(target_panel(spark, sf).df, FOLD.train)
    return rounded(rows, [*KEY, "target_end"], ["target"])


@query(
    "clip_bounds",
    f"""WITH {SCORED} SELECT factor, {q6("lo", "lower")}, {q6("hi", "upper")} FROM bounds
UNION ALL SELECT 'target', {q6("lo")}, {q6("hi")} FROM tb""",
)
def clip_bounds(spark, sf):
    panel = scored_panel(spark, sf)
    train = targets.split_rows(panel.df, FOLD.train)
    bounds = scoring.fit_bounds(train, [*NAMES, "target"], (0.01, 0.99), panel.rows)
    return rounded(bounds, ["factor"], ["lower", "upper"])


@query(
    "clipped_scores",
    f"WITH {SCORED} SELECT factor, split, instrument_id, trading_day, {q6('value', 'value')}, {q6('target', 'target')} FROM clipped WHERE split <> 'test'",
)
def clipped_scores(spark, sf):
    panel = scored_panel(spark, sf)
    labelled = scoring.label_splits(panel.df, FOLD)
    train = labelled.where("split = 'train'")
    bounds = scoring.fit_bounds(train, NAMES, (0.01, 0.99), panel.rows)
    ends = targets.clip_bounds(train, ["target"], rows=panel.rows)
    long = scoring.long_scores(labelled, NAMES, ["split", *KEY, "target"])
    return rounded(scoring.clip_scores(long, bounds, ends), ["factor", "split", *KEY], ["value", "target"])


@query("product_weights", f"WITH {TARGETS}, {WEIGHTS} SELECT product, {q6('weight', 'weight')} FROM pw WHERE split = 'train'")
def product_weights(spark, sf):
    return rounded(scoring.product_weights(target_panel(spark, sf).df, FOLD.train), ["product"], ["weight"])


@query(
    "ic_momentum",
    f"""WITH {SCORED}, raw AS (SELECT * FROM long WHERE factor = 'momentum' AND split = 'train'),
{ranked_sql("raw", "trading_day", "g")}
SELECT count(spearman) AS months, {q6("avg(spearman)", "mean_rank_ic")} FROM g""",
)
def ic_momentum(spark, sf):
    """Mean monthly rank IC of one-month price momentum: scan, rolling, target, rank, score."""
    panel = target_panel(spark, sf)
    wide = panel.with_features({"momentum": FACTORS["momentum"]})
    rows = targets.split_rows(wide, FOLD.train).withColumnRenamed("momentum", "value")
    groups = scoring.group_ic(rows, [], "trading_day", ("spearman",), panel.rows)
    return groups.agg(F.count("spearman").alias("months"), r6(F.avg("spearman")).alias("mean_rank_ic"))


def _groups(spark, sf, group: str) -> DataFrame:
    panel = scored_panel(spark, sf)
    labelled = scoring.label_splits(panel.df, FOLD).select("split", group, "target", *NAMES)
    return measured(wide_ic(frozen(labelled), NAMES, ["split", group], rows=panel.rows))


@query(
    "ic_by_month",
    f"""WITH {SCORED}, v AS (SELECT * FROM long WHERE split <> 'test'), {ranked_sql("v", "factor, split, trading_day", "g")}
SELECT factor, split, trading_day, n, {q6("pearson", "pearson")}, {q6("spearman", "spearman")} FROM g""",
)
def ic_by_month(spark, sf):
    groups = _groups(spark, sf, "trading_day")
    return rounded(groups, ["factor", "split", "trading_day", "n"], ["pearson", "spearman"])


@query(
    "ic_by_product",
    f"""WITH {SCORED}, v AS (SELECT * FROM long WHERE split <> 'test'), {ranked_sql("v", "factor, split, product", "g")}
SELECT factor, split, product, n, {q6("pearson", "pearson")}, {q6("spearman", "spearman")} FROM g""",
)
def ic_by_product(spark, sf):
    groups = _groups(spark, sf, "product")
    return rounded(groups, ["factor", "split", "product", "n"], ["pearson", "spearman"])


def _aggregate_sql(group: str, metrics: list[tuple[str, str, bool]], source: str = "clipped") -> str:
    """Long metrics per factor and split, then pivoted and directed like the evaluation."""
    parts = []
    for name, kind, weighted in metrics:
        if weighted:
            parts.append(
                f"""SELECT factor, split, '{name}' AS metric, sum({kind} * weight) / sum(weight) AS value, CAST(sum(n) AS BIGINT) AS n_obs, count(*) AS n_groups
  FROM g JOIN pw USING (split, product) WHERE {kind} IS NOT NULL GROUP BY 1, 2"""
            )
        else:
            parts.append(
                f"""SELECT factor, split, '{name}' AS metric, avg({kind}) AS value, CAST(sum(n) AS BIGINT) AS n_obs, count(*) AS n_groups
  FROM g WHERE {kind} IS NOT NULL GROUP BY 1, 2"""
            )
    return f"""v AS (SELECT * FROM {source} WHERE split <> 'test'), {ranked_sql("v", f"factor, split, {group}", "g")},
agg AS ({" UNION ALL ".join(parts)}),
wide AS (SELECT factor, metric, max(value) FILTER (WHERE split = 'train') AS train, max(value) FILTER (WHERE split = 'val') AS val_raw,
    max(n_obs) FILTER (WHERE split = 'train') AS train_n_obs, max(n_groups) FILTER (WHERE split = 'train') AS train_n_groups,
    max(n_obs) FILTER (WHERE split = 'val') AS val_n_obs, max(n_groups) FILTER (WHERE split = 'val') AS val_n_groups FROM agg GROUP BY 1, 2),
dir AS (SELECT factor, CASE WHEN train < 0 THEN -1 WHEN train IS NOT NULL THEN 1 END AS direction, val_raw AS primary_val FROM wide WHERE metric = '{metrics[0][0]}'),
cov AS (SELECT factor, avg(CASE WHEN value IS NOT NULL THEN 1.0 ELSE 0.0 END) AS coverage FROM long WHERE split = 'val' GROUP BY 1)
SELECT factor, metric, {q6("train", "train")}, {q6("val_raw", "val_raw")}, {q6("val_raw * direction", "val")}, {q6("coverage", "coverage")},
  CAST(direction AS BIGINT) AS direction, train_n_obs, train_n_groups, val_n_obs, val_n_groups, 'success' AS status
FROM wide JOIN dir USING (factor) JOIN cov USING (factor)"""


def _evaluated(spark, sf, metric: str) -> DataFrame:
    panel = scored_panel(spark, sf)
    result = scoring.evaluate_factors(panel.df, NAMES, FOLD, metric, rows=panel.rows)
    counts = ["train_n_obs", "train_n_groups", "val_n_obs", "val_n_groups"]
    return result.select(
        "factor",
        "metric",
        *[r6(c).alias(c) for c in ("train", "val_raw", "val", "coverage")],
        F.col("direction").cast("long").alias("direction"),
        *counts,
        "status",
    )


@query(
    "evaluate_stocks",
    f"WITH {SCORED}, {_aggregate_sql('trading_day', scoring.metric_names(STOCKS))}",
)
def evaluate_stocks(spark, sf):
    return _evaluated(spark, sf, STOCKS)


@query(
    "evaluate_futures",
    f"WITH {SCORED}, {WEIGHTS}, {_aggregate_sql('product', scoring.metric_names(FUTURES))}",
)
def evaluate_futures(spark, sf):
    return _evaluated(spark, sf, FUTURES)


def _train_long(spark, sf) -> tuple[DataFrame, Panel]:
    panel = scored_panel(spark, sf)
    rows = targets.split_rows(panel.df, FOLD.train)
    return scoring.long_scores(rows, NAMES, ["trading_day", "product", "target"]), panel


DAILY = f"""{SCORED}, v AS (SELECT * FROM long WHERE split = 'train'), {ranked_sql("v", "factor, trading_day", "g")}"""


@query(
    "daily_ic",
    f"WITH {DAILY} SELECT factor, trading_day, {q6('spearman', 'ic')} FROM g",
)
def daily_ic(spark, sf):
    long, panel = _train_long(spark, sf)
    return rounded(scoring.daily_ic(long, ["factor"], STOCKS, rows=panel.rows), ["factor", "trading_day"], ["ic"])


@query(
    "daily_ic_futures",
    f"""WITH {SCORED}, {WEIGHTS}, q AS (SELECT *, 'all' AS one FROM long WHERE split = 'train'),
p AS (SELECT factor, trading_day, product, corr(value, target) AS ic FROM (SELECT * FROM q WHERE value IS NOT NULL)
  GROUP BY 1, 2, 3 HAVING count(*) >= 5 AND min(value) < max(value) AND min(target) < max(target))
SELECT factor, trading_day, {q6("sum(ic * weight) / sum(weight)", "ic")} FROM p JOIN pw ON pw.product = p.product AND pw.split = 'train' GROUP BY 1, 2""",
)
def daily_ic_futures(spark, sf):
    long, panel = _train_long(spark, sf)
    weights = scoring.product_weights(panel.df, FOLD.train)
    daily = scoring.daily_ic(long, ["factor"], FUTURES, weights, panel.rows)
    return rounded(daily, ["factor", "trading_day"], ["ic"])


@query(
    "icir",
    f"""WITH {DAILY}
SELECT factor, {q6("CASE WHEN count(spearman) >= 2 AND stddev_samp(spearman) > 1e-12 THEN avg(spearman) / stddev_samp(spearman) END", "icir")},
  count(spearman) AS icir_days FROM g GROUP BY 1""",
)
def icir(spark, sf):
    long, panel = _train_long(spark, sf)
    daily = scoring.daily_ic(long, ["factor"], STOCKS, rows=panel.rows)
    ratio = scoring.information_ratio(daily, ["factor"])
    return ratio.select("factor", r6("icir").alias("icir"), "icir_days")


_IN_TRAIN = f"trading_day BETWEEN DATE '{FOLD.train.start}' AND DATE '{FOLD.train.end}'"
_HELD = " UNION ALL ".join(
    f"SELECT '{n}' AS factor, exchange, product, instrument_id, trading_day, eligible, {n} AS value, target, target_end FROM f WHERE {_IN_TRAIN}"
    for n in NAMES
)


@query(
    "signed_turnover",
    f"""WITH {SCORED}, {WEIGHTS}, h AS ({_HELD}),
p AS (SELECT *, CASE WHEN eligible THEN sign(value) END AS pos FROM h),
c AS (SELECT *, abs(pos - lag(pos) OVER (PARTITION BY factor, exchange, instrument_id ORDER BY trading_day)) / 2 AS change FROM p),
g AS (SELECT factor, product, avg(change) AS change, count(change) AS n FROM c WHERE change IS NOT NULL GROUP BY 1, 2)
SELECT factor, {q6("sum(change * weight) / sum(weight)", "turnover")}, CAST(sum(n) AS BIGINT) AS turnover_observations
FROM g JOIN pw ON pw.product = g.product AND pw.split = 'train' GROUP BY 1""",
)
def signed_turnover(spark, sf):
    panel = scored_panel(spark, sf)
    weights = scoring.product_weights(panel.df, FOLD.train)
    held = scoring.signed_turnover(panel, NAMES, FOLD.train, weights)
    return held.select("factor", r6("turnover").alias("turnover"), "turnover_observations")


@query(
    "rank_turnover",
    f"""WITH {SCORED}, h AS ({_HELD}),
s AS (SELECT trading_day, row_number() OVER (ORDER BY trading_day) AS step FROM (SELECT DISTINCT trading_day FROM h)),
e AS (SELECT h.*, step, coalesce(value, 0) AS filled FROM h JOIN s USING (trading_day) WHERE eligible),
ok AS (SELECT factor, step FROM e GROUP BY 1, 2 HAVING count(value) = count(*) AND count(*) >= 5),
r AS (SELECT e.*, rank() OVER (PARTITION BY factor, step ORDER BY filled) + (count(*) OVER (PARTITION BY factor, step, filled) - 1) / 2 AS k
  FROM e JOIN ok USING (factor, step)),
c AS (SELECT *, k - avg(k) OVER (PARTITION BY factor, step) AS d FROM r),
p AS (SELECT factor, step, instrument_id, coalesce(d / nullif(sum(abs(d)) OVER (PARTITION BY factor, step), 0), 0) AS pos FROM c),
adj AS (SELECT a.factor, a.step FROM ok a JOIN ok b ON a.factor = b.factor AND a.step = b.step + 1),
m AS (SELECT coalesce(a.factor, b.factor) AS factor, coalesce(a.step, b.step + 1) AS step, abs(coalesce(a.pos, 0) - coalesce(b.pos, 0)) / 2 AS change
  FROM p a FULL JOIN p b ON a.factor = b.factor AND a.step = b.step + 1 AND a.instrument_id = b.instrument_id),
t AS (SELECT factor, step, sum(change) AS change FROM m JOIN adj USING (factor, step) GROUP BY 1, 2)
SELECT n.factor, {q6("avg(change)", "turnover")}, count(change) AS turnover_observations
FROM (VALUES {", ".join(f"('{n}')" for n in NAMES)}) n(factor) LEFT JOIN t ON t.factor = n.factor GROUP BY 1""",
)
def rank_turnover(spark, sf):
    panel = scored_panel(spark, sf)
    held = scoring.rank_turnover(panel.df, NAMES, FOLD.train, rows=panel.rows)
    return held.select("factor", r6("turnover").alias("turnover"), "turnover_observations")


@query(
    "lag_diagnostics",
    f"""WITH {SCORED}, h AS ({_HELD}),
s AS (SELECT trading_day, row_number() OVER (ORDER BY trading_day) AS step FROM (SELECT DISTINCT trading_day FROM h)),
d AS (SELECT h.*, CASE WHEN step - lag(step) OVER w = 1 THEN lag(CASE WHEN eligible THEN value END) OVER w END AS late
  FROM h JOIN s USING (trading_day) WINDOW w AS (PARTITION BY factor, exchange, instrument_id ORDER BY trading_day)),
u AS (SELECT factor, 'now' AS which, trading_day, value, target, target_end, eligible FROM d
  UNION ALL SELECT factor, 'lag', trading_day, late, target, target_end, eligible FROM d),
v AS (SELECT * FROM u WHERE eligible AND target IS NOT NULL AND target_end BETWEEN DATE '{FOLD.train.start}' AND DATE '{FOLD.train.end}'),
{ranked_sql("v", "factor, which, trading_day", "g")},
a AS (SELECT factor, avg(spearman) FILTER (WHERE which = 'now') AS rank_ic, avg(spearman) FILTER (WHERE which = 'lag') AS lag1_rank_ic,
    CAST(sum(n) FILTER (WHERE which = 'lag') AS BIGINT) AS lag1_n_obs,
    avg(spearman) FILTER (WHERE which = 'now') / stddev_samp(spearman) FILTER (WHERE which = 'now') AS rank_icir,
    count(*) FILTER (WHERE which = 'now') AS rank_icir_days FROM g GROUP BY 1)
SELECT factor, {q6("rank_ic", "rank_ic")}, {q6("lag1_rank_ic", "lag1_rank_ic")}, lag1_n_obs, {q6("rank_icir", "rank_icir")}, rank_icir_days,
  {q6("greatest(0, rank_ic - lag1_rank_ic)", "lag1_gap")} FROM a""",
)
def lag_diagnostics(spark, sf):
    result = scoring.lag_diagnostics(scored_panel(spark, sf), NAMES, FOLD.train, STOCKS)
    values = ["rank_ic", "lag1_rank_ic", "rank_icir", "lag1_gap"]
    return result.select("factor", *[r6(v).alias(v) for v in values], "lag1_n_obs", "rank_icir_days")


PAIRS = [("momentum", "stretch"), ("momentum", "size"), ("stretch", "size")]


@query(
    "factor_correlations",
    f"""WITH {SCORED}, {WEIGHTS}, t AS (SELECT * FROM l WHERE split = 'train'),
u AS ({" UNION ALL ".join(f"SELECT '{a}' AS a, '{b}' AS b, product, {a} AS value, {b} AS target FROM t WHERE {a} IS NOT NULL AND {b} IS NOT NULL" for a, b in PAIRS)}),
g AS (SELECT a, b, product, count(*) AS n, corr(value, target) AS r FROM u GROUP BY 1, 2, 3
  HAVING count(*) >= 5 AND min(value) < max(value) AND min(target) < max(target))
SELECT a AS "left", b AS "right", {q6("sum(r * weight) / sum(weight)", "correlation")}, CAST(sum(n) AS BIGINT) AS overlap
FROM g JOIN pw ON pw.product = g.product AND pw.split = 'train' GROUP BY 1, 2""",
)
def factor_correlations(spark, sf):
    panel = scored_panel(spark, sf)
    train = targets.split_rows(panel.df, FOLD.train)
    weights = scoring.product_weights(panel.df, FOLD.train)
    pairs = scoring.factor_correlations(train, PAIRS, FUTURES, 10, weights, panel.rows)
    return pairs.select("left", "right", r6("correlation").alias("correlation"), "overlap")


@query(
    "prediction_errors",
    f"""WITH {SCORED}, v AS (SELECT split, target AS y, momentum / 10 AS p, 0.001 AS b, amount AS w FROM l WHERE momentum IS NOT NULL)
SELECT split, count(*) AS n, {q6("sum(w * (y - p) * (y - p)) / sum(w)", "mse")}, {q6("sum(w * (y - b) * (y - b)) / sum(w)", "baseline_mse")},
  {q6("1 - sum(w * (y - p) * (y - p)) / sum(w * (y - b) * (y - b))", "relative_mse_reduction")}, {q6("ln(sum(w))", "log_weight")}
FROM v GROUP BY 1""",
)
def prediction_errors(spark, sf):
    panel = scored_panel(spark, sf)
    rows = scoring.label_splits(panel.df, FOLD, ("train", "val", "test")).where("momentum IS NOT NULL")
    rows = rows.withColumns({"p": F.col("momentum") / 10, "b": F.lit(0.001)})
    report = scoring.prediction_errors(rows, "target", "p", "b", "amount", ["split"])
    values = ["mse", "baseline_mse", "relative_mse_reduction"]
    return report.select("split", "n", *[r6(v).alias(v) for v in values], r6(F.ln("weight_sum")).alias("log_weight"))


@query(
    "pooled_ranks",
    """SELECT l_orderkey, l_linenumber, l_partkey, l_quantity,
  CAST(rank() OVER (ORDER BY l_quantity) + (count(*) OVER (PARTITION BY l_quantity) - 1) / 2 AS DOUBLE) AS pooled_rank FROM lineitem""",
)
def pooled_ranks(spark, sf):
    """Average ranks over the whole table, through distinct counts instead of one global window."""
    lines = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_quantity")
    return attach_ranks(lines, [], "l_quantity", "pooled_rank", split=True)


FROZEN = [("momentum", 1, -0.4, 0.6), ("stretch", -1, -1.5, 1.5), ("size", 1, 0.05, 0.95)]


def frozen_members(spark) -> DataFrame:
    return spark.createDataFrame(FROZEN, "factor string, direction int, lower double, upper double")


def _frozen_sql(by_year: bool) -> str:
    rows = ", ".join(f"('{f}', {d}, {lo}, {hi})" for f, d, lo, hi in FROZEN)
    year = ", year(trading_day) AS year" if by_year else ""
    by = "factor, year" if by_year else "factor"
    names = scoring.metric_names(FUTURES)
    parts = []
    for name, kind, weighted in names:
        value = f"sum({kind} * weight) / sum(weight)" if weighted else f"avg({kind})"
        join = "JOIN pw ON pw.product = g.product AND pw.split = 'test'" if weighted else ""
        parts.append(
            f"SELECT {by}, '{name}' AS metric, {value} AS value, CAST(sum(n) AS BIGINT) AS n_obs, count(*) AS n_groups FROM g {join} WHERE {kind} IS NOT NULL GROUP BY {by}"
        )
    return f"""{SCORED}, {WEIGHTS}, lib(factor, direction, lo, hi) AS (VALUES {rows}),
raw AS (SELECT factor, product, trading_day, value AS rv, direction * least(greatest(value, lo), hi) AS value, target{year}
  FROM long JOIN lib USING (factor) WHERE split = 'test'),
v AS (SELECT factor, product, target, CASE WHEN rv IS NOT NULL THEN value END AS value{", year" if by_year else ""} FROM raw),
{ranked_sql("v", f"{by}, product", "g")},
agg AS ({" UNION ALL ".join(parts)}),
cov AS (SELECT {by}, avg(CASE WHEN rv IS NOT NULL THEN 1.0 ELSE 0.0 END) AS coverage FROM raw GROUP BY {by})"""


@query(
    "frozen_scores_by_year",
    f"""WITH {_frozen_sql(True)}
SELECT factor, CAST(year AS BIGINT) AS year, metric, {q6("value", "value")}, n_obs, n_groups, {q6("coverage", "coverage")} FROM agg JOIN cov USING (factor, year)""",
)
def frozen_scores_by_year(spark, sf):
    panel = scored_panel(spark, sf)
    scored = scoring.score_frozen(panel.df, frozen_members(spark), NAMES, FOLD.test, FUTURES, by_year=True, rows=panel.rows)
    return scored.select(
        "factor", F.col("year").cast("long").alias("year"), "metric", r6("value").alias("value"), "n_obs", "n_groups", r6("coverage").alias("coverage")
    )


@query(
    "frozen_library_summary",
    f"""WITH {_frozen_sql(False)}
SELECT metric, {q6("avg(value)", "mean")}, {q6("quantile_cont(value, 0.5)", "median")}, count(*) FILTER (WHERE value > 0) AS positive,
  count(value) AS defined, {q6("count(*) FILTER (WHERE value > 0) / count(value)", "positive_share")}, count(*) AS factors FROM agg GROUP BY 1""",
)
def frozen_library_summary(spark, sf):
    panel = scored_panel(spark, sf)
    scored = scoring.score_frozen(panel.df, frozen_members(spark), NAMES, FOLD.test, FUTURES, rows=panel.rows)
    summary = scoring.library_summary(scored)
    values = ["mean", "median", "positive_share"]
    return summary.select("metric", *[r6(v).alias(v) for v in values], "positive", "defined", "factors")
