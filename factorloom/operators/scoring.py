"""Scoring many factors in one job: information coefficients, stability and turnover.

Factors are columns of a wide panel; `long_scores` turns them into rows, so every metric is one
grouped aggregation keyed by factor.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.guards import EPS, corr_agg, finite, flag, guarded_corr, is_finite, ratio
from .blocks import DAY_ROWS, frozen, join_stats, oversized
from .panel import Panel
from .portfolio import clock
from .radix import pooled_quantiles
from .ranks import attach_ranks
from .targets import DateRange, Fold, clipped, split_rows
from .wide import MIN_OBSERVATIONS, Clipping, measured, wide_ic

# Columns that one plan can reasonably carry; bounds every frame keyed by factor.
FACTOR_ROWS = 10_000
CROSS_SECTIONAL = "cross_sectional_spearman"
TIME_SERIES = (
    "time_series_equal_pearson_ic",
    "time_series_weighted_pearson_ic",
    "time_series_equal_spearman_ic",
    "time_series_weighted_spearman_ic",
)


def metric_group(metric: str) -> str:
    """Stocks correlate within a day, futures within a product."""
    if metric == CROSS_SECTIONAL:
        return "trading_day"
    if metric in TIME_SERIES:
        return "product"
    raise ValueError(f"unsupported metric {metric}")


def primary_kind(metric: str) -> str:
    return "pearson" if "pearson" in metric else "spearman"


def _other(kind: str) -> str:
    return "spearman" if kind == "pearson" else "pearson"


def _weights(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    amount = F.col("amount").cast("double")
    usable = F.when(is_finite(amount) & (amount >= 0), amount)
    return (
        df.where(flag(F.col("eligible")))
        .groupBy(*keys)
        .agg(F.sqrt(F.sum(usable)).alias("weight"))
        .where(is_finite(F.col("weight")) & (F.col("weight") > 0))
    )


def product_weights(df: DataFrame, period: DateRange, day: str = "trading_day") -> DataFrame:
    """Square root of each product's eligible amount in the period; positive ones only."""
    return _weights(df.where(period.holds(day)), ["product"])


def split_weights(
    df: DataFrame, fold: Fold, splits: Sequence[str], day: str = "trading_day"
) -> DataFrame:
    """The weights of several (disjoint) periods in one pass, with the `split` they belong to."""
    label = None
    for s in splits:
        rule = getattr(fold, s).holds(day)
        label = F.when(rule, s) if label is None else label.when(rule, s)
    marked = df.withColumn("split", label).where(F.col("split").isNotNull())
    return _weights(marked, ["split", "product"])


def long_scores(df: DataFrame, factors: Sequence[str], keep: Sequence[str]) -> DataFrame:
    """Rows of (keep..., factor, value); a single projection, no shuffle."""
    return df.unpivot(list(keep), list(factors), "factor", "value")


def group_ic(
    long: DataFrame,
    by: Sequence[str],
    group: str,
    kinds: Sequence[str] = ("pearson", "spearman"),
    rows: int | None = None,
) -> DataFrame:
    """Correlation of value and target per (by, group) over jointly finite rows.

    Groups need five rows and variation on both sides.  Spearman ranks are taken inside the group,
    with the split form when a group exceeds a task.
    """
    keys = [*by, group]
    scored = long.where(is_finite(F.col("value")) & is_finite(F.col("target")))
    aggregates = [
        F.count(F.lit(1)).alias("n"),
        (F.min("value") < F.max("value")).alias("__vx"),
        (F.min("target") < F.max("target")).alias("__vy"),
    ]
    if "pearson" in kinds:
        aggregates.append(corr_agg("value", "target").alias("pearson"))
    if "spearman" in kinds:
        split = oversized(scored, keys, rows)
        scored = scored.select(*keys, "value", "target")
        scored = attach_ranks(scored, keys, "value", "__rx", split=split)
        scored = attach_ranks(scored, keys, "target", "__ry", split=split)
        aggregates.append(corr_agg("__rx", "__ry").alias("spearman"))
    return (
        scored.groupBy(*keys)
        .agg(*aggregates)
        .where((F.col("n") >= MIN_OBSERVATIONS) & F.col("__vx") & F.col("__vy"))
        .drop("__vx", "__vy")
    )


def _clamp(c: Column) -> Column:
    return F.greatest(F.lit(-1.0), F.least(F.lit(1.0), c))


def metric_names(metric: str) -> list[tuple[str, str, bool]]:
    """(name, correlation kind, weighted) of everything reported next to the primary metric."""
    names = []
    for kind in (primary_kind(metric), _other(primary_kind(metric))):
        if metric == CROSS_SECTIONAL:
            names.append((f"cross_sectional_{kind}", kind, False))
            continue
        first = "_weighted_" in metric
        for weighted in (first, not first):
            word = "weighted" if weighted else "equal"
            names.append((f"time_series_{word}_{kind}_ic", kind, weighted))
    return names


def aggregate_ic(
    groups: DataFrame, by: Sequence[str], metric: str, weights: DataFrame | None = None
) -> DataFrame:
    """Long metrics: one row per (by, metric) with value, n_obs and n_groups.

    Equal metrics average the groups; weighted ones normalise the product weights over the groups
    that were observed.
    """
    group = metric_group(metric)
    staged = groups
    if weights is not None:
        on = [c for c in (*by, group) if c in weights.columns]
        staged = join_stats(groups, weights, on)
    else:
        staged = staged.withColumn("weight", F.lit(None).cast("double"))
    parts = []
    for name, kind, weighted in metric_names(metric):
        ic = F.col(kind)
        if weighted:
            use = ic.isNotNull() & F.col("weight").isNotNull()
            value = ratio(F.sum(F.when(use, ic * F.col("weight"))), F.sum(F.when(use, F.col("weight"))))
        else:
            use = ic.isNotNull()
            value = F.avg(ic)
        n = F.coalesce(F.sum(F.when(use, F.col("n"))), F.lit(0)).alias("n_obs")
        parts.append(
            F.struct(
                F.lit(name).alias("metric"),
                F.when(value.isNotNull(), _clamp(value)).alias("value"),
                n,
                F.count_if(use).alias("n_groups"),
            ).alias(f"__m{len(parts)}")
        )
    packed = staged.groupBy(*by).agg(*parts)
    rows = packed.select(*by, F.explode(F.array(*[F.col(f"__m{i}") for i in range(len(parts))])).alias("m"))
    return rows.select(*by, "m.*")


def fit_bounds(
    train: DataFrame, factors: Sequence[str], probabilities: Sequence[float], rows: int | None = None
) -> DataFrame:
    """Per factor the clipping bounds of its training values (factor, lower, upper); all columns in the same passes.

    `rows` is not needed and kept for callers.
    """
    ends = column_bounds(train, factors, probabilities)
    found = [(f, *(ends[f] or (None, None))) for f in factors]
    return train.sparkSession.createDataFrame(found, "factor string, lower double, upper double")


def column_bounds(
    train: DataFrame, columns: Sequence[str], probabilities: Sequence[float], written: bool = False
) -> dict[str, list[float] | None]:
    """Exact quantiles of the finite values of each column."""
    clean = train.select(*[finite(F.col(c).cast("double")).alias(c) for c in columns])
    return pooled_quantiles(clean, columns, probabilities, written=written)


def label_splits(df: DataFrame, fold: Fold, splits: Sequence[str] = ("train", "val")) -> DataFrame:
    """One scan: `split` is the period holding both the signal day and the target end."""
    chain = None
    for s in splits:
        period = getattr(fold, s)
        rule = period.holds("trading_day") & period.holds("target_end")
        chain = F.when(rule, s) if chain is None else chain.when(rule, s)
    usable = flag(F.col("eligible")) & is_finite(F.col("target"))
    return df.withColumn("split", F.when(usable, chain)).where(F.col("split").isNotNull())


def clip_scores(
    long: DataFrame, bounds: DataFrame | None, target_bounds: DataFrame | None
) -> DataFrame:
    """Clip value and target with fitted bounds; the bound frames have one row per factor / one row."""
    if bounds is None:
        return long
    # One row per factor; factors are columns of one plan, so their number is small.
    joined = join_stats(long, bounds, ["factor"], FACTOR_ROWS)
    joined = joined.withColumn("value", clipped(F.col("value"), F.col("lower"), F.col("upper")))
    joined = joined.drop("lower", "upper")
    if target_bounds is not None:
        one = target_bounds.select(
            F.lit(1).alias("__one"),
            F.col("target_lower").alias("__tl"),
            F.col("target_upper").alias("__tu"),
        )
        joined = join_stats(joined.withColumn("__one", F.lit(1)), one, ["__one"], 1)
        joined = joined.withColumn("target", clipped(F.col("target"), F.col("__tl"), F.col("__tu")))
        joined = joined.drop("__one", "__tl", "__tu")
    return joined


def evaluate_factors(
    df: DataFrame,
    factors: Sequence[str],
    fold: Fold,
    metric: str,
    probabilities: Sequence[float] | None = (0.01, 0.99),
    rows: int | None = None,
) -> DataFrame:
    """Directed metrics of all factors on train and val, from one scan of the panel.

    `df` carries trading_day, eligible, target, target_end and, for futures, product and amount.
    Columns: factor, metric, train, val_raw, val, n_obs / n_groups per split, direction, coverage,
    status.  The direction is the sign of the primary training value.
    """
    group = metric_group(metric)
    weights = split_weights(df, fold, ("train", "val")) if metric in TIME_SERIES else None
    # Bounds and correlations read the scoring rows in turn, so they are written once.
    labelled = frozen(label_splits(df, fold).select("split", group, "target", *factors))
    clipping = Clipping()
    if probabilities is not None:
        # The target rides along as one more column.
        train = labelled.where(F.col("split") == "train")
        ends = column_bounds(train, [*factors, "target"], probabilities, written=True)
        # Without training targets there is no training metric and so no direction.
        clipping = Clipping(ends, ends["target"] or (0.0, 0.0))
    # One row per group and factor.
    found = frozen(wide_ic(labelled, factors, ["split", group], clipping, rows))
    val = F.col("split") == "val"
    shares = found.groupBy("factor").agg(
        F.try_divide(F.sum(F.when(val, F.col("seen"))), F.sum(F.when(val, F.col("rows")))).alias("coverage"),
        (F.min("low") == F.max("high")).alias("__constant"),
    )
    metrics = aggregate_ic(measured(found), ["factor", "split"], metric, weights)
    return directed_metrics(metrics, shares, metric, factors)


def directed_metrics(
    measured: DataFrame, shares: DataFrame, metric: str, factors: Sequence[str]
) -> DataFrame:
    """Pivot train / val, fix the direction on train and derive the status."""
    columns = []
    for s in ("train", "val"):
        mine = F.col("split") == s
        columns.append(F.max(F.when(mine, F.col("value"))).alias("train" if s == "train" else "val_raw"))
        for c in ("n_obs", "n_groups"):
            picked = F.max(F.when(mine, F.col(c)))
            columns.append(F.coalesce(picked, F.lit(0).cast("long")).alias(f"{s}_{c}"))
    wide = measured.groupBy("factor", "metric").agg(*columns)
    spark = measured.sparkSession
    names = [(f, n) for f in factors for n, _, _ in metric_names(metric)]
    # One row per factor and metric name: the size of the catalogue, not of the data.
    grid = spark.createDataFrame(names, "factor string, metric string")
    wide = join_stats(grid, wide, ["factor", "metric"], FACTOR_ROWS)
    first = wide.where(F.col("metric") == metric_names(metric)[0][0])
    direction = F.when(F.col("train") < 0, -1).when(F.col("train").isNotNull(), 1)
    primary = first.select(
        "factor", direction.alias("direction"), F.col("val_raw").alias("__val")
    )
    joined = join_stats(wide, primary, ["factor"], FACTOR_ROWS)
    joined = join_stats(joined, shares, ["factor"], FACTOR_ROWS)
    status = (
        F.when(F.col("__constant"), "constant_factor")
        .when(F.col("direction").isNull(), "undefined_train_metric")
        .when(F.col("__val").isNull(), "undefined_val_metric")
        .otherwise("success")
    )
    zero = {c: F.coalesce(c, F.lit(0).cast("long")) for c in (
        "train_n_obs", "train_n_groups", "val_n_obs", "val_n_groups")}
    return joined.withColumns(
        {**zero, "val": F.col("val_raw") * F.col("direction"), "status": status}
    ).drop("__val", "__constant")


def daily_ic(
    long: DataFrame, by: Sequence[str], metric: str, weights: DataFrame | None = None,
    rows: int | None = None,
) -> DataFrame:
    """One value per day; futures correlate inside (day, product) first, then combine products."""
    kind = primary_kind(metric)
    scored = long.where(is_finite(F.col("value")) & is_finite(F.col("target")))
    futures = metric in TIME_SERIES
    keys = [*by, "trading_day"] + (["product"] if futures else [])
    value, target = "value", "target"
    if kind == "spearman":
        split = oversized(scored, keys, rows)
        scored = attach_ranks(scored, keys, "value", "__rx", split=split)
        scored = attach_ranks(scored, keys, "target", "__ry", split=split)
        value, target = "__rx", "__ry"
    groups = (
        scored.groupBy(*keys)
        .agg(F.count(F.lit(1)).alias("n"), corr_agg(value, target).alias("ic"))
        .where((F.col("n") >= MIN_OBSERVATIONS) & F.col("ic").isNotNull())
    )
    days = [*by, "trading_day"]
    if not futures:
        return groups.select(*days, "ic")
    if "_weighted_" in metric:
        weighted = groups.join(weights, "product")
        mean = F.sum(F.col("ic") * F.col("weight")) / F.sum("weight")
        return weighted.groupBy(*days).agg(mean.alias("ic"))
    return groups.groupBy(*days).agg(F.avg("ic").alias("ic"))


def information_ratio(daily: DataFrame, by: Sequence[str], direction: DataFrame | None = None) -> DataFrame:
    """Mean over sample deviation of (directed) daily values; needs two days that vary."""
    if direction is not None:
        daily = daily.join(direction, list(by)).withColumn("ic", F.col("ic") * F.col("direction"))
    std = F.stddev_samp("ic")
    usable = (F.count("ic") >= 2) & (std > EPS)
    return daily.groupBy(*by).agg(
        F.when(usable, F.try_divide(F.avg("ic"), std)).alias("icir"), F.count("ic").alias("icir_days")
    )


def _every_factor(found: DataFrame, factors: Sequence[str], count: str) -> DataFrame:
    """One row per factor; those without an observation have a null value and a zero count."""
    names = found.sparkSession.createDataFrame([(f,) for f in factors], "factor string")
    joined = join_stats(names, found, ["factor"])
    return joined.withColumn(count, F.coalesce(count, F.lit(0).cast("long")))


def signed_turnover(
    panel: Panel,
    factors: Sequence[str],
    period: DateRange,
    weights: DataFrame | None = None,
) -> DataFrame:
    """Futures: half the mean change of the factor's sign per product, inside segments.

    With weights the products are combined by weight, else equally.
    """
    held = panel.with_df(panel.df.where(period.holds("trading_day")))
    eligible = flag(F.col(panel.spec.eligible)) if panel.spec.eligible else F.lit(True)

    def moves(d: DataFrame, frames) -> DataFrame:
        columns = {}
        for f in factors:
            position = F.when(eligible & is_finite(F.col(f)), F.signum(f))
            columns[f"__p_{f}"] = position
        d = d.withColumns(columns)
        return d.withColumns(
            {
                f"__c_{f}": F.abs(F.col(f"__p_{f}") - F.lag(f"__p_{f}").over(frames.ordered)) / 2
                for f in factors
            }
        )

    changed = held.over_history(1, 0, moves)
    renamed = changed.select("product", *[F.col(f"__c_{f}").alias(f) for f in factors])
    per_product = (
        long_scores(renamed, factors, ["product"])
        .where(F.col("value").isNotNull())
        .groupBy("factor", "product")
        .agg(F.avg("value").alias("change"), F.count(F.lit(1)).alias("n"))
    )
    if weights is None:
        value = F.avg("change")
    else:
        per_product = per_product.join(weights, "product")
        value = F.sum(F.col("change") * F.col("weight")) / F.sum("weight")
    found = per_product.groupBy("factor").agg(
        value.alias("turnover"), F.sum("n").alias("turnover_observations")
    )
    return _every_factor(found, factors, "turnover_observations")


def rank_turnover(
    df: DataFrame,
    factors: Sequence[str],
    period: DateRange,
    identity: Sequence[str] = ("exchange", "instrument_id"),
    rows: int | None = None,
) -> DataFrame:
    """Stocks: half the L1 change of demeaned-rank, unit-gross holdings between adjacent days.

    A day counts when every eligible member has a value and there are at least five; days are
    adjacent on the full observed clock.  Members that enter or leave count from or to zero.
    """
    held = df.where(period.holds("trading_day"))
    steps = clock(held, "trading_day", "step", DAY_ROWS)
    members = held.where(flag(F.col("eligible")))
    long = long_scores(members, factors, ["trading_day", *identity])
    long = join_stats(long, steps, ["trading_day"], DAY_ROWS)
    day = ["factor", "step"]
    split = oversized(long, day, rows)
    long = long.withColumn("value", finite(F.col("value")))
    ranked = frozen(attach_ranks(long, day, "value", "__rank", split=split))
    summary = ranked.groupBy(*day).agg(
        F.count(F.lit(1)).alias("__n"),
        F.count("value").alias("__finite"),
        F.avg("__rank").alias("__mean"),
    )
    complete = summary.where((F.col("__n") == F.col("__finite")) & (F.col("__n") >= MIN_OBSERVATIONS))
    centred = ranked.join(complete.select(*day, "__mean"), day).withColumn(
        "__c", F.col("__rank") - F.col("__mean")
    )
    gross = centred.groupBy(*day).agg(F.sum(F.abs("__c")).alias("__gross"))
    positions = centred.join(gross, day).select(
        *day,
        *identity,
        F.coalesce(F.try_divide("__c", "__gross"), F.lit(0.0)).alias("position"),
    )
    previous = positions.select(
        "factor", (F.col("step") + 1).alias("step"), *identity, F.col("position").alias("previous")
    )
    both = complete.select(*day).join(
        complete.select("factor", (F.col("step") + 1).alias("step")), day
    )
    moved = positions.join(previous, [*day, *identity], "full").join(both, day)
    size = F.abs(F.coalesce("position", F.lit(0.0)) - F.coalesce("previous", F.lit(0.0))) / 2
    changes = moved.groupBy(*day).agg(F.sum(size).alias("change"))
    found = changes.groupBy("factor").agg(
        F.avg("change").alias("turnover"), F.count(F.lit(1)).alias("turnover_observations")
    )
    return _every_factor(found, factors, "turnover_observations")


def delayed_values(
    panel: Panel, factors: Sequence[str], period: DateRange, adjacent_days: bool
) -> DataFrame:
    """Each factor replaced by its previous row's value inside the panel's history.

    Ineligible or missing rows are not bridged; stocks also need consecutive market days.
    """
    train = panel.df.where(period.holds("trading_day"))
    if adjacent_days:
        train = join_stats(train, clock(train, "trading_day", "__day", DAY_ROWS), ["trading_day"], DAY_ROWS)
    eligible = flag(F.col("eligible"))

    def lagged(d: DataFrame, frames) -> DataFrame:
        w = frames.ordered
        usable = F.lit(True)
        if adjacent_days:
            d = d.withColumn("__gap", F.col("__day") - F.lag("__day").over(w))
            usable = F.col("__gap") == 1
        d = d.withColumns(
            {f"__l_{f}": F.lag(F.when(eligible & is_finite(F.col(f)), F.col(f))).over(w) for f in factors}
        )
        return d.withColumns({f: F.when(usable, F.col(f"__l_{f}")) for f in factors})

    done = panel.with_df(train).over_history(1, 0, lagged)
    return done.drop("__day", "__gap", *[f"__l_{f}" for f in factors])


def lag_diagnostics(
    panel: Panel,
    factors: Sequence[str],
    period: DateRange,
    metric: str,
    weights: DataFrame | None = None,
    bounds: DataFrame | None = None,
    target_bounds: DataFrame | None = None,
) -> DataFrame:
    """Undirected rank IC, its daily ratio, the one-bar-delayed rank IC and their gap."""
    group = metric_group(metric)
    keep = list(dict.fromkeys(["target", "trading_day", group]))
    current = panel.df.where(period.holds("trading_day"))
    delayed = delayed_values(panel, factors, period, metric == CROSS_SECTIONAL)
    tagged = []
    for name, frame in (("now", current), ("lag", delayed)):
        rows = split_rows(frame, period).select(*keep, *factors)
        tagged.append(long_scores(rows, factors, keep).withColumn("which", F.lit(name)))
    long = frozen(clip_scores(tagged[0].unionByName(tagged[1]), bounds, target_bounds))
    groups = group_ic(long, ["factor", "which"], group, ("spearman",), panel.rows)
    if weights is not None and "_weighted_" in metric:
        groups = groups.join(weights, "product")
        value = ratio(F.sum(F.col("spearman") * F.col("weight")), F.sum("weight"))
    else:
        value = F.avg("spearman")
    ic = groups.groupBy("factor", "which").agg(
        _clamp(value).alias("ic"),
        F.sum(F.when(F.col("spearman").isNotNull(), F.col("n"))).alias("n"),
    )
    picked = ic.groupBy("factor").agg(
        F.max(F.when(F.col("which") == "now", F.col("ic"))).alias("rank_ic"),
        F.max(F.when(F.col("which") == "lag", F.col("ic"))).alias("lag1_rank_ic"),
        F.coalesce(F.max(F.when(F.col("which") == "lag", F.col("n"))), F.lit(0)).alias("lag1_n_obs"),
    )
    now = long.where(F.col("which") == "now")
    daily = daily_ic(now, ["factor"], metric.replace("pearson", "spearman"), weights, panel.rows)
    stable = information_ratio(daily, ["factor"]).withColumnsRenamed(
        {"icir": "rank_icir", "icir_days": "rank_icir_days"}
    )
    gap = F.when(
        F.col("rank_ic").isNotNull() & F.col("lag1_rank_ic").isNotNull(),
        F.greatest(F.lit(0.0), F.col("rank_ic") - F.col("lag1_rank_ic")),
    )
    return join_stats(picked, stable, ["factor"]).withColumn("lag1_gap", gap)


# Pairs per pass; bounds the size of one aggregation.
PAIR_CHUNK = 100


def _pair_correlation(a: str, b: str) -> Column:
    """Rows where both columns are finite, and their Pearson correlation; null if one is constant."""
    both = is_finite(F.col(a)) & is_finite(F.col(b))
    x, y = F.when(both, F.col(a)), F.when(both, F.col(b))
    varies = (F.min(x) < F.max(x)) & (F.min(y) < F.max(y))
    pearson = guarded_corr(F.covar_pop(x, y), F.stddev_pop(x), F.stddev_pop(y), varies)
    return F.struct(F.count(x).alias("n"), pearson.alias("pearson"))


def factor_correlations(
    train: DataFrame,
    pairs: Sequence[tuple[str, str]],
    metric: str,
    min_overlap: int,
    weights: DataFrame | None = None,
    rows: int | None = None,
) -> DataFrame:
    """Training Pearson between factors, aggregated like the metric.

    Each pair is one masked aggregate per group, so rows are neither copied nor shuffled before they
    are summed up; PAIR_CHUNK pairs share a pass.  `rows` is not needed and kept for callers.
    """
    group, groups = metric_group(metric), None
    chunks = [pairs[at : at + PAIR_CHUNK] for at in range(0, len(pairs), PAIR_CHUNK)]
    for chunk in chunks:
        measured = train.groupBy(group).agg(*[_pair_correlation(a, b).alias(f"__{i}") for i, (a, b) in enumerate(chunk)])
        found = measured.select(
            group,
            F.inline(
                F.array(
                    *[
                        F.struct(
                            F.lit(a).alias("left"),
                            F.lit(b).alias("right"),
                            F.col(f"__{i}.n").alias("n"),
                            F.col(f"__{i}.pearson").alias("pearson"),
                        )
                        for i, (a, b) in enumerate(chunk)
                    ]
                )
            ),
        ).where(F.col("n") >= MIN_OBSERVATIONS)
        groups = found if groups is None else groups.unionByName(found)
    if weights is not None and "_weighted_" in metric:
        groups = groups.join(weights, "product")
        value = ratio(F.sum(F.col("pearson") * F.col("weight")), F.sum("weight"))
    else:
        value = F.avg("pearson")
    usable = F.when(F.col("pearson").isNotNull(), F.col("n"))
    merged = groups.groupBy("left", "right").agg(
        value.alias("__value"), F.coalesce(F.sum(usable), F.lit(0)).alias("overlap")
    )
    return merged.select(
        "left",
        "right",
        F.when(F.col("overlap") >= min_overlap, _clamp(F.col("__value"))).alias("correlation"),
        "overlap",
    )


def prediction_errors(
    df: DataFrame,
    target: str,
    prediction: str,
    baseline: str,
    weight: str | None = None,
    by: Sequence[str] = (),
) -> DataFrame:
    """Squared errors against a baseline on an aligned sample, per `by` key.

    Non-finite inputs, negative weights and empty weight sums raise instead of being dropped.
    """
    y, p, b = F.col(target), F.col(prediction), F.col(baseline)
    w = F.col(weight).cast("double") if weight else F.lit(1.0)
    bad = ~(is_finite(y) & is_finite(p) & is_finite(b) & is_finite(w)) | (w < 0)
    total = F.sum(w)
    sse, base = F.sum(w * (y - p) * (y - p)), F.sum(w * (y - b) * (y - b))
    broken = (F.count_if(bad) > 0) | ~F.coalesce(total > 0, F.lit(False))
    broken = broken | ~(is_finite(sse) & is_finite(base))

    def checked(c: Column) -> Column:
        message = F.lit("prediction errors need finite inputs and positive weights")
        return F.when(broken, F.raise_error(message).cast("double")).otherwise(c)

    columns = [
        F.count(F.lit(1)).alias("n"),
        checked(sse).alias("sse"),
        base.alias("baseline_sse"),
        F.try_divide(sse, total).alias("mse"),
        F.try_divide(base, total).alias("baseline_mse"),
        F.when(base > 0, (base - sse) / base).alias("relative_mse_reduction"),
    ]
    if weight:
        columns.append(total.alias("weight_sum"))
    return df.groupBy(*by).agg(*columns)


def score_frozen(
    df: DataFrame,
    library: DataFrame,
    factors: Sequence[str],
    period: DateRange,
    metric: str,
    by_year: bool = False,
    target_bounds: tuple[float, float] | None = None,
    rows: int | None = None,
) -> DataFrame:
    """Out-of-sample metrics with frozen direction and bounds.

    `library` has one row per factor: factor, direction and, when clipping was used, lower, upper.
    """
    group = metric_group(metric)
    weights = product_weights(df, period) if metric in TIME_SERIES else None
    keep = list(dict.fromkeys(["target", "trading_day", group]))
    scored = split_rows(df, period).select(*keep, *factors)
    if target_bounds is not None:
        low, high = (F.lit(float(v)) for v in target_bounds)
        scored = scored.withColumn("target", clipped(F.col("target"), low, high))
    by = []
    if by_year:
        by, scored = ["year"], scored.withColumn("year", F.year("trading_day"))
    members = {r["factor"]: r for r in library.collect()}  # one row per factor column
    scale = {f: float(members[f]["direction"]) if f in members else float("nan") for f in factors}
    bounds = None
    if "lower" in library.columns:
        bounds = {f: (m["lower"], m["upper"]) if m["lower"] is not None else None for f, m in members.items()}
    scored = frozen(scored.select(*by, group, "target", *factors))
    found = frozen(wide_ic(scored, factors, [*by, group], Clipping(bounds, scale=scale), rows))
    by = ["factor", *by]
    coverage = found.groupBy(*by).agg(F.try_divide(F.sum("seen"), F.sum("rows")).alias("coverage"))
    return join_stats(aggregate_ic(measured(found), by, metric, weights), coverage, by)


def library_summary(measured: DataFrame, by: Sequence[str] = ("metric",)) -> DataFrame:
    """Mean, median and positive share of factor values per metric."""
    value = F.when(is_finite(F.col("value")), F.col("value"))
    positive = F.count_if(value > 0)
    return measured.groupBy(*by).agg(
        F.avg(value).alias("mean"),
        F.percentile(value, F.lit(0.5)).alias("median"),
        positive.alias("positive"),
        F.count(value).alias("defined"),
        F.try_divide(positive, F.count(value)).alias("positive_share"),
        F.count(F.lit(1)).alias("factors"),
    )
