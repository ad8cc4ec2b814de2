"""The research cycle on one prepared panel: evaluate, admit, freeze, score out of sample."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field as _field

from pyspark.sql import DataFrame, functions as F

from ..functions.feature import Feature
from ..operators import library, scoring, targets
from ..operators.blocks import frozen
from ..operators.coarse import with_mixed_features
from ..operators.panel import Panel
from ..operators.targets import Fold
from ..sources.market import panel_spec

KEY = ("exchange", "instrument_id", "timestamp")


@dataclass(frozen=True)
class Profile:
    """What an asset class trades on: price, horizon, metric, panel view and library rules."""

    price_field: str
    horizon: int
    metric: str
    panel: str = "contract"
    probabilities: tuple[float, float] | None = (0.01, 0.99)
    rules: library.AdmissionRules = _field(default_factory=library.AdmissionRules)

    def __post_init__(self):
        scoring.metric_group(self.metric)
        if self.horizon < 1 or self.panel not in {"contract", "product"}:
            raise ValueError("invalid horizon or panel mode")


@dataclass(frozen=True)
class Study:
    """Scored rows of one panel: factor columns next to their targets, written once."""

    df: DataFrame
    factors: tuple[str, ...]
    fold: Fold
    profile: Profile
    rows: int | None

    def weights(self, split: str) -> DataFrame | None:
        if self.profile.metric not in scoring.TIME_SERIES:
            return None
        return scoring.product_weights(self.df, getattr(self.fold, split))


def prepare(
    panel: DataFrame, features: Mapping[str, Feature], fold: Fold, profile: Profile, rows: int | None = None
) -> Study:
    """Targets on the contract panel, factors on the profile's panel view, one row set for both."""
    contract = Panel(panel, panel_spec(panel.columns), rows)
    labelled = targets.build_targets(contract, profile.price_field, profile.horizon)
    view = Panel(labelled, panel_spec(panel.columns, profile.panel), rows)
    wide = with_mixed_features(view, features)
    extra = [c for c in ("product", "amount", "segment_id", "product_segment_id") if c in panel.columns]
    columns = [*KEY, "trading_day", "eligible", *extra, "target", "target_end", *features]
    kept = wide.select(*columns).withColumn("row_id", F.xxhash64(*KEY))
    return Study(frozen(kept), tuple(features), fold, profile, rows)


def evaluate(study: Study) -> DataFrame:
    """Directed train / val metrics, coverage and status of every factor, in one job."""
    p = study.profile
    return scoring.evaluate_factors(
        study.df, study.factors, study.fold, p.metric, p.probabilities, study.rows
    )


def diagnostics(study: Study, directions: DataFrame) -> DataFrame:
    """Stability, turnover and lag sensitivity on the training period.

    `directions` has one row per factor (factor, direction).
    """
    p, period = study.profile, study.fold.train
    weights = study.weights("train")
    bounds, ends = _bounds(study)
    group = scoring.metric_group(p.metric)
    keep = list(dict.fromkeys(["target", "trading_day", group]))
    rows = targets.split_rows(study.df, period).select(*keep, *study.factors)
    long = scoring.clip_scores(scoring.long_scores(rows, study.factors, keep), bounds, ends)
    daily = scoring.daily_ic(long, ["factor"], p.metric, weights, study.rows)
    stable = scoring.information_ratio(daily, ["factor"], directions.select("factor", "direction"))
    view = Panel(study.df, panel_spec(study.df.columns, p.panel), study.rows)
    if weights is None:
        turnover = scoring.rank_turnover(study.df, study.factors, period, rows=study.rows)
    else:
        heavy = weights if "_weighted_" in p.metric else None
        turnover = scoring.signed_turnover(view, study.factors, period, heavy)
    lags = scoring.lag_diagnostics(view, study.factors, period, p.metric, weights, bounds, ends)
    return turnover.join(stable, "factor", "left").join(lags, "factor", "left")


def _bounds(study: Study) -> tuple[DataFrame | None, DataFrame | None]:
    p = study.profile
    if p.probabilities is None:
        return None, None
    train = targets.split_rows(study.df, study.fold.train)
    bounds = scoring.fit_bounds(train, study.factors, p.probabilities, study.rows)
    return bounds, targets.clip_bounds(train, ["target"], p.probabilities, rows=study.rows)


def build_library(study: Study, measured: DataFrame, order: Sequence[str]) -> DataFrame:
    """Greedy admission log; validation values are clipped with the training bounds."""
    p = study.profile
    rows = targets.split_rows(study.df, study.fold.val)
    bounds, ends = _bounds(study)
    if bounds is not None:
        fitted = {r["factor"]: (r["lower"], r["upper"]) for r in bounds.collect()}
        low, high = ends.first()
        fitted["target"] = (low, high)
        known = {c: b for c, b in fitted.items() if None not in b}
        rows = targets.apply_clipping(rows, {c: known.get(c) for c in fitted})
    rows = frozen(rows)
    pairs = library.pairwise_spearman(rows, study.factors, rows=study.rows)
    wanted = None
    if p.rules.min_residual_ic is not None:
        wanted = library.ResidualStudy(rows, study.factors, p.metric, study.weights("val"), study.rows)
    return library.admission_frame(measured, pairs, order, p.metric, p.rules, wanted)


def freeze(study: Study, measured: DataFrame, log: DataFrame) -> DataFrame:
    """The admitted factors with direction and training bounds: one small row per member."""
    first = scoring.metric_names(study.profile.metric)[0][0]
    members = log.where("accepted").select("factor")
    chosen = measured.where(F.col("metric") == first).select("factor", "direction").join(members, "factor")
    bounds, _ = _bounds(study)
    return chosen if bounds is None else chosen.join(bounds, "factor")


def out_of_sample(study: Study, frozen_library: DataFrame, by_year: bool = False) -> DataFrame:
    """Test metrics of the frozen members; neither direction nor bounds are fitted again."""
    names = [r["factor"] for r in frozen_library.select("factor").collect()]
    _, ends = _bounds(study)
    p = study.profile
    target = None if ends is None else tuple(ends.first())
    return scoring.score_frozen(
        study.df, frozen_library, names, study.fold.test, p.metric, by_year, target, study.rows
    )
