"""End to end: panel, factors, evaluation, admission, freezing and out-of-sample scoring."""

from datetime import date, datetime, timedelta

import numpy as np
import pytest

from factorloom.functions import feature as fx
from factorloom.operators.library import AdmissionRules
from factorloom.operators.targets import DateRange, Fold
from factorloom.plans import cta, research, sweep
from factorloom.sources import market

START = date(2020, 1, 1)


@pytest.fixture(scope="module")
def panel(spark):
    rng = np.random.default_rng(5)
    rows = []
    for i in range(8):
        price = 100.0
        drift = (i - 3.5) * 0.002
        for d in range(90):
            day = START + timedelta(days=d)
            price *= 1 + drift + 0.005 * rng.normal()
            rows.append(
                ("X", f"I{i}", f"P{i % 2}", datetime(day.year, day.month, day.day), day, price, price * 1.01, price * 0.99, price, 100.0 + i, price * 100)
            )
    df = spark.createDataFrame(
        rows,
        "exchange string, instrument_id string, product string, timestamp timestamp, trading_day date, open double, high double, low double, close double, volume double, amount double",
    )
    return market.prepare_panel(df.drop("product"), ["open", "high", "low", "close", "volume", "amount"], date(2021, 1, 1))


def days(a, b):
    return DateRange(START + timedelta(days=a), START + timedelta(days=b))


FOLD = Fold("f", days(10, 40), days(41, 65), days(66, 89))


def test_cycle(panel):
    close = fx.field("close")
    features = {
        "momentum": fx.change(close, 5),
        "twin": fx.change(close, 5) * 3,
        "noise": fx.ts_zscore(fx.field("volume") + close * 0, 3) + fx.delta(close, 1),
    }
    rules = AdmissionRules(min_corr_overlap=20, min_residual_ic=-1.0, max_abs_corr=0.99)
    profile = research.Profile("close", 2, "cross_sectional_spearman", rules=rules)
    study = research.prepare(panel, features, FOLD, profile)
    measured = research.evaluate(study)
    rows = {r["factor"]: r for r in measured.where("metric = 'cross_sectional_spearman'").collect()}
    assert rows["momentum"]["status"] == "success" and rows["momentum"]["train"] > 0.3
    log = research.build_library(study, measured, list(features)).orderBy("trial").collect()
    assert log[0]["reason"] == "accepted" and log[1]["reason"] == "behavior_duplicate"
    assert log[1]["nearest"] == "momentum" and log[1]["library_r2"] > 0.99
    frozen_log = study.df.sparkSession.createDataFrame(log)
    members = research.freeze(study, measured, frozen_log)
    scored = research.out_of_sample(study, members)
    best = scored.where("factor = 'momentum' AND metric = 'cross_sectional_spearman'").first()
    assert best["value"] > 0.3 and best["coverage"] == 1.0
    extra = {r["factor"]: r for r in research.diagnostics(study, measured.select("factor", "direction").distinct()).collect()}
    assert extra["momentum"]["icir"] > 0 and extra["momentum"]["turnover"] is not None
    assert extra["momentum"]["rank_ic"] == pytest.approx(rows["momentum"]["train"], abs=0.05)


def test_profile_is_validated():
    with pytest.raises(ValueError):
        research.Profile("close", 0, "cross_sectional_spearman")
    with pytest.raises(ValueError):
        research.Profile("close", 1, "unknown")


def test_catalogue_scaling_and_availability(spark):
    entries = cta.cta_catalog("5m", 48)
    assert len(entries) == 22
    assert {e.name: e.feature for e in entries}["tsmom_63"].lookback() == 63 * 48
    listed = cta.inspect(spark, cta.cta_catalog(), ["close"]).collect()
    status = {r["name"]: r["status"] for r in listed}
    assert status["tsmom_252"] == "available" and status["carry_ann"] == "missing_fields"
    with pytest.raises(ValueError):
        cta.cta_catalog("5m")
    with pytest.raises(ValueError):
        cta.cta_catalog("1d", 2)


def test_grammar_lists_each_genome_once():
    genomes = sweep.grammar(["a", "b"], ops=["mean"], windows=[3], combines=["single", "add"])
    assert sorted(genomes) == ["mean_a_3", "mean_a_add_a_3", "mean_a_add_b_3", "mean_b_3", "mean_b_add_a_3", "mean_b_add_b_3"]
