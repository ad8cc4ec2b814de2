"""Golden values, missing-value rules, causality and isolation of the factor operators."""

from datetime import datetime, timedelta

import numpy as np
import pandas as pd
import pytest

from factorloom.functions import feature as fx
from factorloom.operators.panel import Panel, PanelSpec

X, Y = fx.field("x"), fx.field("y")
SPEC = PanelSpec(eligible="eligible")


def series(spark, x=(2.0, 1.0, 3.0, 5.0, 4.0)):
    n = len(x)
    return spark.createDataFrame(
        [
            ("X", "A", datetime(2020, 1, 1) + timedelta(days=i), True, None if v is None else float(v), x[n - 1 - i])
            for i, v in enumerate(x)
        ],
        "exchange string, instrument_id string, timestamp timestamp, eligible boolean, x double, y double",
    )


def number(condition):
    return fx.if_then_else(condition, 1, 0)


GOLDEN = [
    (fx.add(X, 2), 6),
    (fx.subtract(X, 2), 2),
    (fx.multiply(X, 2), 8),
    (fx.divide(X, 2), 2),
    (fx.neg(X), -4),
    (fx.absolute(-X), 4),
    (fx.sign(X), 1),
    (fx.log(X), np.log(4)),
    (fx.log1p(X), np.log(5)),
    (fx.sqrt(X), 2),
    (fx.exp(X), np.exp(4)),
    (fx.power(X, 2), 16),
    (fx.signed_power(-X, 0.5), -2),
    (fx.minimum(X, 3), 3),
    (fx.maximum(X, 3), 4),
    (fx.clip(X, 1, 3), 3),
    (fx.if_then_else(X < 5, X, 0), 4),
    (number(X <= 4), 1),
    (number(X > 3), 1),
    (number(X >= 4), 1),
    (number(fx.eq(X, 4)), 1),
    (number(fx.ne(X, 4)), 0),
    (number(fx.both(X > 0, X < 5)), 1),
    (number(fx.either(X < 0, X > 3)), 1),
    (number(fx.negate(X > 0)), 0),
    (number(fx.is_finite(X)), 1),
    (fx.fillna(X / 0, 7), 7),
    (fx.delay(X, 2), 3),
    (fx.obs_lag(X, 2), 3),
    (fx.delta(X, 2), 1),
    (fx.change(X, 2), 1 / 3),
    (fx.ts_sum(X, 3), 12),
    (fx.ts_prod(X, 3), 60),
    (fx.ts_mean(X, 3), 4),
    (fx.ts_median(X, 3), 4),
    (fx.ts_linear_decay(X, 3), 25 / 6),
    (fx.ts_std(X, 3), 1),
    (fx.ts_var(X, 3), 1),
    (fx.ts_zscore(X, 3), 0),
    (fx.ts_skew(X, 3), 0),
    (fx.ts_kurt(X, 5), -1.2),
    (fx.ts_skew_pop(X, 3), 0),
    (fx.ts_kurt_pop(X, 5), -1.3),
    (fx.ts_quantile(X, 3, 0.25), 3.5),
    (fx.ts_winsorize(X, 3, 0.6, 0.9), 4.2),
    (fx.ts_min(X, 3), 3),
    (fx.ts_max(X, 3), 5),
    (fx.ts_rank(X, 3), 2 / 3),
    (fx.ts_argmin(X, 3), 2),
    (fx.ts_argmax(X, 3), 1),
    (fx.ts_corr(X, Y, 3), -1),
    (fx.ts_cov(X, Y, 3), -1),
    (fx.ts_rankcorr(X, Y, 3), -1),
    (fx.ts_count(X > 3, 3), 2),
    (fx.ts_rate(X > 3, 3), 2 / 3),
    (number(fx.ts_any(X > 3, 3)), 1),
    (number(fx.ts_all(X > 3, 3)), 0),
]


@pytest.mark.parametrize("frame, group", [(1000, 1000), (0, 1000), (1000, 2), (0, 2)])
def test_golden_values(spark, configured, frame, group):
    """Spark frames and Arrow passes, whole histories and split ones, give the same numbers."""
    configured(frame=frame, group=group)
    features = {f"g{i}": f for i, (f, _) in enumerate(GOLDEN)}
    last = Panel(series(spark), SPEC).with_features(features).orderBy("timestamp").collect()[-1]
    for i, (feature, expected) in enumerate(GOLDEN):
        assert last[f"g{i}"] == pytest.approx(expected, abs=1e-9), feature.op


ROLLING = {
    **{n: getattr(fx, n)(X, 3) for n in ("obs_lag", "delay", "delta", "change", "ts_sum", "ts_prod", "ts_mean")},
    **{n: getattr(fx, n)(X, 3) for n in ("ts_median", "ts_min", "ts_max", "ts_std", "ts_var", "ts_zscore")},
    **{n: getattr(fx, n)(X, 4) for n in ("ts_skew", "ts_kurt", "ts_skew_pop", "ts_kurt_pop", "ts_rank")},
    **{n: getattr(fx, n)(X, 3) for n in ("ts_linear_decay", "ts_argmin", "ts_argmax")},
    "ts_quantile": fx.ts_quantile(X, 3, 0.3),
    "ts_winsorize": fx.ts_winsorize(X, 3, 0.1, 0.9),
    "ts_corr": fx.ts_corr(X, Y, 4),
    "ts_cov": fx.ts_cov(X, Y, 4),
    "ts_rankcorr": fx.ts_rankcorr(X, Y, 4),
    "ts_count": fx.ts_count(X > 0, 3),
    "nested": fx.ts_mean(fx.ts_zscore(X, 3), 2),
}


def random_panel(seed, groups=3, days=25, segments=False):
    rng = np.random.default_rng(seed)
    rows = []
    for g in range(groups):
        for d in range(days):
            x, y = rng.normal(), rng.normal()
            x = None if rng.random() < 0.06 else float(np.round(x, 1))
            rows.append(("X", f"I{g}", datetime(2020, 1, 1) + timedelta(days=d), d // 9 if segments else 0, True, x, float(y)))
    return pd.DataFrame(rows, columns=["exchange", "instrument_id", "timestamp", "segment", "eligible", "x", "y"])


SCHEMA = "exchange string, instrument_id string, timestamp timestamp, segment long, eligible boolean, x double, y double"


def frame(spark, pdf):
    return spark.createDataFrame(pdf.astype({"x": object}).where(pdf.notna(), None), SCHEMA)


def table(df, names, key=("instrument_id", "timestamp")):
    pdf = df.select(*key, *names).toPandas().sort_values(list(key)).reset_index(drop=True)
    return pdf[list(names)].astype(float).to_numpy()


def test_frames_and_arrow_agree_on_random_data(spark, configured):
    pdf = random_panel(3, segments=True)
    spec = PanelSpec(segment="segment", eligible="eligible")
    results = []
    for limit, group in ((1000, 10_000), (0, 10_000), (1000, 6), (0, 6)):
        configured(frame=limit, group=group)
        results.append(table(Panel(frame(spark, pdf), spec).with_features(ROLLING), ROLLING))
    for other in results[1:]:
        np.testing.assert_allclose(results[0], other, rtol=1e-9, atol=1e-10, equal_nan=True)


def test_against_independent_window_code(spark):
    """Every complete window, recomputed one by one with numpy."""
    pdf = random_panel(5, groups=2)
    got = table(Panel(frame(spark, pdf), SPEC).with_features(ROLLING), ROLLING)
    pdf = pdf.sort_values(["instrument_id", "timestamp"]).reset_index(drop=True)
    names = list(ROLLING)
    for _, part in pdf.groupby("instrument_id"):
        x = part["x"].to_numpy(float)
        y = part["y"].to_numpy(float)
        for i, row in enumerate(part.index):
            w = x[max(0, i - 2) : i + 1]
            full = len(w) == 3 and np.isfinite(w).all()
            expected = {
                "ts_sum": w.sum() if full else np.nan,
                "ts_std": np.std(w, ddof=1) if full else np.nan,
                "ts_median": np.median(w) if full else np.nan,
                "ts_argmax": float(np.argmax(w[::-1])) if full else np.nan,
                "ts_linear_decay": w @ [1, 2, 3] / 6 if full else np.nan,
                "obs_lag": x[i - 3] if i >= 3 else np.nan,
            }
            w4, v4 = x[max(0, i - 3) : i + 1], y[max(0, i - 3) : i + 1]
            if len(w4) == 4 and np.isfinite(w4).all():
                expected["delta"] = x[i] - x[i - 3]
                expected["ts_cov"] = np.cov(w4, v4)[0, 1]
                ranks = [pd.Series(v).rank().to_numpy() for v in (w4, v4)]
                if np.ptp(ranks[0]) > 0:
                    expected["ts_rankcorr"] = np.corrcoef(*ranks)[0, 1]
                expected["ts_rank"] = ranks[0][-1] / 4
            for name, value in expected.items():
                actual = got[row, names.index(name)]
                assert actual == pytest.approx(value, abs=1e-9, nan_ok=True), name


def test_future_rows_do_not_change_the_past(spark, configured):
    pdf = random_panel(7)
    later = pdf.copy()
    cut = datetime(2020, 1, 18)
    late = later["timestamp"] >= cut
    later.loc[late, "x"] = 99.0
    for limit in (1000, 0):
        configured(frame=limit)
        a = Panel(frame(spark, pdf), SPEC).with_features(ROLLING).where("timestamp < '2020-01-18'")
        b = Panel(frame(spark, later), SPEC).with_features(ROLLING).where("timestamp < '2020-01-18'")
        np.testing.assert_allclose(table(a, ROLLING), table(b, ROLLING), equal_nan=True)


def test_histories_are_isolated_and_order_does_not_matter(spark):
    pdf = random_panel(9)
    alone = pdf[pdf["instrument_id"] == "I1"]
    together = Panel(frame(spark, pdf.sample(frac=1, random_state=1)), SPEC).with_features(ROLLING)
    single = Panel(frame(spark, alone), SPEC).with_features(ROLLING)
    np.testing.assert_allclose(
        table(together.where("instrument_id = 'I1'"), ROLLING), table(single, ROLLING), equal_nan=True
    )


def test_missing_value_rules(spark):
    inf = float("inf")
    data = series(spark, (1.0, 2.0, inf, 4.0, 5.0))
    unknown = X > 0
    features = {
        "mean": fx.ts_mean(X, 3),
        "if_": fx.if_then_else(unknown, 1, 0),
        "fill": fx.fillna(X, 9),
        "and_": number(fx.both(unknown, fx.lt(fx.const(1), fx.const(0)))),
        "log": fx.log(-X),
        "over": fx.exp(X * 1000),
        "flat": fx.ts_corr(fx.const(1) + X * 0, Y, 2),
    }
    rows = Panel(data, SPEC).with_features(features).orderBy("timestamp").collect()
    assert rows[-1]["mean"] is None and rows[2]["if_"] is None and rows[2]["fill"] == 9
    assert rows[2]["and_"] is None  # false AND unknown stays unknown
    assert rows[-1]["log"] is None and rows[-1]["over"] is None
    assert rows[1]["flat"] is None


def test_regression_kernel_needs_a_full_rank_design(spark):
    rng = np.random.default_rng(9)
    n = 12
    x = rng.normal(size=(3, n))
    y = x.T @ [1.0, -2.0, 0.5] + rng.normal(size=n)
    rows = [
        ("X", "A", datetime(2020, 1, 1) + timedelta(days=i), float(y[i]), *map(float, x[:, i]), float(2 * x[0, i]))
        for i in range(n)
    ]
    df = spark.createDataFrame(
        rows,
        "exchange string, instrument_id string, timestamp timestamp, y double, a double, b double, c double, d double",
    )
    f = fx.field
    features = {
        "ok": fx.ts_resid_std3(f("y"), f("a"), f("b"), f("c"), n),
        "bad": fx.ts_resid_std3(f("y"), f("a"), f("b"), f("d"), n),
    }
    last = Panel(df).with_features(features).orderBy("timestamp").collect()[-1]
    design = np.column_stack([np.ones(n), *x])
    residual = y - design @ np.linalg.lstsq(design, y, rcond=None)[0]
    assert last["ok"] == pytest.approx(np.std(residual, ddof=1))
    assert last["bad"] is None


def test_robust_trend_by_hand(spark):
    x, v = [-2.0, -1.0, 1.0, 1.0, 2.0], [5.0, 2.5, 5 / 3, 1.25, 1.0]
    rows = [("X", "A", datetime(2020, 1, 1 + i), x[i], v[i]) for i in range(5)]
    df = spark.createDataFrame(
        rows, "exchange string, instrument_id string, timestamp timestamp, x double, v double"
    )
    out = Panel(df).with_features({"t": fx.robust_trend(X, fx.field("v"), 5)}).orderBy("timestamp").collect()
    assert [r["t"] for r in out[:4]] == [None] * 4
    assert out[-1]["t"] == pytest.approx(2.5)


def test_legs_only_break_expressions_that_read_them(spark):
    rows = [("X", "A", datetime(2020, 1, 1 + i), 0, i // 3, float(i), float(i)) for i in range(6)]
    df = spark.createDataFrame(
        rows,
        "exchange string, instrument_id string, timestamp timestamp, segment_id long, segment_id_p1 long, close double, close_p1 double",
    )
    spec = PanelSpec(segment="segment_id", legs={"p1": "segment_id_p1"})
    near, far = fx.field("close"), fx.field("close_p1")
    features = {"own": fx.delta(near, 1), "leg": fx.delta(far, 1), "both": fx.delta(near + far, 1), "long": fx.ts_std(far, 2)}
    rows = Panel(df, spec).with_features(features).orderBy("timestamp").collect()
    assert [r["own"] for r in rows] == [None, 1, 1, 1, 1, 1]
    assert [r["leg"] for r in rows] == [None, 1, 1, None, 1, 1]
    assert [r["both"] for r in rows] == [None, 2, 2, None, 2, 2]
    assert rows[3]["long"] is None and rows[4]["long"] is not None


@pytest.mark.parametrize(
    "build",
    [
        lambda: fx.ts_std(X, 1),
        lambda: fx.ts_skew(X, 2),
        lambda: fx.ts_resid_std3(X, X, X, X, 4),
        lambda: fx.clip(X, 2, 1),
        lambda: fx.ts_winsorize(X, 3, 0.9, 0.1),
        lambda: fx.ts_quantile(X, 3, 1.5),
        lambda: fx.both(X, X > 1),
        lambda: fx.ts_mean(X > 1, 3),
        lambda: fx.cs_lagged_mean(X, X > 0, 4, 0),
        lambda: fx.cs_lagged_spread(X, X, X > 0, 0.6, 0.8),
        lambda: fx.const(float("nan")),
        lambda: fx.ts_mean(X, 2.5),
    ],
)
def test_invalid_arguments_are_refused(build):
    with pytest.raises((ValueError, TypeError)):
        build()


def test_lookback_and_shared_subexpressions():
    inner = fx.ts_mean(X, 10)
    feature = fx.delta(inner, 5) + inner
    assert feature.lookback() == 14
    assert feature.fields() == {"x"}
    assert fx.ts_mean(X, 10) == inner and hash(fx.ts_mean(X, 10)) == hash(inner)
