"""Cross-sections, lagged portfolios and custom kernels, in window and joined form."""

from datetime import datetime

import numpy as np
import pytest

from factorloom.functions import feature as fx
from factorloom.operators.panel import Panel, PanelSpec

X = fx.field("x")
SPEC = PanelSpec(eligible="eligible")


def members(spark, values, eligible):
    rows = [("X", chr(65 + i), datetime(2020, 1, 1), e, v) for i, (v, e) in enumerate(zip(values, eligible))]
    return spark.createDataFrame(
        rows, "exchange string, instrument_id string, timestamp timestamp, eligible boolean, x double"
    )


@pytest.mark.parametrize("group", [1000, 2])
def test_ties_and_ineligible_members(spark, configured, group):
    configured(group=group)
    df = members(spark, [1.0, 2.0, 2.0, 100.0], [True, True, True, False])
    features = {
        "rank": fx.cs_rank(X),
        "demean": fx.cs_demean(X),
        "zscore": fx.cs_zscore(X),
        "scale": fx.cs_scale(X),
        "wins": fx.cs_winsorize(X, 0.25, 0.75),
    }
    rows = Panel(df, SPEC).with_features(features).orderBy("instrument_id").collect()
    std = np.std([1, 2, 2], ddof=1)
    expected = {
        "rank": [1 / 3, 2.5 / 3, 2.5 / 3],
        "demean": [-2 / 3, 1 / 3, 1 / 3],
        "zscore": [-2 / 3 / std, 1 / 3 / std, 1 / 3 / std],
        "scale": [0.2, 0.4, 0.4],
        "wins": [1.5, 2, 2],
    }
    for name, values in expected.items():
        assert [r[name] for r in rows[:3]] == pytest.approx(values)
        assert rows[3][name] is None


def lagged(spark):
    rows = []
    for t in range(2):
        for i in range(8):
            if t == 1 and i == 7:
                continue
            rows.append((datetime(2020, 1, 1 + t), "X", str(i), True, float(i if t == 0 else -i), float(i), 1.0))
    return spark.createDataFrame(
        rows, "timestamp timestamp, exchange string, instrument_id string, eligible boolean, signal double, r double, member double"
    )


@pytest.mark.parametrize("group", [1000, 2])
def test_lagged_holdings_are_never_replaced(spark, configured, group):
    configured(group=group)
    r, signal, member = fx.field("r"), fx.field("signal"), fx.field("member") > 0
    features = {
        "strict": fx.cs_lagged_spread(r, signal, member, 0.25, 0.8),
        "loose": fx.cs_lagged_spread(r, signal, member, 0.25, 0.5),
        "mean": fx.cs_lagged_mean(r, member, 4, 0.8),
        "few": fx.cs_lagged_mean(r, member, 9, 0.8),
    }
    rows = Panel(lagged(spark), SPEC).with_features(features).orderBy("timestamp").collect()
    assert all(row["strict"] is None and row["few"] is None for row in rows)
    first, second = rows[:8], rows[8:]
    assert all(row["loose"] is None and row["mean"] is None for row in first)
    # The high tail held 6 and 7; only 6 is observed.  The low tail held 0 and 1.
    assert [row["loose"] for row in second] == [5.5] * 7
    assert [row["mean"] for row in second] == pytest.approx([3.0] * 7)


def test_cross_section_kernel_sees_only_eligible_members(spark, configured):
    df = members(spark, [1.0, 2.0, None, 100.0], [True, True, True, False])
    panel = Panel(df, SPEC)
    feature = fx.cs_apply(lambda x: x - x.max(), [X])
    rows = panel.with_features({"gap": feature}).orderBy("instrument_id").collect()
    assert [r["gap"] for r in rows] == [-1.0, 0.0, None, None]
    configured(group=2)
    rows = Panel(df, SPEC).with_features({"gap": feature}).orderBy("instrument_id").collect()
    assert [r["gap"] for r in rows] == [-1.0, 0.0, None, None]


def test_cross_section_reduction_does_not_depend_on_the_split(spark):
    rng = np.random.default_rng(4)
    rows = [
        ("X", f"i{k}", datetime(2020, 1, 1, 0, m), bool(rng.random() < 0.8), None if rng.random() < 0.1 else float(rng.normal()))
        for k in range(60)
        for m in range(3)
    ]
    df = spark.createDataFrame(
        rows, "exchange string, instrument_id string, timestamp timestamp, eligible boolean, x double"
    )
    spread = fx.Reduction(
        partial=lambda x: np.array([len(x), x.sum(), (x * x).sum()]),
        merge=lambda states: states.sum(axis=0),
        finish=lambda state, x: (x - state[1] / state[0]) / np.sqrt((state[2] - state[1] ** 2 / state[0]) / (state[0] - 1)),
    )
    features = {"own": fx.cs_reduce(spread, [X]), "known": fx.cs_zscore(X)}
    for parts in (1, 7):
        out = Panel(df.repartition(parts), SPEC).with_features(features).toPandas()
        assert out["own"].notna().sum() == out["known"].notna().sum() > 100
        np.testing.assert_allclose(out["own"].astype(float), out["known"].astype(float), atol=1e-9, equal_nan=True)


@pytest.mark.parametrize("group", [10_000, 20])
def test_alternating_phases_on_a_hot_group(spark, configured, group):
    """A third of all rows belongs to one instrument, and one time holds many members."""
    configured(group=group)
    rng = np.random.default_rng(2)
    rows = [("X", "hot", datetime(2020, 1, 1, 0, i), True, float(rng.normal())) for i in range(50)]
    rows += [("X", f"i{k}", datetime(2020, 1, 1, 0, m), True, float(rng.normal())) for k in range(30) for m in (0, 1, 2)]
    df = spark.createDataFrame(
        rows, "exchange string, instrument_id string, timestamp timestamp, eligible boolean, x double"
    )
    feature = fx.ts_sum(fx.cs_demean(fx.ts_mean(X, 2)), 2)
    out = Panel(df, SPEC).with_features({"v": feature}).toPandas()
    import pandas as pd

    pdf = pd.DataFrame(rows, columns=["exchange", "instrument_id", "timestamp", "eligible", "x"])
    pdf = pdf.sort_values(["instrument_id", "timestamp"])
    pdf["m"] = pdf.groupby("instrument_id")["x"].transform(lambda s: s.rolling(2).mean())
    pdf["d"] = pdf["m"] - pdf.groupby("timestamp")["m"].transform("mean")
    pdf["v"] = pdf.groupby("instrument_id")["d"].transform(lambda s: s.rolling(2).sum())
    merged = out.merge(pdf, on=["instrument_id", "timestamp"], suffixes=("", "_want"))
    np.testing.assert_allclose(merged["v"].astype(float), merged["v_want"], atol=1e-10, equal_nan=True)
    assert len(out) == len(rows)


def test_split_ranks_need_no_histories(spark, configured, monkeypatch):
    """A rank of a field reads no other row of its history, and its level's rows are written once."""
    import factorloom.operators.panel as module
    from workload import ORACLE, QUERIES

    from oracle import compare, connect

    folder = "/root/testdata/sf0.001"
    configured(group=5)
    calls, write = [], module.frozen
    monkeypatch.setattr(module, "positions", lambda *a: pytest.fail("row positions of whole histories"))
    monkeypatch.setattr(module, "frozen", lambda d: calls.append(d.columns) or write(d))
    for name in ("cs_rank", "cs_scaling"):
        got = QUERIES[name](spark, folder)
        assert len(calls) == 1 and "amount" not in calls.pop()
        ok, text = compare(got, connect(folder), ORACLE[name])
        assert ok, text
