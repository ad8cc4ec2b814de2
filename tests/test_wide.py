"""The wide rank pass against pandas, for groups in one task and beyond."""

import numpy as np
import pandas as pd
import pytest

from factorloom.operators import wide
from factorloom.operators.wide import Clipping, average_ranks, correlations, measured, wide_ic

FACTORS = ["f", "g", "ragged", "flat", "few"]


@pytest.fixture(scope="module")
def panel(spark):
    rng = np.random.default_rng(3)
    n = 900
    day = rng.choice(["2020-01-01", "2020-01-02", "2020-01-03", "2020-01-04"], n, p=[0.6, 0.2, 0.195, 0.005])
    pdf = pd.DataFrame({"split": rng.choice(["train", "val"], n), "day": day, "target": rng.normal(size=n).round(1)})
    pdf["f"] = rng.normal(size=n).round(1)
    pdf["g"] = rng.integers(0, 3, n).astype(float)
    pdf["ragged"] = np.where(rng.random(n) < 0.3, np.nan, rng.normal(size=n) + pdf["target"])
    pdf["flat"] = 2.0
    pdf["few"] = np.where(rng.random(n) < 0.98, np.nan, rng.normal(size=n))
    pdf.loc[rng.random(n) < 0.05, "target"] = np.nan
    pdf.loc[3, "f"], pdf.loc[5, "f"] = np.inf, -np.inf
    df = spark.createDataFrame(pdf.astype(object).where(pdf.notna(), None), "split string, day string, target double, f double, g double, ragged double, flat double, few double")
    return pdf.replace([np.inf, -np.inf], np.nan), df.repartition(3)


def expected(pdf, bounds=None, target=None, scale=None):
    out = {}
    for (split, day), part in pdf.groupby(["split", "day"]):
        for f in FACTORS:
            x, y = part[f], part["target"]
            if bounds is not None:
                x = x.clip(*bounds[f]) if bounds[f] else x * np.nan
            if target:
                y = y.clip(*target)
            x = x * (scale or {}).get(f, 1.0)
            both = x.notna() & y.notna()
            a, b = x[both], y[both]
            fine = len(a) >= 5 and a.nunique() > 1 and b.nunique() > 1
            pearson, spearman = (a.corr(b), a.rank().corr(b.rank())) if fine else (np.nan, np.nan)
            out[split, day, f] = (len(part), part[f].notna().sum(), x.min(), x.max(), len(a), pearson, spearman)
    return out


@pytest.mark.parametrize("cells", [1 << 20, 600, 1])
@pytest.mark.parametrize("clip", [False, True])
def test_equals_pandas(panel, cells, clip):
    pdf, df = panel
    bounds = {"f": (-1.0, 1.0), "g": (0.0, 1.0), "ragged": (-2.0, 2.0), "flat": None, "few": (-1.0, 1.0)}
    args = (bounds, (-1.0, 1.5), {"f": -1.0, "g": 2.0}) if clip else ()
    want = expected(pdf, *args)
    rows = wide_ic(df, FACTORS, ["split", "day"], Clipping(*args), cells=cells).collect()
    assert len(rows) == len(want)
    for r in rows:
        numbers = [np.nan if r[c] is None else r[c] for c in ("rows", "seen", "low", "high", "n", "pearson", "spearman")]
        np.testing.assert_allclose(numbers, np.array(want[r.split, r.day, r.factor], float), atol=1e-12, err_msg=str(r))
    defined = sum(not np.isnan(w[5]) for w in want.values())
    assert measured(wide_ic(df, FACTORS, ["split", "day"], Clipping(*args), cells=cells)).count() == defined


@pytest.mark.parametrize("cells", [1 << 20, 1200, 1100])
def test_groups_take_slices_of_bounded_size(panel, monkeypatch, cells):
    """Large groups take slices of their factors to tasks, which rank a few columns at a time."""
    pdf, df = panel
    monkeypatch.setattr(wide, "STEP_CELLS", 400)
    monkeypatch.setattr(wide, "_per_factor", lambda *a: pytest.fail("rows per factor"))
    want = expected(pdf)
    rows = wide.wide_ic(df, FACTORS, ["split", "day"], cells=cells).collect()
    assert len(rows) == len(want)
    for r in rows:
        numbers = [np.nan if r[c] is None else r[c] for c in ("rows", "seen", "low", "high", "n", "pearson", "spearman")]
        np.testing.assert_allclose(numbers, np.array(want[r.split, r.day, r.factor], float), atol=1e-12, err_msg=str(r))


def test_a_task_ranks_few_values_at_a_time(monkeypatch):
    import pyarrow as pa

    shapes, own = [], wide.correlations
    monkeypatch.setattr(wide, "STEP_CELLS", 4000)
    monkeypatch.setattr(wide, "correlations", lambda x, y, s: shapes.append(x.shape) or own(x, y, s))
    names = [f"f{i}" for i in range(30)]
    values = np.random.default_rng(1).normal(size=(1000, 31))
    table = pa.table({"day": ["a"] * 1000, "target": values[:, 0], **{f: values[:, i + 1] for i, f in enumerate(names)}})
    rows = list(wide._task(1, names, Clipping(), True)(iter(table.to_batches(max_chunksize=300))))
    assert [f for r in rows for f in r.column("factor").to_pylist()] == names
    assert max(a * b for a, b in shapes) <= 4000


def test_ranks_and_classes():
    x = np.array([[1.0, 5.0], [1.0, np.nan], [3.0, 5.0], [2.0, 1.0]])
    assert average_ranks(x)[:, 0].tolist() == [1.5, 1.5, 4.0, 3.0]
    assert average_ranks(x)[[0, 2, 3], 1].tolist() == [2.5, 2.5, 1.0]
    n, pearson, spearman = correlations(np.zeros((0, 2)), np.zeros(0))
    assert n.tolist() == [0, 0] and np.isnan(pearson).all() and np.isnan(spearman).all()
