"""Exact quantiles by radix selection against numpy, whatever the number of passes."""

import numpy as np
import pandas as pd
import pytest
from hypothesis import given, settings, strategies as st

from factorloom.operators import radix

POINTS = (0.0, 0.01, 0.3, 0.5, 0.9, 1.0)


@given(st.lists(st.floats(allow_nan=False), min_size=2, max_size=30))
@settings(max_examples=200, deadline=None)
def test_bits_order_like_numbers(values):
    x = np.array(values)
    bits = radix.ordered_bits(x)
    assert (np.argsort(bits, kind="stable") == np.argsort(x + 0.0, kind="stable")).all()
    back = radix._doubles(radix._signed(bits))
    assert (back == x).all()


@pytest.fixture(scope="module")
def rows(spark):
    rng = np.random.default_rng(0)
    n = 6000
    pdf = pd.DataFrame(
        {
            "k": rng.choice(["hot", "b", None, "c"], n, p=[0.7, 0.15, 0.14, 0.01]),
            "v": rng.normal(size=n) * 10.0 ** rng.integers(-300, 300, n),
            "ties": rng.integers(-2, 3, n).astype(float),
            "none": np.nan,
        }
    )
    pdf.loc[rng.random(n) < 0.1, "v"] = np.nan
    pdf.loc[pdf["k"] == "c", "ties"] = np.nan
    df = spark.createDataFrame(pdf.astype(object).where(pdf.notna(), None), "k string, v double, ties double, none double")
    return pdf, df.repartition(5)


def expected(values):
    values = values.dropna()
    return None if values.empty else np.quantile(values, POINTS)


@pytest.mark.parametrize("last", [radix.POOLED_LAST, 500, 10, 1])
def test_pooled(rows, last):
    pdf, df = rows
    got = radix.pooled_quantiles(df, ["v", "ties", "none"], POINTS, last)
    assert got["none"] is None
    for c in ("v", "ties"):
        np.testing.assert_allclose(got[c], expected(pdf[c]), rtol=1e-12)
    many = np.arange(101) / 100
    np.testing.assert_allclose(radix.pooled_quantiles(df, ["v"], many, last)["v"], np.quantile(pdf["v"].dropna(), many), rtol=1e-12)


@pytest.mark.parametrize("last", [radix.LAST, 20, 1])
def test_keyed(rows, last):
    pdf, df = rows
    got = {r.k: r for r in radix.quantiles(df, ["k"], ["v", "ties", "none"], POINTS, last).collect()}
    assert set(got) == {"hot", "b", "c", None}
    for k, row in got.items():
        part = pdf[pdf["k"].isna()] if k is None else pdf[pdf["k"] == k]
        assert row.none_q is None
        for c in ("v", "ties"):
            want = expected(part[c])
            assert (row[f"{c}_q"] is None) == (want is None)
            if want is not None:
                np.testing.assert_allclose(row[f"{c}_q"], want, rtol=1e-12)


def test_infinite_values_and_an_empty_table(spark):
    inf = float("inf")
    df = spark.createDataFrame([(-inf,), (0.0,), (-0.0,), (inf,), (inf,)], "v double")
    assert radix.pooled_quantiles(df, ["v"], (0.0, 0.25, 0.5, 1.0))["v"] == [-inf, 0.0, 0.0, inf]
    assert radix.pooled_quantiles(df.limit(0), ["v"], (0.5,)) == {"v": None}
    assert radix.quantiles(df.limit(0).selectExpr("v", "v AS k"), ["k"], ["v"], (0.5,)).collect() == []
