"""Sliding structures against windows taken one by one."""

import time

import numpy as np
import pytest
from hypothesis import given, settings, strategies as st

from factorloom.functions import kernels, sliding

EPS = 1e-12


def average(w):
    return np.array([(w < v).sum() + ((w == v).sum() + 1) / 2 for v in w])


def moment(w, order):
    d = w - w.mean()
    return (d**order).mean() / (d * d).mean() ** (order / 2) if w.min() < w.max() else np.nan


def corrcoef(a, b):
    return np.corrcoef(a, b)[0, 1] if a.min() < a.max() and b.min() < b.max() else np.nan


def residual(y, *x):
    design = np.stack([np.ones(len(y)), *x], axis=1)
    if np.linalg.matrix_rank(design) < design.shape[1]:
        return np.nan
    return (y - design @ np.linalg.lstsq(design, y, rcond=None)[0]).std(ddof=1)


ONE = {
    "ts_std": lambda w: w.std(ddof=1),
    "ts_var": lambda w: w.var(ddof=1),
    "ts_zscore": lambda w: (w[-1] - w.mean()) / w.std(ddof=1) if w.std(ddof=1) > EPS else np.nan,
    "ts_skew_pop": lambda w: moment(w, 3),
    "ts_kurt_pop": lambda w: moment(w, 4) - 3,
    "ts_skew": lambda w: moment(w, 3) * np.sqrt(len(w) * (len(w) - 1)) / (len(w) - 2),
    "ts_kurt": lambda w: (len(w) - 1) / ((len(w) - 2) * (len(w) - 3)) * ((len(w) + 1) * (moment(w, 4) - 3) + 6),
    "ts_prod": lambda w: w.prod(),
    "ts_argmin": lambda w: np.argmin(w[::-1]),
    "ts_argmax": lambda w: np.argmax(w[::-1]),
    "ts_median": np.median,
    "ts_rank": lambda w: average(w)[-1] / len(w),
}
TWO = {
    "ts_cov": lambda a, b: np.cov(a, b)[0, 1],
    "ts_corr": corrcoef,
    "ts_rankcorr": lambda a, b: corrcoef(average(a), average(b)),
}


def windows(compute, arrays, n):
    out = np.full(len(arrays[0]), np.nan)
    for i in range(n - 1, len(out)):
        w = [a[i - n + 1 : i + 1] for a in arrays]
        if np.isfinite(w).all():
            with np.errstate(all="ignore"):
                out[i] = compute(*w)
    return out


def blanked(values, arrays, n):
    ends = sliding._complete_ends(np.logical_and.reduce([np.isfinite(a) for a in arrays]), n)
    out = np.full(len(values), np.nan)
    out[ends] = values[ends]
    return out


def series(seed, rows, kind="mixed"):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=rows) if kind == "mixed" else rng.integers(-2, 3, rows).astype(float)
    x[rng.random(rows) < 0.03] = np.nan
    x[rows // 3 : rows // 3 + 25] = 1.5
    return x


@pytest.mark.parametrize("rows, n", [(200, 5), (200, 12), (61, 20), (20, 20), (3, 20), (0, 4)])
@pytest.mark.parametrize("kind", ["mixed", "ties"])
def test_kernels_equal_single_windows(rows, n, kind):
    x, y = series(1, rows, kind), series(2, rows, kind)
    with np.errstate(all="ignore"):
        for name, compute in ONE.items():
            got = blanked(kernels.KERNELS[name](x, n=n, params=()), [x], n)
            np.testing.assert_allclose(got, windows(compute, [x], n), rtol=1e-9, atol=1e-10, err_msg=name)
        for name, compute in TWO.items():
            got = blanked(kernels.KERNELS[name](x, y, n=n, params=()), [x, y], n)
            np.testing.assert_allclose(got, windows(compute, [x, y], n), rtol=1e-9, atol=1e-10, err_msg=name)
        for q in (0.0, 0.2, 0.77, 1.0):
            got = kernels.KERNELS["ts_quantile"](x, n=n, params=(q,))
            np.testing.assert_allclose(got, windows(lambda w: np.quantile(w, q), [x], n), rtol=1e-12, atol=1e-14)
        got = kernels.KERNELS["ts_winsorize"](x, n=n, params=(0.1, 0.9))
        np.testing.assert_allclose(got, windows(lambda w: np.clip(w[-1], *np.quantile(w, [0.1, 0.9])), [x], n), rtol=1e-12, atol=1e-14)


@pytest.mark.parametrize("rows, n", [(150, 6), (150, 13), (40, 40)])
def test_residuals_equal_least_squares(rows, n):
    y, a, b = series(3, rows), series(4, rows), series(5, rows)
    for c in (series(6, rows), 2 * a - b + 1, np.zeros(rows), a * 0 + 7.0):
        got = sliding.residual_deviation(y, a, b, c, n=n)
        np.testing.assert_allclose(got, windows(residual, [y, a, b, c], n), rtol=1e-8, atol=1e-10)
    exact = 3 * a - 2 * b
    got = sliding.residual_deviation(exact, a, b, series(6, rows), n=n)
    assert np.isnan(got).all() or np.nanmax(got) < 1e-12


def test_no_digits_are_lost_to_values_outside_the_window():
    x = np.concatenate((np.full(30, 1e16), np.full(40, 0.1), np.arange(40.0)))
    std = sliding.deviation(x, 10)
    assert (std[39:70] == 0).all() and std[85] == pytest.approx(np.arange(10.0).std(ddof=1), rel=1e-14)


@given(st.lists(st.integers(-5, 5), min_size=1, max_size=40), st.integers(0, 39), st.integers(1, 40))
@settings(max_examples=150, deadline=None)
def test_any_range(values, begin, size):
    x = np.array(values, float)
    begin = min(begin, len(x) - 1)
    end = min(len(x), begin + size)
    ranges = sliding.Ranges(x)
    at = np.array([begin]), np.array([end])
    assert [ranges.nth(*at, k)[0] for k in range(end - begin)] == sorted(values[begin:end])
    for code, v in enumerate(ranges.values):
        less, same = ranges.below(*at, np.array([code]))
        assert (less[0], same[0]) == (sum(u < v for u in values[begin:end]), sum(u == v for u in values[begin:end]))


@pytest.mark.parametrize("name", ["ts_std", "ts_kurt", "ts_median", "ts_rank", "ts_argmax", "ts_prod", "ts_corr"])
def test_time_does_not_follow_the_window(name):
    x, y = np.random.default_rng(0).normal(size=(2, 1 << 16))
    args = (x, y) if name in TWO else (x,)
    seconds = {}
    for n in (20, 250, 20, 250):
        begin = time.process_time()
        kernels.KERNELS[name](*args, n=n, params=())
        seconds[n] = min(seconds.get(n, 9.0), time.process_time() - begin)
    assert seconds[250] < 2 * seconds[20] + 0.05, seconds
    print(name, seconds)
