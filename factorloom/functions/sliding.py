"""Sliding-window statistics whose cost per row does not grow with the window.

Three structures, all evaluated for every row of a batch at once:

* two stacks: rows are cut into blocks of n; a window is the end of one block and the beginning of the
  next, so it is the merge of a suffix state and a prefix state.  States only ever grow or merge, nothing
  is subtracted, so neither cancellation nor values outside the window cost digits, and a constant window
  has exactly no deviation.  Moments, co-moments, products, positions of extremes and triangular
  factors of a regression are such states.
* a wavelet matrix over rank codes: order statistics and ranks in any range of rows, in one step per bit
  of the number of different values.
* ranks kept under insert and delete, for rank correlations: each step compares the window with the value
  that enters and the one that leaves; many stretches of rows advance together.  This one is linear in n,
  without the sorts.

Functions take 1-D arrays and the window length, and return one value per row; rows whose window is not
complete or holds a missing value have no defined value.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np

from .guards import EPS

State = tuple[np.ndarray, ...]


def two_stacks(columns: Sequence[np.ndarray], n: int, first: Callable, add: Callable, merge: Callable) -> State | None:
    """State of every window, one entry for each row from n - 1 on; None with fewer rows.

    `first(*values)` is the state of one row, `add(state, *values, count)` takes one more row into a state of
    `count` rows, `merge(a, count_a, b, count_b)` joins two states, the earlier rows first.
    """
    rows = len(columns[0])
    if rows < n:
        return None
    blocks = -(-rows // n)
    steps = [np.ascontiguousarray(np.concatenate((c, np.full(blocks * n - rows, np.nan))).reshape(blocks, n).T) for c in columns]

    def scan(order: range) -> list[np.ndarray]:
        state, out = None, []
        for count, k in enumerate(order):
            values = [s[k] for s in steps]
            state = first(*values) if state is None else add(state, *values, count)
            out.append(state)
        if order.step < 0:
            out.reverse()
        # Entry (place in the block, block) as one axis.
        return [np.stack([s[c] for s in out]).reshape(n * blocks, *out[0][c].shape[1:]) for c in range(len(out[0]))]

    ends = np.arange(n - 1, rows)
    begins = ends - n + 1
    at = lambda row: row % n * blocks + row // n
    early = tuple(s[at(begins)] for s in scan(range(n - 1, -1, -1)))
    split = np.flatnonzero(begins % n)
    if len(split):
        late = tuple(s[at(ends[split])] for s in scan(range(n)))
        joined = merge(tuple(s[split] for s in early), n - begins[split] % n, late, ends[split] % n + 1)
        for whole, part in zip(early, joined):
            whole[split] = part
    return early


def _from(rows: int, n: int, values: np.ndarray | None) -> np.ndarray:
    out = np.full(rows, np.nan)
    if values is not None:
        out[n - 1 :] = values
    return out


# --- moments --------------------------------------------------------------------------------------


def _moments(x: np.ndarray, n: int, order: int) -> State | None:
    """(mean, sums of the 2nd to `order`-th powers of the distances from it) of every window."""

    def first(v):
        return (v.copy(), *[v * 0.0 for _ in range(order - 1)])

    def add(state, v, count):
        size = count + 1
        mean, second = state[:2]
        delta = v - mean
        part = delta / size
        term = delta * part * count
        out = [mean + part, second + term]
        if order > 2:
            out.append(state[2] + term * part * (size - 2) - 3 * part * second)
        if order > 3:
            square = part * part
            out.append(state[3] + term * square * (size * size - 3 * size + 3) + 6 * square * second - 4 * part * state[2])
        return tuple(out)

    def merge(a, na, b, nb):
        size = na + nb
        delta = b[0] - a[0]
        part = delta / size
        cross = delta * part * na * nb
        out = [a[0] + part * nb, a[1] + b[1] + cross]
        if order > 2:
            out.append(a[2] + b[2] + cross * part * (na - nb) + 3 * part * (na * b[1] - nb * a[1]))
        if order > 3:
            square = part * part
            out.append(
                a[3] + b[3] + cross * square * (na * na - na * nb + nb * nb)
                + 6 * square * (na * na * b[1] + nb * nb * a[1]) + 4 * part * (na * b[2] - nb * a[2])
            )
        return tuple(out)

    return two_stacks([x], n, first, add, merge)


def extreme(pick: np.ufunc) -> Callable:
    """Window extremes from prefix and suffix extremes of the blocks."""

    def kernel(x: np.ndarray, n: int, params: tuple = ()) -> np.ndarray:
        out = np.full(len(x), np.nan)
        if len(x) < n:
            return out
        blocks = np.concatenate((x, np.full(-len(x) % n, np.nan))).reshape(-1, n)
        upto = pick.accumulate(blocks, axis=1).reshape(-1)
        onward = pick.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].reshape(-1)
        out[n - 1 :] = pick(onward[: len(x) - n + 1], upto[n - 1 : len(x)])
        return out

    return kernel


_low, _high = extreme(np.fmin), extreme(np.fmax)


def varies(x: np.ndarray, n: int) -> np.ndarray:
    return _low(x, n) < _high(x, n)


def variance(x: np.ndarray, n: int, params: tuple = ()) -> np.ndarray:
    state = _moments(x, n, 2)
    return _from(len(x), n, None if state is None else state[1] / (n - 1))


def deviation(x: np.ndarray, n: int, params: tuple = ()) -> np.ndarray:
    return np.sqrt(variance(x, n))


def zscore(x: np.ndarray, n: int, params: tuple = ()) -> np.ndarray:
    state = _moments(x, n, 2)
    if state is None:
        return np.full(len(x), np.nan)
    mean, std = state[0], np.sqrt(state[1] / (n - 1))
    return _from(len(x), n, np.where(std > EPS, (x[n - 1 :] - mean) / np.where(std > EPS, std, 1.0), np.nan))


def _standard(x: np.ndarray, n: int, order: int) -> tuple[np.ndarray, np.ndarray]:
    """Standardised moment of every window that varies, and its sample deviation."""
    state = _moments(x, n, order)
    if state is None:
        return (np.full(len(x), np.nan),) * 2
    second = state[1] / n
    value = state[order - 1] / n / np.where(second > 0, second, 1.0) ** (order / 2)
    return np.where(varies(x, n), _from(len(x), n, value), np.nan), _from(len(x), n, np.sqrt(state[1] / (n - 1)))


def skew_pop(x: np.ndarray, n: int, params: tuple = ()) -> np.ndarray:
    return _standard(x, n, 3)[0]


def kurt_pop(x: np.ndarray, n: int, params: tuple = ()) -> np.ndarray:
    return _standard(x, n, 4)[0] - 3


def skew(x: np.ndarray, n: int, params: tuple = ()) -> np.ndarray:
    value, std = _standard(x, n, 3)
    return np.where(std > EPS, value * np.sqrt(n * (n - 1)) / (n - 2), np.nan)


def kurt(x: np.ndarray, n: int, params: tuple = ()) -> np.ndarray:
    value, std = _standard(x, n, 4)
    return np.where(std > EPS, (n - 1) / ((n - 2) * (n - 3)) * ((n + 1) * (value - 3) + 6), np.nan)


def _comoments(x: np.ndarray, y: np.ndarray, n: int) -> State | None:
    """(means, sum of products, sums of squares) of the distances from the window's means."""

    def first(a, b):
        return a.copy(), b.copy(), a * b * 0.0, a * 0.0, b * 0.0

    def add(state, a, b, count):
        ma, mb, ab, aa, bb = state
        da, db = a - ma, b - mb
        share = count / (count + 1)
        return ma + da / (count + 1), mb + db / (count + 1), ab + da * db * share, aa + da * da * share, bb + db * db * share

    def merge(p, np_, q, nq):
        da, db = q[0] - p[0], q[1] - p[1]
        share = np_ * nq / (np_ + nq)
        part = nq / (np_ + nq)
        return (
            p[0] + da * part, p[1] + db * part, p[2] + q[2] + da * db * share, p[3] + q[3] + da * da * share, p[4] + q[4] + db * db * share,
        )

    return two_stacks([x, y], n, first, add, merge)


def _joint(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    both = np.isfinite(x) & np.isfinite(y)
    return np.where(both, x, np.nan), np.where(both, y, np.nan)


def covariance(x: np.ndarray, y: np.ndarray, n: int, params: tuple = ()) -> np.ndarray:
    state = _comoments(*_joint(x, y), n)
    return _from(len(x), n, None if state is None else state[2] / (n - 1))


def correlation(x: np.ndarray, y: np.ndarray, n: int, params: tuple = ()) -> np.ndarray:
    x, y = _joint(x, y)
    state = _comoments(x, y, n)
    if state is None:
        return np.full(len(x), np.nan)
    size = _from(len(x), n, np.sqrt(state[3]) * np.sqrt(state[4]))
    usable = varies(x, n) & varies(y, n) & (size > 0)
    return np.where(usable, np.clip(_from(len(x), n, state[2]) / np.where(usable, size, 1.0), -1, 1), np.nan)


def product(x: np.ndarray, n: int, params: tuple = ()) -> np.ndarray:
    state = two_stacks([x], n, lambda v: (v.copy(),), lambda s, v, count: (s[0] * v,), lambda a, na, b, nb: (a[0] * b[0],))
    return _from(len(x), n, None if state is None else state[0])


def rows_since(best: Callable[[np.ndarray, np.ndarray], np.ndarray]) -> Callable:
    """Rows since the window's last extreme value; `best(a, b)` says where a is strictly better than b."""

    def kernel(x: np.ndarray, n: int, params: tuple = ()) -> np.ndarray:
        place = np.arange(len(x), dtype=float)

        def first(v, at):
            return v.copy(), at.copy()

        def merge(a, na, b, nb):
            # Of equal values the later one counts.
            early = best(a[0], b[0])
            return np.where(early, a[0], b[0]), np.where(early, a[1], b[1])

        def add(state, v, at, count):
            later = at > state[1]
            better = np.where(later, ~best(state[0], v), best(v, state[0]))
            return np.where(better, v, state[0]), np.where(better, at, state[1])

        state = two_stacks([x, place], n, first, add, merge)
        return _from(len(x), n, None if state is None else place[n - 1 :] - state[1])

    return kernel


# --- order statistics -----------------------------------------------------------------------------


class Ranges:
    """Order statistics of any ranges of rows, by a wavelet matrix over the values' rank codes."""

    def __init__(self, x: np.ndarray):
        known = np.isfinite(x)
        self.values, codes = np.unique(x[known], return_inverse=True)
        self.codes = np.zeros(len(x), np.int64)
        self.codes[known] = codes
        self.bits = range(max(1, int(max(len(self.values) - 1, 1)).bit_length()) - 1, -1, -1)
        #: Per bit: rows with a 0 before each row, and with a 0 at all.
        self.levels: list[tuple[np.ndarray, int]] = []
        order = self.codes
        for bit in self.bits:
            one = (order >> bit) & 1 == 1
            zeros = np.concatenate(([0], np.cumsum(~one)))
            self.levels.append((zeros, int(zeros[-1])))
            order = np.concatenate((order[~one], order[one]))

    def nth(self, begin: np.ndarray, end: np.ndarray, place: int) -> np.ndarray:
        """The value at a place (from 0) in the order of each range begin .. end - 1."""
        rest = np.full(len(begin), place)
        code = np.zeros(len(begin), np.int64)
        for bit, (zeros, all_) in zip(self.bits, self.levels):
            a, b = zeros[begin], zeros[end]
            up = rest >= b - a
            rest = np.where(up, rest - (b - a), rest)
            begin, end = np.where(up, all_ + begin - a, a), np.where(up, all_ + end - b, b)
            code |= up.astype(np.int64) << bit
        return self.values[np.minimum(code, max(len(self.values) - 1, 0))] if len(self.values) else np.full(len(code), np.nan)

    def below(self, begin: np.ndarray, end: np.ndarray, code: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """How many values of each range have a smaller code, and how many this one."""
        less = np.zeros(len(begin), np.int64)
        for bit, (zeros, all_) in zip(self.bits, self.levels):
            a, b = zeros[begin], zeros[end]
            up = (code >> bit) & 1 == 1
            less += np.where(up, b - a, 0)
            begin, end = np.where(up, all_ + begin - a, a), np.where(up, all_ + end - b, b)
        return less, end - begin


def _complete_ends(known: np.ndarray, n: int) -> np.ndarray:
    """Last rows of the windows that hold known values only."""
    total = np.concatenate(([0], np.cumsum(known)))
    return np.flatnonzero(total[n:] - total[:-n] == n) + n - 1 if len(known) >= n else np.zeros(0, np.int64)


def _quantiles(x: np.ndarray, n: int, points: Sequence[float]) -> tuple[np.ndarray, list[np.ndarray]]:
    ends = _complete_ends(np.isfinite(x), n)
    ranges, out, seen = Ranges(x), [], {}
    for q in points:
        at = (n - 1) * q
        for place in (int(np.floor(at)), int(np.ceil(at))):
            if place not in seen:
                seen[place] = ranges.nth(ends - n + 1, ends + 1, place)
        low, high = seen[int(np.floor(at))], seen[int(np.ceil(at))]
        out.append(low + (high - low) * (at - np.floor(at)))
    return ends, out


def quantile(x: np.ndarray, n: int, params: tuple) -> np.ndarray:
    out = np.full(len(x), np.nan)
    ends, (value,) = _quantiles(x, n, params)
    out[ends] = value
    return out


def median(x: np.ndarray, n: int, params: tuple = ()) -> np.ndarray:
    return quantile(x, n, (0.5,))


def winsorize(x: np.ndarray, n: int, params: tuple) -> np.ndarray:
    out = np.full(len(x), np.nan)
    ends, (low, high) = _quantiles(x, n, params)
    out[ends] = np.minimum(np.maximum(x[ends], low), high)
    return out


def rank(x: np.ndarray, n: int, params: tuple = ()) -> np.ndarray:
    """Average rank of the last value in its window, over n."""
    out = np.full(len(x), np.nan)
    ends = _complete_ends(np.isfinite(x), n)
    ranges = Ranges(x)
    less, same = ranges.below(ends - n + 1, ends + 1, ranges.codes[ends])
    out[ends] = (less + (same + 1) / 2) / n
    return out


# --- rank correlation -----------------------------------------------------------------------------

#: Cells of the windows that advance together.
CELLS = 1 << 18


def _above(window: np.ndarray, value: np.ndarray) -> np.ndarray:
    """What a value adds to the rank of each of the window's values: one below it, a half if equal."""
    v = value[:, None]
    return (window > v) + 0.5 * (window == v)


def rank_correlation(x: np.ndarray, y: np.ndarray, n: int, params: tuple = ()) -> np.ndarray:
    """Spearman correlation, ranked again inside each window."""
    out = np.full(len(x), np.nan)
    x, y = _joint(x, y)
    rows = len(x)
    if rows < n:
        return out
    windows = rows - n + 1
    # Stretches of `length` windows begin side by side; a stretch's first window is ranked by itself.
    length = min(windows, max(n, -(-windows * n // CELLS)))
    starts = np.arange(0, windows, length)
    pad = np.full(length + n, np.nan)
    sides = [np.concatenate((x, pad)), np.concatenate((y, pad))]
    views = [np.lib.stride_tricks.sliding_window_view(s, n)[starts].copy() for s in sides]
    # Ranks of missing values mean nothing, and windows that hold one are blanked.
    ranks = [sum(_above(w, w[:, k]) for k in range(n)) + 0.5 for w in views]
    centre = (n + 1) / 2
    for step in range(length):
        at = starts + step
        own = at < windows
        a, b = (r - centre for r in ranks)
        with np.errstate(all="ignore"):
            r = (a * b).sum(1) / np.sqrt((a * a).sum(1) * (b * b).sum(1))
        out[at[own] + n - 1] = r[own]
        if step + 1 == length:
            break
        slot = step % n
        for side, window, rank_ in zip(sides, views, ranks):
            old, new = window[:, slot].copy(), side[at + n]
            window[:, slot] = new
            rank_ += _above(window, new)
            rank_ -= _above(window, old)
            rank_[:, slot] = _rank_of(window, new)
    known = np.isfinite(x)
    blank = np.ones(rows, bool)
    blank[_complete_ends(known, n)] = False
    out[blank] = np.nan
    return out


def _rank_of(window: np.ndarray, value: np.ndarray) -> np.ndarray:
    v = value[:, None]
    return (window < v).sum(1) + ((window == v).sum(1) + 1) / 2


# --- least squares --------------------------------------------------------------------------------


def residual_deviation(y: np.ndarray, *regressors: np.ndarray, n: int, params: tuple = ()) -> np.ndarray:
    """Sample deviation of least-squares residuals on an intercept and the regressors.

    Undefined unless the design has full column rank, by its singular values, which are those of
    its triangular factor.
    """
    columns = [np.ones(len(y)), *regressors, y]
    known = np.logical_and.reduce([np.isfinite(c) for c in columns])
    columns = [np.where(known, c, np.nan) for c in columns]
    k = len(columns)

    def take(factor: np.ndarray, row: np.ndarray) -> np.ndarray:
        """The triangular factor of the rows so far and one more, by plane rotations."""
        out, row = factor.copy(), row.copy()
        for i in range(k):
            a, b = out[:, i, i], row[:, i]
            size = np.hypot(a, b)
            safe = np.where(size > 0, size, 1.0)
            c, s = np.where(size > 0, a / safe, 1.0)[:, None], np.where(size > 0, b / safe, 0.0)[:, None]
            upper, lower = out[:, i, i:].copy(), row[:, i:].copy()
            out[:, i, i:] = c * upper + s * lower
            row[:, i:] = c * lower - s * upper
        return out

    def first(*values):
        return (take(np.zeros((len(values[0]), k, k)), np.stack(values, axis=1)),)

    def add(state, *values):
        return (take(state[0], np.stack(values[:-1], axis=1)),)

    def merge(a, na, b, nb):
        joined = a[0]
        for i in range(k):
            joined = take(joined, b[0][:, i])
        return (joined,)

    with np.errstate(all="ignore"):
        state = two_stacks(columns, n, first, add, merge)
    out = np.full(len(y), np.nan)
    ends = _complete_ends(known, n)
    if state is None or not len(ends):
        return out
    factor = state[0][ends - n + 1]
    s = np.linalg.svd(factor[:, : k - 1, : k - 1], compute_uv=False)
    full = (s > s[:, :1] * max(n, k - 1) * np.finfo(float).eps).all(axis=1)
    out[ends] = np.where(full, np.abs(factor[:, k - 1, k - 1]) / np.sqrt(n - 1), np.nan)
    return out
