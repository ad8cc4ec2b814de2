"""Factor expressions: immutable compositions of named operators over panel fields.

A `Feature` only records what to compute.  `Panel.with_features` turns a batch of them into staged
DataFrame columns, so equal sub-expressions are computed once and Catalyst plans the rest.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterable
from dataclasses import dataclass, field as _field

from . import rolling, scalar
from .guards import MIN_WINDOW


@dataclass(frozen=True)
class Operator:
    """How one named operator is evaluated and validated."""

    name: str
    scope: str  # scalar | ts | kernel | cs | lagged
    series: int
    params: tuple[str, ...] = ()
    defaults: tuple[float, ...] = ()
    function: Callable | None = None
    history: str = "none"  # none | window | lag
    condition: bool = False
    takes_condition: tuple[int, ...] = ()
    clean: bool = True

    def rows_back(self, params: tuple) -> int:
        if self.history == "none":
            return 0
        n = int(params[self.params.index("n")])
        return n if self.history == "lag" else n - 1


@dataclass(frozen=True)
class Feature:
    op: str
    args: tuple["Feature", ...] = ()
    params: tuple = ()
    kernel: Callable | None = None
    _hash: int = _field(default=0, compare=False, repr=False)

    def __post_init__(self):
        key = (self.op, self.args, self.params, self.kernel)
        object.__setattr__(self, "_hash", hash(key))

    def __hash__(self):
        return self._hash

    def __add__(self, other):
        return add(self, other)

    def __radd__(self, other):
        return add(other, self)

    def __sub__(self, other):
        return subtract(self, other)

    def __rsub__(self, other):
        return subtract(other, self)

    def __mul__(self, other):
        return multiply(self, other)

    def __rmul__(self, other):
        return multiply(other, self)

    def __truediv__(self, other):
        return divide(self, other)

    def __rtruediv__(self, other):
        return divide(other, self)

    def __neg__(self):
        return neg(self)

    def __lt__(self, other):
        return lt(self, other)

    def __le__(self, other):
        return le(self, other)

    def __gt__(self, other):
        return gt(self, other)

    def __ge__(self, other):
        return ge(self, other)

    @property
    def condition(self) -> bool:
        if self.op == "at":
            return self.args[0].condition
        return self.op in OPERATORS and OPERATORS[self.op].condition

    def fields(self) -> frozenset[str]:
        if self.op == "field":
            return frozenset([self.params[0]])
        return frozenset().union(*(a.fields() for a in self.args))

    def lookback(self) -> int:
        """Rows before the current one that the value depends on."""
        inner = max((a.lookback() for a in self.args), default=0)
        if self.op in OPERATORS:
            spec = OPERATORS[self.op]
            return inner + (1 if spec.scope == "lagged" else spec.rows_back(self.params))
        return inner


OPERATORS: dict[str, Operator] = {}


def field(name: str) -> Feature:
    return Feature("field", params=(name,))


def const(value: float) -> Feature:
    if not math.isfinite(value):
        raise ValueError("constants must be finite")
    return Feature("const", params=(float(value),))


def _wrap(value) -> Feature:
    return value if isinstance(value, Feature) else const(value)


def _validate(spec: Operator, args: tuple[Feature, ...], params: tuple) -> None:
    for i, a in enumerate(args):
        if a.condition != (i in spec.takes_condition):
            kind = "a condition" if i in spec.takes_condition else "a numeric series"
            raise ValueError(f"{spec.name}: argument {i + 1} must be {kind}")
    named = dict(zip(spec.params, params, strict=True))
    if "n" in named:
        n = named["n"]
        if n != int(n) or n < MIN_WINDOW.get(spec.name, 1):
            raise ValueError(f"{spec.name}: window must be an integer >= {MIN_WINDOW.get(spec.name, 1)}")
    if "low" in named:
        low, high = named["low"], named["high"]
        if low > high or ("winsorize" in spec.name and not 0 <= low < high <= 1):
            raise ValueError(f"{spec.name}: invalid bounds")
    if "q" in named and not 0 <= named["q"] <= 1:
        raise ValueError(f"{spec.name}: quantile must be in [0, 1]")
    if "coverage" in named and not 0 < named["coverage"] <= 1:
        raise ValueError(f"{spec.name}: coverage must be in (0, 1]")
    if "tail" in named and not 0 < named["tail"] <= 0.5:
        raise ValueError(f"{spec.name}: tail must be in (0, 0.5]")


def _register(spec: Operator) -> Callable[..., Feature]:
    OPERATORS[spec.name] = spec

    def build(*values, **named) -> Feature:
        args = tuple(_wrap(v) for v in values[: spec.series])
        given = list(values[spec.series :])
        for name in spec.params[len(given) :]:
            if name in named:
                given.append(named.pop(name))
        if named:
            raise TypeError(f"{spec.name}: unexpected {sorted(named)}")
        missing = len(spec.params) - len(given)
        if len(args) != spec.series or missing < 0 or missing > len(spec.defaults):
            raise TypeError(f"{spec.name} takes {spec.series} series and {spec.params}")
        if missing:
            given += spec.defaults[-missing:]
        params = tuple(given)
        _validate(spec, args, params)
        return Feature(spec.name, args, params)

    build.__name__ = spec.name
    build.__doc__ = (spec.function.__doc__ if spec.function else None) or spec.name
    return build


def _scalar(name, series, params=(), **options):
    return _register(Operator(name, "scalar", series, params, function=getattr(scalar, name), **options))


def _ts(name, series=1, params=("n",), history="window", **options):
    return _register(
        Operator(name, "ts", series, params, function=getattr(rolling, name), history=history, **options)
    )


add, subtract, multiply, divide = (_scalar(n, 2) for n in ("add", "subtract", "multiply", "divide"))
minimum, maximum, fillna = (_scalar(n, 2) for n in ("minimum", "maximum", "fillna"))
neg, absolute, sign = (_scalar(n, 1) for n in ("neg", "absolute", "sign"))
log, log1p, sqrt, exp = (_scalar(n, 1) for n in ("log", "log1p", "sqrt", "exp"))
power, signed_power = (_scalar(n, 1, ("p",)) for n in ("power", "signed_power"))
clip = _scalar("clip", 1, ("low", "high"))
lt, le, gt, ge, eq, ne = (
    _scalar(n, 2, condition=True) for n in ("lt", "le", "gt", "ge", "eq", "ne")
)
both, either = (
    _scalar(n, 2, condition=True, takes_condition=(0, 1)) for n in ("both", "either")
)
negate = _scalar("negate", 1, condition=True, takes_condition=(0,))
if_then_else = _scalar("if_then_else", 3, takes_condition=(0,))
is_finite = _scalar("is_finite", 1, condition=True)

obs_lag, delay, delta, change = (_ts(n, history="lag") for n in ("obs_lag", "delay", "delta", "change"))
ts_sum, ts_mean, ts_median, ts_min, ts_max = (
    _ts(n) for n in ("ts_sum", "ts_mean", "ts_median", "ts_min", "ts_max")
)
ts_std, ts_var, ts_zscore = (_ts(n) for n in ("ts_std", "ts_var", "ts_zscore"))
ts_skew, ts_kurt, ts_skew_pop, ts_kurt_pop = (
    _ts(n) for n in ("ts_skew", "ts_kurt", "ts_skew_pop", "ts_kurt_pop")
)
ts_rank, ts_linear_decay, ts_prod, ts_argmin, ts_argmax = (
    _ts(n) for n in ("ts_rank", "ts_linear_decay", "ts_prod", "ts_argmin", "ts_argmax")
)
ts_quantile = _ts("ts_quantile", params=("n", "q"))
ts_winsorize = _ts("ts_winsorize", params=("n", "low", "high"), defaults=(0.01, 0.99))
ts_corr, ts_cov = _ts("ts_corr", 2), _ts("ts_cov", 2)
ts_count, ts_rate = (_ts(n, takes_condition=(0,)) for n in ("ts_count", "ts_rate"))
ts_any, ts_all = (_ts(n, takes_condition=(0,), condition=True) for n in ("ts_any", "ts_all"))



def _kernel(name: str, series: int):
    return _register(Operator(name, "kernel", series, ("n",), history="window"))


ts_rankcorr, ts_resid_std3 = _kernel("ts_rankcorr", 2), _kernel("ts_resid_std3", 4)
robust_trend = _kernel("robust_trend", 2)


def _cs(name, params=(), defaults=()):
    return _register(Operator(name, "cs", 1, params, defaults, function=None))


cs_rank, cs_demean, cs_zscore, cs_scale = (
    _cs(n) for n in ("cs_rank", "cs_demean", "cs_zscore", "cs_scale")
)
cs_winsorize = _cs("cs_winsorize", ("low", "high"), (0.01, 0.99))
cs_lagged_mean = _register(
    Operator("cs_lagged_mean", "lagged", 2, ("holdings", "coverage"), takes_condition=(1,))
)
cs_lagged_spread = _register(
    Operator("cs_lagged_spread", "lagged", 3, ("tail", "coverage"), takes_condition=(2,))
)
OPERATORS["ts_apply"] = Operator("ts_apply", "kernel", 0, ("n",), history="window")
OPERATORS["cs_apply"] = Operator("cs_apply", "cs_kernel", 0)
OPERATORS["cs_reduce"] = Operator("cs_reduce", "cs_reduction", 0)


@dataclass(frozen=True)
class Reduction:
    """A cross-section kernel in parts, so that no task needs a whole cross-section.

    `partial(*arrays)` sums some members up in a short 1-D array, `merge(states)` combines such
    arrays (one per row of a matrix) into one, and `finish(state, *arrays)` gives some members their
    values.  The result may not depend on how members are split.
    """

    partial: Callable
    merge: Callable
    finish: Callable


def ts_apply(kernel: Callable, series: Iterable, n: int) -> Feature:
    """Custom rolling kernel.

    `kernel` receives one 2-D array per series, a row for each complete finite window (oldest
    value first), and returns one number per row; non-finite results become null.
    """
    return Feature("ts_apply", tuple(_wrap(s) for s in series), (int(n),), kernel)


def cs_apply(kernel: Callable, series: Iterable) -> Feature:
    """Custom cross-section kernel over the eligible finite members of one time.

    The members of a time meet in one task; a kernel that can be split should be a `cs_reduce`.
    """
    return Feature("cs_apply", tuple(_wrap(s) for s in series), (), kernel)


def cs_reduce(reduction: Reduction, series: Iterable) -> Feature:
    """Custom cross-section kernel given as partial sums, at any width of a time."""
    return Feature("cs_reduce", tuple(_wrap(s) for s in series), (), reduction)


# Short names for the same operators.
sub, mul, div, lag, mean, std, zscore = subtract, multiply, divide, delay, ts_mean, ts_std, ts_zscore
csrank = rank = cs_rank
ts_pctchange, pow_ = change, power
