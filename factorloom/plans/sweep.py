"""The finite factor grammar op(combine(field_a, field_b), window) as one bulk job."""

from __future__ import annotations

import itertools
from collections.abc import Sequence

from pyspark.sql import DataFrame

from ..functions import feature as fx
from ..functions.feature import Feature
from ..operators.blocks import frozen
from ..operators.panel import Panel
from ..operators.scoring import evaluate_factors
from ..operators.targets import Fold

# The dimensions of the grammar.
OPS = {
    "return": fx.change,
    "delta": fx.delta,
    "mean": fx.ts_mean,
    "std": fx.ts_std,
    "zscore": fx.ts_zscore,
}
COMBINES = {"add": fx.add, "sub": fx.subtract, "mul": fx.multiply, "div": fx.divide}
WINDOWS = {"5m": (3, 6, 12, 24, 48, 96), "1d": (5, 10, 20, 60, 120)}


def genome(op: str, a: str, b: str, window: int, combine: str) -> tuple[str, Feature]:
    base = fx.field(a) if combine == "single" else COMBINES[combine](fx.field(a), fx.field(b))
    second = "" if combine == "single" else f"_{combine}_{b}"
    return f"{op}_{a}{second}_{window}", OPS[op](base, window)


def grammar(
    fields: Sequence[str],
    frequency: str = "1d",
    ops: Sequence[str] = tuple(OPS),
    windows: Sequence[int] | None = None,
    combines: Sequence[str] = ("single", *COMBINES),
) -> dict[str, Feature]:
    """Every distinct genome; single-field genomes appear once."""
    out: dict[str, Feature] = {}
    sizes = windows or WINDOWS[frequency]
    for op, a, b, n, c in itertools.product(ops, fields, fields, sizes, combines):
        name, feature = genome(op, a, b, n, c)
        out.setdefault(name, feature)
    return out


def sweep(
    panel: Panel, features: dict[str, Feature], fold: Fold, metric: str, chunk: int = 150
) -> DataFrame:
    """Evaluate all genomes; a chunk's columns are computed in one pass over the sorted rows and scored together."""
    names, result = list(features), None
    # The chunks read one written panel.
    panel = Panel(frozen(panel.df), panel.spec, panel.rows, frames=0)
    for at in range(0, len(names), chunk):
        part = names[at : at + chunk]
        wide = panel.with_features({n: features[n] for n in part})
        scored = evaluate_factors(wide, part, fold, metric, rows=panel.rows)
        result = scored if result is None else result.unionByName(scored)
    return result
