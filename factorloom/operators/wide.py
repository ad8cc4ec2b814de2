"""Correlations of many factor columns with one target, per group, without rows per factor.

Rows are shuffled once, wide, so that a group (a day, a product) lies in one task; one Arrow pass then
ranks the group's factor columns, some at a time.  Factors with the same rows missing form a mask class,
and the target is ranked once per class.  What leaves the pass is one row per (group, factor).
Groups with more values than a task should hold are counted beforehand.  Their columns are dealt in slices,
each with the target, to tasks of their own.  Only groups of which not even a slice of one column fits take rows
per factor instead, ranked through distinct values that combine on the map side.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import DoubleType, LongType, StringType, StructField, StructType

from ..functions.guards import corr_agg, finite, is_finite
from .blocks import group_limit
from .ranks import attach_ranks

#: Values (rows x columns) of one group that a task may hold, and of those that are ranked at a time.
CELLS = 8 << 20
STEP_CELLS = 1 << 19
#: Column with the number of a slice of the factors.
SLICE = "__slice"
MIN_OBSERVATIONS = 5
#: Result columns next to the keys: rows of the group, rows with a finite raw value, extremes of the
#: clipped values, rows with value and target, and their correlations (null unless both vary on enough rows).
RESULT = [
    StructField("factor", StringType()),
    *[StructField(c, LongType()) for c in ("rows", "seen")],
    *[StructField(c, DoubleType()) for c in ("low", "high")],
    StructField("n", LongType()),
    *[StructField(c, DoubleType()) for c in ("pearson", "spearman")],
]
Bounds = Mapping[str, Sequence[float] | None]


@dataclass(frozen=True)
class Clipping:
    """Fitted bounds by column name; a column without bounds has no value.  None: no clipping."""

    factors: Bounds | None = None
    target: Sequence[float] | None = None
    #: Factor of each column, for instance its direction.
    scale: Mapping[str, float] = field(default_factory=dict)

    def apply(self, name: str, x: np.ndarray) -> np.ndarray:
        x = np.where(np.isfinite(x), x, np.nan)
        if self.factors is not None:
            ends = self.factors.get(name)
            x = np.full(len(x), np.nan) if ends is None else np.clip(x, *ends)
        return x * self.scale.get(name, 1.0)


def average_ranks(x: np.ndarray) -> np.ndarray:
    """Ranks from 1 inside every column, ties averaged; NaN sort last."""
    n = len(x)
    order = np.argsort(x, axis=0, kind="stable")
    sorted_ = np.take_along_axis(x, order, 0)
    at = np.arange(n)[:, None]
    new = np.ones(x.shape, bool)
    new[1:] = sorted_[1:] != sorted_[:-1]
    first = np.maximum.accumulate(np.where(new, at, 0), axis=0)
    last = np.ones(x.shape, bool)
    last[:-1] = new[1:]
    end = np.minimum.accumulate(np.where(last, at, n)[::-1], axis=0)[::-1]
    out = np.empty(x.shape)
    np.put_along_axis(out, order, (first + end) / 2 + 1, 0)
    return out


def _pearson(x: np.ndarray, y: np.ndarray, ok: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Column by column over the rows that `ok` marks."""
    with np.errstate(all="ignore"):
        x, y = np.where(ok, x, 0.0), np.where(ok, y, 0.0)
        x = np.where(ok, x - x.sum(0) / n, 0.0)
        y = np.where(ok, y - y.sum(0) / n, 0.0)
        r = (x * y).sum(0) / (np.sqrt((x * x).sum(0)) * np.sqrt((y * y).sum(0)))
    return np.where(np.isfinite(r), np.clip(r, -1.0, 1.0), np.nan)


def correlations(x: np.ndarray, y: np.ndarray, spearman: bool = True) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(n, pearson, spearman) of every column of x with y, each over its rows where both are finite."""
    ok = np.isfinite(x) & np.isfinite(y)[:, None]
    n = ok.sum(0)
    span = lambda a: np.where(ok, a, -np.inf).max(0, initial=-np.inf) > np.where(ok, a, np.inf).min(0, initial=np.inf)
    wide = np.broadcast_to(y[:, None], x.shape)
    valid = (n >= MIN_OBSERVATIONS) & span(x) & span(wide)
    pearson, ranked = np.full(len(n), np.nan), np.full(len(n), np.nan)
    own = np.flatnonzero(valid)
    if len(own):
        x, ok = x[:, own], ok[:, own]
        pearson[own] = _pearson(x, wide[:, own], ok, n[own])
        if spearman:
            ry = np.zeros(x.shape)
            classes: dict[bytes, list[int]] = {}
            for j, mask in enumerate(np.packbits(ok, axis=0).T):
                classes.setdefault(mask.tobytes(), []).append(j)
            for members in classes.values():
                rows = np.flatnonzero(ok[:, members[0]])
                ry[np.ix_(rows, members)] = average_ranks(y[rows][:, None])
            rx = average_ranks(np.where(ok, x, np.nan))
            ranked[own] = _pearson(rx, ry, ok, n[own])
    return n, pearson, ranked


def _task(keys: int, factors: Sequence[str], clipping: Clipping, spearman: bool, width: int | None = None):
    """Task function over rows sorted by key: (keys..., target, factors...) to one row per group and factor.

    With a width the last key is the number of a slice of so many factors, which the result leaves out.
    """

    def results(group: pa.Table) -> Iterator[pa.RecordBatch]:
        own, heads = factors, keys
        if width is not None:
            at, heads = group.column(keys - 1)[0].as_py() * width, keys - 1
            own = factors[at : at + width]
        y = group.column(keys).to_numpy().astype(np.float64)
        y = np.where(np.isfinite(y), y, np.nan)
        if clipping.target is not None:
            y = np.clip(y, *clipping.target)
        step = max(1, STEP_CELLS // len(group))
        for at in range(0, len(own), step):
            yield result(group, own[at : at + step], y, keys + 1 + at, heads)

    def result(group: pa.Table, factors: Sequence[str], y: np.ndarray, first: int, keys: int) -> pa.RecordBatch:
        raw = [group.column(first + i).to_numpy().astype(np.float64) for i in range(len(factors))]
        seen = [int(np.isfinite(c).sum()) for c in raw]
        x = np.stack([clipping.apply(f, c) for f, c in zip(factors, raw)], axis=1)
        known = ~np.isnan(x)
        low, high = np.where(known, x, np.inf).min(0), np.where(known, x, -np.inf).max(0)
        n, pearson, ranked = correlations(x, y, spearman)
        k = len(factors)
        number = lambda a: pa.array(a, pa.float64(), mask=~np.isfinite(a))
        heads = [pa.array([group.column(i)[0].as_py()] * k, group.schema.field(i).type) for i in range(keys)]
        return pa.RecordBatch.from_arrays(
            [
                *heads, pa.array(factors), pa.array([len(group)] * k, pa.int64()), pa.array(seen, pa.int64()),
                number(low), number(high), pa.array(n.astype(np.int64)), number(pearson), number(ranked),
            ],
            names=[*group.schema.names[:keys], *[f.name for f in RESULT]],
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        key = None
        for batch in batches:
            if not batch.num_rows:
                continue
            change = np.zeros(batch.num_rows, bool)
            for i in range(keys):
                code = batch.column(i).dictionary_encode(null_encoding="encode").indices.to_numpy(zero_copy_only=False)
                change[1:] |= code[1:] != code[:-1]
            cuts = [0, *np.flatnonzero(change).tolist(), batch.num_rows]
            for a, b in zip(cuts[:-1], cuts[1:]):
                own = tuple(batch.column(i)[a].as_py() for i in range(keys))
                if held and own != key:
                    yield from results(pa.Table.from_batches(held))
                    held = []
                key = own
                held.append(batch.slice(a, b - a))
        if held:
            yield from results(pa.Table.from_batches(held))

    return run


def _sliced(df: DataFrame, keys: Sequence[str], factors: Sequence[str], width: int) -> DataFrame:
    """A row per slice of `width` factors: (keys..., slice, target, v0, v1, ...); the last slice is filled up with nulls."""
    slices = []
    for number, at in enumerate(range(0, len(factors), width)):
        own = [F.col(f) for f in factors[at : at + width]]
        own += [F.lit(None).cast("double")] * (width - len(own))
        slices.append(F.struct(F.lit(number).alias(SLICE), *[c.alias(f"v{i}") for i, c in enumerate(own)]))
    rows = df.select(*keys, "target", F.inline(F.array(*slices)))
    return rows.select(*keys, SLICE, "target", *[f"v{i}" for i in range(width)])


def _per_factor(df: DataFrame, keys: Sequence[str], factors: Sequence[str], clipping: Clipping, spearman: bool) -> DataFrame:
    """The same rows for groups beyond a task, from rows per factor."""
    long = df.unpivot([*keys, "target"], list(factors), "factor", "raw")
    x, y = finite(F.col("raw")), finite(F.col("target"))
    bounds = [
        (f, *(clipping.factors.get(f) or (None, None)), float(clipping.scale.get(f, 1.0))) if clipping.factors is not None
        else (f, None, None, float(clipping.scale.get(f, 1.0)))
        for f in factors
    ]
    table = df.sparkSession.createDataFrame(bounds, "factor string, lower double, upper double, scale double")
    # One row per factor column of the plan.
    long = long.join(F.broadcast(table), "factor")
    if clipping.factors is not None:
        x = F.when(F.col("lower").isNotNull(), F.least(F.greatest(x, F.col("lower")), F.col("upper")))
        x = F.when(is_finite(F.col("raw")), x)
    if clipping.target is not None:
        y = F.when(y.isNotNull(), F.least(F.greatest(y, F.lit(float(clipping.target[0]))), F.lit(float(clipping.target[1]))))
    each = [*keys, "factor"]
    long = long.select(*each, "raw", finite(x * F.col("scale")).alias("value"), y.alias("y"))
    both = F.col("value").isNotNull() & F.col("y").isNotNull()
    long = long.withColumns({"x": F.when(both, F.col("value")), "y": F.when(both, F.col("y"))})
    stats = long.groupBy(*each).agg(
        F.count(F.lit(1)).alias("rows"),
        F.count_if(is_finite(F.col("raw"))).alias("seen"),
        F.min("value").alias("low"),
        F.max("value").alias("high"),
        F.count("x").alias("n"),
        corr_agg("x", "y").alias("pearson"),
    )
    if spearman:
        known = long.where("x is not null").select(*each, "x", "y")
        ranked = attach_ranks(attach_ranks(known, each, "x", "rx", split=True), each, "y", "ry", split=True)
        ranks = ranked.groupBy(*each).agg(corr_agg("rx", "ry").alias("spearman"))
        stats = stats.join(ranks, each, "left")
    else:
        stats = stats.withColumn("spearman", F.lit(None).cast("double"))
    enough = F.col("n") >= MIN_OBSERVATIONS
    stats = stats.withColumns({c: F.when(enough, F.col(c)) for c in ("pearson", "spearman")})
    return stats.select(*keys, *[F.col(f.name).cast(f.dataType) for f in RESULT])


def wide_ic(
    df: DataFrame,
    factors: Sequence[str],
    keys: Sequence[str],
    clipping: Clipping = Clipping(),
    rows: int | None = None,
    spearman: bool = True,
    cells: int = CELLS,
) -> DataFrame:
    """Per (keys, factor): the columns of RESULT.  `df` has the keys, `target` and the factor columns.

    `rows` is a proven row bound; without one, or above the limit, the rows of each group are counted,
    so `df` should be a stored table then.
    """
    factors, keys = list(factors), list(keys)
    frame = df.select(*keys, F.col("target").cast("double"), *[F.col(f).cast("double").alias(f) for f in factors])
    schema = StructType([*[frame.schema[k] for k in keys], *RESULT])
    # Rows of a group that fit a task with all factors, and with a slice of one.
    most = group_limit(df.sparkSession)
    limit, beyond = min(most, max(1, cells // (len(factors) + 1))), min(most, max(1, cells // 2))

    def in_tasks(part: DataFrame, width: int | None = None) -> DataFrame:
        own = keys if width is None else [*keys, SLICE]
        ordered = part.repartition(*own).sortWithinPartitions(*own)
        return ordered.mapInArrow(_task(len(own), factors, clipping, spearman, width), schema)

    if rows is not None and rows <= limit:
        return in_tasks(frame)
    counts = df.groupBy(*keys).count().where(F.col("count") > limit)
    fits = F.col("count") <= beyond
    largest, others = counts.agg(F.max(F.when(fits, F.col("count"))), F.count_if(~fits)).first()
    if largest is None and not others:
        return in_tasks(frame)
    # At most one row for every `limit` rows of the table.
    found = in_tasks(frame.join(F.broadcast(counts), keys, "left_anti"))
    if largest is not None:
        width = max(1, min(len(factors), cells // largest - 1))
        sliced = frame.join(F.broadcast(counts.where(fits)), keys, "left_semi")
        found = found.unionByName(in_tasks(_sliced(sliced, keys, factors, width), width))
    if others:
        large = frame.join(F.broadcast(counts.where(~fits)), keys, "left_semi")
        found = found.unionByName(_per_factor(large, keys, factors, clipping, spearman))
    return found


def measured(found: DataFrame) -> DataFrame:
    """The groups in which a factor has a correlation."""
    return found.where(F.coalesce("pearson", "spearman").isNotNull()).drop("rows", "seen", "low", "high")
