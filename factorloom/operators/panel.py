"""Panels and staged evaluation of factor expressions."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass, field as _field, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.types import ArrayType, BooleanType, DoubleType, StructField, StructType

from ..functions import cross
from ..functions.feature import OPERATORS, Feature
from ..functions.guards import finite, flag
from ..functions.kernels import KERNELS, Job, custom, rolling_pass
from ..functions.rolling import Frames
from .blocks import frozen, group_limit, join_stats, oversized, positions, with_halo
from .portfolio import lagged_portfolio

# Features planned together; bounds the size of one query plan.
CHUNK = 32
# Longest window evaluated as a Spark frame; longer ones run as Arrow passes.  Higher moments and
# two-series statistics cost several times more per frame row, so they switch earlier.
FRAME_CONF = "spark.factorloom.frameRows"
DEFAULT_FRAME = 16
COSTLY = {"ts_skew", "ts_kurt", "ts_skew_pop", "ts_kurt_pop", "ts_corr", "ts_cov"}
COSTLY_SHARE = 4


def frame_rows(spark: SparkSession) -> int:
    return int(spark.conf.get(FRAME_CONF, str(DEFAULT_FRAME)))


def _in_utc(table: pa.Table) -> pa.Table:
    """Arrow results must carry timestamps in UTC, whatever the session time zone is."""
    for i, f in enumerate(table.schema):
        if pa.types.is_timestamp(f.type) and f.type.tz not in (None, "UTC"):
            table = table.set_column(i, f.name, table[f.name].cast(pa.timestamp("us", "UTC")))
    return table


@dataclass(frozen=True)
class PanelSpec:
    """Names of the structural columns.

    Rolling history follows `identity` inside one `segment`; `legs` maps a field suffix to the
    extra segment column that breaks the history of expressions reading that leg.
    """

    identity: tuple[str, ...] = ("exchange", "instrument_id")
    time: str = "timestamp"
    segment: str | None = None
    ties: tuple[str, ...] = ()
    eligible: str | None = None
    legs: Mapping[str, str] = _field(default_factory=dict)
    known_legs: Mapping[str, frozenset[str]] = _field(default_factory=dict)

    @property
    def group(self) -> tuple[str, ...]:
        return self.identity + ((self.segment,) if self.segment else ())

    @property
    def order(self) -> tuple[str, ...]:
        return (self.time, *self.ties)


def field_legs(name: str, spec: PanelSpec) -> frozenset[str]:
    """Legs whose continuity a field depends on, by suffix or as declared."""
    if name in spec.known_legs:
        return spec.known_legs[name]
    return frozenset(leg for leg in spec.legs if name.endswith(f"_{leg}"))


class Panel:
    """A DataFrame of observations plus the meaning of its structural columns.

    `rows` is a proven upper bound on the row count (for instance the footer count of the scanned
    table); without it the largest history and cross-section are measured once, when first needed.
    `frames` is the longest window evaluated as a Spark frame, by default the session's; 0 runs all rolling
    operators as passes, so that hundreds of features make one short plan.
    """

    def __init__(
        self, df: DataFrame, spec: PanelSpec | None = None, rows: int | None = None, frames: int | None = None
    ):
        self.df, self.spec, self.rows, self.frames = df, spec or PanelSpec(), rows, frames
        self._measured: dict = {}

    def with_df(self, df: DataFrame) -> "Panel":
        """Same panel with extra columns or fewer rows."""
        other = Panel(df, self.spec, self.rows, self.frames)
        other._measured = self._measured
        return other

    def _oversized(self, keys: tuple[str, ...]) -> bool:
        if keys not in self._measured:
            self._measured[keys] = oversized(self.df, keys, self.rows)
        return self._measured[keys]

    @property
    def long_histories(self) -> bool:
        return self._oversized(self.spec.group)

    @property
    def wide_times(self) -> bool:
        key, limit = (self.spec.time,), group_limit(self.df.sparkSession)
        if key not in self._measured:
            within = self.rows is not None and self.rows <= limit
            self._measured[key] = not within and self._times()[0] > limit
        return self._measured[key]

    def _times(self) -> tuple[int, int]:
        """Rows of the largest time and number of times, from one pass."""
        if "times" not in self._measured:
            counts = self.df.groupBy(self.spec.time).count()
            largest, times = counts.agg(F.max("count"), F.count(F.lit(1))).first()
            self._measured["times"] = largest or 0, times
        return self._measured["times"]

    @property
    def time_count(self) -> int:
        """Distinct observation times; only measured when cross-sections are oversized."""
        return self._times()[1]

    def over_history(
        self, back: int, ahead: int, compute: Callable[[DataFrame, Frames], DataFrame]
    ) -> DataFrame:
        """Run `compute`, whose windows read at most `back` earlier and `ahead` later rows.

        Histories that fit a task use one partition per group.  Longer ones are cut into blocks
        of rows that overlap by the declared reach.
        """
        group, order = self.spec.group, self.spec.order
        if not self.long_histories:
            return compute(self.df, Frames(group, order))
        df = self.df
        if "__pos" not in df.columns:
            df = positions(df, group, order, "__pos")
        size = max(1, group_limit(df.sparkSession) // 2)
        spread = with_halo(df, "__pos", size, back, ahead)
        done = compute(spread, Frames((*group, "__block"), order))
        return done.where("__home").drop("__block", "__home", "__pos")

    def with_features(self, features: Mapping[str, Feature]) -> DataFrame:
        """Append one column per feature; numeric results are finite or null."""
        names = list(features)
        df = self.df
        size = max(1, len(names)) if self.frames == 0 else CHUNK
        for at in range(0, len(names), size):
            part = {n: features[n] for n in names[at : at + size]}
            df = _Stages(self.with_df(df), part).run()
        return df

    def features(self, features: Mapping[str, Feature]) -> "Panel":
        return self.with_df(self.with_features(features))


class _Stages:
    """Evaluates one batch: alternating history and cross-section phases, level by level."""

    def __init__(self, panel: Panel, features: Mapping[str, Feature]):
        self.panel, self.spec, self.wanted = panel, panel.spec, features
        self.nodes: dict[Feature, str] = {}
        self.phase: dict[Feature, int] = {}
        self.level: dict[Feature, int] = {}
        self.legs: dict[Feature, frozenset[str]] = {}
        for feature in features.values():
            self._visit(feature)

    def _visit(self, node: Feature) -> None:
        if node in self.nodes:
            return
        for child in node.args:
            self._visit(child)
        children = node.args
        phase = max((self.phase[c] for c in children), default=0)
        scope = self._scope(node)
        if scope in {"ts", "kernel"}:
            phase += phase % 2
        elif scope in {"cs", "lagged", "cs_kernel", "cs_reduction"}:
            phase += 1 - phase % 2
        self.phase[node] = phase
        inside = [self.level[c] for c in children if self.phase[c] == phase]
        self.level[node] = 1 + max(inside, default=0)
        legs = frozenset().union(*(self.legs[c] for c in children))
        if node.op == "field":
            legs |= field_legs(node.params[0], self.spec)
        self.legs[node] = legs
        self.nodes[node] = f"__f{len(self.nodes)}"

    def _reach(self, phase: int) -> int:
        """Earlier rows that the history operators of one phase read in total."""
        reach: dict[Feature, int] = {}
        for node in self.nodes:
            if self.phase[node] != phase:
                continue
            inner = max((reach.get(c, 0) for c in node.args), default=0)
            spec = OPERATORS.get(node.op)
            own = spec.rows_back(node.params) if self._scope(node) in {"ts", "kernel"} else 0
            reach[node] = inner + own
        return max(reach.values(), default=0)

    def _column(self, node: Feature) -> Column:
        return F.col(self.nodes[node])

    def run(self) -> DataFrame:
        kept = self.panel.df.columns
        df = self.panel.df
        for phase in range(max(self.phase.values(), default=0) + 1):
            members = [n for n in self.nodes if self.phase[n] == phase]
            if not members:
                continue
            if phase % 2:
                df = self._cross_section(df, members)
            elif any(self._scope(n) in {"ts", "kernel"} for n in members):
                df = self.panel.with_df(df).over_history(
                    self._reach(phase), 0, lambda d, f, m=members: self._history(d, f, m)
                )
            else:
                # No operator of the phase looks at other rows, so histories need neither size nor blocks.
                df = self._history(df, Frames(self.spec.group, self.spec.order), members)
        results = {n: self._column(f).alias(n) for n, f in self.wanted.items()}
        kept = [c for c in kept if c not in results and c != "__pos"]
        return df.select(*kept, *results.values())

    def _by_level(self, members: list[Feature]) -> list[list[Feature]]:
        depth = max(self.level[n] for n in members)
        return [[n for n in members if self.level[n] == i] for i in range(1, depth + 1)]

    def _scalar(self, node: Feature) -> Column:
        if node.op == "field":
            return finite(F.col(node.params[0]).cast("double"))
        if node.op == "const":
            return F.lit(node.params[0])
        return OPERATORS[node.op].function(*map(self._column, node.args), *node.params)

    def _history(self, df: DataFrame, frames: Frames, members: list[Feature]) -> DataFrame:
        """One phase of rolling operators.

        Short windows become Spark window expressions, long ones and array kernels Arrow passes over the
        rows, which are shuffled and sorted once.  A pass keeps their order, but Spark no longer knows
        it, so operators that read the result of a pass run as passes as well, however short.
        """
        rolling = [n for n in members if self._scope(n) in {"ts", "kernel"}]
        limit = frame_rows(df.sparkSession) if self.panel.frames is None else self.panel.frames

        def long(node: Feature) -> bool:
            if limit and OPERATORS[node.op].history == "lag":
                return False  # reads one earlier row, however far back
            share = COSTLY_SHARE if node.op in COSTLY else 1
            return self._scope(node) == "kernel" or self._reach_of(node) * share > limit

        own = {n: self._frames(frames, n) for n in rolling}
        numbers = {f.row: f.number for f in own.values()}
        if numbers:
            df = df.withColumns(numbers)
        passed = False
        for nodes in self._by_level(members):
            plain, passes = {}, {}
            for node in nodes:
                if node not in own:
                    plain[self.nodes[node]] = self._scalar(node)
                elif passed or long(node):
                    passes.setdefault(own[node].row, []).append(self._job(node))
                else:
                    plain[self.nodes[node]] = OPERATORS[node.op].function(
                        *map(self._column, node.args), *node.params, own[node]
                    )
            if plain:
                df = df.withColumns(plain)
            for row, jobs in passes.items():
                passed = True
                types = [BooleanType() if j.condition else DoubleType() for j in jobs]
                added = [StructField(j.out, t) for j, t in zip(jobs, types)]
                df = df.mapInArrow(rolling_pass(jobs, row), StructType(df.schema.fields + added))
        return df.drop(*numbers)

    def _scope(self, node: Feature) -> str:
        return OPERATORS[node.op].scope if node.op in OPERATORS else "leaf"

    def _reach_of(self, node: Feature) -> int:
        return OPERATORS[node.op].rows_back(node.params) + 1

    def _frames(self, frames: Frames, node: Feature) -> Frames:
        legs = sorted(self.legs[node])
        extra = tuple(self.spec.legs[leg] for leg in legs)
        return replace(frames, keys=frames.keys + extra, row="_".join(["__row", *legs]))

    def _job(self, node: Feature) -> Job:
        spec = OPERATORS[node.op]
        kernel = custom(node.kernel) if node.kernel else KERNELS[node.op]
        at = spec.params.index("n")
        return Job(
            self.nodes[node],
            tuple(self.nodes[a] for a in node.args),
            kernel,
            int(node.params[at]),
            0 if node.op == "obs_lag" else self._reach_of(node),
            tuple(p for i, p in enumerate(node.params) if i != at),
            spec.condition,
        )

    def _cross_section(self, df: DataFrame, members: list[Feature]) -> DataFrame:
        spec, split = self.spec, self.panel.wide_times
        for nodes in self._by_level(members):
            plain = {}
            lagged = [n for n in nodes if self._scope(n) == "lagged"]
            if lagged:
                df = self._lagged(df, lagged, split)
            source = None
            masked = {f"{self.nodes[n]}_in": self._eligible(n) for n in nodes if self._scope(n) == "cs"}
            if split and masked:
                # Counts, totals and the joins of a level read its rows in turn, so they are written once.
                df = source = frozen(df.withColumns(masked))
            for node in nodes:
                scope = self._scope(node)
                if scope == "lagged":
                    continue
                if scope == "cs":
                    own = f"{self.nodes[node]}_in"
                    if split or node.op == "cs_winsorize":
                        df = cross.joined(
                            df if split else df.withColumn(own, masked[own]),
                            node.op,
                            own,
                            node.params,
                            spec.time,
                            self.nodes[node],
                            self.panel.time_count,
                            source,
                        )
                    else:
                        plain[self.nodes[node]] = cross.windowed(node.op, masked[own], node.params, spec.time)
                elif scope == "cs_kernel":
                    df = self._cross_kernel(df, node)
                elif scope == "cs_reduction":
                    df = self._cross_reduction(df, node)
                else:
                    plain[self.nodes[node]] = self._scalar(node)
            if plain:
                df = df.withColumns(plain)
        return df

    def _eligible(self, node: Feature) -> Column:
        """The argument of a cross-sectional operator, for eligible rows."""
        x = self._column(node.args[0])
        return F.when(flag(F.col(self.spec.eligible)), x) if self.spec.eligible else x

    def _lagged(self, df: DataFrame, nodes: list[Feature], split: bool) -> DataFrame:
        """Portfolio returns per time.  Each reads the panel several times, so it is materialised."""
        source, spec = frozen(df), self.spec
        times = self.panel.time_count if split else None
        df = source
        for node in nodes:
            returns = lagged_portfolio(
                source,
                node.op,
                [self.nodes[a] for a in node.args],
                node.params,
                spec.identity,
                spec.time,
                spec.eligible,
                self.nodes[node],
                split,
                self.panel.rows,
                times,
            )
            df = join_stats(df, returns, [spec.time], times)
        return df

    def _usable(self, columns: Sequence[str]) -> Column:
        usable = flag(F.col(self.spec.eligible)) if self.spec.eligible else F.lit(True)
        for c in columns:
            usable = usable & F.col(c).isNotNull()
        return usable

    def _cross_kernel(self, df: DataFrame, node: Feature) -> DataFrame:
        """A custom kernel gets the members of a time in one task, whatever their number."""
        columns, out, kernel = [self.nodes[a] for a in node.args], self.nodes[node], node.kernel
        ordered = [(c, "ascending") for c in (*self.spec.identity, *self.spec.ties)]

        def apply(table: pa.Table) -> pa.Table:
            table = _in_utc(table).sort_by(ordered)
            mask = table["__usable"].to_numpy(zero_copy_only=False).astype(bool)
            values = np.full(len(mask), np.nan)
            if mask.any():
                arrays = [table[c].to_numpy(zero_copy_only=False).astype(float)[mask] for c in columns]
                values[mask] = kernel(*arrays)
            good = np.isfinite(values)
            return table.append_column(out, pa.array(values, mask=~good))

        marked = df.withColumn("__usable", self._usable(columns))
        schema = StructType(marked.schema.fields + [StructField(out, DoubleType())])
        return marked.groupBy(self.spec.time).applyInArrow(apply, schema).drop("__usable")

    def _cross_reduction(self, df: DataFrame, node: Feature) -> DataFrame:
        """Partial states per batch and time, merged per time, finished where the rows are."""
        columns, out, parts, time = [self.nodes[a] for a in node.args], self.nodes[node], node.kernel, self.spec.time

        def by_time(batch: pa.RecordBatch):
            """Rows of each time, and the columns as arrays."""
            code = batch.column(batch.schema.get_field_index(time)).dictionary_encode().indices
            code = code.to_numpy(zero_copy_only=False)
            order = np.argsort(code, kind="stable")
            cuts = np.flatnonzero(np.diff(code[order])) + 1
            arrays = [batch.column(c).to_numpy(zero_copy_only=False).astype(float) for c in columns]
            return np.split(order, cuts), arrays

        def partial(batches):
            for batch in batches:
                if not batch.num_rows:
                    continue
                groups, arrays = by_time(batch)
                states = [np.asarray(parts.partial(*[a[g] for a in arrays]), float).tolist() for g in groups]
                first = batch.column(time).take(pa.array([int(g[0]) for g in groups]))
                table = _in_utc(pa.table({time: first, "__state": pa.array(states, pa.list_(pa.float64()))}))
                yield from table.to_batches()

        def merge(table: pa.Table) -> pa.Table:
            state = np.asarray(parts.merge(np.array(table["__state"].to_pylist(), float)), float)
            one = pa.table({time: table[time].slice(0, 1), "__state": pa.array([state.tolist()], pa.list_(pa.float64()))})
            return _in_utc(one)

        def finish(batches):
            for batch in batches:
                values = np.full(batch.num_rows, np.nan)
                if batch.num_rows:
                    usable = batch.column("__usable").to_numpy(zero_copy_only=False).astype(bool)
                    groups, arrays = by_time(batch)
                    states = batch.column("__state")
                    for g in groups:
                        g = g[usable[g]]
                        if len(g):
                            state = np.array(states[int(g[0])].as_py(), float)
                            values[g] = parts.finish(state, *[a[g] for a in arrays])
                table = pa.Table.from_batches([batch]).append_column(out, pa.array(values, mask=~np.isfinite(values)))
                yield from _in_utc(table).to_batches()

        marked = df.withColumn("__usable", self._usable(columns))
        kind = StructType([df.schema[time], StructField("__state", ArrayType(DoubleType()))])
        states = marked.where("__usable").select(time, *columns).mapInArrow(partial, kind)
        merged = states.groupBy(time).applyInArrow(merge, kind)
        joined = marked.join(merged, time, "left")
        schema = StructType(joined.schema.fields + [StructField(out, DoubleType())])
        return joined.mapInArrow(finish, schema).drop("__usable", "__state")


def product_panel(spec: PanelSpec, product: Sequence[str], segment: str | None, legs=None) -> PanelSpec:
    """The product view of a contract panel: same rows, history grouped by product."""
    return replace(spec, identity=tuple(product), segment=segment, legs=legs or {})
