"""Gradient-boosted regression trees, grown leaf by leaf from gradient histograms.

Columns are binned once at exact quantiles.  Rows with the same bins share every leaf and so every score;
of their gradients only the sum counts, which their number and the sum of their labels give exactly.  So
the rows are stored as blocks of distinct bin numbers with these two sums: with few columns a bounded
number of them, and never more than rows.  A pass over the blocks sums, for some leaves, the gradients
and rows of every (column, bin): per task first, then per cell over the tasks, so only leaves x columns x
bins sums move, whatever the number of rows.  The driver
holds nothing else than these sums and the trees.  A tree always splits its leaf of largest gain next;
one pass serves all open leaves at once (the children of each leaf's best split), so a tree takes about
as many passes as it is deep, not as it has leaves.  Labels and scores are rounded to whole numbers of a fixed step before they
are summed, so that the trees do not depend on partitions, task order or repeated tasks.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from .blocks import frozen
from .radix import pooled_quantiles

#: Rows of a block; labels as whole numbers up to 2^GRAIN, so that a block's sums are exact doubles.
BLOCK, GRAIN = 1 << 16, 36
#: Rounds after which the blocks are written again with the trees so far added up.
REFRESH = 10
_LOW = (1 << 30) - 1


@dataclass(frozen=True)
class TreeSettings:
    """The boosted-tree settings of the downstream comparison."""

    rounds: int = 50
    learning_rate: float = 0.05
    leaves: int = 15
    min_rows: int = 100
    l2: float = 1.0
    bins: int = 255


@dataclass(frozen=True)
class Tree:
    """Splits in the order in which they were made, and the leaf values.

    Split i sends the rows of leaf `leaf` with a column above `cut` (bin above `bin`) to new leaf i + 1.
    """

    leaf: tuple[int, ...]
    column: tuple[int, ...]
    bin: tuple[int, ...]
    cut: tuple[float, ...]
    values: tuple[float, ...]

    def leaves(self, bins: np.ndarray) -> np.ndarray:
        """Leaf number of every row of bin numbers."""
        out = np.zeros(len(bins), np.int64)
        for i, (leaf, column, at) in enumerate(zip(self.leaf, self.column, self.bin)):
            out[(out == leaf) & (bins[:, column] > at)] = i + 1
        return out

    def expression(self, columns: Sequence[Column]) -> Column:
        """The tree's value as one JVM expression."""
        # Leaves become inner nodes in place: [leaf] -> [column, cut, low, high].
        nodes: dict[int, list] = {0: [0]}
        whole = nodes[0]
        for i, (leaf, column, cut) in enumerate(zip(self.leaf, self.column, self.cut)):
            low, high = [leaf], [i + 1]
            nodes[leaf][:] = [column, cut, low, high]
            nodes[leaf], nodes[i + 1] = low, high

        def built(node: list) -> Column:
            if len(node) == 1:
                return F.lit(float(self.values[node[0]]))
            column, cut, low, high = node
            return F.when(columns[column] <= F.lit(float(cut)), built(low)).otherwise(built(high))

        return built(whole)


@dataclass(frozen=True)
class Boosted:
    initial: float
    trees: tuple[Tree, ...]

    def expression(self, columns: Sequence[Column]) -> Column:
        total = F.lit(float(self.initial))
        for tree in self.trees:
            total = total + tree.expression(columns)
        return total


# --- tasks ------------------------------------------------------------------------------------------


def _pack(cuts: Sequence[np.ndarray]):
    """Task function: rows (columns..., label) as blocks of bin numbers and labels."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, rows = [], 0

        def packed(tables: list[pa.RecordBatch]) -> pa.RecordBatch:
            table = pa.Table.from_batches(tables)
            columns = [c.to_numpy().astype(np.float64) for c in table.columns]
            bins = np.stack([np.searchsorted(at, x, "left") for at, x in zip(cuts, columns)], axis=1).astype(np.uint8)
            names = ["bins", "label", "score"]
            score = np.zeros(len(bins)).tobytes()
            return pa.RecordBatch.from_arrays([pa.array([b], pa.binary()) for b in (bins.tobytes(), columns[-1].tobytes(), score)], names=names)

        for batch in batches:
            for at in range(0, batch.num_rows, BLOCK):
                part = batch.slice(at, BLOCK)
                if rows and rows + part.num_rows > BLOCK:
                    yield packed(held)
                    held, rows = [], 0
                held.append(part)
                rows += part.num_rows
        if rows:
            yield packed(held)

    return run


def _unpacked(batch: pa.RecordBatch, width: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    for bins, label, score in zip(*[c.to_pylist() for c in batch.columns]):
        yield np.frombuffer(bins, np.uint8).reshape(-1, width), np.frombuffer(label), np.frombuffer(score)


def _combined(width: int, low: float, step: float):
    """Task function: blocks of rows to distinct bin numbers, their rows and their labels' sum in steps above `low`, in two parts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for bins, label, _ in _unpacked(batch, width):
                known, code = np.unique(bins.view(np.dtype((np.void, width))).ravel(), return_inverse=True)
                steps = np.rint((label - low) / step).astype(np.int64)
                high, rest = (np.bincount(code, part, len(known)).astype(np.int64) for part in (steps >> 30, steps & _LOW))
                columns = [pa.array([k.tobytes() for k in known], pa.binary()), np.bincount(code, minlength=len(known)), high, rest]
                yield pa.RecordBatch.from_arrays([columns[0], *[pa.array(c, pa.int64()) for c in columns[1:]]], names=["bins", "n", "high", "low"])

    return run


def _stacked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Task function: rows (bins, n, high, low) as blocks with a score of 0."""
    held, rows = [], 0

    def block() -> pa.RecordBatch:
        table = pa.Table.from_batches(held)
        cells = [b"".join(table["bins"].to_pylist()), *[table[c].to_numpy().astype(np.int64).tobytes() for c in ("n", "high", "low")], np.zeros(rows).tobytes()]
        return pa.RecordBatch.from_arrays([pa.array([c], pa.binary()) for c in cells], names=["bins", "n", "high", "low", "score"])

    for batch in batches:
        for at in range(0, batch.num_rows, BLOCK):
            part = batch.slice(at, BLOCK)
            if rows and rows + part.num_rows > BLOCK:
                yield block()
                held, rows = [], 0
            held.append(part)
            rows += part.num_rows
    if rows:
        yield block()


def _cells(batch: pa.RecordBatch, width: int) -> Iterator[tuple[np.ndarray, ...]]:
    for bins, *sums, score in zip(*[c.to_pylist() for c in batch.columns]):
        yield np.frombuffer(bins, np.uint8).reshape(-1, width), *[np.frombuffer(x, np.int64) for x in sums], np.frombuffer(score)


def _added(trees: Sequence[Tree], width: int):
    """Task function: blocks with the trees' values added to the scores."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for bins, *sums, score in _cells(batch, width):
                for tree in trees:
                    score = score + np.array(tree.values)[tree.leaves(bins)]
                cells = [bins.tobytes(), *[x.tobytes() for x in sums], score.tobytes()]
                yield pa.RecordBatch.from_arrays([pa.array([c], pa.binary()) for c in cells], names=batch.schema.names)

    return run


def _sums(trees: Sequence[Tree], open_: Tree, wanted: Sequence[tuple[int, int, int]], width: int, bins_: int, base: float, step: float):
    """Task function: gradient and row sums of (wanted set, column, bin); `base` is the first score above the lowest label.

    A wanted set is (leaf, column, bin): the rows of a leaf of the open tree up to a bin; column -1: all.
    """
    shape = (len(wanted), width, bins_)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # In two parts, whose sums stay exact up to 2^33 rows.
        high, low, rows = (np.zeros(shape, np.int64) for _ in range(3))
        for batch in batches:
            for bins, n, label_high, label_low, score in _cells(batch, width):
                for tree in trees:
                    score = score + np.array(tree.values)[tree.leaves(bins)]
                steps = np.rint((base + score) / step).astype(np.int64)
                g_high, g_low = n * (steps >> 30) - label_high, n * (steps & _LOW) - label_low
                leaf = open_.leaves(bins)
                for k, (own, column, at) in enumerate(wanted):
                    inside = leaf == own
                    if column >= 0:
                        inside &= bins[:, column] <= at
                    inside = np.flatnonzero(inside)
                    for j in range(width):
                        at_bin = bins[inside, j]
                        for total, part in ((high, g_high), (low, g_low), (rows, n)):
                            np.add.at(total[k, j], at_bin, part[inside])
        cells = np.flatnonzero(rows)
        if len(cells):
            columns = [cells, *[x.ravel()[cells] for x in (high, low, rows)]]
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["cell", "high", "low", "n"])

    return run


# --- growth -----------------------------------------------------------------------------------------


@dataclass
class _Leaf:
    """Gradient and row sums per (column, bin), with the best split they offer."""

    gradient: np.ndarray
    rows: np.ndarray
    gain: float = 0.0
    split: tuple[int, int] | None = None
    children: tuple["_Leaf", "_Leaf"] | None = None

    def find(self, settings: TreeSettings) -> "_Leaf":
        g, n = self.gradient.sum(1)[0], self.rows.sum(1)[0]
        left_g, left_n = np.cumsum(self.gradient, axis=1)[:, :-1], np.cumsum(self.rows, axis=1)[:, :-1]
        right_g, right_n = g - left_g, n - left_n
        worth = lambda a, b: a * a / (b + settings.l2)
        gain = worth(left_g, left_n) + worth(right_g, right_n) - worth(g, n)
        gain[(left_n < settings.min_rows) | (right_n < settings.min_rows)] = 0.0
        best = int(gain.argmax())  # of equal gains the first column and bin
        if gain.size and gain.flat[best] > 0:
            self.gain, self.split = float(gain.flat[best]), tuple(int(i) for i in np.unravel_index(best, gain.shape))
        return self

    def value(self, settings: TreeSettings) -> float:
        return float(-settings.learning_rate * self.gradient.sum(1)[0] / (self.rows.sum(1)[0] + settings.l2))


def fit(data: DataFrame, columns: Sequence[str], label: str, settings: TreeSettings = TreeSettings()) -> Boosted:
    """Squared-error boosting of `label` on finite double columns, starting from the mean label."""
    width = len(columns)
    stored = frozen(data.select(*[F.col(c).cast("double").alias(c) for c in columns], F.col(label).cast("double").alias("__label")))
    size, initial, low, high = stored.agg(F.count(F.lit(1)), F.avg("__label"), F.min("__label"), F.max("__label")).first()
    if not size:
        raise ValueError("no rows to fit")
    initial = min(max(initial, low), high)  # the mean of equal labels may miss them by rounding
    points = [i / settings.bins for i in range(1, settings.bins)]
    ends = pooled_quantiles(stored.select(*columns), columns, points, written=True)
    cuts = [np.unique(ends[c]) for c in columns]
    # Labels are whole numbers of steps above the lowest; scores stay within the labels' range.
    step = max(high - low, 1e-300) / float(1 << GRAIN)
    packed = stored.mapInArrow(_pack(cuts), "bins binary, label binary, score binary")
    distinct = packed.mapInArrow(_combined(width, low, step), "bins binary, n long, high long, low long")
    distinct = distinct.groupBy("bins").agg(*[F.sum(c).alias(c) for c in ("n", "high", "low")])
    blocks = frozen(distinct.mapInArrow(_stacked, "bins binary, n binary, high binary, low binary, score binary"))
    done: list[Tree] = []
    fresh: list[Tree] = []

    def summed(open_: Tree, wanted: Sequence[tuple[int, int, int]]) -> list[_Leaf]:
        shape = (len(wanted), width, settings.bins)
        task = _sums(tuple(fresh), open_, wanted, width, settings.bins, initial - low, step)
        cells = blocks.mapInArrow(task, "cell long, high long, low long, n long")
        table = cells.groupBy("cell").agg(F.sum("high").alias("high"), F.sum("low").alias("low"), F.sum("n").alias("n")).toArrow()
        cell, upper, lower, n = (table[c].to_numpy() for c in ("cell", "high", "low", "n"))
        gradient, rows = np.zeros(shape), np.zeros(shape)
        gradient.flat[cell] = (upper.astype(np.float64) * (_LOW + 1) + lower) * step
        rows.flat[cell] = n
        return [_Leaf(g, r) for g, r in zip(gradient, rows)]

    for _ in range(settings.rounds):
        tree = Tree((), (), (), (), ())
        leaves = {0: summed(tree, [(0, -1, 0)])[0].find(settings)}
        while len(leaves) < settings.leaves:
            number = max(leaves, key=lambda k: (leaves[k].gain, -k))
            leaf = leaves[number]
            if leaf.split is None:
                break
            if leaf.children is None:
                # One pass for every open leaf that could be split.
                waiting = [k for k in sorted(leaves) if leaves[k].split is not None and leaves[k].children is None]
                found = summed(tree, [(k, *leaves[k].split) for k in waiting])
                for k, low_part in zip(waiting, found):
                    parent = leaves[k]
                    high_part = _Leaf(parent.gradient - low_part.gradient, parent.rows - low_part.rows)
                    parent.children = low_part.find(settings), high_part.find(settings)
            column, at = leaf.split
            new = len(leaves)
            leaves[number], leaves[new] = leaf.children
            tree = Tree((*tree.leaf, number), (*tree.column, column), (*tree.bin, at), (*tree.cut, float(cuts[column][at])), ())
        values = tuple(leaves[k].value(settings) for k in range(len(leaves)))
        fresh.append(Tree(tree.leaf, tree.column, tree.bin, tree.cut, values))
        if len(fresh) == REFRESH:
            blocks = frozen(blocks.mapInArrow(_added(tuple(fresh), width), blocks.schema))
            done, fresh = done + fresh, []
    return Boosted(float(initial), tuple(done + fresh))
