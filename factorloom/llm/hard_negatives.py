"""Hard negatives by slot-decomposed selection.

An anchor's positives are its best rows of the same label.  Every positive p opens a window of allowed
negative scores, from `low` % to `high` % of p's score.  The windows of an anchor overlap; their upper
limits u0 >= u1 >= ... cut the scores into disjoint slots (u[j+1], u[j]], so that one pass over all
pairs serves all windows: each block of rows keeps the first k of every (anchor, slot), Spark merges
the blocks, and a merge over the slots from the lowest up gives the first k at or below each upper
limit.  The lower limit only cuts the end of such a list, so what is left of it is the window's first k.

Anchors with their limits are a table in the shared folder.  A task holds one block of rows and reads
the anchors a batch at a time, so its memory does not depend on the number of rows or anchors, and a
block sends on at most k rows per anchor and slot.

Rows with a null id, label or vector, or with a null or non-finite component, take no part; an anchor
without a positive, or a window without a row, has no result.  Of several rows with one id the one
with the smallest (label, vector) counts.  Ties go to the smaller id.  Other columns are not read.
Vectors of unequal length are compared as if the shorter ended in zeros; an empty vector scores 0.
Components are integers of at most 2^24 in size (`quantised` keeps larger ones at that limit), so that
every score is exact.  Very long vectors only make the blocks hold fewer rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
import pyarrow.parquet as pq
from pyspark.sql import Column, DataFrame, Window, functions as F

from .common import filesystem, shared_folder

#: Rows and vector components of a block, rows and anchors of a tile.
BLOCK_ROWS, BLOCK_VALUES, TILE_ROWS, TILE_ANCHORS = 65_536, 8_000_000, 8_192, 128
LARGEST = 1 << 24
NONE = np.iinfo(np.int64).min


def quantised(vector: Column, steps: int = 256) -> Column:
    """Every component x as floor(steps * x), in double precision."""
    whole = lambda x: F.floor(x.cast("double") * steps)
    return F.transform(vector, lambda x: F.least(F.greatest(whole(x), F.lit(-LARGEST)), F.lit(LARGEST)).cast("int"))


def usable(label: Column, vector: Column) -> Column:
    """Whether a row takes part."""
    size = lambda x: F.abs(x.cast("double"))
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (size(x) < float("inf")))
    return label.isNotNull() & F.coalesce(finite, F.lit(False))


class Block:
    """Vectors of several rows, ordered by (label, id)."""

    def __init__(self, ids: np.ndarray, labels: np.ndarray, matrix: np.ndarray):
        order = np.lexsort((ids, labels))
        self.ids, self.labels, self.matrix = ids[order], labels[order], matrix[order]
        self.largest = float(np.abs(matrix).max(initial=0))


def _matrix(column: pa.Array) -> np.ndarray:
    """Rows of a list column, padded with zeros."""
    lengths = column.value_lengths().to_numpy(zero_copy_only=False)
    out = np.zeros((len(column), int(lengths.max(initial=0))), np.int64)
    out[np.arange(out.shape[1])[None, :] < lengths[:, None]] = column.flatten().to_numpy(zero_copy_only=False)
    return out


def _scores(a: np.ndarray, b: np.ndarray, largest: float) -> np.ndarray:
    """Exact inner products of all rows of a and b; `largest` bounds the size of a product of two components."""
    width = min(a.shape[1], b.shape[1])
    a, b = a[:, :width], b[:, :width]
    if width * largest < 2**53:
        return (a.astype(np.float64) @ b.astype(np.float64).T).astype(np.int64)
    return a @ b.T


def _blocks(batches: Iterator[pa.RecordBatch], block_rows: int) -> Iterator[Block]:
    """Bounded blocks of a task's rows (vec_id, label, vector)."""
    ids, labels, parts, rows, values = [], [], [], 0, 0
    for batch in batches:
        for at in range(0, batch.num_rows, min(TILE_ROWS, block_rows)):
            part = batch.slice(at, min(TILE_ROWS, block_rows))
            matrix = _matrix(part.column(2))
            if rows and (rows + len(matrix) > block_rows or values + matrix.size > BLOCK_VALUES):
                yield _joined(ids, labels, parts)
                ids, labels, parts, rows, values = [], [], [], 0, 0
            ids.append(part.column(0).to_numpy())
            labels.append(part.column(1).to_numpy())
            parts.append(matrix)
            rows, values = rows + len(matrix), values + matrix.size
    if rows:
        yield _joined(ids, labels, parts)


def _joined(ids: list, labels: list, parts: list[np.ndarray]) -> Block:
    width = max(p.shape[1] for p in parts)
    matrix = np.concatenate([np.pad(p, ((0, 0), (0, width - p.shape[1]))) for p in parts])
    return Block(np.concatenate(ids), np.concatenate(labels), matrix)


def _anchor_batches(folder: str, rows: int = TILE_ANCHORS) -> Iterator[pa.RecordBatch]:
    """The anchor table, a few rows at a time, from the files that Spark committed."""
    fs, path = filesystem(folder)
    for info in fs.get_file_info(pafs.FileSelector(path)):
        if info.base_name.endswith(".parquet") and info.size:
            with fs.open_input_file(info.path) as source:
                yield from pq.ParquetFile(source).iter_batches(batch_size=rows)


def _first(keys: list[np.ndarray], scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Indexes of the first k entries of every key: by score descending, then id."""
    order = np.lexsort((ids, -scores, *reversed(keys)))
    new = np.ones(len(order), bool)
    for key in keys:
        same = key[order]
        new[1:] &= same[1:] == same[:-1]
    new[:1] = False
    heads = np.flatnonzero(~new)
    rank = np.arange(len(order)) - np.repeat(heads, np.diff(np.append(heads, len(order))))
    return order[rank < k]


def _nearest(folder: str, k: int, block_rows: int, tile_rows: int):
    """Task function: the first k rows of the anchor's label in every block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in _blocks(batches, block_rows):
            for anchors in _anchor_batches(folder):
                own, labels, vectors = anchors.column("vec_id").to_numpy(), anchors.column("label").to_numpy(), _matrix(anchors.column("vector"))
                bound = block.largest * float(np.abs(vectors).max(initial=0))
                kept: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
                for label in np.unique(labels):
                    mine = np.flatnonzero(labels == label)
                    a, b = np.searchsorted(block.labels, label, "left"), np.searchsorted(block.labels, label, "right")
                    floor = np.full(len(mine), NONE)
                    for at in range(a, b, tile_rows):
                        end = min(b, at + tile_rows)
                        scores = _scores(vectors[mine], block.matrix[at:end], bound)
                        scores[own[mine][:, None] == block.ids[None, at:end]] = NONE
                        if end - at > k:
                            # Nothing below a tile's k-th score can be among the first k.
                            floor = np.maximum(floor, np.partition(scores, end - at - k, axis=1)[:, end - at - k])
                        r, c = np.nonzero((scores >= floor[:, None]) & (scores > NONE))
                        chosen = _first([r], scores[r, c], block.ids[at + c], k)
                        kept.append((mine[r[chosen]], at + c[chosen], scores[r, c][chosen]))
                if kept:
                    r, c, s = (np.concatenate(x) for x in zip(*kept))
                    chosen = _first([r], s, block.ids[c], k)
                    yield _batch(anchor_id=own[r[chosen]], positive_id=block.ids[c[chosen]], score=s[chosen])

    return run


def _slot_firsts(folder: str, k: int, block_rows: int, tile_rows: int):
    """Task function: the first k rows of other labels in every (anchor, slot) of every block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in _blocks(batches, block_rows):
            for anchors in _anchor_batches(folder):
                own, labels, vectors = anchors.column("vec_id").to_numpy(), anchors.column("label").to_numpy(), _matrix(anchors.column("vector"))
                upper, least = _matrix_of_limits(anchors.column("upper")), anchors.column("least").to_numpy()
                bound = block.largest * float(np.abs(vectors).max(initial=0))
                kept: list[tuple[np.ndarray, ...]] = []
                for at in range(0, len(block.ids), tile_rows):
                    end = min(len(block.ids), at + tile_rows)
                    scores = _scores(vectors, block.matrix[at:end], bound)
                    inside = (scores >= least[:, None]) & (scores <= upper[:, :1])
                    r, c = np.nonzero(inside & (labels[:, None] != block.labels[None, at:end]))
                    s = scores[r, c]
                    slot = (upper[r] >= s[:, None]).sum(1) - 1
                    chosen = _first([r, slot], s, block.ids[at + c], k)
                    kept.append((r[chosen], slot[chosen], at + c[chosen], s[chosen]))
                r, slot, c, s = (np.concatenate(x) for x in zip(*kept))
                chosen = _first([r, slot], s, block.ids[c], k)
                yield _batch(anchor_id=own[r[chosen]], slot=slot[chosen].astype(np.int32), negative_id=block.ids[c[chosen]], score=s[chosen])

    return run


def _matrix_of_limits(column: pa.Array) -> np.ndarray:
    """Upper limits, one column per positive; an anchor with fewer positives has no slot there."""
    lengths = column.value_lengths().to_numpy(zero_copy_only=False)
    out = np.full((len(column), int(lengths.max(initial=1))), NONE)
    out[np.arange(out.shape[1])[None, :] < lengths[:, None]] = column.flatten().to_numpy(zero_copy_only=False)
    return out


def _batch(**columns: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c) for c in columns.values()], names=list(columns))


def _written(df: DataFrame) -> tuple[DataFrame, str]:
    path = shared_folder(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path), path


def _ranked(df: DataFrame, keys: list[str], id_column: str, k: int) -> DataFrame:
    """The first k rows per key over all blocks, numbered; the rows of a key are at most k per block."""
    order = Window.partitionBy(*keys).orderBy(F.col("score").desc(), id_column)
    return df.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def mine(
    rows: DataFrame,
    is_anchor: Column,
    positives: int = 5,
    negatives: int = 3,
    low: int = 50,
    high: int = 95,
    block_rows: int = BLOCK_ROWS,
    tile_rows: int = TILE_ROWS,
) -> DataFrame:
    """Hard negatives of the anchors among `rows` (vec_id, label, vector of integers).

    Returns anchor_id, positive_id, positive_score, rank, negative_id, negative_score: for each of the
    anchor's first `positives` rows of its label, the first `negatives` rows of other labels with
    low % <= 100 * negative_score / positive_score <= high % (compared as whole numbers).
    """
    spark = rows.sparkSession
    known = rows.select(F.col("vec_id").cast("long"), F.col("label").cast("long"), F.col("vector").cast("array<int>"))
    known = known.filter(F.col("vec_id").isNotNull() & usable(F.col("label"), F.col("vector")))
    single = known.groupBy("vec_id").agg(F.min(F.struct("label", "vector")).alias("r")).select("vec_id", "r.*")
    tasks = max(spark.sparkContext.defaultParallelism, -(-known.count() // block_rows))
    # Files by id, whatever the labels: a label with a third of all rows lies in all of them.
    blocks, _ = _written(single.repartition(tasks, "vec_id"))
    anchors, folder = _written(blocks.filter(is_anchor))

    near = blocks.mapInArrow(_nearest(folder, positives, block_rows, tile_rows), "anchor_id long, positive_id long, score long")
    best = _ranked(near, ["anchor_id"], "positive_id", positives)
    listed = best.groupBy("anchor_id").agg(F.array_sort(F.collect_list(F.struct("rank", "positive_id", "score"))).alias("p"))
    listed, _ = _written(listed)
    lower = F.transform("p", lambda x: -_hundredth(-low * x["score"].cast("decimal(20,0)")))
    upper = F.transform("p", lambda x: _hundredth(high * x["score"].cast("decimal(20,0)")))
    limits = listed.select(F.col("anchor_id").alias("vec_id"), upper.alias("upper"), F.array_min(lower).alias("least"), lower.alias("lower"), "p")
    _, limited = _written(anchors.join(limits.select("vec_id", "upper", "least"), "vec_id"))

    found = blocks.mapInArrow(_slot_firsts(limited, negatives, block_rows, tile_rows), "anchor_id long, slot int, negative_id long, score long")
    firsts = _ranked(found, ["anchor_id", "slot"], "negative_id", negatives)
    # At most `positives` x `negatives` entries per anchor.
    entry = F.struct((-F.col("score")).alias("minus"), "negative_id", "slot")
    slots = firsts.groupBy("anchor_id").agg(F.collect_list(entry).alias("entries"))

    def merged(lists: Column, slot: Column) -> Column:
        own = F.filter("entries", lambda e: e["slot"] == slot)
        return F.concat(F.array(F.slice(F.array_sort(F.concat(lists[0], own)), 1, negatives)), lists)

    empty = F.array(F.slice("entries", 1, 0))
    below = F.aggregate(F.sequence(F.lit(positives - 1), F.lit(0), F.lit(-1)), empty, merged)
    windows = slots.withColumn("below", below).join(limits, F.col("anchor_id") == F.col("vec_id"))
    each = windows.select("anchor_id", "below", F.posexplode(F.arrays_zip("p", "lower")).alias("slot", "w"))
    inside = F.filter(F.col("below")[F.col("slot")], lambda e: -e["minus"] >= F.col("w.lower"))
    rows_out = each.select("anchor_id", "w.p", F.posexplode(inside).alias("at", "n"))
    return rows_out.select(
        "anchor_id",
        F.col("p.positive_id").alias("positive_id"),
        (F.col("at") + 1).cast("int").alias("rank"),
        F.col("n.negative_id").alias("negative_id"),
        F.col("p.score").alias("positive_score"),
        (-F.col("n.minus")).alias("negative_score"),
    )


def _hundredth(value: Column) -> Column:
    """value / 100 rounded down, in whole numbers."""
    return F.call_function("div", value - F.pmod(value, F.lit(100)), F.lit(100))
