"""Exact order statistics of many columns by radix selection, without a sort of rows.

A double's bits, turned so that they order like the numbers, are read 16 at a time.  Each pass counts
how many values share their leading bits, for all columns at once and combined on the map side; the
counts say which leading bits hold a wanted order statistic, and the next pass looks only there.  No key
ever has more than 2^16 counts per column and pass, whatever its rows.  As soon as every wanted bucket
is small, one pass over all remaining bits ends the search.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window, functions as F
from pyspark.sql.types import ArrayType, DoubleType, IntegerType, LongType, StructField, StructType

from .blocks import frozen

DIGIT = 16
#: Values of a key's bucket that a last pass may tell apart by all their bits; for pooled columns, the
#: values of all wanted buckets together, which also bounds the counts that a pass may bring to the driver.
LAST, POOLED_LAST = 1 << DIGIT, 1 << 20
_TOP = np.uint64(1 << 63)


def ordered_bits(x: np.ndarray) -> np.ndarray:
    """Unsigned integers that order like the doubles; both zeros are one number."""
    bits = (x + 0.0).view(np.uint64)
    return np.where(bits & _TOP, ~bits, bits | _TOP)


def _signed(bits: np.ndarray) -> np.ndarray:
    """As Spark longs that order the same way."""
    return (bits ^ _TOP).view(np.int64)


def _unsigned(signed: np.ndarray) -> np.ndarray:
    return signed.view(np.uint64) ^ _TOP


def _codes(batch: pa.RecordBatch, keys: int) -> tuple[np.ndarray, np.ndarray]:
    """Number of each row's key, and a row of each number."""
    code = np.zeros(batch.num_rows, np.int64)
    for i in range(keys):
        column = pc.dictionary_encode(batch.column(i), null_encoding="encode")
        own = column.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        _, code = np.unique(code * (len(column.dictionary) + 1) + own, return_inverse=True)
    _, first, code = np.unique(code, return_index=True, return_inverse=True)
    return first, code


def _count(keys: int, columns: int, shift: int, above: int | None = None, wanted: dict[int, np.ndarray] | None = None):
    """Task function: values per (key, column, bits from `shift` up), inside the wanted buckets of the pass before.

    Those buckets, cut off at bit `above`, are given per column, or in a last column of the rows per key
    as a list of (column, bits).
    """

    def cut(bits: np.ndarray, at: int) -> np.ndarray:
        return _signed((bits >> np.uint64(at)) << np.uint64(at))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            first, code = _codes(batch, keys)
            if above is not None and wanted is None:
                lists = batch.column(batch.num_columns - 1).take(pa.array(first))
                owner = pc.list_parent_indices(lists).to_numpy()
                pair_column, pair_bits = (x.to_numpy(zero_copy_only=False) for x in lists.flatten().flatten())
            parts = []
            for c in range(columns):
                x = batch.column(keys + c).to_numpy(zero_copy_only=False).astype(np.float64)
                rows = np.flatnonzero(~np.isnan(x))
                bits, own = ordered_bits(x[rows]), code[rows]
                up = np.zeros(len(bits), np.int64)
                if above is not None:
                    up = cut(bits, above)
                    if wanted is not None:
                        ok = np.isin(up, wanted.get(c, np.zeros(0, np.int64)))
                    else:
                        mine = pair_column == c
                        known, number = np.unique(np.concatenate((pair_bits[mine], up)), return_inverse=True)
                        n = int(mine.sum())
                        ok = np.isin(own * len(known) + number[n:], owner[mine] * len(known) + number[:n])
                    bits, own, up = bits[ok], own[ok], up[ok]
                if not len(bits):
                    continue
                low = cut(bits, shift)
                order = np.lexsort((low, own))
                low, own, up = low[order], own[order], up[order]
                new = np.flatnonzero(np.concatenate(([True], (low[1:] != low[:-1]) | (own[1:] != own[:-1]))))
                n = np.diff(np.append(new, len(low)))
                parts.append((first[own[new]], np.full(len(new), c, np.int32), up[new], low[new], n))
            if parts:
                row, c, up, low, n = (np.concatenate(p) for p in zip(*parts))
                heads = [batch.column(i).take(pa.array(row)) for i in range(keys)]
                names = [*batch.schema.names[:keys], "c", "up", "bits", "n"]
                yield pa.RecordBatch.from_arrays([*heads, pa.array(c), pa.array(up), pa.array(low), pa.array(n)], names=names)

    return run


def _decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Appends the double that the last column's bits stand for."""
    for batch in batches:
        bits = batch.column(batch.num_columns - 1).to_numpy(zero_copy_only=False).astype(np.int64)
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(_doubles(bits))], names=[*batch.schema.names, "value"])


def _joined(left: DataFrame, right: DataFrame, on: Sequence[str], how: str = "inner") -> DataFrame:
    """Equi-join in which a null key is a key like any other."""
    other = right.withColumnsRenamed({k: f"__on_{k}" for k in on})
    same = [F.col(k).eqNullSafe(F.col(f"__on_{k}")) for k in on]
    return left.join(other, same, how).drop(*[f"__on_{k}" for k in on])


def _counted(source: DataFrame, keys: int, columns: int, shift: int, above: int | None = None, wanted=None) -> DataFrame:
    """Values per key, column and bucket, combined on the map side."""
    fields = [*source.schema.fields[:keys], StructField("c", IntegerType()), *[StructField(f, LongType()) for f in ("up", "bits", "n")]]
    found = source.mapInArrow(_count(keys, columns, shift, above, wanted), StructType(fields))
    return found.groupBy(*[f.name for f in fields[:-1]]).agg(F.sum("n").alias("n"))


def _source(df: DataFrame, keys: Sequence[str], values: Sequence[str]) -> DataFrame:
    """The rows that every pass reads, written once."""
    return frozen(df.select(*keys, *[F.col(v).cast("double").alias(v) for v in values]))


def _doubles(bits: np.ndarray) -> np.ndarray:
    bits = _unsigned(bits)
    return np.where(bits & _TOP, bits ^ _TOP, ~bits).view(np.float64)


def pooled_quantiles(
    df: DataFrame, values: Sequence[str], probabilities: Sequence[float], last: int = POOLED_LAST, written: bool = False
) -> dict[str, list[float] | None]:
    """Exact linear quantiles of each value over all rows; None for a column without values.

    The driver gets one count per column and bucket: at most 2^16 a column in the first pass, about `last`
    in all in the others.  `written` says that `df` is a stored table, so that reading it again costs a scan.
    """
    values = list(values)
    source = df.select(*[F.col(v).cast("double").alias(v) for v in values]) if written else _source(df, [], values)
    # Wanted places: column, bucket of the last pass, place inside it, one row per probability and side.
    column = bucket = place = np.zeros(0, np.int64)
    parts: dict[int, np.ndarray] = {}
    shift, above, wanted = 64 - DIGIT, None, None
    while True:
        table = _counted(source, 0, len(values), shift, above, wanted).toArrow()
        c, up, bits, n = (table[f].to_numpy() for f in ("c", "up", "bits", "n"))
        order = np.lexsort((bits, up, c))
        c, up, bits, n = c[order], up[order], bits[order], n[order]
        upto = np.cumsum(n)
        if above is None:
            heads = np.searchsorted(c, np.unique(c))
            sizes = np.add.reduceat(n, heads) if len(heads) else n
            at = (sizes[:, None] - 1) * np.asarray(probabilities, np.float64)[None, :]
            parts = dict(zip(c[heads].tolist(), at - np.floor(at)))
            place = np.stack((np.floor(at), np.ceil(at)), axis=2).astype(np.int64).ravel()
            column = np.repeat(c[heads].astype(np.int64), 2 * len(probabilities))
            bucket = np.zeros(len(column), np.int64)
        if not len(column):
            break
        # All counts lie in one running sum; a bucket's part of it begins after the buckets before.
        heads = np.flatnonzero(np.concatenate(([True], (c[1:] != c[:-1]) | (up[1:] != up[:-1]))))
        begin = {key: int(upto[h] - n[h]) for key, h in zip(zip(c[heads].tolist(), up[heads].tolist()), heads)}
        base = np.array([begin[key] for key in zip(column.tolist(), bucket.tolist())])
        hit = np.searchsorted(upto, base + place, "right")
        bucket, place = bits[hit], base + place - (upto[hit] - n[hit])
        if not shift:
            break
        wanted = {k: np.unique(bucket[column == k]) for k in range(len(values))}
        left = int(n[np.unique(hit)].sum())
        digit = max(1, min(DIGIT, int(math.log2(max(2, last / len(np.unique(hit)))))))
        above, shift = shift, 0 if left <= last else max(0, shift - digit)

    out: dict[str, list[float] | None] = {}
    for k, name in enumerate(values):
        if k not in parts:
            out[name] = None
            continue
        ends = _doubles(bucket[column == k]).reshape(-1, 2)
        # Equal neighbours stay as they are, infinite ones too.
        out[name] = [float(lo if lo == hi else lo + (hi - lo) * f) for (lo, hi), f in zip(ends, parts[k])]
    return out


def quantiles(
    df: DataFrame, keys: Sequence[str], values: Sequence[str], probabilities: Sequence[float], last: int = LAST
) -> DataFrame:
    """One row per key with an array column `<value>_q` of exact linear quantiles of each value.

    Nulls and NaN are not counted; a column without values has a null array.  Without keys there is
    one row.  The same passes run at every size, and only their number follows the data.
    """
    keys, values = list(keys), list(values)
    if not keys:
        found = pooled_quantiles(df, values, probabilities)
        return df.sparkSession.createDataFrame(
            [tuple(found[v] for v in values)], StructType([StructField(f"{v}_q", ArrayType(DoubleType())) for v in values])
        )
    source, group = _source(df, keys, values), [*keys, "c"]

    def placed(found: DataFrame, within: list[str]) -> DataFrame:
        """With `upto`, the values up to each bucket inside its parent: at most 2^16 rows a window."""
        order = Window.partitionBy(*within).orderBy("bits").rowsBetween(Window.unboundedPreceding, 0)
        return found.withColumn("upto", F.sum("n").over(order))

    def located(sought: DataFrame, found: DataFrame, on: list[str]) -> DataFrame:
        """Each wanted place with its bucket, its place there and the bucket's size."""
        inside = (F.col("upto") - F.col("n") <= F.col("place")) & (F.col("place") < F.col("upto"))
        place = F.col("place") - (F.col("upto") - F.col("n"))
        hit = _joined(sought, found, on).where(inside)
        return frozen(hit.select(*group, "i", "side", "part", F.col("bits").alias("up"), place.alias("place"), "n"))

    shift = 64 - DIGIT
    first = placed(frozen(_counted(source, len(keys), len(values), shift)).drop("up"), group)
    sizes = first.groupBy(*group).agg(F.max("upto").alias("all"))
    # Two wanted places per probability: the neighbours of the interpolated one.
    at = lambda p: (F.col("all") - 1) * F.lit(float(p))
    places = F.array(
        *[
            F.struct(F.lit(i).alias("i"), F.lit(side).alias("side"), f(at(p)).cast("long").alias("place"), (at(p) - F.floor(at(p))).alias("part"))
            for i, p in enumerate(probabilities)
            for side, f in ((0, F.floor), (1, F.ceil))
        ]
    )
    state = located(sizes.select(*group, F.inline(places)), first, group)
    while shift:
        largest = state.agg(F.max("n")).first()[0]
        if largest is None:
            break
        above, shift = shift, 0 if largest <= last else shift - DIGIT
        pairs = state.select(*group, "up").distinct()
        listed = pairs.groupBy(*keys).agg(F.collect_list(F.struct("c", F.col("up").alias("bits"))).alias("__sought"))
        found = _counted(_joined(source, listed, keys), len(keys), len(values), shift, above)
        state = located(state.drop("n"), placed(found, [*group, "up"]), [*group, "up"])

    decoded = state.select(*group, "i", "side", "part", "up")
    decoded = decoded.mapInArrow(_decode, StructType([*decoded.schema.fields, StructField("value", DoubleType())]))
    low, high = (F.max(F.when(F.col("side") == side, F.col("value"))) for side in (0, 1))
    each = decoded.groupBy(*group, "i").agg(low.alias("low"), high.alias("high"), F.max("part").alias("part"))
    blend = F.col("low") + (F.col("high") - F.col("low")) * F.col("part")
    q = F.when(F.col("low") == F.col("high"), F.col("low")).otherwise(blend)
    listed = each.groupBy(*group).agg(
        F.transform(F.array_sort(F.collect_list(F.struct("i", q.alias("q")))), lambda s: s["q"]).alias("q")
    )
    columns = [F.max(F.when(F.col("c") == i, F.col("q"))).alias(f"{v}_q") for i, v in enumerate(values)]
    return _joined(source.select(*keys).distinct(), listed.groupBy(*keys).agg(*columns), keys, "left")
