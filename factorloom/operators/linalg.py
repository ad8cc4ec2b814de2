"""Small dense algebra from distributed rows: Gram matrices and tall-skinny QR.

Executors reduce their rows to k x k matrices; only those are combined further.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F


def _matrix(batch: pa.RecordBatch) -> np.ndarray:
    columns = [c.to_numpy(zero_copy_only=False).astype(float) for c in batch.columns]
    return np.column_stack(columns) if columns else np.zeros((batch.num_rows, 0))


def gram(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Rows (i, j, value) of the cross-product matrix; missing values count as zero."""
    k = len(columns)

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((k, k))
        for batch in batches:
            x = np.nan_to_num(_matrix(batch), nan=0.0)
            total += x.T @ x
        i, j = np.indices((k, k))
        yield pa.RecordBatch.from_arrays(
            [pa.array(i.ravel().astype("int32")), pa.array(j.ravel().astype("int32")), pa.array(total.ravel())],
            names=["i", "j", "value"],
        )

    chosen = df.select(*[F.col(c).cast("double").alias(c) for c in columns])
    parts = chosen.mapInArrow(partial, "i int, j int, value double")
    return parts.groupBy("i", "j").agg(F.sum("value").alias("value"))


def gram_matrix(df: DataFrame, columns: Sequence[str]) -> np.ndarray:
    out = np.zeros((len(columns), len(columns)))
    for row in gram(df, columns).collect():
        out[row["i"], row["j"]] = row["value"]
    return out


# Triangular factors per combining round: 1024 groups, then 32 on the driver.
ROUNDS = (1024, 32)


def triangular_factor(df: DataFrame, columns: Sequence[str]) -> np.ndarray:
    """R of the QR factorisation of the rows, combined in a tree of k x k factors.

    Keeps the singular values of the data, which forming the Gram matrix would square.
    """
    k = len(columns)

    def reduce(stack: np.ndarray) -> np.ndarray:
        return np.linalg.qr(stack, mode="r") if len(stack) else stack

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        r = np.zeros((0, k))
        for batch in batches:
            r = reduce(np.vstack([r, _matrix(batch)]))
        if len(r):
            yield pa.RecordBatch.from_arrays(
                [pa.array([r.ravel().tolist()], pa.list_(pa.float64()))], names=["r"]
            )

    def combine(table: pa.Table) -> pa.Table:
        stack = np.vstack([np.array(v).reshape(-1, k) for v in table["r"].to_pylist()])
        return pa.table({"r": pa.array([reduce(stack).ravel().tolist()], pa.list_(pa.float64()))})

    chosen = df.select(*[F.col(c).cast("double").alias(c) for c in columns])
    factors = chosen.mapInArrow(first, "r array<double>")
    for groups in ROUNDS:
        keyed = factors.withColumn("g", F.pmod(F.xxhash64("r"), F.lit(groups)))
        factors = keyed.groupBy("g").applyInArrow(combine, "r array<double>")
    rows = factors.collect()
    if not rows:
        return np.zeros((0, k))
    return reduce(np.vstack([np.array(row["r"]).reshape(-1, k) for row in rows]))
