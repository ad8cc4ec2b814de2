"""Concatenate-and-cut packing of token sequences.

Pass one encodes every partition and numbers its tokens from 0; a prefix sum over the partitions'
token totals turns these into global offsets; pass two cuts at the multiples of the window.  A piece
is the record of the part of a document that lies in one window, so a window that two partitions
share needs no exchange of tokens.

Null or empty texts hold the end id alone.  Repeated rows are packed as often as they occur.  Other
columns are not read.  A very long text is encoded alone, whole, and spans as many windows as it needs.
The order of documents is that of the partitions that Spark reads.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window, functions as F

from .common import frozen, spread, text_batches
from .tokenizer import encoder

WINDOW = 1024

TOKENS = "part int, doc_id {id}, part_start long, doc_tokens long, ids binary"
PIECES = "doc_id {id}, start long, length long, doc_tokens long, sequence_id long, offset long, ids binary"


def _binaries(ids: np.ndarray, borders: np.ndarray) -> pa.Array:
    """Binary array of the stretches of uint32 ids between neighbouring borders, without a copy."""
    offsets = pa.py_buffer((4 * borders).astype("<i4"))
    data = pa.py_buffer(np.ascontiguousarray(ids, "<u4"))
    return pa.Array.from_buffers(pa.binary(), len(borders) - 1, [None, offsets, data])


def tokenized(
    docs: DataFrame, vocabulary: str, end_id: int, id_column: str = "doc_id", text_column: str = "text"
) -> DataFrame:
    """Ids of every document, written once: part, doc_id, part_start, doc_tokens, ids (uint32)."""

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, done = TaskContext.get().partitionId(), 0
        for batch, texts in text_batches(batches, "text"):
            ids, borders = encoder(vocabulary).encode(texts, end_id)
            n = len(texts)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.full(n, part, np.int32)),
                    batch.column(0),
                    pa.array(done + borders[:-1]),
                    pa.array(np.diff(borders)),
                    _binaries(ids, borders),
                ],
                names=["part", "doc_id", "part_start", "doc_tokens", "ids"],
            )
            done += int(borders[-1])

    rows = docs.select(F.col(id_column).alias("doc_id"), F.col(text_column).cast("string").alias("text"))
    schema = TOKENS.format(id=rows.schema["doc_id"].dataType.simpleString())
    return frozen(rows.mapInArrow(encode, schema))


def pack(tokens: DataFrame, window: int = WINDOW) -> DataFrame:
    """Pieces of the documents in consecutive windows of `window` ids.

    The only gathered table has one row per partition of `tokens`.
    """
    totals = tokens.groupBy("part").agg(F.max(F.col("part_start") + F.col("doc_tokens")).alias("n"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("part_offset"))
    placed = tokens.join(F.broadcast(offsets), "part").select(
        "doc_id", (F.col("part_offset") + F.col("part_start")).alias("begin"), "ids"
    )

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, column = batch.num_rows, batch.column(2)
            begin = batch.column(1).to_numpy()
            at = np.frombuffer(column.buffers()[1], "<i4")[column.offset : column.offset + rows + 1] // 4
            ids = np.frombuffer(column.buffers()[2], "<u4", count=int(at[-1]))[at[0] :]
            n = np.diff(at).astype(np.int64)
            first = begin // window
            pieces = (begin + n - 1) // window - first + 1
            row = np.repeat(np.arange(rows), pieces)
            k = spread(first, pieces)
            start = np.maximum(k * window - begin[row], 0)
            length = np.minimum((k + 1) * window - begin[row], n[row]) - start
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0).take(pa.array(row)),
                    pa.array(start),
                    pa.array(length),
                    pa.array(n[row]),
                    pa.array(k),
                    pa.array(begin[row] + start - k * window),
                    _binaries(ids, np.concatenate(([0], np.cumsum(length)))),
                ],
                names=["doc_id", "start", "length", "doc_tokens", "sequence_id", "offset", "ids"],
            )

    return placed.mapInArrow(cut, PIECES.format(id=tokens.schema["doc_id"].dataType.simpleString()))


def sequences(pieces: DataFrame) -> DataFrame:
    """One row per window: its ids in order and their number (less than the window at the end only)."""
    in_order = F.array_sort(F.collect_list(F.struct("offset", "ids")))
    return (
        pieces.groupBy("sequence_id")
        .agg(F.sum("length").alias("n_ids"), in_order.alias("parts"))
        .withColumn("ids", F.aggregate("parts", F.lit(b""), lambda all_ids, p: F.concat(all_ids, p["ids"])))
        .drop("parts")
    )
