"""Shared folder, words and hashes for the text operators.

A word is a maximal run of characters other than space and the ASCII controls 0x09-0x0D.
"""

from __future__ import annotations

import contextlib
import ctypes
import gc
import uuid
from collections.abc import Iterator
from urllib.parse import unquote, urlparse

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession

from factorloom.operators import blocks

WORD = "[^\\x20\\x09-\\x0D]+"
SPACE = "[\\x20\\x09-\\x0D]+"

#: Text bytes that a task holds as numpy arrays at a time (a longer text is taken alone).
BATCH_BYTES = 2 << 20


def shared_folder(spark: SparkSession) -> str:
    """A new subfolder name in the application's work folder under `spark.checkpoint.dir`."""
    return f"{blocks.shared_folder(spark)}/llm/{uuid.uuid4().hex}"


def frozen(df: DataFrame) -> DataFrame:
    """Write the rows once to the shared folder and read them back: cuts the lineage, so that a lost
    executor costs a read and numbers given to partitions cannot move."""
    path = shared_folder(df.sparkSession)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def filesystem(uri: str) -> tuple[pafs.FileSystem, str]:
    """The Arrow file system and path of a URI or plain path; works on any executor."""
    if "://" not in uri and not uri.startswith("file:"):
        return pafs.LocalFileSystem(), uri
    parsed = urlparse(uri)
    if parsed.scheme == "file":
        return pafs.LocalFileSystem(), unquote(parsed.path)
    return pafs.FileSystem.from_uri(uri)


# --- words of an Arrow string column as numpy arrays ---------------------------------------------


class Texts:
    """UTF-8 bytes of several texts in one buffer: text i is buf[offsets[i]:offsets[i + 1]]."""

    def __init__(self, column: pa.Array):
        column = pc.fill_null(column.cast(pa.large_string()), "")
        if isinstance(column, pa.ChunkedArray):
            column = column.combine_chunks()
        _, offsets, data = column.buffers()
        n = len(column)
        at = np.frombuffer(offsets, np.int64)[column.offset : column.offset + n + 1] if n else np.zeros(1, np.int64)
        whole = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
        self.buf = whole[at[0] : at[-1]]
        self.offsets = at - at[0]

    def __len__(self) -> int:
        return len(self.offsets) - 1

    def words(self, inside: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Start, end and text number of every word, in order; `inside` may mark other runs of bytes."""
        b = self.buf
        if inside is None:
            inside = ~((b == 32) | ((b >= 9) & (b <= 13)))
        first = np.zeros(len(b) + 1, bool)
        first[self.offsets] = True
        before = np.concatenate(([False], inside[:-1])) if len(b) else inside
        starts = np.flatnonzero(inside & (~before | first[:-1]))
        after = np.concatenate((inside[1:], [False])) if len(b) else inside
        ends = np.flatnonzero(inside & (~after | first[1:])) + 1
        return starts, ends, np.searchsorted(self.offsets, starts, "right") - 1


def text_batches(
    batches: Iterator[pa.RecordBatch], text: str, limit: int = BATCH_BYTES
) -> Iterator[tuple[pa.RecordBatch, Texts]]:
    """Slices of the record batches whose texts fill about `limit` bytes, at least one row each."""
    try:
        for batch in batches:
            if not batch.num_rows:
                continue
            column = batch.column(batch.schema.get_field_index(text))
            sizes = pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False)
            block = np.cumsum(sizes) // limit
            cuts = [0, *(np.flatnonzero(np.diff(block)) + 1).tolist(), batch.num_rows]
            for a, b in zip(cuts[:-1], cuts[1:]):
                if b > a:
                    part = batch.slice(a, b - a)
                    yield part, Texts(part.column(part.schema.get_field_index(text)))
    finally:
        release()


def release() -> None:
    """Give memory that a task no longer needs back to the machine: workers stay for later tasks."""
    _powers.clear()
    gc.collect()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL("libc.so.6").malloc_trim(0)


_BASE = np.uint64(0x9E3779B97F4A7C15)
_powers: dict[str, np.ndarray] = {}


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser (splitmix64)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _powers_to(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers.get("up", ())) < n:
        inverse = np.uint64(pow(int(_BASE), -1, 1 << 64))
        size = max(n + n // 4, BATCH_BYTES + (1 << 18))
        _powers["up"] = np.cumprod(np.full(size, _BASE, np.uint64))
        _powers["down"] = np.cumprod(np.full(size, inverse, np.uint64))
    return _powers["up"], _powers["down"]


class SpanHashes:
    """64-bit hashes of any spans of a buffer, from one prefix sum of a polynomial.

    A long buffer is summed in stretches, so that memory follows the stretch and its longest span.
    """

    def __init__(self, buf: np.ndarray, whole: bool = False):
        self.buf = buf
        self.total = None
        if whole or len(buf) <= 2 * BATCH_BYTES:
            up, self.down = _powers_to(len(buf) + 1)
            self.total = np.zeros(len(buf) + 1, np.uint64)
            np.cumsum((buf.astype(np.uint64) + np.uint64(1)) * up[: len(buf)], out=self.total[1:])

    def of(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        if self.total is not None:
            h = (self.total[ends] - self.total[starts]) * self.down[starts]
            return mix(h ^ ((ends - starts).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)))
        out = np.empty(len(starts), np.uint64)
        stretch = starts // BATCH_BYTES
        for own in np.unique(stretch).tolist():
            rows = np.flatnonzero(stretch == own)
            a, b = int(starts[rows].min()), int(ends[rows].max())
            out[rows] = SpanHashes(self.buf[a:b], whole=True).of(starts[rows] - a, ends[rows] - a)
        return out


def span_hashes(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hash of buf[start:end] for each span."""
    return SpanHashes(buf).of(starts, ends)


def letters(buf: np.ndarray) -> np.ndarray:
    """Which bytes are ASCII letters or belong to characters beyond ASCII."""
    folded = buf | 32
    return ((folded >= 97) & (folded <= 122)) | (buf >= 128)


def lowered(buf: np.ndarray) -> np.ndarray:
    """A-Z to a-z; other characters stay."""
    return np.where((buf >= 65) & (buf <= 90), buf + np.uint8(32), buf)


def spread(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Indexes start, start + 1, ... of each run, one run after the other."""
    total = int(lengths.sum())
    if not total:
        return np.zeros(0, np.int64)
    shift = starts - (np.cumsum(lengths) - lengths)
    return np.repeat(shift, lengths) + np.arange(total)
