"""Minimal perfect hashes over byte strings, with the keys stored for verification.

Each level sets one bit per key that meets no other key in the level's bit array; keys that meet go on
to the next level.  A key's slot is the number of set bits before its own, so n keys get the slots
0 .. n - 1.  A string that is not among the keys may also hit a bit; the key stored at the slot decides.
"""

from __future__ import annotations

import io

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from .common import mix

#: Bits per key of a level, and levels before the last keys are listed one by one.
SPACING, LEVELS = 2.0, 32


def _places(hashes: np.ndarray, level: int, size: int) -> np.ndarray:
    return mix(hashes ^ mix(np.uint64(level + 1) + np.zeros(1, np.uint64))) % np.uint64(size)


class PerfectHash:
    """Slots of a fixed set of different keys."""

    def __init__(self, sizes: np.ndarray, bits: np.ndarray, listed: np.ndarray, keys: pa.Array):
        self.sizes, self.bits, self.listed, self.keys = sizes, bits, listed, keys
        self.before = np.cumsum(bits, dtype=np.int64) - bits
        self.starts = np.concatenate(([0], np.cumsum(sizes)))
        self.placed = int(bits.sum())

    @classmethod
    def build(cls, hashes: np.ndarray, keys: pa.Array) -> "PerfectHash":
        """`hashes` are 64-bit hashes of the keys; equal hashes of different keys are allowed."""
        sizes, levels, slots = [], [], np.full(len(hashes), -1, np.int64)
        left, placed = np.arange(len(hashes)), 0
        for level in range(LEVELS):
            if not len(left):
                break
            size = max(64, int(len(left) * SPACING))
            at = _places(hashes[left], level, size).astype(np.int64)
            alone = np.bincount(at, minlength=size) == 1
            mine = alone[at]
            slots[left[mine]] = placed + (np.cumsum(alone) - alone)[at[mine]]
            placed += int(alone.sum())
            sizes.append(size)
            levels.append(alone)
            left = left[~mine]
        slots[left] = placed + np.arange(len(left))
        bits = np.concatenate(levels) if levels else np.zeros(0, bool)
        order = np.argsort(slots)
        return cls(np.array(sizes, np.int64), bits, hashes[left], keys.take(pa.array(order)))

    def __len__(self) -> int:
        return len(self.keys)

    @property
    def nbytes(self) -> int:
        return self.keys.nbytes + len(self.bits) * 9

    def slots(self, hashes: np.ndarray, keys: pa.Array) -> np.ndarray:
        """Slot of every key, -1 for one that is not stored."""
        out, open_ = np.full(len(hashes), -1, np.int64), np.arange(len(hashes))
        for level, size in enumerate(self.sizes.tolist()):
            at = _places(hashes[open_], level, size).astype(np.int64) + self.starts[level]
            hit = self.bits[at]
            out[open_[hit]] = self.before[at[hit]]
            open_ = open_[~hit]
        self._verify(out, keys)
        if len(self.listed):
            # Keys whose hash equals another key's never get a bit of their own.
            for i in np.flatnonzero((out < 0) & np.isin(hashes, self.listed)).tolist():
                for j in np.flatnonzero(self.listed == hashes[i]).tolist():
                    if self.keys[self.placed + j] == keys[i]:
                        out[i] = self.placed + j
        return out

    def _verify(self, slots: np.ndarray, keys: pa.Array) -> None:
        found = np.flatnonzero(slots >= 0)
        same = pc.equal(self.keys.take(pa.array(slots[found])), keys.take(pa.array(found)))
        slots[found[~same.to_numpy(zero_copy_only=False)]] = -1

    def tobytes(self) -> bytes:
        lengths = np.diff(np.frombuffer(self.keys.buffers()[1], np.int64)[self.keys.offset :][: len(self) + 1])
        blob = np.frombuffer(b"".join(self.keys.to_pylist()), np.uint8)
        out = io.BytesIO()
        np.savez(out, sizes=self.sizes, bits=np.packbits(self.bits), listed=self.listed, lengths=lengths, blob=blob)
        return out.getvalue()

    @classmethod
    def frombytes(cls, data: bytes) -> "PerfectHash":
        got = np.load(io.BytesIO(data))
        bits = np.unpackbits(got["bits"], count=int(got["sizes"].sum())).astype(bool)
        return cls(got["sizes"], bits, got["listed"], strings(got["blob"], got["lengths"]))


def strings(blob: np.ndarray, lengths: np.ndarray) -> pa.Array:
    """Byte strings that follow each other in `blob`."""
    offsets = np.concatenate(([0], np.cumsum(lengths, dtype=np.int64)))
    return pa.Array.from_buffers(pa.large_binary(), len(lengths), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(blob))])
