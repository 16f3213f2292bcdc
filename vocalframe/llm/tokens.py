"""Words of whole Arrow text columns, found and hashed with numpy inside tasks.

A word is a run of ASCII letters (lower-cased), digits and non-ASCII characters,
that is, of the UTF-8 bytes of ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]`` after lower-casing A-Z.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

_fold = np.zeros(256, np.uint8)
_fold[0x30:0x3A] = np.arange(0x30, 0x3A)
_fold[0x41:0x5B] = np.arange(0x61, 0x7B)
_fold[0x61:0x7B] = np.arange(0x61, 0x7B)
_fold[0x80:] = np.arange(0x80, 0x100)
#: Byte to lower-cased word byte, 0 between words.
FOLD = _fold

_BASE = np.uint64(0x9E3779B97F4A7C55)          # odd, so it has an inverse modulo 2^64
_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijection on 64 bits that spreads every bit."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class _Powers:
    """Powers of the base and its inverse, kept for texts up to a few MB."""

    def __init__(self) -> None:
        self.up = self.down = np.zeros(0, np.uint64)

    def get(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            size = max(n, 1 << 20)
            up, down = np.full(size, _BASE), np.full(size, _INVERSE)
            up[0] = down[0] = 1
            up, down = np.cumprod(up, dtype=np.uint64), np.cumprod(down, dtype=np.uint64)
            if size > 1 << 23:
                return up[:n], down[:n]
            self.up, self.down = up, down
        return self.up[:n], self.down[:n]


_powers = _Powers()


@dataclass
class Words:
    """Words of a column: byte ranges in ``low`` (folded bytes) and 64-bit hashes;
    document i has the words ``ptr[i]:ptr[i + 1]`` and the bytes ``off[i]:off[i + 1]``."""

    raw: np.ndarray
    low: np.ndarray
    off: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    ptr: np.ndarray
    hashes: np.ndarray

    @property
    def doc(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.ptr) - 1), np.diff(self.ptr))


def words_of(column: pa.Array) -> Words:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column.cast(pa.large_string()), "")
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    n = len(column)
    off = np.frombuffer(column.buffers()[1], np.int64, n + 1, 8 * column.offset) if n else np.zeros(1, np.int64)
    data = column.buffers()[2] if n else None
    raw = np.frombuffer(data, np.uint8)[off[0]:off[-1]] if data is not None and off[-1] > off[0] else np.zeros(0, np.uint8)
    off = off - off[0]
    low = FOLD[raw]
    inside = np.zeros(len(low) + 2, bool)
    inside[1:-1] = low > 0
    edge = np.zeros(len(low) + 1, bool)
    edge[off] = True
    starts = np.flatnonzero(inside[1:-1] & (edge[:-1] | ~inside[:-2]))
    ends = np.flatnonzero(inside[1:-1] & (edge[1:] | ~inside[2:])) + 1
    up, down = _powers.get(len(low) + 1)
    sums = np.zeros(len(low) + 1, np.uint64)
    np.cumsum(low * up[:-1], dtype=np.uint64, out=sums[1:])
    hashes = mix64((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))
    return Words(raw, low, off, starts, ends, np.searchsorted(starts, off), hashes)


def slices(batch: pa.RecordBatch, text: int, most: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    """Cut a batch into pieces of about ``most`` bytes of text, one row at least."""
    column = batch.column(text)
    sizes = pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False)
    group = np.cumsum(sizes) // most
    cuts = [0, *(np.flatnonzero(np.diff(group)) + 1).tolist(), batch.num_rows]
    for a, b in zip(cuts, cuts[1:]):
        if b > a:
            yield batch.slice(a, b - a)


def list_of(values: list[np.ndarray] | list[list], kind: pa.DataType) -> pa.Array:
    return pa.array([list(v) for v in values], pa.list_(kind))
