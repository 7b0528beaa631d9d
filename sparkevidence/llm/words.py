"""Words of Arrow text columns as NumPy arrays: bounds, hashes, runs and selected positions.

A batch is handled as one byte buffer, so the cost per word is a few array operations. Batches are
cut to a few MB of text first, which bounds the memory of a task whatever the length of the texts
(one text is never split, so a single very long text sets the bound). A null text has no words.
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

SLICE_BYTES = 1 << 20

_SPACES = bytes([0x20, *range(0x09, 0x0E)])
_BYTE_BASE = np.uint64(0x9E3779B97F4A7C15)
_WORD_BASE = np.uint64(0xD1B54A32D192ED03)


def _flags(delimiters: bytes) -> np.ndarray:
    flags = np.ones(256, dtype=bool)
    flags[list(delimiters)] = False
    return flags


#: Bytes of words that white space separates, and of words of digits, a-z and non-ASCII letters.
SPACED = _flags(_SPACES)
ALNUM = _flags(bytes([*range(0x00, 0x30), *range(0x3A, 0x61), *range(0x7B, 0x80)]))
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 0x20


def mix(x: np.ndarray) -> np.ndarray:
    """Finalizer of a 64-bit hash."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class _Powers:
    """Powers of an odd number and of its inverse modulo 2**64, made as far as they are needed."""

    def __init__(self, base: np.uint64):
        self.base, self.inverse = int(base), pow(int(base), -1, 1 << 64)
        self.up = self.down = np.ones(1, dtype=np.uint64)

    def reach(self, n: int) -> None:
        if len(self.up) < n:
            for name, factor in (("up", self.base), ("down", self.inverse)):
                steps = np.full(n, factor, dtype=np.uint64)
                steps[0] = 1
                setattr(self, name, np.cumprod(steps, dtype=np.uint64))


_BYTES, _WORDS = _Powers(_BYTE_BASE), _Powers(_WORD_BASE)


_trim = getattr(ctypes.CDLL(None), "malloc_trim", None)


def give_back() -> None:
    """Return freed memory to the system: a Python worker lives on, and what its tasks freed would stay its own."""
    pa.default_memory_pool().release_unused()
    if _trim is not None:  # the C library of GNU only
        _trim(0)


def slices(batch: pa.RecordBatch, column: str, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Parts of a batch with about ``limit`` bytes of text each, one row at least.

    What the batches before have left behind is given back first.
    """
    give_back()
    if batch.num_rows == 0:
        return
    _, offsets = buffer_of(batch.column(column))
    row = 0
    while row < batch.num_rows:
        end = int(np.searchsorted(offsets, offsets[row] + limit, side="right")) - 1
        end = min(max(end, row + 1), batch.num_rows)
        yield batch.slice(row, end - row)
        row = end


def buffer_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column and the offset of each text; nulls are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null(b"" if pa.types.is_binary(column.type) else "")
    large = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, at, data = column.buffers()
    n = len(column)
    if n == 0 or at is None:
        return np.empty(0, np.uint8), np.zeros(n + 1, np.int64)
    offsets = np.frombuffer(at, dtype=np.int64 if large else np.int32, count=n + 1 + column.offset)
    offsets = offsets[column.offset :].astype(np.int64)
    whole = np.frombuffer(data, dtype=np.uint8) if data is not None else np.empty(0, np.uint8)
    return whole[offsets[0] : offsets[-1]], offsets - offsets[0]


@dataclass
class Words:
    """Words of a batch in order: byte bounds in ``data``, row and hash; ``first`` word of each row."""

    data: np.ndarray
    offsets: np.ndarray
    start: np.ndarray
    end: np.ndarray
    row: np.ndarray
    first: np.ndarray

    def __len__(self) -> int:
        return len(self.start)

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    def hashes(self) -> np.ndarray:
        """A 64-bit hash of each word."""
        n = len(self.data)
        _BYTES.reach(n + 1)
        total = np.zeros(n + 1, dtype=np.uint64)
        with np.errstate(over="ignore"):
            np.cumsum((self.data.astype(np.uint64) + np.uint64(1)) * _BYTES.up[:n], out=total[1:])
            return mix((total[self.end] - total[self.start]) * _BYTES.down[self.start])

    def text(self, first: int, end: int) -> bytes:
        """Words ``first`` to ``end`` joined by one space."""
        return b" ".join(
            self.data[a:b].tobytes() for a, b in zip(self.start[first:end], self.end[first:end])
        )


def words_of(column: pa.Array, flags: np.ndarray = SPACED, lower: bool = False) -> Words:
    data, offsets = buffer_of(column)
    if lower:
        data = _LOWER[data]
    inside = flags[data]
    opens, closes = inside.copy(), inside.copy()
    if len(data):
        cut = np.zeros(len(data) + 1, dtype=bool)
        cut[offsets] = True
        opens[1:] &= ~inside[:-1] | cut[1:-1]
        closes[:-1] &= ~inside[1:] | cut[1:-1]
    start, end = np.flatnonzero(opens), np.flatnonzero(closes) + 1
    first = np.searchsorted(start, offsets)
    row = np.repeat(np.arange(len(offsets) - 1), np.diff(first))
    return Words(data, offsets, start, end, row, first)


def grams(hashes: np.ndarray, row: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of k words and a flag for those that stay in one row."""
    n = len(hashes)
    if n < k:
        return np.empty(0, np.uint64), np.empty(0, bool)
    _WORDS.reach(n + 1)
    total = np.zeros(n + 1, dtype=np.uint64)
    with np.errstate(over="ignore"):
        np.cumsum(hashes * _WORDS.up[:n], out=total[1:])
        out = mix((total[k:] - total[:-k]) * _WORDS.down[: n - k + 1])
    return out, row[: n - k + 1] == row[k - 1 :]


def row_hash(hashes: np.ndarray, first: np.ndarray) -> np.ndarray:
    """A hash of the whole word sequence of each row."""
    n = len(hashes)
    _WORDS.reach(n + 1)
    total = np.zeros(n + 1, dtype=np.uint64)
    with np.errstate(over="ignore"):
        np.cumsum(hashes * _WORDS.up[:n], out=total[1:])
        value = (total[first[1:]] - total[first[:-1]]) * _WORDS.down[first[:-1]]
        return mix(value + np.diff(first).astype(np.uint64) * _BYTE_BASE)


def minimisers(
    hashes: np.ndarray, row: np.ndarray, window: int, gram: int
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Windows of ``window`` words inside a row, the position each selects, and the gram hashes.

    A window selects the leftmost of its smallest ``gram``-word hashes, so equal windows select the
    same place in themselves.
    """
    hashed, _ = grams(hashes, row, gram)
    width = window - gram + 1
    if len(hashed) < width:
        return np.empty(0, np.int64), np.empty(0, np.int64), hashed
    start = np.flatnonzero(row[: len(row) - window + 1] == row[window - 1 :])
    low = np.lib.stride_tricks.sliding_window_view(hashed, width)
    chosen = np.empty(len(start), dtype=np.int64)
    for a in range(0, len(start), 1 << 16):
        part = start[a : a + (1 << 16)]
        chosen[a : a + (1 << 16)] = part + low[part].argmin(axis=1)
    return start, chosen, hashed


def spans_of(hit: np.ndarray) -> np.ndarray:
    """Bounds (start, end) of the runs of true flags."""
    edge = np.diff(np.concatenate(([0], hit.astype(np.int8), [0])))
    return np.stack([np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)], axis=1)


def signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)


def lists(values: np.ndarray, counts: np.ndarray, kind: pa.DataType) -> pa.Array:
    """A list column from flat values and the length of each row's list."""
    at = np.concatenate(([0], np.cumsum(counts))).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(values, kind))
