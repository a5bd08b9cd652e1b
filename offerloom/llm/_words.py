"""Whole columns of text as arrays: words, lines and their hashes, without an object per word.

A slice of an Arrow text column is one byte buffer with document bounds.  All
functions here work on such a slice at once, so the cost of a word is a few array
operations.  A slice holds about ``SLICE_BYTES`` of text (or one longer text), which
bounds the memory of a task.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

SLICE_BYTES = 1 << 20

_U64 = np.uint64
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[ord("A"):ord("Z") + 1] += 32


def mix(x: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit values (a bijection)."""
    x = x.astype(_U64, copy=True)
    x ^= x >> _U64(30)
    x *= _U64(0xBF58476D1CE4E5B9)
    x ^= x >> _U64(27)
    x *= _U64(0x94D049BB133111EB)
    x ^= x >> _U64(31)
    return x


class _Powers:
    """Powers of an odd base and of its inverse modulo 2**64, as far as asked for."""

    def __init__(self, base: int):
        self.base, self.inverse = base, pow(base, -1, 1 << 64)
        self._up = self._down = np.ones(1, _U64)

    @staticmethod
    def _grow(base: int, n: int) -> np.ndarray:
        out = np.full(n, base, _U64)
        out[0] = 1
        return np.cumprod(out, dtype=_U64)

    def __call__(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self._up) < n:
            size = max(n, 2 * SLICE_BYTES)
            self._up, self._down = self._grow(self.base, size), self._grow(self.inverse, size)
        return self._up, self._down


_BYTES = (_Powers(0x9E3779B97F4A7C15), mix(np.arange(1, 257, dtype=_U64)))
_ITEMS = (_Powers(0xD1342543DE82EF95), _Powers(0xA0761D6478BD642F))


def _runs(values: np.ndarray, powers: _Powers, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A hash of each run values[start:end], from differences of one running sum."""
    up, down = powers(len(values) + 1)
    total = np.zeros(len(values) + 1, _U64)
    np.cumsum(values * up[:len(values)], out=total[1:])
    return (total[ends] - total[starts]) * down[starts]


@dataclass
class Slice:
    """Some rows of a batch; ``data[bounds[i]:bounds[i + 1]]`` is the text of row i, empty for null."""

    batch: pa.RecordBatch
    data: np.ndarray
    bounds: np.ndarray

    def __len__(self) -> int:
        return len(self.bounds) - 1

    def text(self, i: int) -> bytes:
        return self.data[self.bounds[i]:self.bounds[i + 1]].tobytes()

    def lowered(self) -> "Slice":
        return Slice(self.batch, _LOWER[self.data], self.bounds)

    def sums(self, mask: np.ndarray) -> np.ndarray:
        """How many bytes of each row a mask over the bytes marks."""
        total = np.zeros(len(mask) + 1, np.int64)
        np.cumsum(mask, out=total[1:])
        return total[self.bounds[1:]] - total[self.bounds[:-1]]


def slices(batches: Iterator[pa.RecordBatch], column: str = "text", size: int = SLICE_BYTES, rows: int = 1 << 20) -> Iterator[Slice]:
    for batch in batches:
        at = batch.schema.get_field_index(column)
        whole = batch.column(at)
        if whole.null_count:
            whole = whole.fill_null("")
        width = np.int64 if pa.types.is_large_string(whole.type) else np.int32
        _, offsets, data = whole.buffers()
        bounds = np.frombuffer(offsets, width)[whole.offset:whole.offset + len(whole) + 1].astype(np.int64) if len(whole) else np.zeros(1, np.int64)
        body = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
        first = 0
        while first < len(whole):
            last = max(first + 1, int(np.searchsorted(bounds, bounds[first] + size, "right")) - 1)
            last = min(last, first + rows)
            yield Slice(batch.slice(first, last - first), body[bounds[first]:bounds[last]], bounds[first:last + 1] - bounds[first])
            first = last


@dataclass
class Words:
    """Words ``[^\\x20\\x09-\\x0D]+``: byte starts and ends, and the first word of each row (rows + 1 entries)."""

    starts: np.ndarray
    ends: np.ndarray
    first: np.ndarray

    def __len__(self) -> int:
        return len(self.starts)

    def rows(self) -> np.ndarray:
        """The row of each word."""
        return np.repeat(np.arange(len(self.first) - 1), np.diff(self.first))


def spaces(part: Slice) -> np.ndarray:
    return _SPACE[part.data]


def words(part: Slice) -> Words:
    space = spaces(part)
    n = len(space)
    inner = part.bounds[(part.bounds > 0) & (part.bounds < n)]
    before = np.ones(n, bool)
    before[1:] = space[:-1]
    before[inner] = True
    after = np.ones(n, bool)
    after[:-1] = space[1:]
    after[inner - 1] = True
    starts = np.flatnonzero(~space & before)
    ends = np.flatnonzero(~space & after) + 1
    return Words(starts, ends, np.searchsorted(starts, part.bounds))


def byte_hashes(part: Slice, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each byte run."""
    powers, table = _BYTES
    return mix(_runs(table[part.data], powers, starts, ends) + (ends - starts).astype(_U64))


def word_hashes(part: Slice, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each byte run, from blocks of eight bytes that are mixed with their number before they are added."""
    size = ends - starts
    blocks = (size + 7) >> 3
    first = np.cumsum(blocks) - blocks
    inside = np.arange(blocks.sum()) - np.repeat(first, blocks)
    padded = np.concatenate([part.data, np.zeros(8, np.uint8)])
    eight = np.ndarray((len(part.data) + 1,), "<u8", padded, 0, (1,))
    value = eight[np.repeat(starts, blocks) + 8 * inside]
    left = np.minimum(np.repeat(size, blocks) - 8 * inside, 8).astype(_U64)
    value = mix(mix(value & (~_U64(0) >> (_U64(64) - _U64(8) * left))) + inside.astype(_U64) * _U64(0x9E3779B97F4A7C15))
    total = np.zeros(len(value) + 1, _U64)
    np.cumsum(value, out=total[1:])
    return mix(total[first + blocks] - total[first] + size.astype(_U64))


def gram_starts(first: np.ndarray, size: int) -> np.ndarray:
    """Where runs of ``size`` words begin that stay within one row."""
    room = np.maximum(np.diff(first) - size + 1, 0)
    return np.repeat(first[:-1] - np.cumsum(room) + room, room) + np.arange(room.sum())


def gram_hashes(values: np.ndarray, starts: np.ndarray, size: int, which: int = 0) -> np.ndarray:
    """A 64-bit hash of each run of ``size`` values; ``which`` picks one of two independent ones."""
    if which:
        values = mix(values + _U64(0x632BE59BD9B4E019))
    return mix(_runs(values, _ITEMS[which], starts, starts + size))


def covered(n: int, starts: np.ndarray, size: int) -> np.ndarray:
    """Which of n words lie in a run of ``size`` words from one of ``starts``."""
    steps = np.bincount(starts, minlength=n + 1) - np.bincount(starts + size, minlength=n + 1)
    return np.cumsum(steps)[:n] > 0


def repeated(rows: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """Which hashes occur twice or more within their row."""
    keys = mix(hashes ^ mix(rows.astype(_U64) + _U64(1)))
    order = np.argsort(keys)
    same = keys[order[1:]] == keys[order[:-1]]
    out = np.zeros(len(keys), bool)
    out[order[1:][same]] = True
    out[order[:-1][same]] = True
    return out


def later_copies(rows: np.ndarray, hashes: np.ndarray, count: int) -> np.ndarray:
    """For each of ``count`` rows, how many hashes equal an earlier one of the row."""
    keys = mix(hashes ^ mix(rows.astype(_U64) + _U64(1)))
    _, first = np.unique(keys, return_index=True)
    return np.bincount(rows, minlength=count) - np.bincount(rows[first], minlength=count)


def lines(part: Slice) -> Words:
    """Lines between ``\\n``: starts, ends and the first line of each row; every row has one at least."""
    breaks = np.flatnonzero(part.data == 10)
    starts = np.concatenate([part.bounds[:-1], breaks + 1])
    ends = np.concatenate([part.bounds[1:], breaks])
    starts.sort()
    ends.sort()
    row = np.concatenate([np.arange(len(part)), np.searchsorted(part.bounds, breaks, "right") - 1])
    counts = np.bincount(row, minlength=len(part))
    return Words(starts, ends, np.concatenate([[0], np.cumsum(counts)]))
