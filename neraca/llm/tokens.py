"""Vectorised tokens of Arrow text columns, for use inside ``mapInArrow`` tasks.

Words are found and hashed on the raw UTF-8 bytes with numpy, a slice of about ``SLICE``
bytes at a time.  A longer text is cut at separators, so the memory of a task follows the
batch and the words of one text, never a multiple of its bytes.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa

SLICE = 1 << 19
_PRIME = 0x9E3779B97F4A7C15
_MASK = (1 << 64) - 1

#: Bytes of words `[^\x20\x09-\x0D]+`; bytes of lines; bytes of alphanumeric words.
WORD = np.ones(256, bool)
WORD[[0x20, *range(0x09, 0x0E)]] = False
LINE = np.ones(256, bool)
LINE[0x0A] = False
ALNUM = np.zeros(256, bool)
ALNUM[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True

#: First bytes of code points.
HEADS = (np.arange(256) & 0xC0) != 0x80

#: Identity, and A-Z to a-z.
SAME = np.arange(256, dtype=np.uint8)
LOWER = SAME.copy()
LOWER[0x41:0x5B] += 0x20


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit scrambler."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_VALUES = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(_PRIME))


class _Powers:
    """Powers of an odd number and of its inverse modulo 2**64, up to the longest slice so far."""

    up = down = np.ones(1, np.uint64)

    @classmethod
    def of(cls, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(cls.up) <= n:
            size = max(SLICE + 1, n + 1)
            inverse = pow(_PRIME, -1, 1 << 64)
            steps = np.full(size, _PRIME, np.uint64)
            steps[0] = 1
            cls.up = np.multiply.accumulate(steps)
            steps = np.full(size, inverse, np.uint64)
            steps[0] = 1
            cls.down = np.multiply.accumulate(steps)
        return cls.up, cls.down


class Words(NamedTuple):
    """Tokens of rows ``first .. first + rows - 1``, in order; ``row`` counts from ``first``."""

    first: int
    rows: int
    row: np.ndarray
    hash: np.ndarray
    size: np.ndarray  # bytes
    marked: np.ndarray  # marked bytes in it

    @property
    def bounds(self) -> np.ndarray:
        """Position of each row's first token, and the end."""
        return np.searchsorted(self.row, np.arange(self.rows + 1))


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and row offsets of a text column; a null row is empty."""
    column = column.cast(pa.large_string())
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    if column.null_count:  # a null may still span bytes
        lengths = np.where(np.asarray(column.is_valid()), np.diff(at), 0)
        if (lengths != np.diff(at)).any():
            return buffers(column.fill_null(""))
    return raw, at


def slices(at: np.ndarray, limit: int = SLICE, most_rows: int = 1 << 30) -> Iterator[tuple[int, int]]:
    """Row ranges of at most ``limit`` bytes and ``most_rows`` rows, or one longer row."""
    low, n = 0, len(at) - 1
    while low < n:
        high = max(low + 1, int(np.searchsorted(at, at[low] + limit, "right")) - 1)
        high = min(high, n, low + most_rows)
        yield low, high
        low = high


def pieces(raw: np.ndarray, low: int, high: int, token: np.ndarray, limit: int = SLICE) -> Iterator[tuple[int, int]]:
    """Byte ranges of about ``limit`` bytes that cut no token of ``raw[low:high]``."""
    while high - low > limit:
        cut, step = low + limit, limit
        while cut < high:
            gaps = np.flatnonzero(~token[raw[cut : min(cut + step, high)]])
            if len(gaps):
                cut += int(gaps[0])
                break
            cut += step
        cut = min(cut, high)
        yield low, cut
        low = cut
    if high > low:
        yield low, high


def spans(raw: np.ndarray, heads: np.ndarray, token: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and end of each token; one that reaches a byte in ``heads`` begins anew there."""
    inside = np.zeros(len(raw) + 2, bool)
    inside[1:-1] = token[raw]
    edge = inside[1:] != inside[:-1]
    starts, ends = edge & inside[1:], edge & inside[:-1]
    heads = heads[(heads > 0) & (heads < len(raw))]
    joined = heads[inside[heads] & inside[heads + 1]]
    starts[joined] = ends[joined] = True
    return np.flatnonzero(starts), np.flatnonzero(ends)


def hashes(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray, fold: np.ndarray = SAME) -> np.ndarray:
    """64-bit hash of each byte span."""
    up, down = _Powers.of(len(raw))
    sums = np.zeros(len(raw) + 1, np.uint64)
    np.cumsum(_VALUES[fold[raw]] * up[: len(raw)], out=sums[1:])
    return mix((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(np.uint64))


def words(
    column: pa.Array, token: np.ndarray = WORD, fold: np.ndarray = LOWER, limit: int = SLICE, most_rows: int = 1 << 30,
    mark: np.ndarray | None = None,
) -> Iterator[Words]:
    """The tokens of every whole text, some rows at a time; ``mark`` picks the bytes to count in each."""
    raw, at = buffers(column)
    for low, high in slices(at, limit, most_rows):
        begin, end = int(at[low]), int(at[high])
        found = []
        cuts = pieces(raw, begin, end, token, limit) if high == low + 1 else [(begin, end)]
        for a, b in cuts:
            part = raw[a:b]
            starts, ends = spans(part, at[low + 1 : high] - a, token)
            row = np.searchsorted(at[low + 1 : high], starts + a, "right").astype(np.int32)
            if mark is None:
                marked = starts[:0]
            else:
                sums = np.concatenate([[0], np.cumsum(mark[part], dtype=np.int64)])
                marked = sums[ends] - sums[starts]
            found.append((row, hashes(part, starts, ends, fold), (ends - starts).astype(np.int32), marked.astype(np.int32)))
        if not found:
            none = np.zeros(0, np.int32)
            found = [(none, np.zeros(0, np.uint64), none, none)]
        yield Words(low, high - low, *(np.concatenate(x) if len(found) > 1 else x[0] for x in zip(*found, strict=True)))


def ngrams(row: np.ndarray, values: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Row and hash of every run of ``n`` tokens inside a row, in order."""
    if len(values) < n:
        return row[:0], values[:0]
    end = len(values) - n + 1
    out = values[:end].copy()
    for k in range(1, n):
        out = mix(out * np.uint64(_PRIME) + values[k : k + end])
    whole = row[:end] == row[n - 1 :]
    return row[:end][whole], out[whole]


def word_sets(found: Words, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct ``n``-word shingles, sorted by row and hash; a shorter text is one shingle, none if empty."""
    row, value = ngrams(found.row, found.hash, n)
    counts = np.bincount(found.row, minlength=found.rows)
    short = np.flatnonzero((counts > 0) & (counts < n))
    if len(short):
        bounds, extra = found.bounds, []
        for r in short:
            h = np.uint64(counts[r])
            for v in found.hash[bounds[r] : bounds[r + 1]]:
                h = mix(np.asarray([h], np.uint64) * np.uint64(_PRIME) + v)[0]
            extra.append(h)
        row, value = np.concatenate([row, short.astype(row.dtype)]), np.concatenate([value, np.asarray(extra, np.uint64)])
    order = np.lexsort((value, row))
    row, value = row[order], value[order]
    if len(row):
        fresh = np.ones(len(row), bool)
        fresh[1:] = (row[1:] != row[:-1]) | (value[1:] != value[:-1])
        row, value = row[fresh], value[fresh]
    return row, value


def sums_by_row(row: np.ndarray, values: np.ndarray, rows: int) -> np.ndarray:
    """Wrapping sum of 64-bit values per row; ``row`` is sorted."""
    total = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values, out=total[1:])
    at = np.searchsorted(row, np.arange(rows + 1))
    return total[at[1:]] - total[at[:-1]]


def lists(values: np.ndarray, bounds: np.ndarray, kind: pa.DataType) -> pa.Array:
    """A list column from flat values and row bounds."""
    return pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), pa.array(values, kind))
