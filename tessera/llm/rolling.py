"""Words and their hashes for whole Arrow batches at once, by numpy on the UTF-8 bytes."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Bytes handled at once; a longer word is handled whole.
CHUNK = 1 << 20
_M = np.uint64


def _odd_inverse(a: int) -> int:
    return pow(a, -1, 1 << 64)


_BASE = 0x9E3779B97F4A7C15 | 1
_TABLE = np.random.default_rng(20240601).integers(1, 1 << 63, 256, dtype=np.uint64) * _M(2) + _M(1)
_powers: dict[str, np.ndarray] = {}


def _grown(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse, modulo 2^64."""
    if not _powers or len(_powers["up"]) < n + 1:
        m = max(CHUNK + 65536, n + 1)
        for name, base in (("up", _BASE), ("down", _odd_inverse(_BASE))):
            p = np.full(m, base, np.uint64)
            p[0] = 1
            _powers[name] = np.multiply.accumulate(p, dtype=np.uint64)
    return _powers["up"], _powers["down"]


def mix(x: np.ndarray) -> np.ndarray:
    """A finaliser that spreads every bit over the 64."""
    x = x ^ (x >> _M(32))
    x = x * _M(0xD6E8FEB86659FD93)
    x = x ^ (x >> _M(32))
    x = x * _M(0xD6E8FEB86659FD93)
    return x ^ (x >> _M(32))


def blank(data: np.ndarray) -> np.ndarray:
    return (data == 32) | ((data >= 9) & (data <= 13))


def spans(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the words of one run of bytes."""
    inside = np.zeros(len(data) + 2, np.int8)
    inside[1:-1] = ~blank(data)
    edge = np.flatnonzero(inside[1:] != inside[:-1])
    return edge[::2], edge[1::2]


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    up, down = _grown(len(data))
    total = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_TABLE[data] * up[: len(data)], out=total[1:], dtype=np.uint64)
    return mix((total[ends] - total[starts]) * down[starts] + (ends - starts).astype(np.uint64))


def _pieces(data: np.ndarray) -> Iterator[tuple[int, int]]:
    """Cuts at white space, about CHUNK bytes apart."""
    at, n = 0, len(data)
    while at < n:
        end = min(at + CHUNK, n)
        if end < n:
            gap = np.flatnonzero(blank(data[at:end]))
            while not len(gap) and end < n:
                further = min(end + CHUNK, n)
                gap = np.flatnonzero(blank(data[end:further])) + (end - at)
                end = further
            if len(gap):
                end = at + int(gap[-1]) + 1 if end - at <= CHUNK else at + int(gap[0]) + 1
        yield at, end
        at = end


def words(data: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and hashes of all words."""
    parts = []
    for a, b in _pieces(data):
        s, e = spans(data[a:b])
        parts.append((s + a, e + a, span_hashes(data[a:b], s, e)))
    if not parts:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64)
    return tuple(np.concatenate(x) for x in zip(*parts, strict=True))


def blocks(column: pa.Array, most: int = CHUNK) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Runs of rows of a string column of about ``most`` bytes: first row, end row, their bytes, and where each
    row starts in them (one more entry than rows). Nulls are empty. A longer row is a run by itself."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string())
    if column.null_count:
        column = column.fill_null("")
    n = len(column)
    if not n:
        return
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + n + 1]
    data = np.frombuffer(column.buffers()[2], np.uint8) if column.buffers()[2] else np.zeros(0, np.uint8)
    first = 0
    while first < n:
        end = max(first + 1, int(np.searchsorted(offsets, offsets[first] + most, "right")) - 1)
        yield first, end, data[offsets[first] : offsets[end]], offsets[first : end + 1] - offsets[first]
        first = end


def rows_of(starts: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """The row in which each start lies."""
    return np.searchsorted(offsets, starts, "right") - 1


def row_words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Words of a run of rows: row, start, end, hash. A word never crosses the end of its row."""
    gapped = data
    at = offsets[:-1]
    if len(offsets) > 2:  # a blank between rows, so that words end there
        gapped = np.insert(data, offsets[1:-1], 32)
        at = offsets[:-1] + np.arange(len(offsets) - 1)
    s, e, h = words(gapped)
    row = np.searchsorted(at, s, "right") - 1
    # rows that are empty share their start with the next one's blank, never with a word
    return row, s - row, e - row, h
